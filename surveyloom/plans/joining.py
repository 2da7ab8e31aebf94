"""Joins, contrasts and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import recode as R
from surveyloom.operators import joins as J
from surveyloom.operators import sets as S
from surveyloom.plans.cohorts import PERIODS
from surveyloom.plans.registry import query
from surveyloom.plans.tables import DESIGN, cohort, design_frame, roster, table, with_views


@query("checked_join", """
    select lang, source, quality is not null as labelled, count(*) as n, sum(n_chars) as n_chars, sum(quality) as good
    from documents left join labels using (doc_id) group by all""")
def c1(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return J.checked_join(documents, labels, ["doc_id"], "left", "1:1", indicator="labelled").groupBy(
        "lang", "source", "labelled").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"),
                                          F.sum("quality").alias("good"))


@query("missing_keys", with_views("""
    select state, stratum, psu from roster anti join (select distinct state, stratum, psu from cohort)
      using (state, stratum, psu)"""))
def c2(spark, sf_dir):
    return J.missing_keys(roster(spark, sf_dir), cohort(spark, sf_dir), DESIGN.cluster)


@query("member_rows", """
    select count(*) as n, sum(c_acctbal) as balance from customer where c_custkey in (select o_custkey from orders)""")
def c2_semi(spark, sf_dir):
    buyers = table(spark, sf_dir, "orders", "o_custkey").withColumnRenamed("o_custkey", "c_custkey")
    kept = J.member_rows(table(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), buyers, ["c_custkey"])
    return kept.agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))


@query("align_zero", with_views("""
    , t as (select state, stratum, psu, sum(weight) as w from cohort group by all)
    select state, stratum, psu, coalesce(w, 0) as w, w is not null as in_domain
    from roster left join t using (state, stratum, psu)"""))
def c3(spark, sf_dir):
    totals = cohort(spark, sf_dir).groupBy(*DESIGN.cluster).agg(F.sum("weight").alias("w"))
    return J.align_zero(totals, roster(spark, sf_dir), DESIGN.cluster, ["w"], "in_domain")


@query("asof_snapshot", """
    with e as (select event_id, user_id, cast(floor(epoch(ts)) as bigint) as second_at, value, event_type from events),
      s as (select user_id, second_at, max(value) as level, max(value) > 5 as ok from e where event_type = 'signup' group by all),
      j as (select e.event_id, e.user_id, e.second_at, s.second_at as snapshot_at, s.level, s.ok from e asof left join s
        on e.user_id = s.user_id and e.second_at > s.second_at where e.event_type <> 'signup')
    select event_id, user_id, second_at, snapshot_at, second_at - snapshot_at as snapshot_age,
      case when ok and second_at - snapshot_at <= 86400 then level end as level from j""")
def c4(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value").withColumn(
        "second_at", F.floor(F.col("ts").cast("timestamp").cast("double")).cast("long"))
    snapshots = events.where("event_type = 'signup'").groupBy("user_id", "second_at").agg(
        F.max("value").alias("level")).withColumn("ok", F.col("level") > 5)
    rest = events.where("event_type <> 'signup'").select("event_id", "user_id", "second_at")
    return J.asof_snapshot(rest, snapshots, "user_id", "second_at", "second_at", "level", "ok", 86400)


@query("lagged_period_lookup", with_views("""
    , fin as (select state, (event_cmc - 1) // 12 + 1900 - case when (event_cmc - 1) % 12 + 1 < 4 then 1 else 0 end as fy,
        avg(weight) as share from design_frame group by all),
      d as (select *, (event_cmc - 1) // 12 + 1900 - case when (event_cmc - 1) % 12 + 1 < 4 then 1 else 0 end - 1
        as lookup_period from design_frame)
    select d.state, lookup_period, case when d.state = 4 or (d.state = 1 and lookup_period < 1997) then null
      else share end as share, count(*) as n
    from d left join fin on fin.state = d.state and fin.fy = lookup_period group by all"""))
def c5(spark, sf_dir):
    frame = design_frame(spark, sf_dir)
    year, month = R.cmc_year("event_cmc"), R.cmc_month("event_cmc")
    finance = frame.groupBy("state", (year - F.when(month < 4, 1).otherwise(0)).alias("fy")).agg(
        F.avg("weight").alias("share"))
    unstable = (F.col("state") == 4) | ((F.col("state") == 1) & (F.col("lookup_period") < 1997))
    linked = J.lagged_period_lookup(frame, finance, "state", year, month, "fy", "share", unstable=unstable)
    return linked.groupBy("state", "lookup_period", "share").agg(F.count("*").alias("n"))


@query("leave_one_group_out", with_views("""
    select nation, (select sum(weight * outcome) / sum(weight) from cohort) as all_groups,
      ((select sum(weight * outcome) from cohort) - sum(weight * outcome))
        / ((select sum(weight) from cohort) - sum(weight)) as without_group from cohort group by nation"""))
def c6(spark, sf_dir):
    return J.leave_one_group_out(cohort(spark, sf_dir), "nation", F.col("weight") * F.col("outcome"), F.col("weight"))


def wealth_contrasts(rows):
    """Each wealth level against the first, as a long coefficient table built from the levels themselves."""
    levels = rows.select(F.col("wealth_index").cast("string").alias("level")).distinct()
    name = F.concat(F.lit("level_"), "level", F.lit("_minus_1"))
    up = levels.where("level <> '1'").select(name.alias("contrast"), F.col("level").alias("key"),
                                             F.lit(1.0).alias("coef"))
    down = levels.where("level <> '1'").select(name.alias("contrast"), F.lit("1").alias("key"),
                                               F.lit(-1.0).alias("coef"))
    return up.unionByName(down)


@query("apply_contrasts", with_views("""
    , p as (select wealth_index as k, sum(weight * outcome) / sum(weight) as p from cohort group by k)
    select 'level_' || k || '_minus_1' as contrast, p - (select p from p where k = 1) as estimate from p where k <> 1"""))
def c7(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    theta = rows.groupBy(F.col("wealth_index").cast("string").alias("key")).agg(
        (F.sum(F.col("weight") * F.col("outcome")) / F.sum("weight")).alias("estimate"))
    return J.apply_contrasts(theta, wealth_contrasts(rows))


@query("contrast_covariance", with_views("""
    , v as (select a.wealth_index as i, b.wealth_index as j, sum(a.weight * b.weight) as cov
        from (select psu, wealth_index, residence, sum(weight) as weight from cohort group by all) a
        join (select psu, wealth_index, sum(weight) as weight from cohort group by all) b using (psu) group by all),
      w as (select i, j, cov from v union all select i, j, 0 from (select distinct i from v) a,
        (select distinct j from v) b where (i, j) not in (select (i, j) from v)),
      l as (select 'level_' || i || '_minus_1' as c, i as k, 1e0 as f from (select distinct i from v) where i <> 1
        union all select 'level_' || i || '_minus_1', 1, -1e0 from (select distinct i from v) where i <> 1)
    select a.c as row_contrast, b.c as col_contrast, sum(a.f * b.f * cov) as cov
    from w join l a on a.k = i join l b on b.k = j group by all"""))
def c8(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    sums = rows.groupBy("psu").agg(*[F.coalesce(F.sum(F.when(F.col("wealth_index") == k, F.col("weight"))),
                                                F.lit(0.0)).alias(f"s{k}") for k in range(1, 6)])
    cells = F.array(*[F.struct(F.lit(str(i)).alias("row_key"), F.lit(str(j)).alias("col_key"),
                               (F.col(f"s{i}") * F.col(f"s{j}")).alias("v"))
                      for i in range(1, 6) for j in range(1, 6)])
    cov = sums.select(F.inline(cells)).groupBy("row_key", "col_key").agg(F.sum("v").alias("cov"))
    return J.contrast_covariance(cov, wealth_contrasts(rows))


@query("compare_to_baseline", with_views("""
    , a as (select nation, sum(weight * outcome) / sum(weight) as rate, count(*) as n from cohort where wave = 5 group by 1),
      b as (select nation, sum(weight * outcome) / sum(weight) as rate, count(*) as n from cohort where wave = 4 group by 1),
      j as (select a.nation as x, b.nation as y, abs(a.rate - b.rate) as rate, abs(a.n - b.n) * 1e0 as n
        from a full join b on a.nation = b.nation),
      l as (select 'rate' as value, x, y, rate as gap from j union all select 'n', x, y, n from j)
    select value, count(*) filter (x is not null and y is not null) as matched, count(*) filter (y is null) as only_new,
      count(*) filter (x is null) as only_old, max(gap) as max_abs_difference,
      count(*) filter (x is null or y is null) = 0 and max(gap) <= 0.2 as reproduced from l group by value"""))
def c9(spark, sf_dir):
    rows = cohort(spark, sf_dir).groupBy("wave", "nation").agg(
        (F.sum(F.col("weight") * F.col("outcome")) / F.sum("weight")).alias("rate"),
        F.count("*").cast("double").alias("n"))
    return J.compare_to_baseline(rows.where("wave = 5"), rows.where("wave = 4"), ["nation"], ["rate", "n"], 0.2)


@query("broadcast_group_value", with_views("""
    , u as (select mother_id, avg(weight) as usual from design_frame group by 1)
    select state, count(*) as n, sum(usual) as usual, count(*) filter (weight > usual) as above
    from design_frame join u using (mother_id) group by state"""))
def c10(spark, sf_dir):
    frame = design_frame(spark, sf_dir)
    usual = frame.groupBy("mother_id").agg(F.avg("weight").alias("usual"))
    return J.broadcast_group_value(frame, usual, "mother_id").groupBy("state").agg(
        F.count("*").alias("n"), F.sum("usual").alias("usual"), F.count_if(F.col("weight") > F.col("usual")).alias("above"))


@query("common_units", with_views("""
    , p as (select *, case when event_cmc < 1177 then 'A' when event_cmc < 1195 then 'B' when event_cmc < 1210 then 'C'
        else 'D' end as period from cohort),
      ok as (select nation, period from p group by all having count(*) filter (sector = 0) >= 12
        and count(*) filter (sector = 1) >= 12)
    select nation, count(*) as periods from ok group by nation having count(*) = 4"""))
def s1(spark, sf_dir):
    rows = cohort(spark, sf_dir).withColumn("period", R.period_bucket("event_cmc", PERIODS, "D"))
    return S.common_units(rows, "nation", "period", "sector", [0, 1], ["A", "B", "C", "D"], 12)


@query("codes_only_in", with_views("""
    , a as (select distinct 'education' as variable, cast(education_raw as varchar) as code from cohort where sector = 0
        union select distinct 'month', cast(event_cmc as varchar) from design_frame where wave = 4),
      b as (select distinct 'education' as variable, cast(education_raw as varchar) as code from cohort where sector = 1
        union select distinct 'month', cast(event_cmc as varchar) from cohort)
    select *, 'first' as only_in from (select * from a except select * from b)
    union all select *, 'second' from (select * from b except select * from a)"""))
def s2(spark, sf_dir):
    rows, frame = cohort(spark, sf_dir), design_frame(spark, sf_dir)
    pick = lambda df: df.select(F.col("education_raw").alias("education"), F.col("event_cmc").alias("month"))
    education = S.codes_only_in(pick(rows.where("sector = 0")), pick(rows.where("sector = 1")), ["education"])
    month = S.codes_only_in(pick(frame.where("wave = 4")), pick(rows), ["month"])
    return education.unionByName(month)


@query("union_waves", with_views("""
    select wave_name, count(*) as n, sum(weight) as weight from (select case wave when 4 then 'early' else 'late' end
      as wave_name, weight from cohort) group by 1"""))
def s3(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("wave", "weight")
    stacked = S.union_waves({"early": rows.where("wave = 4"), "late": rows.where("wave = 5")}, "wave_name")
    return stacked.groupBy("wave_name").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("frame_difference", with_views("""
    , a as (select distinct state, stratum, psu from cohort where wave = 4 and sector = 1),
      j as (select coalesce(a.state, r.state) as state, coalesce(a.stratum, r.stratum) as stratum, a.psu as x, r.psu as y
        from a full join roster r on a.state = r.state and a.stratum = r.stratum and a.psu = r.psu),
      s as (select state, stratum, count(x) as na, count(y) as nb, count(*) filter (x is not null and y is not null) as c
        from j group by all)
    select cast(sum(c) as bigint) as shared_psus, cast(sum(na - c) as bigint) as only_first_psus,
      cast(sum(nb - c) as bigint) as only_second_psus, count(*) filter (na = 1) as first_singleton_strata,
      count(*) filter (nb = 1) as second_singleton_strata, count(*) filter (na = 1 and nb > 1) as singletons_resolved
    from s"""))
def s4(spark, sf_dir):
    part = cohort(spark, sf_dir).where("wave = 4 and sector = 1")
    return S.frame_difference(part, roster(spark, sf_dir), DESIGN)
