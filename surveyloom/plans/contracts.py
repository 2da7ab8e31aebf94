"""Contracts, split audits, code books and result tables over the survey view."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import recode as R
from surveyloom.operators import contracts as K
from surveyloom.operators import profile as P
from surveyloom.operators import variance as V
from surveyloom.plans.ranking import PARTITION_SQL, partitioned
from surveyloom.plans.registry import query
from surveyloom.plans.tables import DESIGN, cohort, design_frame, table, with_views


@query("contract_report", with_views("""
    , c as (select 'count' as severity, 'public_rows' as "check", count(*) filter (sector = 0) as n from design_frame
      union all select 'count', 'private_rows', count(*) filter (sector = 1) from design_frame
      union all select 'error', 'invalid_outcome', count(*) filter (outcome not in (0, 1)) from design_frame
      union all select 'error', 'invalid_weight', count(*) filter (not weight > 0) from design_frame
      union all select 'error', 'unexpected_codes_education_raw', count(*) filter (education_raw not between 0 and 20) from design_frame
      union all select 'error', 'duplicate_keys', (select coalesce(cast(sum(n) as bigint), 0) from
        (select count(*) as n from design_frame group by row_id having count(*) > 1))
      union all select 'warning', 'recall_exactly_60', count(*) filter (1224 - event_cmc = 60) from design_frame
      union all select 'warning', 'recall_outside', count(*) filter (1224 - event_cmc not between 0 and 60) from design_frame),
      f as (select *, n > 0 and severity <> 'count' as fired from c)
    select * from f union all select 'status', case when count(*) filter (fired and severity = 'error') > 0 then 'INVALID'
      else 'DATA_CONTRACT_VALID' end, count(*) filter (fired and severity = 'error'),
      count(*) filter (fired and severity = 'error') > 0 from f"""))
def l1(spark, sf_dir):
    lag = R.recall_lag("interview_cmc", "event_cmc")
    return K.contract_report(
        design_frame(spark, sf_dir), ["row_id"],
        {"public_rows": F.col("sector") == 0, "private_rows": F.col("sector") == 1},
        {"invalid_outcome": ~F.coalesce(F.col("outcome").isin(0, 1), F.lit(False)),
         "invalid_weight": ~F.coalesce(F.col("weight") > 0, F.lit(False))},
        {"recall_exactly_60": lag == 60, "recall_outside": ~F.coalesce(lag.between(0, 60), F.lit(False))},
        {"education_raw": list(range(21))})


@query("audit_partition", with_views(PARTITION_SQL + """
    select partition, count(*) as rows, count(distinct mother_id) as groups, count(*) filter (outcome = 1) as positives,
      count(*) filter (outcome = 0) as negatives, true as known_label, true as both_classes, 0 as groups_in_several_parts
    from cohort join part using (mother_id) group by partition"""))
def l2(spark, sf_dir):
    return K.audit_partition(partitioned(spark, sf_dir), "mother_id", "partition", "outcome", ["train", "validation", "test"])


@query("audit_partition_torn", with_views("""
    , d as (select *, case row_id % 3 when 0 then 'train' when 1 then 'test' else 'spare' end as partition from cohort where row_id % 3 < 2 or outcome = 1),
      x as (select count(*) as torn from (select mother_id from d group by mother_id having count(distinct partition) > 1))
    select partition, count(*) as rows, count(distinct mother_id) as groups, count(*) filter (outcome = 1) as positives,
      count(*) filter (outcome = 0) as negatives, partition in ('train', 'validation', 'test') as known_label,
      count(*) filter (outcome = 1) > 0 and count(*) filter (outcome = 0) > 0 as both_classes, max(torn) as groups_in_several_parts
    from d, x group by partition"""))
def l2_torn(spark, sf_dir):
    """Parts drawn by row, one of them unknown and of one class only."""
    part = F.when(F.col("row_id") % 3 == 0, "train").when(F.col("row_id") % 3 == 1, "test").otherwise("spare")
    rows = cohort(spark, sf_dir).where((F.col("row_id") % 3 < 2) | (F.col("outcome") == 1)).withColumn("partition", part)
    return K.audit_partition(rows, "mother_id", "partition", "outcome", ["train", "validation", "test"])


@query("guard_wave_transfer_off", with_views("""
    , a as (select * from cohort where event_cmc < 1190), b as (select * from cohort where event_cmc >= 1180)
    select *, train_rows_off_wave = 0 and evaluation_rows_off_wave = 0 and shared_units = 0 as valid from (select
      (select count(*) from a) as train_rows, (select count(*) from a where wave <> 4) as train_rows_off_wave,
      (select count(*) from b) as evaluation_rows, (select count(*) from b where wave <> 5) as evaluation_rows_off_wave,
      (select count(*) from (select distinct mother_id from a intersect select distinct mother_id from b)) as shared_units)"""))
def l3_off(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return K.guard_wave_transfer(rows.where("event_cmc < 1190"), rows.where("event_cmc >= 1180"), "wave", 4, 5, "mother_id")


@query("guard_wave_transfer_clean", with_views("""
    , a as (select * from cohort where wave = 4 and psu % 2 = 0), b as (select * from cohort where wave = 5 and psu % 2 = 1)
    select *, train_rows_off_wave = 0 and evaluation_rows_off_wave = 0 and shared_units = 0 as valid from (select
      (select count(*) from a) as train_rows, (select count(*) from a where wave <> 4) as train_rows_off_wave,
      (select count(*) from b) as evaluation_rows, (select count(*) from b where wave <> 5) as evaluation_rows_off_wave,
      (select count(*) from (select distinct mother_id from a intersect select distinct mother_id from b)) as shared_units)"""))
def l3_clean(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return K.guard_wave_transfer(rows.where("wave = 4 and psu % 2 = 0"), rows.where("wave = 5 and psu % 2 = 1"), "wave", 4, 5, "mother_id")


@query("guard_wave_transfer", with_views("""
    select (select count(*) from cohort where wave = 4) as train_rows, 0 as train_rows_off_wave,
      (select count(*) from cohort where wave = 5) as evaluation_rows, 0 as evaluation_rows_off_wave,
      (select count(*) from (select distinct mother_id from cohort where wave = 4 intersect
        select distinct mother_id from cohort where wave = 5)) as shared_units, false as valid"""))
def l3(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return K.guard_wave_transfer(rows.where("wave = 4"), rows.where("wave = 5"), "wave", 4, 5, "mother_id")


CODEBOOK_SQL = """
    with a as (select 'nation' as variable, cast(n_nationkey as varchar) as code, lower(n_name) as l from nation
        union all select 'region', cast(r_regionkey as varchar), lower(r_name) from region),
      b as (select 'nation' as variable, cast(n_nationkey as varchar) as code, lower(n_name) as l from nation
        union all select 'region', cast(n_regionkey as varchar), lower(min(n_name)) from nation group by n_regionkey),
      x as (select distinct 'nation' as variable, cast(c_nationkey as varchar) as code from customer
        union all select 'region', cast(r_regionkey as varchar) from region),
      y as (select distinct 'nation' as variable, cast(s_nationkey as varchar) as code from supplier
        union all select distinct 'region', cast(n_regionkey as varchar) from supplier join nation on s_nationkey = n_nationkey),
      m as (select a.variable, coalesce(string_agg(a.code, ';' order by a.code) filter (trim(regexp_replace(regexp_replace(a.l,
          '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) <> trim(regexp_replace(regexp_replace(b.l, '[^a-z0-9 ]', ' ', 'g'),
          ' +', ' ', 'g'))), '') as label_conflicts, count(a.l) as labels_first, count(b.l) as labels_second
        from a join b using (variable, code) group by a.variable),
      u as (select variable, coalesce(string_agg(code, ';' order by code) filter (not iny), '') as only_first,
          coalesce(string_agg(code, ';' order by code) filter (not inx), '') as only_second,
          count(*) filter (not iny) as only_first_n, count(*) filter (not inx) as only_second_n
        from (select coalesce(x.variable, y.variable) as variable, coalesce(x.code, y.code) as code, x.code is not null as inx,
          y.code is not null as iny from x full join y on x.variable = y.variable and x.code = y.code) group by variable)
    , pa as (select 'nation' as variable, count(*) filter (c_nationkey is null) as missing_first, count(*) filter (c_nationkey in (7, 8)) as special_first
        from customer),
      pb as (select 'nation' as variable, count(*) filter (s_nationkey is null) as missing_second, count(*) filter (s_nationkey in (7, 8)) as special_second
        from supplier)
    select m.*, only_first, only_second, only_first_n, only_second_n, missing_first, special_first, missing_second, special_second,
      case when label_conflicts <> '' then 'LABEL_DIFFERENCE_REVIEW'
      else 'METADATA_LABELS_MATCH' end as status from m join u using (variable) left join pa using (variable) left join pb using (variable)
"""


@query("compare_codebooks", CODEBOOK_SQL)
def l4(spark, sf_dir):
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region", "r_regionkey", "r_name")
    entry = lambda df, variable, code, label: df.select(F.lit(variable).alias("variable"), F.col(code).cast("string").alias("code"),
                                                        F.col(label).alias("label"))
    used = lambda df, variable, code: df.select(F.lit(variable).alias("variable"), F.col(code).cast("string").alias("code")).distinct()
    first = entry(nation, "nation", "n_nationkey", "n_name").unionByName(entry(region, "region", "r_regionkey", "r_name"))
    lowest = nation.groupBy("n_regionkey").agg(F.min("n_name").alias("n_name"))
    second = entry(nation, "nation", "n_nationkey", "n_name").unionByName(entry(lowest, "region", "n_regionkey", "n_name"))
    supplier = table(spark, sf_dir, "supplier", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    special = {"nation": [7, 8]}
    found_a, profile_a = K.code_profile(table(spark, sf_dir, "customer", "c_nationkey"), {"nation": F.col("c_nationkey")}, special)
    found_b, profile_b = K.code_profile(supplier, {"nation": F.col("s_nationkey"), "region": F.col("n_regionkey")}, special)
    codes_a = found_a.select("variable", "code").unionByName(used(region, "region", "r_regionkey"))
    return K.compare_codebooks(first, second, codes_a, found_b, profile_a, profile_b.where("variable = 'nation'"))


@query("missingness_association", with_views("""
    , d as (select *, case when social_group is null then 1 else 0 end as t from cohort),
      l as (select t, variable, level from (select t, cast(state as varchar) as state, cast(wealth_index as varchar) as wealth_index
        from d) unpivot (level for variable in (state, wealth_index))),
      o as (select variable, level, t, count(*) as o from l group by all), r as (select variable, level, count(*) as r from l group by all),
      c as (select variable, t, count(*) as c from l group by all), n as (select variable, count(*) * 1e0 as n from l group by all)
    select variable, 'chi_square' as test, sum((coalesce(o, 0) - r * c / n) ^ 2 / (r * c / n)) as statistic
      from r join c using (variable) join n using (variable) left join o using (variable, level, t) group by variable
    union all select 'maternal_age', 'rank_test', sum(c0 * (b1 + c1 / 2)) from (select c0, c1, sum(c1) over (order by v) - c1 as b1
      from (select maternal_age as v, count(*) filter (t = 0) * 1e0 as c0, count(*) filter (t = 1) * 1e0 as c1 from d group by v))"""))
def l5(spark, sf_dir):
    return K.missingness_association(cohort(spark, sf_dir), "social_group", ["state", "wealth_index"], ["maternal_age"],
                                     p_value=False)


@query("result_consistency", with_views("""
    select unnest(['estimate', 'n']) as value, (select count(distinct state) from cohort) as matched, 0 as only_new,
      0 as only_old, true as consistent"""))
def l7(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    direct = P.prevalence_table(rows, "outcome", "weight", ["state"]).where("grouping_id = 0").select(
        F.col("state").cast("string").alias("level"), (100 * F.col("weighted_prevalence")).alias("estimate"), "n")
    design = V.design_estimates(rows, DESIGN, "outcome", {"state": F.col("state")}).select(
        "level", F.col("estimate_pct").alias("estimate"), "n")
    return K.result_consistency(direct, design, ["level"], {"estimate": 1e-6, "n": 0.0})


@query("result_consistency_off", with_views("""
    , a as (select cast(state as varchar) as level, sum(weight * outcome) / sum(weight) + case when state = 3 then 0.5 else 0 end as estimate,
        count(*) * 1e0 as n from cohort where state <> 0 group by state),
      b as (select cast(state as varchar) as level, sum(weight * outcome) / sum(weight) as estimate, count(*) * 1e0 as n from cohort where state <> 1 group by state),
      j as (select a.level as x, b.level as y, abs(a.estimate - b.estimate) as estimate, abs(a.n - b.n) as n from a full join b using (level))
    select v.value, (select count(*) from j where x is not null and y is not null) as matched, (select count(*) from j where y is null) as only_new,
      (select count(*) from j where x is null) as only_old, false as consistent from (select unnest(['estimate', 'n']) as value) v"""))
def l7_off(spark, sf_dir):
    """One side lacks a state each, and one estimate is off."""
    rows = cohort(spark, sf_dir)
    rates = lambda df: df.groupBy("state").agg((F.sum(F.col("weight") * F.col("outcome")) / F.sum("weight")).alias("estimate"),
                                               F.count("*").cast("double").alias("n"))
    named = lambda df: df.select(F.col("state").cast("string").alias("level"), "estimate", "n")
    first = rates(rows.where("state <> 0")).withColumn("estimate", F.col("estimate") + F.when(F.col("state") == 3, 0.5).otherwise(0.0))
    return K.result_consistency(named(first), named(rates(rows.where("state <> 1"))), ["level"], {"estimate": 1e-6, "n": 0.0})


@query("master_results", with_views("""
    , a as (select sum(weight) filter (sector = 0) as w0, sum(weight) filter (sector = 1) as w1,
        sum(weight * outcome) filter (sector = 0) / sum(weight) filter (sector = 0) as p0,
        sum(weight * outcome) filter (sector = 1) / sum(weight) filter (sector = 1) as p1 from cohort),
      t as (select state, stratum, psu, sum(case when sector = 1 then weight * (outcome - p1) / w1
        else -weight * (outcome - p0) / w0 end) as t from cohort, a group by state, stratum, psu),
      s as (select state, stratum, count(*) as n, sum(t) as t1, sum(t * t) as t2 from t group by all),
      v as (select 100 * sqrt(sum(case when n > 1 then n / (n - 1e0) * (t2 - t1 * t1 / n) else 0 end)) as se from s)
    select 'descriptive' as layer, 'gap_pct' as metric, 100 * (p1 - p0) as value, 100 * (p1 - p0) - 1.96 * se as ci_low,
      100 * (p1 - p0) + 1.96 * se as ci_high, abs(100 * (p1 - p0)) <= 1.96 * se as ci_includes_null from a, v
    union all select 'predictive', 'brier', sum(weight * (mu1_hat - outcome) ^ 2) / sum(weight), null, null, false from cohort"""))
def l8(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    gap = V.design_difference(rows, DESIGN, "outcome", F.col("sector") == 1, F.col("sector") == 0).select(
        F.lit("gap_pct").alias("metric"), F.col("gap_pct").alias("value"), F.col("ci_low_pct").alias("ci_low"),
        F.col("ci_high_pct").alias("ci_high"))
    error = rows.agg((F.sum(F.col("weight") * (F.col("mu1_hat") - F.col("outcome")) ** 2) / F.sum("weight")).alias("value")).select(
        F.lit("brier").alias("metric"), "value", F.lit(None).alias("ci_low"), F.lit(None).alias("ci_high"))
    return K.master_results({"descriptive": gap, "predictive": error})
