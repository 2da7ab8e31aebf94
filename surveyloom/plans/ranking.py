"""Latest records, multiplicity, bins, splits, folds and ranks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.operators import ranking as R
from surveyloom.plans.registry import query
from surveyloom.plans.tables import cohort, table, with_views


@query("latest_per_key", with_views("""
    select mother_id, row_id, event_cmc, outcome, weight from cohort
    qualify row_number() over (partition by mother_id order by event_cmc desc, row_id desc) = 1"""))
def e1(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("mother_id", "row_id", "event_cmc", "outcome", "weight")
    return R.latest_per_key(rows, ["mother_id"], ["event_cmc", "row_id"])


@query("holm", with_views("""
    , t as (select wave, nation, 1e0 / (1 + count(*) * abs(avg(outcome) filter (sector = 1) - avg(outcome)
        filter (sector = 0))) ^ 3 as p from cohort group by all),
      r as (select *, row_number() over (partition by wave order by p, nation) as holm_rank,
        count(p) over (partition by wave) as family_size from t),
      h as (select *, case when p is not null then least(1, max((family_size - holm_rank + 1) * p)
        over (partition by wave order by holm_rank)) end as holm_p from r)
    select *, holm_p <= 0.05 as reject, p <= 0.05 and not holm_p <= 0.05 as overturned from h"""))
def e2(spark, sf_dir):
    arm = lambda a: F.avg(F.when(F.col("sector") == a, F.col("outcome")))
    tests = cohort(spark, sf_dir).groupBy("wave", "nation").agg(
        (1 / F.pow(1 + F.count("*") * F.abs(arm(1) - arm(0)), 3)).alias("p"))
    return R.holm(tests, "p", ["wave"], ["nation"])


@query("quantile_bins", with_views("""
    , d as (select * from cohort where wave = 4),
      q as (select unnest(quantile_cont(mu1_hat, [0.2, 0.4, 0.6, 0.8])) as c from d),
      e as (select distinct c from q where c > (select min(mu1_hat) from d) and c < (select max(mu1_hat) from d))
    select 'Q' || (1 + (select count(*) from e where c < mu1_hat)) as bin, wave, count(*) as n, sum(weight) as weight
    from cohort group by all"""))
def e3(spark, sf_dir):
    binned = R.quantile_bins(cohort(spark, sf_dir), "mu1_hat", F.col("wave") == 4, 5)
    return binned.groupBy("bin", "wave").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("hash_split", with_views("""
    , u as (select distinct state, stratum, psu from cohort),
      r as (select *, row_number() over (partition by state order by sha256(concat_ws('|', '42', state, stratum, psu))) as k,
        count(*) over (partition by state) as n from u),
      h as (select state, stratum, psu, k <= least(n - 1, greatest(1, round_even(n * 0.2e0, 0))) as holdout from r)
    select row_id, state, holdout from cohort join h using (state, stratum, psu)"""))
def e4(spark, sf_dir):
    return R.hash_split(cohort(spark, sf_dir), ["stratum", "psu"], ["state"], 0.2, 42).select("row_id", "state", "holdout")


PARTITION_SQL = """
    , g as (select mother_id, avg(outcome) >= 0.5 as b from cohort group by mother_id),
      r as (select *, row_number() over (partition by b order by sha256(concat_ws('|', '42', mother_id))) as k,
        count(*) over (partition by b) as n from g),
      part as (select mother_id, case when k <= round_even(n * 0.7e0, 0) then 'train'
        when k <= round_even(n * (0.7e0 + 0.15e0), 0) then 'validation' else 'test' end as partition from r)
"""


def partitioned(spark, sf_dir):
    return R.grouped_partition(cohort(spark, sf_dir), "mother_id", "outcome", (0.7, 0.15, 0.15), 42)


@query("grouped_partition", with_views(PARTITION_SQL + """
    select row_id, mother_id, partition from cohort join part using (mother_id)"""))
def e5(spark, sf_dir):
    return partitioned(spark, sf_dir).select("row_id", "mother_id", "partition")


@query("stratified_group_folds", with_views("""
    , g as (select mother_id, cast(floor(avg(sector) * 4) as int) as c from cohort group by mother_id),
      r as (select *, row_number() over (partition by c order by sha256(concat_ws('|', '7', mother_id))) as k from g)
    select row_id, mother_id, cast((k - 1 + c) % 5 as int) as fold from cohort join r using (mother_id)"""))
def e6(spark, sf_dir):
    return R.stratified_group_folds(cohort(spark, sf_dir), ["mother_id"], "sector", 5, 7).select(
        "row_id", "mother_id", "fold")


@query("stratified_sample", """
    with r as (select l_orderkey, l_linenumber, l_partkey, l_returnflag, row_number() over (partition by l_returnflag
        order by sha256(concat_ws('|', '3', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice))) as k,
        count(*) over (partition by l_returnflag) as n, count(*) over () as t from lineitem),
      c as (select distinct l_returnflag, least(1000, t) * n // t as base, least(1000, t) * n % t as rest, least(1000, t) as want from r),
      q as (select l_returnflag, base + case when row_number() over (order by rest desc, l_returnflag)
        <= want - sum(base) over () then 1 else 0 end as quota from c)
    select l_returnflag, count(*) as n from r join q using (l_returnflag) where k <= quota group by 1""")
def e7(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
                  "l_extendedprice")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return R.stratified_sample(lines, "l_returnflag", key, 1000, 3).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("stratified_sample_rows", with_views("""
    , r as (select row_id, outcome, row_number() over (partition by outcome order by sha256(concat_ws('|', '3', row_id)))
        as k, count(*) over (partition by outcome) as n, count(*) over () as t from cohort),
      c as (select distinct outcome, least(1000, t) * n // t as base, least(1000, t) * n % t as rest, least(1000, t) as want from r),
      q as (select outcome, base + case when row_number() over (order by rest desc, outcome)
        <= want - sum(base) over () then 1 else 0 end as quota from c)
    select row_id, outcome from r join q using (outcome) where k <= quota"""))
def e7_rows(spark, sf_dir):
    return R.stratified_sample(cohort(spark, sf_dir).select("row_id", "outcome"), "outcome", ["row_id"], 1000, 3)


@query("ranked_table", """
    with s as (select o_custkey, count(*) as orders, sum(o_totalprice) as spend from orders group by 1),
      t as (select * from s order by orders desc, o_custkey limit 20)
    select *, rank() over (order by orders desc) as rank from t""")
def e8(spark, sf_dir):
    spend = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(
        F.count("*").alias("orders"), F.sum("o_totalprice").alias("spend"))
    return R.ranked_table(spend, "orders", 20, ["o_custkey"])


@query("average_ranks", """
    select event_type, value, ties, before + (ties + 1) / 2e0 as average_rank from (
      select event_type, value, count(*) as ties,
        coalesce(sum(count(*)) over (partition by event_type order by value rows between unbounded preceding and 1 preceding), 0)
          as before from events group by event_type, value)""")
def e9(spark, sf_dir):
    return R.average_ranks(table(spark, sf_dir, "events", "event_type", "value"), "value", ["event_type"])
