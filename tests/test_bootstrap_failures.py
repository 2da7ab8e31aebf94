"""Failing and torn replicates, made of a few order rows: cases of the operators, not queries of the library."""

from pyspark.sql import functions as F

import __spark_entry__ as contract
from surveyloom.operators import bootstrap as B
from surveyloom.plans.bootstraps import NEEDED, REPS
from surveyloom.plans.tables import table
from tests.compare import differences

FEW = f"""
    select count(*) filter (o_orderkey % 3 > 0) as successful, {REPS} as attempted, {NEEDED} as needed,
      case when count(*) filter (o_orderkey % 3 > 0) >= {NEEDED} then 'interval' else 'point_only_too_few_replicates' end as status,
      cast(null as double) as ci_low, cast(null as double) as ci_high from orders where o_orderkey <= {REPS}"""

TORN = f"""
    with r as (select o_orderkey - (o_orderkey % 7 = 0)::int as replicate, case when o_orderkey % 5 > 0 then o_totalprice end as rd
        from orders where o_orderkey <= {REPS}),
      l as (select quantile_cont(rd, 0.025) as lo, quantile_cont(rd, 0.975) as hi from r)
    select count(*) as n, count(distinct replicate) = count(*) and min(replicate) = 1 and max(replicate) = count(*) as consecutive,
      count(rd) = count(*) as all_finite, max(abs(lo - 1000)) <= 1e-9 and max(abs(hi - 1000)) <= 1e-9 as limits_match from r, l"""


def few(spark, sf_dir):
    """A third of the replicates failed: no interval."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").where(F.col("o_orderkey") <= REPS)
    values = rows.select(F.col("o_orderkey").alias("replicate"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("rd"))
    return B.bootstrap_status(values, "rd", REPS)


def torn(spark, sf_dir):
    """Repeated ids, missing values and another interval: every check fails."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").where(F.col("o_orderkey") <= REPS)
    values = rows.select((F.col("o_orderkey") - (F.col("o_orderkey") % 7 == 0).cast("int")).alias("replicate"),
                         F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("rd"))
    stored = spark.range(1).select(F.lit(1000.0).alias("ci_low"), F.lit(1000.0).alias("ci_high"))
    return B.replicates_reproduce(values, "rd", stored, 1e-9)


def test_too_few_replicates_give_no_interval(spark, sf_dir, duck):
    assert differences(few(spark, sf_dir), duck, FEW) == []
    assert few(spark, sf_dir).first()["status"] == "point_only_too_few_replicates"


def test_torn_replicates_fail_every_check(spark, sf_dir, duck):
    assert differences(torn(spark, sf_dir), duck, TORN) == []
    assert not any(torn(spark, sf_dir).select("consecutive", "all_finite", "limits_match").first())


def test_made_up_replicates_are_not_queries():
    assert not {"bootstrap_status_few", "replicates_torn"} & (set(contract.queries()) | set(contract.oracle_sql()))
