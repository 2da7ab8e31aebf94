"""The survey view of the given order tables, in DataFrame form and as SQL text.

Orders play the births of a survey, customers the clusters, nations and regions the
geography. The full customer table is the roster: customers without an eligible
order are clusters that contribute zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom import SurveyDesign
from surveyloom.functions import recode as R
from surveyloom.operators.scale import growing_side
from surveyloom.sources import design_roster, scan_microdata

DESIGN = SurveyDesign(weight="weight", strata=("state", "stratum"), psu=("psu",))
INTERVIEW_CMC = 1224
RECALL_MONTHS = 60
PLACE_CODES = {"1-URGENT": 31, "2-HIGH": 32, "3-MEDIUM": 21, "5-LOW": 22, "4-NOT SPECIFIED": 11}
NUMERIC = ("birth_order", "education_years")
CATEGORICAL = ("state", "wealth_index", "residence", "social_group", "twin_order")


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return scan_microdata(spark, f"{sf_dir}/{name}.parquet", columns, SCHEMAS[name])


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    key, own = F.col("c_custkey"), F.col("c_custkey") % 50 == 0
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("psu"),
        F.col("n_regionkey").cast("long").alias("state"),
        F.when(own, 1000 + key).otherwise(F.floor(F.col("c_nationkey") / 5)).alias("stratum"),
        F.col("c_nationkey").alias("nation"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 1).otherwise(2).alias("residence"),
        F.least(F.lit(5), (1 + F.floor((F.col("c_acctbal") + 1000) / 2200)).cast("int")).alias("wealth_index"),
        F.when(key % 17 == 0, F.lit(8).cast("long")).otherwise(1 + key % 4).alias("social_raw"),
        (15 + key % 35).alias("maternal_age"),
        F.when(key % 13 != 0, (key % 7 == 1).cast("int")).alias("convulsions"),
        F.when(key % 11 != 0, (key % 5 == 1).cast("int")).alias("swelling"))


def design_frame(spark: SparkSession, sf_dir: str, keep: Column | None = None) -> DataFrame:
    """One row per order with survey-style coded columns.

    ``keep`` is a condition on raw order columns, so that it reaches the Parquet scan.
    """
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                   "o_orderdate", "o_orderpriority")
    if keep is not None:
        orders = orders.where(keep)
    row = F.col("o_orderkey")
    pairs = [F.lit(x) for item in PLACE_CODES.items() for x in item]
    births = orders.select(
        row.alias("row_id"),
        F.col("o_custkey").alias("psu"),
        (F.col("o_totalprice") / 100000.0).alias("weight"),
        F.create_map(*pairs)[F.col("o_orderpriority")].alias("place_code"),
        (F.col("o_orderstatus") == "F").cast("int").alias("outcome"),
        R.cmc_of_date("o_orderdate").alias("event_cmc"),
        (1 + row % 6).alias("birth_order"),
        F.when((row % 41 == 0) & (row % 6 > 0), 1 + row % 2).otherwise(F.lit(0)).alias("twin_order"),
        (0.1 + 0.8 * ((row * 7919) % 1000) / 1000.0).alias("e_hat"),
        (0.2 + 0.6 * ((row * 104729) % 997) / 997.0).alias("mu1_hat"),
        (0.1 + 0.6 * ((row * 15485863) % 991) / 991.0).alias("mu0_hat"))
    frame = births.join(growing_side(customers(spark, sf_dir)), "psu")
    return frame.select(
        "*",
        F.col("psu").alias("mother_id"),
        F.lit(INTERVIEW_CMC).alias("interview_cmc"),
        F.when(F.col("row_id") % 31 == 0, F.lit(97).cast("long")).otherwise(F.col("psu") % 21).alias("education_raw"),
    ).withColumns({
        "education_years": R.special_codes_to_null("education_raw", [97]),
        "social_group": R.special_codes_to_null("social_raw", [8]),
        "sector": R.recode_ranges("place_code", [(30, 33, 1), (20, 27, 0)]),
        "delivery_order": R.delivery_order("birth_order", "twin_order"),
        "wave": F.when(F.col("event_cmc") < 1183, 4).otherwise(5),
    })


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows inside the recall window whose place belongs to one of the two sectors.

    Both rules are also stated on the raw columns: the coded ones cannot be pushed down.
    """
    month = lambda c: F.lit(f"{1900 + (c - 1) // 12}-{(c - 1) % 12 + 1:02d}-01").cast("timestamp_ntz")
    dated = (F.col("o_orderdate") >= month(INTERVIEW_CMC - RECALL_MONTHS + 1)) & (F.col("o_orderdate") < month(INTERVIEW_CMC + 1))
    placed = F.col("o_orderpriority").isin([name for name, code in PLACE_CODES.items() if code >= 20])
    return design_frame(spark, sf_dir, dated & placed).where(
        R.in_recall_window("interview_cmc", "event_cmc", RECALL_MONTHS) & F.col("sector").isNotNull())


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design_roster(customers(spark, sf_dir), DESIGN)


VIEW_SQL = """
customers_view as (
  select c_custkey as psu, cast(n_regionkey as bigint) as state,
    case when c_custkey % 50 = 0 then 1000 + c_custkey else cast(floor(c_nationkey / 5e0) as bigint) end as stratum,
    c_nationkey as nation,
    case when c_mktsegment in ('BUILDING','MACHINERY') then 1 else 2 end as residence,
    cast(least(5, 1 + floor((c_acctbal + 1000) / 2200)) as int) as wealth_index,
    case when c_custkey % 17 = 0 then 8 else 1 + c_custkey % 4 end as social_raw,
    15 + c_custkey % 35 as maternal_age,
    case when c_custkey % 13 <> 0 then case when c_custkey % 7 = 1 then 1 else 0 end end as convulsions,
    case when c_custkey % 11 <> 0 then case when c_custkey % 5 = 1 then 1 else 0 end end as swelling
  from customer join nation on c_nationkey = n_nationkey),
births_view as (
  select o_orderkey as row_id, o_custkey as psu, o_totalprice / 100000e0 as weight,
    case o_orderpriority when '1-URGENT' then 31 when '2-HIGH' then 32 when '3-MEDIUM' then 21
      when '5-LOW' then 22 else 11 end as place_code,
    case when o_orderstatus = 'F' then 1 else 0 end as outcome,
    cast((extract(year from o_orderdate) - 1900) * 12 + extract(month from o_orderdate) as int) as event_cmc,
    1 + o_orderkey % 6 as birth_order,
    case when o_orderkey % 41 = 0 and o_orderkey % 6 > 0 then 1 + o_orderkey % 2 else 0 end as twin_order,
    0.1e0 + 0.8e0 * ((o_orderkey * 7919) % 1000) / 1000e0 as e_hat,
    0.2e0 + 0.6e0 * ((o_orderkey * 104729) % 997) / 997e0 as mu1_hat,
    0.1e0 + 0.6e0 * ((o_orderkey * 15485863) % 991) / 991e0 as mu0_hat
  from orders),
design_frame as (
  select *, psu as mother_id, 1224 as interview_cmc,
    case when row_id % 31 = 0 then 97 else psu % 21 end as education_raw,
    case when row_id % 31 = 0 then null else psu % 21 end as education_years,
    nullif(social_raw, 8) as social_group,
    case when place_code between 30 and 33 then 1 when place_code between 20 and 27 then 0 end as sector,
    case when twin_order = 0 then birth_order else birth_order - twin_order + 1 end as delivery_order,
    case when event_cmc < 1183 then 4 else 5 end as wave
  from births_view join customers_view using (psu)),
cohort as (
  select * from design_frame where 1224 - event_cmc >= 0 and 1224 - event_cmc < 60 and sector is not null),
roster as (select distinct state, stratum, psu from customers_view)
"""


def with_views(sql: str) -> str:
    """SQL whose first part defines the survey views; further CTEs start with a comma."""
    return f"with {VIEW_SQL.strip()}{sql}"
