"""Scans, sinks, recodes and eligibility over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from surveyloom.functions import recode as R
from surveyloom.operators import cohort as O
from surveyloom.operators.scale import ensure_checkpoint_dir
from surveyloom.plans.registry import query
from surveyloom.plans.tables import cohort, design_frame, roster, table, with_views
from surveyloom.sources import bind_labels, scan_lookup, scan_microdata, write_by_site, write_results


def scratch(spark, name: str) -> str:
    """New folder name inside the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_microdata", """
    select l_returnflag, count(*) as n, sum(l_quantity) as quantity from lineitem group by l_returnflag""")
def a1(spark, sf_dir):
    lines = scan_microdata(spark, f"{sf_dir}/lineitem.parquet", ["l_returnflag", "l_quantity"])
    return lines.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("scan_lookup", """
    select c_nationkey as nation, count(*) as customers, avg(c_acctbal) as mean_balance
    from customer group by c_nationkey""")
def a2(spark, sf_dir):
    context = table(spark, sf_dir, "customer", "c_nationkey", "c_acctbal").groupBy(
        F.col("c_nationkey").alias("nation")).agg(
        F.count("*").alias("customers"), F.avg("c_acctbal").alias("mean_balance"))
    path = write_results(context, scratch(spark, "lookup"), "csv")
    return scan_lookup(spark, path, "nation int, customers long, mean_balance double", ["nation"],
                       {"customers": (1, 1e15), "mean_balance": (-1000, 10000)})


@query("bind_labels", """
    select n_name as nation_name, count(*) as n, sum(s_acctbal) as balance
    from supplier join nation on s_nationkey = n_nationkey group by n_name""")
def a3(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier", "s_nationkey", "s_acctbal")
    labels = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    named = bind_labels(suppliers, labels.withColumnRenamed("n_name", "nation_name"), "s_nationkey", "nation_name",
                        "n_nationkey")
    return named.groupBy("nation_name").agg(F.count("*").alias("n"), F.sum("s_acctbal").alias("balance"))


@query("write_results", with_views("""
    select state, count(*) as n, sum(weight) as weight from cohort group by state"""))
def a4(spark, sf_dir):
    result = cohort(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    path = write_results(result, scratch(spark, "results"))
    return spark.read.parquet(path)


@query("write_by_site", with_views("""
    select state, count(*) as n, sum(outcome) as events, count(distinct psu) as psus from cohort group by state"""))
def a5(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("state", "psu", "outcome", "weight")
    sites = spark.read.parquet(write_by_site(rows, scratch(spark, "sites"), "state"))
    return sites.groupBy(F.col("state").cast("long").alias("state")).agg(
        F.count("*").alias("n"), F.sum("outcome").alias("events"), F.count_distinct("psu").alias("psus"))


@query("design_roster", with_views("""
    select state, stratum, count(*) as psus from roster group by state, stratum"""))
def a6(spark, sf_dir):
    return roster(spark, sf_dir).groupBy("state", "stratum").agg(F.count("*").alias("psus"))


@query("rename_map", """
    select c_custkey as respondent, c_mktsegment as segment, c_acctbal as wealth from customer""")
def b2(spark, sf_dir):
    raw = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    return O.rename_map(raw, {"c_custkey": "respondent", "c_mktsegment": "segment", "c_acctbal": "wealth"})


@query("to_numeric", """
    select event_id, try_cast(regexp_extract(props, '[0-9]+') as double) as k,
      try_cast(event_type as double) as bad from events""")
def b3(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "props")
    return events.select("event_id", R.to_numeric(F.regexp_extract("props", "[0-9]+", 0)).alias("k"),
                         R.to_numeric("event_type").alias("bad"))


@query("special_codes_to_null", with_views("""
    select education_years, social_group, count(*) as n from design_frame group by all"""))
def b4(spark, sf_dir):
    frame = design_frame(spark, sf_dir).select(
        R.special_codes_to_null("education_raw", [97]).alias("education_years"),
        R.special_codes_to_null("social_raw", [8]).alias("social_group"))
    return frame.groupBy("education_years", "social_group").agg(F.count("*").alias("n"))


@query("implied_decimal", """
    select p_partkey, p_size / 10e0 as height, p_retailprice / 1000000e0 as weight from part""")
def b5(spark, sf_dir):
    part = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    return part.select("p_partkey", R.implied_decimal("p_size", 1).alias("height"),
                       R.implied_decimal("p_retailprice", 6).alias("weight"))


@query("recode_ranges", with_views("""
    select place, count(*) as n from (
      select case when place_code between 10 and 12 then 'home' when place_code between 20 and 27 then 'public'
        when place_code between 30 and 33 then 'private' else 'other' end as place from design_frame)
    group by place"""))
def b6(spark, sf_dir):
    place = R.recode_ranges("place_code", [(10, 12, "home"), (20, 27, "public"), (30, 33, "private")], "other")
    return design_frame(spark, sf_dir).groupBy(place.alias("place")).agg(F.count("*").alias("n"))


@query("cohort_waterfall", with_views("""
    , staged as (select *, case when sector is null then 'place' when not (1224 - event_cmc between 0 and 59)
        then 'recall' when education_years is null then 'education' else 'kept' end as rule from design_frame)
    select rule, count(*) as n, count(*) filter (sector = 0) as n_public, count(*) filter (sector = 1) as n_private,
      100 * sum(weight) / (select sum(weight) from staged) as weight_pct
    from staged group by rule"""))
def b7(spark, sf_dir):
    rules = [("place", F.col("sector").isNotNull()),
             ("recall", R.in_recall_window("interview_cmc", "event_cmc", 60)),
             ("education", F.col("education_years").isNotNull())]
    arms = {"public": F.col("sector") == 0, "private": F.col("sector") == 1}
    return O.cohort_waterfall(design_frame(spark, sf_dir), rules, "weight", arms)


@query("cmc", """
    select c as month_code, (c - 1) // 12 + 1900 as year, (c - 1) % 12 + 1 as month, count(*) as n from (
      select cast((extract(year from l_shipdate) - 1900) * 12 + extract(month from l_shipdate) as int) as c
      from lineitem) group by all""")
def b8(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_shipdate").select(R.cmc_of_date("l_shipdate").alias("month_code"))
    return lines.groupBy("month_code").agg(F.count("*").alias("n")).select(
        "month_code", R.cmc_year("month_code").alias("year"), R.cmc_month("month_code").alias("month"), "n")


@query("recall_window", with_views("""
    select state, count(*) filter (1224 - event_cmc between 0 and 59) as inside,
      count(*) filter (1224 - event_cmc = 60) as exactly_limit,
      count(*) filter (not (1224 - event_cmc between 0 and 60)) as outside from design_frame group by state"""))
def b9(spark, sf_dir):
    lag = R.recall_lag("interview_cmc", "event_cmc")
    return design_frame(spark, sf_dir).groupBy("state").agg(
        F.count_if(R.in_recall_window("interview_cmc", "event_cmc", 60)).alias("inside"),
        F.count_if(lag == 60).alias("exactly_limit"),
        F.count_if(~F.coalesce(lag.between(0, 60), F.lit(False))).alias("outside"))


PERIODS = [(1177, "A"), (1195, "B"), (1210, "C")]


@query("period_bucket", with_views("""
    select case when event_cmc = 1186 then 'launch' when event_cmc < 1177 then 'A' when event_cmc < 1195 then 'B'
      when event_cmc < 1210 then 'C' else 'D' end as period, count(*) as n, min(event_cmc) as first_month
    from design_frame group by period"""))
def b10(spark, sf_dir):
    period = R.period_bucket("event_cmc", PERIODS, "D", {1186: "launch"})
    return design_frame(spark, sf_dir).groupBy(period.alias("period")).agg(
        F.count("*").alias("n"), F.min("event_cmc").alias("first_month"))


@query("bin_numeric", with_views("""
    select case when maternal_age > 14 and maternal_age <= 19 then '15-19' when maternal_age > 19 and
      maternal_age <= 34 then '20-34' when maternal_age > 34 and maternal_age <= 49 then '35-49' end as age_group,
      count(*) as n from design_frame group by age_group"""))
def b11(spark, sf_dir):
    group = R.bin_numeric("maternal_age", [14, 19, 34, 49], ["15-19", "20-34", "35-49"])
    return design_frame(spark, sf_dir).groupBy(group.alias("age_group")).agg(F.count("*").alias("n"))


@query("delivery_order", with_views("""
    select delivery_order, delivery_order = 1 as first_event, count(*) as n from design_frame group by all"""))
def b12(spark, sf_dir):
    order = R.delivery_order("birth_order", "twin_order")
    return design_frame(spark, sf_dir).groupBy(order.alias("delivery_order")).agg(
        F.count("*").alias("n")).withColumn("first_event", F.col("delivery_order") == 1)


@query("risk_stratum", with_views("""
    select case when delivery_order <> 1 then 'not_applicable_multiparous'
        when maternal_age < 35 and twin_order = 0 then 'lower_risk' else 'elevated_risk' end as primary_risk,
      case when delivery_order <> 1 then 'not_applicable_multiparous'
        when convulsions is null or swelling is null then 'excluded_missing_complication_data'
        when maternal_age < 35 and twin_order = 0 and convulsions = 0 and swelling = 0 then 'refined_lower_risk'
        else 'refined_elevated_risk' end as refined_risk, count(*) as n
    from design_frame group by all"""))
def b13(spark, sf_dir):
    first = F.col("delivery_order") == 1
    return design_frame(spark, sf_dir).groupBy(
        R.primary_risk(first, "maternal_age", "twin_order").alias("primary_risk"),
        R.refined_risk(first, "maternal_age", "twin_order", ["convulsions", "swelling"]).alias("refined_risk"),
    ).agg(F.count("*").alias("n"))


@query("category_token", with_views("""
    select coalesce(cast(social_group as varchar), '__MISSING__') as social_token,
      case when education_years is null then '__MISSING__' when education_years < 18
        then cast(education_years as varchar) else '__UNKNOWN__' end as education_token, count(*) as n
    from design_frame group by all"""))
def b14(spark, sf_dir):
    return design_frame(spark, sf_dir).groupBy(
        R.category_token(F.col("social_group").cast("double")).alias("social_token"),
        R.category_token("education_years", [str(i) for i in range(18)]).alias("education_token"),
    ).agg(F.count("*").alias("n"))


@query("map_wave_columns", with_views("""
    select wave, case case when wave = 4 then convulsions else swelling end when 0 then 'no' when 1 then 'yes'
      when 8 then 'unknown' end as complication, count(*) as n from design_frame group by all"""))
def b15(spark, sf_dir):
    mapped = O.map_wave_columns(design_frame(spark, sf_dir), "wave",
                                {"complication": {4: "convulsions", 5: "swelling"}},
                                {0: "no", 1: "yes", 8: "unknown"})
    return mapped.groupBy("wave", "complication").agg(F.count("*").alias("n"))


@query("canonical_name", """
    select p_partkey, trim(regexp_replace(regexp_replace(replace(lower(p_type || ' & ' || p_brand), '&', ' and '),
      '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) as name from part""")
def b16(spark, sf_dir):
    part = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand")
    return part.select("p_partkey", R.canonical_name(F.concat_ws(" & ", "p_type", "p_brand")).alias("name"))


@query("harmonize_units", with_views("""
    select wave, nation, n_name as unit, count(*) as n from design_frame join nation on nation = n_nationkey
    group by all"""))
def b17(spark, sf_dir):
    crosswalk = table(spark, sf_dir, "nation", "n_nationkey", "n_name").select(
        F.col("n_nationkey").alias("nation"), F.col("n_name").alias("unit"))
    return O.harmonize_units(design_frame(spark, sf_dir), crosswalk, ["nation"], "unit").groupBy(
        "wave", "nation", "unit").agg(F.count("*").alias("n"))


@query("harmonize_units_check", with_views("""
    , a as (select distinct nation from design_frame where wave = 4),
      b as (select distinct nation from design_frame where wave = 5)
    select (select count(*) from a) as n_first, (select count(*) from a anti join b using (nation)) as only_first,
      (select count(*) from b anti join a using (nation)) as only_second,
      not exists (from a anti join b using (nation)) and not exists (from b anti join a using (nation)) as same_units"""))
def b17_check(spark, sf_dir):
    frame = design_frame(spark, sf_dir)
    return O.same_unit_sets(frame.where("wave = 4"), frame.where("wave = 5"), "nation")


@query("restrict_binary_exposure", with_views("""
    select case when place_code = 31 then 1 else 0 end as exposure, state, count(*) as n, sum(weight) as weight
    from design_frame where place_code in (31, 21) group by all"""))
def b18(spark, sf_dir):
    kept = O.restrict_binary_exposure(design_frame(spark, sf_dir), "place_code", 31, 21, ["outcome", "weight"])
    return kept.groupBy("exposure", "state").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


LAUNCHES = {1: 1180, 3: 1192}


@query("post_event_indicator", with_views("""
    select state, cast(coalesce(event_cmc > case state when 1 then 1180 when 3 then 1192 end, false) as int) as post,
      coalesce(event_cmc = case state when 1 then 1180 when 3 then 1192 end, false) as ambiguous, count(*) as n
    from design_frame group by all"""))
def b21(spark, sf_dir):
    post, ambiguous = R.post_event(F.col("state").cast("int"), "event_cmc", LAUNCHES)
    return design_frame(spark, sf_dir).groupBy("state", post.alias("post"), ambiguous.alias("ambiguous")).agg(
        F.count("*").alias("n"))
