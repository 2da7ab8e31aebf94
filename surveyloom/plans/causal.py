"""Doubly robust algebra with given prediction columns over the survey view."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import recode as R
from surveyloom.operators import causal as C
from surveyloom.operators.ranking import stratified_group_folds
from surveyloom.plans.bootstraps import PSI, scored
from surveyloom.plans.registry import query
from surveyloom.plans.tables import DESIGN, cohort, roster, with_views

RISKS = """count(*) as n, {n1} / {d1} as risk_treated, {n0} / {d0} as risk_control,
    {n1} / {d1} - {n0} / {d0} as risk_difference, ({n1} / {d1}) / ({n0} / {d0}) as risk_ratio"""
AIPW = RISKS.format(n1="sum(weight * psi1)", d1="sum(weight)", n0="sum(weight * psi0)", d0="sum(weight)")


@query("clip", with_views("""
    select row_id, least(greatest(e_hat, 0.2e0), 0.8e0) as clipped from cohort"""))
def i2(spark, sf_dir):
    return cohort(spark, sf_dir).select("row_id", R.clip("e_hat", 0.2).alias("clipped"))


@query("aipw", with_views(PSI + f"select state, {AIPW} from s group by state"))
def i3(spark, sf_dir):
    return C.aipw(scored(spark, sf_dir), "weight", ["state"])


@query("ipw_only", with_views("select state, " + RISKS.format(
    n1="sum(weight * sector * outcome / e_hat)", d1="sum(weight * sector / e_hat)",
    n0="sum(weight * (1 - sector) * outcome / (1 - e_hat))", d0="sum(weight * (1 - sector) / (1 - e_hat))")
    + " from cohort group by state"))
def i4(spark, sf_dir):
    return C.ipw_only(cohort(spark, sf_dir), "weight", "outcome", "sector", "e_hat", by=["state"])


@query("outcome_only", with_views("select state, " + RISKS.format(
    n1="sum(weight * mu1_hat)", d1="sum(weight)", n0="sum(weight * mu0_hat)", d0="sum(weight)")
    + " from cohort group by state"))
def i4_outcome(spark, sf_dir):
    return C.outcome_only(cohort(spark, sf_dir), "weight", "mu1_hat", "mu0_hat", ["state"])


@query("trimmed", with_views(PSI + f"""
    select {AIPW}, (select count(*) from s) - count(*) as n_dropped,
      100e0 * ((select count(*) from s) - count(*)) / (select count(*) from s) as pct_dropped
    from s where e_hat between 0.25 and 0.75"""))
def i5(spark, sf_dir):
    return C.trimmed(scored(spark, sf_dir), "weight", "e_hat", 0.25, 0.75)


IPW_SQL = """
    , m as (select sum(weight * sector) / sum(weight) as m from cohort),
      ipw as (select cohort.*, case when sector = 1 then m / e_hat else (1 - m) / (1 - e_hat) end as stabilized_ipw,
        weight * stabilized_ipw as combined_weight from cohort, m)
"""


@query("stabilized_ipw", with_views(IPW_SQL + """
    select sector, count(*) as n, sum(stabilized_ipw) as ipw, sum(combined_weight) as combined,
      sum(combined_weight) ^ 2 / sum(combined_weight ^ 2) as ess from ipw group by sector"""))
def i6(spark, sf_dir):
    w = F.col("combined_weight")
    return C.stabilized_ipw(cohort(spark, sf_dir), "weight", "sector", "e_hat").groupBy("sector").agg(
        F.count("*").alias("n"), F.sum("stabilized_ipw").alias("ipw"), F.sum(w).alias("combined"),
        (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"))


@query("overlap_summary", with_views(IPW_SQL + """
    , b as (select max(lo) as lo, min(hi) as hi from (select min(e_hat) as lo, max(e_hat) as hi from ipw group by sector)),
      g as (select 'all' as "group", * from ipw union all select cast(sector as varchar), * from ipw)
    select "group", count(*) as n, min(e_hat) as propensity_min, max(e_hat) as propensity_max,
      count(*) filter (e_hat between lo and hi) as n_common_support,
      100e0 * count(*) filter (e_hat between lo and hi) / count(*) as pct_common_support,
      count(*) filter (e_hat < 0.2 or e_hat > 0.8) as n_extreme,
      100e0 * count(*) filter (e_hat < 0.2 or e_hat > 0.8) / count(*) as pct_extreme,
      count(*) filter (stabilized_ipw > 3) as n_heavy_weights, max(stabilized_ipw) as max_weight
    from g, b group by "group" """))
def i7(spark, sf_dir):
    weighted = C.stabilized_ipw(cohort(spark, sf_dir), "weight", "sector", "e_hat")
    return C.overlap_summary(weighted, "sector", "e_hat", 0.2, 0.8, "stabilized_ipw", 3.0)


@query("overlap_percentiles", with_views("""
    select sector, quantile_cont(e_hat, 0.01) as p01, quantile_cont(e_hat, 0.05) as p05, median(e_hat) as p50,
      quantile_cont(e_hat, 0.95) as p95, quantile_cont(e_hat, 0.99) as p99 from cohort group by sector"""))
def i7_percentiles(spark, sf_dir):
    return C.overlap_percentiles(cohort(spark, sf_dir), "sector", "e_hat",
                                 {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("balance_table", with_views(IPW_SQL + """
    , l as (select sector, combined_weight as c, variable, level from (select sector, combined_weight,
        cast(state as varchar) as state, cast(wealth_index as varchar) as wealth_index,
        coalesce(cast(social_group as varchar), '__MISSING__') as social_group from ipw)
        unpivot (level for variable in (state, wealth_index, social_group))),
      t as (select sector, count(*) * 1e0 as n, sum(combined_weight) as c from ipw group by sector),
      p as (select variable, level, sum(1 / t.n) filter (l.sector = 1) as b1, sum(1 / t.n) filter (l.sector = 0) as b0,
        sum(l.c / t.c) filter (l.sector = 1) as a1, sum(l.c / t.c) filter (l.sector = 0) as a0
        from l join t using (sector) group by all),
      d as (select variable, level, (b1 - b0) / sqrt((b1 * (1 - b1) + b0 * (1 - b0)) / 2) as smd_before,
        (a1 - a0) / sqrt((a1 * (1 - a1) + a0 * (1 - a0)) / 2) as smd_after from p)
    select *, abs(smd_after) > 0.1 as flag_after from d"""))
def i8(spark, sf_dir):
    weighted = C.stabilized_ipw(cohort(spark, sf_dir), "weight", "sector", "e_hat")
    return C.balance_table(weighted, "sector", ["state", "wealth_index", "social_group"], "combined_weight")


@query("aipw_influence_ci", with_views(PSI + """
    , r as (select sum(weight) as w, sum(weight * psi1) / sum(weight) as r1, sum(weight * psi0) / sum(weight) as r0 from s),
      z as (select state, stratum, psu, sum(weight / w * (psi1 - r1 - psi0 + r0)) as u1,
        sum(weight / w * ((psi1 - r1) / r1 - (psi0 - r0) / r0)) as u2 from s, r group by state, stratum, psu),
      al as (select state, stratum, psu, coalesce(u1, 0) as risk_difference, coalesce(u2, 0) as risk_ratio
        from roster left join z using (state, stratum, psu)),
      l as (select * from al unpivot (u for metric in (risk_difference, risk_ratio))),
      g as (select metric, avg(u) as g from l group by metric),
      st as (select metric, state, stratum, count(*) as n, sum(u) as s1, sum(u * u) as s2 from l group by all),
      v as (select metric, sum(case when n > 1 then n / (n - 1e0) * (s2 - s1 * s1 / n) else 0 end) as base,
        sum(case when n = 1 then (s1 - g) ^ 2 else 0 end) as lonely, count(*) filter (n = 1) as k,
        count(*) filter (n > 1) as m, cast(sum(n) - count(*) as bigint) as design_df
        from st join g using (metric) group by metric),
      q as (select metric, rule as singleton, design_df, case metric when 'risk_difference' then r1 - r0 else r1 / r0 end as estimate,
        sqrt(case rule when 'adjust' then base + lonely when 'average' then base + k * base / m else base end) as se
        from v, r, (values ('remove'), ('adjust'), ('average')) t(rule))
    select *, case metric when 'risk_difference' then estimate - 1.96 * se else estimate * exp(-1.96 * se) end as ci_low,
      case metric when 'risk_difference' then estimate + 1.96 * se else estimate * exp(1.96 * se) end as ci_high from q"""))
def i16(spark, sf_dir):
    return C.aipw_influence_ci(scored(spark, sf_dir), DESIGN, roster(spark, sf_dir), 1.96)


@query("row_folds_leak", with_views("""
    , f as (select *, row_id % 5 as fold from cohort),
      k as (select count(*) as leaking from (select state, stratum, psu from f group by all having count(distinct fold) > 1))
    select fold, count(distinct (state, stratum, psu)) as psus, count(*) as n, max(leaking) as leaking_psus from f, k group by fold"""))
def i21_leak(spark, sf_dir):
    """Folds drawn by row tear clusters apart."""
    return fold_leaks(cohort(spark, sf_dir).withColumn("fold", F.col("row_id") % 5))


@query("psu_grouped_folds", with_views("""
    , g as (select state, stratum, psu, cast(floor(avg(sector) * 4) as int) as c from cohort group by all),
      r as (select *, row_number() over (partition by c order by sha256(concat_ws('|', '11', state, stratum, psu))) as k from g)
    select cast((k - 1 + c) % 5 as int) as fold, count(distinct (state, stratum, psu)) as psus, count(*) as n,
      0 as leaking_psus from cohort join r using (state, stratum, psu) group by fold"""))
def i21(spark, sf_dir):
    return fold_leaks(stratified_group_folds(cohort(spark, sf_dir), DESIGN.cluster, "sector", 5, 11))


def fold_leaks(folded):
    leaks = folded.groupBy(*DESIGN.cluster).agg((F.min("fold") != F.max("fold")).alias("_leak")).agg(
        F.count_if("_leak").alias("v")).scalar()
    return folded.groupBy("fold").agg(F.count_distinct(*DESIGN.cluster).alias("psus"), F.count("*").alias("n")).withColumn(
        "leaking_psus", leaks)


@query("e_value", with_views(PSI + f"""
    , t as (select nation, {AIPW} from s group by nation),
      i as (select *, risk_ratio * exp(-4 / sqrt(n)) as low, risk_ratio * exp(4 / sqrt(n)) as high from t),
      x as (select *, case when abs(low - 1) < abs(high - 1) then low else high end as near from i),
      v as (select *, case when risk_ratio < 1 then 1 / risk_ratio else risk_ratio end as r,
        case when near < 1 then 1 / near else near end as b from x)
    select nation, risk_ratio, r + sqrt(r * (r - 1)) as e_value,
      case when (near - 1) * (risk_ratio - 1) < 0 then 1 else b + sqrt(b * (b - 1)) end as e_value_interval from v"""))
def i24(spark, sf_dir):
    table = C.aipw(scored(spark, sf_dir), "weight", ["nation"])
    rr, width = F.col("risk_ratio"), 4 / F.sqrt("n")
    point, interval = R.e_value(rr, rr * F.exp(-width), rr * F.exp(width))
    return table.select("nation", "risk_ratio", point.alias("e_value"), interval.alias("e_value_interval"))


@query("nuisance_sanity", with_views("""
    select 'treated_outcome' as quantity, sum(weight * outcome) / sum(weight) as observed,
      sum(weight * mu1_hat) / sum(weight) as predicted from cohort where sector = 1
    union all select 'control_outcome', sum(weight * outcome) / sum(weight), sum(weight * mu0_hat) / sum(weight)
      from cohort where sector = 0
    union all select 'exposure_share', sum(weight * sector) / sum(weight), sum(weight * e_hat) / sum(weight) from cohort"""))
def i26(spark, sf_dir):
    return C.nuisance_sanity(cohort(spark, sf_dir), "weight", "outcome", "sector", "e_hat", "mu1_hat", "mu0_hat")
