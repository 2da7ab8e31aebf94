"""Cluster bootstrap over the survey view."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.operators import bootstrap as B
from surveyloom.operators import causal as C
from surveyloom.plans.cohorts import scratch
from surveyloom.plans.registry import query
from surveyloom.plans.tables import DESIGN, cohort, roster, with_views
from surveyloom.sources import write_results

REPS = 500
NEEDED = 475
SEED = 42
PSI = """
    , s as (select *, mu1_hat + sector / e_hat * (outcome - mu1_hat) as psi1,
        mu0_hat + (1 - sector) / (1 - e_hat) * (outcome - mu0_hat) as psi0 from cohort)
"""


def slots_sql(source: str, prefix: str = "") -> str:
    """Numbered clusters of every stratum of a CTE of cluster totals."""
    return f"""
      {prefix}slots as (select *, row_number() over (partition by state, stratum
          order by sha256(concat_ws('|', 'slot', state, stratum, psu))) as slot,
        count(*) over (partition by state, stratum) as stratum_psus from {source})"""


def draws_sql(prefix: str = "", size: str = "stratum_psus", seed: int = SEED) -> str:
    return f"""
      {prefix}draws as (select state, stratum, replicate, 1 + cast(floor(('0x' || substr(sha256(concat_ws('|', '{seed}', state,
          stratum, slot, replicate)), 1, 8))::bigint / 4294967296e0 * stratum_psus) as bigint) as slot
        from {prefix}slots, range(1, {REPS + 1}) t(replicate) where slot <= {size})"""


def bootstrap_sql(totals: str, values: str, prefix: str = "", seed: int = SEED) -> str:
    sums = ", ".join(f"sum({v}) as {v}" for v in values.split())
    return slots_sql(totals, prefix) + "," + draws_sql(prefix, seed=seed) + f""",
      {prefix}reps as (select replicate, {sums} from {prefix}draws join {prefix}slots using (state, stratum, slot)
        group by replicate)"""


AIPW_TOTALS = """
    , t as (select state, stratum, psu, sum(weight) as w, sum(weight * psi1) as w1, sum(weight * psi0) as w0
        from s {where} group by all),"""


def scored(spark, sf_dir):
    return C.aipw_scores(cohort(spark, sf_dir), "outcome", "sector", "e_hat", "mu1_hat", "mu0_hat")


def aipw_replicates(rows, seed=SEED):
    w = F.col("weight")
    totals = B.cluster_totals(rows, DESIGN, {"w": w, "w1": w * F.col("psi1"), "w0": w * F.col("psi0")})
    return B.psu_bootstrap(totals, DESIGN, REPS, seed).select(
        "replicate", ((F.col("w1") - F.col("w0")) / F.col("w")).alias("rd"), (F.col("w1") / F.col("w0")).alias("rr"))


@query("psu_bootstrap", with_views(PSI + AIPW_TOTALS.format(where="") + bootstrap_sql("t", "w w1 w0") + """
    , l as (select 'risk_difference' as statistic, (w1 - w0) / w as v from reps
        union all select 'risk_ratio', w1 / w0 from reps)
    select statistic, count(*) as replicates, avg(v) as mean, quantile_cont(v, 0.025) as ci_low,
      quantile_cont(v, 0.975) as ci_high from l group by statistic"""))
def i9(spark, sf_dir):
    return B.percentile_intervals(aipw_replicates(scored(spark, sf_dir)),
                                  {"risk_difference": F.col("rd"), "risk_ratio": F.col("rr")})


@query("paired_bootstrap_difference", with_views("""
    , t as (select state, stratum, psu, coalesce(sum(weight * outcome) filter (residence = 1), 0) as na,
        coalesce(sum(weight) filter (residence = 1), 0) as da, coalesce(sum(weight * outcome) filter (residence = 2), 0) as nb,
        coalesce(sum(weight) filter (residence = 2), 0) as db from cohort group by all),
    """ + bootstrap_sql("t", "na da nb db") + """
    select replicate, na / da as first, nb / db as second, na / da - nb / db as difference from reps"""))
def i10(spark, sf_dir):
    return B.paired_bootstrap_difference(cohort(spark, sf_dir), DESIGN, F.col("residence") == 1, F.col("residence") == 2,
                                         F.col("outcome"), REPS, SEED)


@query("wave_change_bootstrap", with_views(PSI + AIPW_TOTALS.format(where="where wave = 5").replace("t as", "ta as")
                                           + bootstrap_sql("ta", "w w1 w0", "a_")
                                           + AIPW_TOTALS.format(where="where wave = 4").replace("t as", "tb as")
                                           + bootstrap_sql("tb", "w w1 w0", "b_", SEED + 1) + """
    , c as (select (a.w1 - a.w0) / a.w - (b.w1 - b.w0) / b.w as rd, a.w1 / a.w0 / (b.w1 / b.w0) as rr
        from a_reps a join b_reps b using (replicate)),
      l as (select 'rd_change' as statistic, rd as v from c union all select 'rr_ratio', rr from c)
    select statistic, count(*) as replicates, avg(v) as mean, quantile_cont(v, 0.025) as ci_low,
      quantile_cont(v, 0.975) as ci_high from l group by statistic"""))
def i11(spark, sf_dir):
    rows = scored(spark, sf_dir)
    change = B.wave_change_bootstrap(aipw_replicates(rows.where("wave = 5")), aipw_replicates(rows.where("wave = 4"), SEED + 1))
    return B.percentile_intervals(change, {"rd_change": F.col("rd_change"), "rr_ratio": F.col("rr_ratio")})


def factor_sql(size: str, factor: str) -> str:
    return with_views(", t as (select * from roster where (state, stratum) in (select (state, stratum) from cohort))," + slots_sql("t") + "," + draws_sql(size=size)
                      + f""", c as (select state, stratum, replicate, slot, count(*) as k from draws group by all),
      f as (select r.replicate, state, stratum, psu, {factor} as factor from slots
        cross join range(1, {REPS + 1}) r(replicate) left join c using (replicate, state, stratum, slot))
    select state, stratum, psu, sum(factor) as total, max(factor) as largest, count(*) filter (factor = 0) as never
    from f group by all""")


def active_roster(spark, sf_dir):
    """All clusters of the strata with cohort rows: clusters without such rows are drawn too."""
    return roster(spark, sf_dir).join(cohort(spark, sf_dir).select(*DESIGN.strata).distinct(), list(DESIGN.strata), "left_semi")


@query("rao_wu_factors", factor_sql(
    "stratum_psus - 1", "case when stratum_psus = 1 then 1 else coalesce(k, 0) * stratum_psus / (stratum_psus - 1e0) end"))
def i12_rescaled(spark, sf_dir):
    return B.psu_factor_summary(active_roster(spark, sf_dir), DESIGN, REPS, SEED, True)


@query("psu_multipliers", factor_sql("stratum_psus", "coalesce(k, 0) * 1e0"))
def i12_plain(spark, sf_dir):
    return B.psu_factor_summary(active_roster(spark, sf_dir), DESIGN, REPS, SEED, False)


@query("bayesian_psu_weights", with_views("""
    , e as (select *, -ln(1 - ('0x' || substr(sha256(concat_ws('|', '42', state, stratum, psu)), 1, 8))::bigint
        / 4294967296e0) as e from (select distinct state, stratum, psu from cohort))
    select state, stratum, psu, e / avg(e) over (partition by state, stratum) as factor from e"""))
def i13(spark, sf_dir):
    return B.bayesian_psu_weights(cohort(spark, sf_dir), DESIGN, SEED)


@query("bootstrap_status", with_views(PSI + AIPW_TOTALS.format(where="") + bootstrap_sql("t", "w w1 w0") + f"""
    select count(*) as successful, {REPS} as attempted, {NEEDED} as needed, 'interval' as status,
      quantile_cont((w1 - w0) / w, 0.025) as ci_low, quantile_cont((w1 - w0) / w, 0.975) as ci_high from reps"""))
def i14(spark, sf_dir):
    return B.bootstrap_status(aipw_replicates(scored(spark, sf_dir)), "rd", REPS)


@query("replicates_reproduce", with_views(PSI + AIPW_TOTALS.format(where="") + bootstrap_sql("t", "w w1 w0") + """
    select count(*) as n, count(distinct replicate) = count(*) as consecutive,
      count(*) = count((w1 - w0) / w) as all_finite, true as limits_match from reps"""))
def i15(spark, sf_dir):
    replicates = aipw_replicates(scored(spark, sf_dir))
    limits = B.bootstrap_status(replicates, "rd", REPS).select("ci_low", "ci_high")
    stored = spark.read.parquet(write_results(limits, scratch(spark, "limits")))
    return B.replicates_reproduce(replicates, "rd", stored, 1e-9)
