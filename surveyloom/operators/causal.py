"""Doubly robust contrasts, weights, overlap and balance from given predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.design import SurveyDesign
from surveyloom.functions.recode import MISSING, clip
from surveyloom.operators.profile import grouped_levels, smd_of_moments
from surveyloom.operators.scale import exact_quantiles
from surveyloom.operators.variance import full_design_variance

SMD_LIMIT = 0.1


def _risks(df: DataFrame, by: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Risks, difference and ratio from summed numerators and denominators."""
    r1, r0 = F.col("_n1") / F.col("_d1"), F.col("_n0") / F.col("_d0")
    return df.select(*by, "n", r1.alias("risk_treated"), r0.alias("risk_control"),
                     (r1 - r0).alias("risk_difference"), F.try_divide(r1, r0).alias("risk_ratio"), *extra)


def aipw_scores(df: DataFrame, outcome: str, exposure: str, e: str, mu1: str, mu0: str, eps: float = 1e-6) -> DataFrame:
    """Add pseudo-outcomes ``psi1`` and ``psi0`` (propensity clipped)."""
    y, a, p = F.col(outcome), F.col(exposure), clip(e, eps)
    return df.withColumns({"psi1": F.col(mu1) + a / p * (y - F.col(mu1)),
                           "psi0": F.col(mu0) + (1 - a) / (1 - p) * (y - F.col(mu0))})


def aipw(df: DataFrame, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted doubly robust risks from ``psi1`` and ``psi0``."""
    w = F.col(weight)
    return _risks(df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(w * F.col("psi1")).alias("_n1"), F.sum(w).alias("_d1"),
        F.sum(w * F.col("psi0")).alias("_n0"), F.sum(w).alias("_d0")), by)


def ipw_only(df: DataFrame, weight: str, outcome: str, exposure: str, e: str, eps: float = 1e-6,
             by: Sequence[str] = ()) -> DataFrame:
    """Normalised inverse-propensity risks."""
    p, a, y = clip(e, eps), F.col(exposure), F.col(outcome)
    w1, w0 = F.col(weight) * a / p, F.col(weight) * (1 - a) / (1 - p)
    return _risks(df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w1 * y).alias("_n1"), F.sum(w1).alias("_d1"),
                                      F.sum(w0 * y).alias("_n0"), F.sum(w0).alias("_d0")), by)


def outcome_only(df: DataFrame, weight: str, mu1: str, mu0: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted means of the two outcome predictions."""
    w = F.col(weight)
    return _risks(df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w * F.col(mu1)).alias("_n1"),
                                      F.sum(w).alias("_d1"), F.sum(w * F.col(mu0)).alias("_n0"),
                                      F.sum(w).alias("_d0")), by)


def trimmed(df: DataFrame, weight: str, e: str, low: float, high: float) -> DataFrame:
    """Doubly robust estimate inside a propensity range, with the number and percent of rows left out."""
    inside, w = F.col(e).between(low, high), F.col(weight)
    pick = lambda v: F.sum(F.when(inside, v))
    sums = df.agg(F.count_if(inside).alias("n"), F.count("*").alias("_all"), pick(w * F.col("psi1")).alias("_n1"),
                  pick(w).alias("_d1"), pick(w * F.col("psi0")).alias("_n0"), pick(w).alias("_d0"))
    dropped = F.col("_all") - F.col("n")
    return _risks(sums, [], [dropped.alias("n_dropped"), (100.0 * dropped / F.col("_all")).alias("pct_dropped")])


def stabilized_ipw(df: DataFrame, weight: str, exposure: str, e: str, eps: float = 1e-6) -> DataFrame:
    """Add ``stabilized_ipw`` (weighted marginal over propensity) and ``combined_weight``."""
    share = df.agg((F.sum(F.col(weight) * F.col(exposure)) / F.sum(weight)).alias("v")).scalar()
    p = clip(e, eps)
    ipw = F.when(F.col(exposure) == 1, share / p).otherwise((1 - share) / (1 - p))
    return df.withColumn("stabilized_ipw", ipw).withColumn("combined_weight", F.col(weight) * F.col("stabilized_ipw"))


def overlap_summary(df: DataFrame, exposure: str, e: str, low: float = 0.05, high: float = 0.95,
                    ipw: str | None = None, heavy: float = 10.0) -> DataFrame:
    """Propensity range, common support and extreme shares, for all rows and per arm."""
    arms = df.groupBy(exposure).agg(F.min(e).alias("_lo"), F.max(e).alias("_hi"))
    support_low = arms.agg(F.max("_lo").alias("v")).scalar()
    support_high = arms.agg(F.min("_hi").alias("v")).scalar()
    p = F.col("_e")
    inside, extreme = p.between(support_low, support_high), (p < low) | (p > high)
    keep = [F.col(e).alias("_e"), *([F.col(ipw).alias("_w")] if ipw else [])]
    long = grouped_levels(df, keep, [exposure], "_g", "group")
    weights = [F.count_if(F.col("_w") > heavy).alias("n_heavy_weights"), F.max("_w").alias("max_weight")] if ipw else []
    return long.groupBy("group").agg(
        F.count("*").alias("n"), F.min(p).alias("propensity_min"), F.max(p).alias("propensity_max"),
        F.count_if(inside).alias("n_common_support"), (100.0 * F.count_if(inside) / F.count("*")).alias("pct_common_support"),
        F.count_if(extreme).alias("n_extreme"), (100.0 * F.count_if(extreme) / F.count("*")).alias("pct_extreme"),
        *weights)


def overlap_percentiles(df: DataFrame, exposure: str, e: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact propensity percentiles per arm."""
    return exact_quantiles(df, [exposure], e, probs)


def balance_table(df: DataFrame, exposure: str, categorical: Sequence[str], after: str,
                  before: str | None = None) -> DataFrame:
    """Standardised difference of every level indicator before and after weighting, largest first.

    An indicator's moments follow from level sums, so rows are never widened to dummies.
    """
    w0 = F.lit(1.0) if before is None else F.col(before)
    cells = F.array(*[F.struct(F.lit(c).alias("variable"),
                               F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("level")) for c in categorical])
    sums = df.select(exposure, w0.alias("_b"), F.col(after).alias("_a"), F.inline(cells)).groupBy("variable", "level").agg(
        *[F.coalesce(F.sum(F.when(F.col(exposure) == arm, F.col(w))), F.lit(0.0)).alias(f"{w}{arm}")
          for arm in (0, 1) for w in ("_b", "_a")])
    total = lambda w, arm: df.agg(F.sum(F.when(F.col(exposure) == arm, w)).alias("v")).scalar()
    share = {f"{name}{arm}": F.col(f"{name}{arm}") / total(w, arm)
             for name, w in (("_b", w0), ("_a", F.col(after))) for arm in (0, 1)}
    shares = sums.select("variable", "level", *[v.alias(k) for k, v in share.items()])
    gap = lambda w: smd_of_moments(F.col(f"{w}1"), F.col(f"{w}1") * (1 - F.col(f"{w}1")),
                                   F.col(f"{w}0"), F.col(f"{w}0") * (1 - F.col(f"{w}0")))
    return shares.select("variable", "level", gap("_b").alias("smd_before"), gap("_a").alias("smd_after")).withColumn(
        "flag_after", F.coalesce(F.abs("smd_after") > SMD_LIMIT, F.lit(False))).orderBy(
        F.abs("smd_before").desc_nulls_last(), "variable", "level")


def aipw_influence(df: DataFrame, weight: str) -> DataFrame:
    """Add centred influence columns ``u_rd`` and ``u_log_rr`` of the doubly robust contrast."""
    w = F.col(weight)
    total = df.agg(F.sum(w).alias("v")).scalar()
    r1 = df.agg((F.sum(w * F.col("psi1")) / F.sum(w)).alias("v")).scalar()
    r0 = df.agg((F.sum(w * F.col("psi0")) / F.sum(w)).alias("v")).scalar()
    s1, s0 = F.col("psi1") - r1, F.col("psi0") - r0
    return df.withColumns({"u_rd": w / total * (s1 - s0), "u_log_rr": w / total * (s1 / r1 - s0 / r0)})


def aipw_influence_ci(df: DataFrame, design: SurveyDesign, roster: DataFrame, critical: float) -> DataFrame:
    """Design-based intervals of difference and ratio under each single-cluster rule."""
    scored = aipw_influence(df, design.weight)
    points = aipw(df, design.weight)
    rows = []
    for metric, column in (("risk_difference", "u_rd"), ("risk_ratio", "u_log_rr")):
        variances = full_design_variance(scored, design, column, roster)
        cells = F.array(*[F.struct(F.lit(rule).alias("singleton"), F.sqrt(F.greatest(rule, F.lit(0.0))).alias("se"))
                          for rule in ("remove", "adjust", "average")])
        point = points.select(metric).scalar()
        half = F.lit(critical) * F.col("se")
        low, high = ((point - half, point + half) if metric == "risk_difference"
                     else (point * F.exp(-half), point * F.exp(half)))
        rows.append(variances.select("design_df", F.inline(cells)).select(
            F.lit(metric).alias("metric"), "singleton", point.alias("estimate"), "se", "design_df",
            low.alias("ci_low"), high.alias("ci_high")))
    return rows[0].unionByName(rows[1])


def nuisance_sanity(df: DataFrame, weight: str, outcome: str, exposure: str, e: str, mu1: str, mu0: str) -> DataFrame:
    """Observed weighted means next to the matching out-of-fold predicted means."""
    w, a = F.col(weight), F.col(exposure)
    mean = lambda v, test=None: (F.sum(w * v) / F.sum(w) if test is None
                                 else F.sum(F.when(test, w * v)) / F.sum(F.when(test, w)))
    sums = df.agg(mean(F.col(outcome), a == 1).alias("o1"), mean(F.col(mu1), a == 1).alias("p1"),
                  mean(F.col(outcome), a == 0).alias("o0"), mean(F.col(mu0), a == 0).alias("p0"),
                  mean(a).alias("o2"), mean(F.col(e)).alias("p2"))
    rows = F.array(*[F.struct(F.lit(name).alias("quantity"), F.col(f"o{i}").alias("observed"),
                              F.col(f"p{i}").alias("predicted"))
                     for i, name in ((1, "treated_outcome"), (0, "control_outcome"), (2, "exposure_share"))])
    return sums.select(F.inline(rows))
