"""Design-based estimates: linearised values, cluster totals, stratum moments.

Domains are boolean columns. Rows outside a domain contribute zero but stay in the
design; filtering them away would lose zero-contribution clusters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.design import SurveyDesign
from surveyloom.functions.special import normal_p_value, t_critical_of, t_p_value
from surveyloom.operators.joins import align_zero

NORMAL_CRITICAL = 1.96
SINGLETON_RULES = ("adjust", "average", "zero")


def _in(domain: Column | None) -> Column:
    return F.lit(True) if domain is None else F.coalesce(domain, F.lit(False))


def domain_share(df: DataFrame, weight: str, outcome: str, domain: Column | None = None) -> tuple[Column, Column]:
    """(weighted proportion, weight sum) of a domain as scalar subqueries."""
    inside = _in(domain)
    total = df.agg(F.sum(F.when(inside, F.col(weight))).alias("v")).scalar()
    events = df.agg(F.sum(F.when(inside, F.col(weight) * F.col(outcome))).alias("v")).scalar()
    return F.try_divide(events, total), total


def domain_influences(df: DataFrame, weight: str, outcome: str, domains: Mapping[str, Column | None]) -> dict[str, Column]:
    """Linearised value of each domain's weighted proportion (zero outside the domain).

    Every share is a scalar subquery over ``df`` itself, so many domains do not nest plans.
    """
    out = {}
    for name, domain in domains.items():
        share, total = domain_share(df, weight, outcome, domain)
        out[name] = F.when(_in(domain), F.col(weight) * (F.col(outcome) - share) / total).otherwise(F.lit(0.0))
    return out


def domain_proportion(df: DataFrame, design: SurveyDesign, outcome: str, domain: Column | None = None,
                      estimate: str = "estimate", z: str = "z") -> DataFrame:
    """Ratio estimate and its linearised value per row."""
    share, _ = domain_share(df, design.weight, outcome, domain)
    return df.withColumns({estimate: share} | domain_influences(df, design.weight, outcome, {z: domain}))


def stratum_moments(totals: DataFrame, strata: Sequence[str], value: str) -> DataFrame:
    """Additive statistics per stratum: clusters, sum and sum of squares of cluster totals."""
    return totals.groupBy(*strata).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("squares"))


def between_clusters(n: Column, total: Column, product: Column, other: Column | None = None) -> Column:
    """``n/(n-1)`` times the centred cross product of cluster totals; null for single clusters."""
    other = total if other is None else other
    return F.when(n > 1, n / (n - 1.0) * (product - total * other / n))


def psu_variance(df: DataFrame, design: SurveyDesign, z: str) -> DataFrame:
    """Ultimate-cluster variance; strata with one cluster are skipped and counted."""
    totals = df.groupBy(*design.cluster).agg(F.sum(z).alias("_t"))
    n = F.col("n")
    part = F.greatest(between_clusters(n, F.col("total"), F.col("squares")), F.lit(0.0))
    return stratum_moments(totals, design.strata, "_t").agg(
        F.coalesce(F.sum(F.when(n > 1, part)), F.lit(0.0)).alias("variance"),
        F.count_if(n == 1).alias("singleton_strata"), F.count_if(n > 1).alias("strata_used"))


def design_estimates(df: DataFrame, design: SurveyDesign, outcome: str,
                     groupings: Mapping[str, Column]) -> DataFrame:
    """Proportion, SE and clipped 95 % interval in percent for every level of every grouping.

    All groupings share one pass. The linearised cluster total is linear in the
    cluster's weight and outcome sums, so the variance follows from their cross
    products and no estimate has to be joined back to the clusters.
    """
    w, y = F.col(design.weight), F.col(outcome)
    levels = F.array(*[F.struct(F.lit(name).alias("grouping"), level.cast("string").alias("level"))
                       for name, level in groupings.items()])
    keys = ["grouping", "level"]
    a, b = F.col("_a"), F.col("_b")
    cells = df.select(*design.cluster, w.alias("_w"), (w * y).alias("_wy"), F.inline(levels)).where(
        "level is not null").groupBy(*keys, *design.cluster).agg(
        F.count("*").alias("_n"), F.sum("_w").alias("_a"), F.sum("_wy").alias("_b"))
    strata = cells.groupBy(*keys, *design.strata).agg(
        F.sum("_n").alias("_n"), F.sum(a).alias("_sa"), F.sum(b).alias("_sb"), F.sum(a * a).alias("_aa"),
        F.sum(a * b).alias("_ab"), F.sum(b * b).alias("_bb"))
    sizes = df.select(*design.cluster).distinct().groupBy(*design.strata).agg(F.count("*").alias("_nh"))
    part = lambda x, z, xz: F.coalesce(F.sum(between_clusters(F.col("_nh"), F.col(x), F.col(xz), F.col(z))), F.lit(0.0))
    domains = strata.join(sizes, list(design.strata)).groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum("_sa").alias("_W"), (F.sum("_sb") / F.sum("_sa")).alias("_p"),
        part("_sa", "_sa", "_aa").alias("_vaa"), part("_sa", "_sb", "_ab").alias("_vab"), part("_sb", "_sb", "_bb").alias("_vbb"))
    singles = sizes.agg(F.count_if(F.col("_nh") == 1).alias("v")).scalar()
    used = sizes.agg(F.count_if(F.col("_nh") > 1).alias("v")).scalar()
    p = F.col("_p")
    variance = (F.col("_vbb") - 2 * p * F.col("_vab") + p * p * F.col("_vaa")) / (F.col("_W") * F.col("_W"))
    se = F.sqrt(F.greatest(variance, F.lit(0.0)))
    return domains.select(
        *keys, "n", (100 * p).alias("estimate_pct"), (100 * se).alias("se_pct"),
        F.greatest(100 * (p - NORMAL_CRITICAL * se), F.lit(0.0)).alias("ci_low_pct"),
        F.least(100 * (p + NORMAL_CRITICAL * se), F.lit(100.0)).alias("ci_high_pct"),
        singles.alias("singleton_strata"), used.alias("strata_used"))


def design_difference(df: DataFrame, design: SurveyDesign, outcome: str, a: Column, b: Column) -> DataFrame:
    """Gap between two domains with the variance of the joint linearised value."""
    w, y = F.col(design.weight), F.col(outcome)
    sums = {"_wa": F.when(_in(a), w), "_wya": F.when(_in(a), w * y),
            "_wb": F.when(_in(b), w), "_wyb": F.when(_in(b), w * y)}
    totals = df.groupBy(*design.cluster).agg(
        *[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in sums.items()],
        F.count_if(_in(a)).alias("_na"), F.count_if(_in(b)).alias("_nb"))
    total = {k: totals.agg(F.sum(k).alias("v")).scalar() for k in sums}
    pa, pb = total["_wya"] / total["_wa"], total["_wyb"] / total["_wb"]
    z = ((F.col("_wya") - pa * F.col("_wa")) / total["_wa"]
         - (F.col("_wyb") - pb * F.col("_wb")) / total["_wb"])
    n = F.col("n")
    part = F.greatest(between_clusters(n, F.col("total"), F.col("squares")), F.lit(0.0))
    variance = stratum_moments(totals.withColumn("_z", z), design.strata, "_z").agg(
        F.sqrt(F.coalesce(F.sum(F.when(n > 1, part)), F.lit(0.0))).alias("_se"),
        F.count_if(n == 1).alias("singleton_strata"))
    n_a = totals.agg(F.sum("_na").alias("v")).scalar()
    n_b = totals.agg(F.sum("_nb").alias("v")).scalar()
    gap, se = F.col("gap_pct"), F.col("se_pct")
    return variance.select(
        n_a.alias("n_a"), n_b.alias("n_b"), (100 * pa).alias("a_pct"), (100 * pb).alias("b_pct"),
        (100 * (pa - pb)).alias("gap_pct"), (100 * F.col("_se")).alias("se_pct"), "singleton_strata").select(
        "*", (gap - NORMAL_CRITICAL * se).alias("ci_low_pct"), (gap + NORMAL_CRITICAL * se).alias("ci_high_pct"))


def _pairs(count: int, diagonal: bool) -> list[tuple[int, int]]:
    return [(i, j) for i in range(count) for j in range(i, count) if i == j or not diagonal]


def roster_moments(df: DataFrame, design: SurveyDesign, metrics: Sequence[str], roster: DataFrame,
                   diagonal: bool = False) -> DataFrame:
    """One row with everything the covariance needs: counts, stratum parts, single clusters, grand sums.

    Roster clusters count inside strata that hold at least one analytic row.
    """
    pairs = _pairs(len(metrics), diagonal)
    col = lambda i: F.col(metrics[i])
    totals = df.groupBy(*design.cluster).agg(*[F.sum(m).alias(m) for m in metrics])
    strata = align_zero(totals, roster, design.cluster, metrics).groupBy(*design.strata).agg(
        F.count("*").alias("_n"), F.count_if("in_domain").alias("_domain"),
        *[F.sum(col(i)).alias(f"_s{i}") for i in range(len(metrics))],
        *[F.sum(col(i) * col(j)).alias(f"_p{i}_{j}") for i, j in pairs]).where("_domain > 0")
    n, single = F.col("_n"), F.col("_n") == 1
    total = lambda value: F.coalesce(F.sum(value), F.lit(0.0))
    return strata.agg(
        F.sum(n).alias("roster_psus"), F.sum("_domain").alias("domain_psus"),
        F.count("*").alias("strata"), F.count_if(single).alias("singleton_strata"),
        *[total(F.col(f"_s{i}")).alias(f"_g{i}") for i in range(len(metrics))],
        *[total(F.when(single, F.col(f"_s{i}"))).alias(f"_l{i}") for i in range(len(metrics))],
        *[total(F.when(single, F.col(f"_p{i}_{j}"))).alias(f"_m{i}_{j}") for i, j in pairs],
        *[total(between_clusters(n, F.col(f"_s{i}"), F.col(f"_p{i}_{j}"), F.col(f"_s{j}"))).alias(f"_b{i}_{j}")
          for i, j in pairs])


def _with_regular(regular: Column, value: Column) -> Column:
    """The value, or a failing job if no stratum holds two or more clusters."""
    return F.when(regular > 0, value).otherwise(F.raise_error(F.lit("No stratum holds two or more clusters")))


def covariance_from_moments(moments: DataFrame, metrics: Sequence[str], diagonal: bool = False) -> DataFrame:
    """Long covariance ``(singleton, row_key, col_key, cov, design_df)`` under three single-cluster rules.

    adjust: single clusters are centred on the mean of all cluster totals, average:
    they get the mean contribution of the regular strata, zero: they add nothing. Without a
    stratum of two or more clusters there is no variance to estimate and the job fails.
    """
    psus, singles = F.col("roster_psus"), F.col("singleton_strata")
    regular = F.col("strata") - singles
    rows = []
    for i in range(len(metrics)):
        for j in ([i] if diagonal else range(len(metrics))):
            a, b = min(i, j), max(i, j)
            base = F.col(f"_b{a}_{b}")
            gi, gj = F.col(f"_g{i}") / psus, F.col(f"_g{j}") / psus
            lonely = F.col(f"_m{a}_{b}") - gi * F.col(f"_l{j}") - gj * F.col(f"_l{i}") + singles * gi * gj
            values = {"adjust": base + lonely, "average": base + F.coalesce(F.try_divide(singles * base, regular),
                                                                            F.lit(0.0)), "zero": base}
            rows += [F.struct(F.lit(rule).alias("singleton"), F.lit(metrics[i]).alias("row_key"),
                              F.lit(metrics[j]).alias("col_key"), _with_regular(regular, values[rule]).alias("cov"))
                     for rule in SINGLETON_RULES]
    return moments.select((psus - F.col("strata")).alias("design_df"), F.inline(F.array(*rows)))


def roster_covariance(df: DataFrame, design: SurveyDesign, metrics: Sequence[str], roster: DataFrame) -> DataFrame:
    """Covariance of summed influence columns with zero-contribution clusters from the roster."""
    return covariance_from_moments(roster_moments(df, design, metrics, roster), metrics)


def roster_variances(df: DataFrame, design: SurveyDesign, metrics: Sequence[str], roster: DataFrame) -> DataFrame:
    """Diagonal of :func:`roster_covariance`, without the cross products."""
    return covariance_from_moments(roster_moments(df, design, metrics, roster, True), metrics, True)


def variance_from_sufficient_stats(stats: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Scalar variance from additive ``(strata..., n, total, squares)`` rows, mergeable across sites."""
    merged = stats.groupBy(*strata).agg(F.sum("n").alias("n"), F.sum("total").alias("total"),
                                        F.sum("squares").alias("squares"))
    n, lonely = F.col("n"), F.col("n") == 1
    part = F.greatest(between_clusters(n, F.col("total"), F.col("squares")), F.lit(0.0))
    sums = merged.agg(
        F.coalesce(F.sum(F.when(n > 1, part)), F.lit(0.0)).alias("remove"), F.count_if(lonely).alias("_k"),
        F.count_if(n > 1).alias("_regular"), F.sum(n).alias("_psus"), F.count("*").alias("_strata"),
        F.sum("total").alias("_grand"),
        F.coalesce(F.sum(F.when(lonely, F.col("total"))), F.lit(0.0)).alias("_ls"),
        F.coalesce(F.sum(F.when(lonely, F.col("squares"))), F.lit(0.0)).alias("_lq"))
    mean, k, regular = F.col("_grand") / F.col("_psus"), F.col("_k"), F.col("_regular")
    return sums.select(
        # each of the three is guarded: a caller may select only one
        _with_regular(regular, F.col("remove")).alias("remove"),
        _with_regular(regular, F.col("remove") + F.col("_lq") - 2 * mean * F.col("_ls") + k * mean * mean).alias("adjust"),
        _with_regular(regular, F.col("remove") + F.coalesce(F.try_divide(k * F.col("remove"), F.col("_regular")), F.lit(0.0))).alias("average"),
        k.alias("singleton_strata"), (F.col("_psus") - F.col("_strata")).alias("design_df"))


def full_design_variance(df: DataFrame, design: SurveyDesign, score: str, roster: DataFrame) -> DataFrame:
    """Variance of a row score over the complete roster, not only strata with analytic rows."""
    totals = df.groupBy(*design.cluster).agg(F.sum(score).alias("_t"))
    aligned = align_zero(totals, roster, design.cluster, ["_t"])
    return variance_from_sufficient_stats(stratum_moments(aligned, design.strata, "_t"), design.strata)


def intervals(df: DataFrame, estimate: str, se: str, critical=None, df_column: str | None = None,
              kind: str = "linear", p_value: str | None = None) -> DataFrame:
    """Add ``ci_low`` and ``ci_high``.

    ``critical`` is a number or Column; without it the t quantile of ``df_column`` is
    used. ``kind='log_ratio'`` reads ``se`` as the SE of the log of ``estimate``.
    """
    if critical is None:
        critical = t_critical_of(F.col(df_column).cast("double"))
    elif not isinstance(critical, Column):
        critical = F.lit(float(critical))
    e, half = F.col(estimate), critical * F.col(se)
    if kind == "linear":
        low, high, statistic = e - half, e + half, F.try_divide(e, F.col(se))
    elif kind == "log_ratio":
        low, high = e * F.exp(-half), e * F.exp(half)
        statistic = F.try_divide(F.ln(e), F.col(se))
    else:
        raise ValueError("kind must be 'linear' or 'log_ratio'")
    out = df.withColumns({"ci_low": low, "ci_high": high})
    if p_value:
        p = t_p_value(statistic, F.col(df_column).cast("double")) if df_column else normal_p_value(statistic)
        out = out.withColumn(p_value, p)
    return out


def independent_change(later: DataFrame, earlier: DataFrame, keys: Sequence[str], estimate: str = "estimate",
                       se: str = "se", df_column: str = "design_df") -> DataFrame:
    """Difference of two independent waves: variances add, the smaller df is kept."""
    keys = list(keys)
    a = later.select(*keys, F.col(estimate).alias("_e1"), F.col(se).alias("_s1"), F.col(df_column).alias("_d1"))
    b = earlier.select(*keys, F.col(estimate).alias("_e0"), F.col(se).alias("_s0"), F.col(df_column).alias("_d0"))
    return a.join(b, keys).select(
        *keys, (F.col("_e1") - F.col("_e0")).alias("change"),
        F.sqrt(F.col("_s1") * F.col("_s1") + F.col("_s0") * F.col("_s0")).alias("se"),
        F.least("_d1", "_d0").alias("design_df"))


def paired_contrast(theta: DataFrame, cov: DataFrame, pairs: DataFrame) -> DataFrame:
    """``estimate_i - estimate_j`` with variance ``v_i + v_j - 2 c_ij``; ``pairs(contrast, first, second)``."""
    value = lambda side: theta.select(F.col("key").alias(side), F.col("estimate").alias(f"_{side}"))
    v = lambda a, b, name: cov.select(F.col("row_key").alias(f"_{name}r"), F.col("col_key").alias(f"_{name}c"),
                                      F.col("cov").alias(f"_v{name}"))
    out = pairs.join(value("first"), "first").join(value("second"), "second")
    for name, a, b in (("a", "first", "first"), ("b", "second", "second"), ("c", "first", "second")):
        out = out.join(v(a, b, name), (F.col(f"_{name}r") == F.col(a)) & (F.col(f"_{name}c") == F.col(b)))
    return out.select("contrast", (F.col("_first") - F.col("_second")).alias("estimate"),
                      F.sqrt(F.greatest(F.col("_va") + F.col("_vb") - 2 * F.col("_vc"), F.lit(0.0))).alias("se"))


def arm_influences(df: DataFrame, design: SurveyDesign, outcome: str, arm: str,
                   domain: Column | None = None) -> DataFrame:
    """Influence columns ``u_control``, ``u_treated`` and ``u_gap`` of the two weighted arm means."""
    arms = {name: _in(domain) & (F.col(arm) == a) for name, a in (("u_control", 0), ("u_treated", 1))}
    return df.withColumns(domain_influences(df, design.weight, outcome, arms)).withColumn(
        "u_gap", F.col("u_treated") - F.col("u_control"))


METRICS = ("control", "treated", "gap")


def unit_descriptive(df: DataFrame, design: SurveyDesign, outcome: str, arm: str, unit: str, labels: DataFrame,
                     label: str, roster: DataFrame, domain: Column | None = None, sparse: int = 30,
                     critical: float | None = None) -> DataFrame:
    """Arm proportions and gap per unit with design SE under three single-cluster rules.

    ``unit`` must be part of the stratum key, so clusters of different units never
    mix. Units without rows stay in the result; ``status`` and ``flags`` say why an
    interval is missing or doubtful.
    """
    if unit not in design.strata:
        raise ValueError("unit must be one of the stratum columns")
    w, y, inside = F.col(design.weight), F.col(outcome), _in(domain)
    sums = []
    for a in (0, 1):
        here = inside & (F.col(arm) == a)
        sums += [F.count_if(here).alias(f"n{a}"), F.coalesce(F.sum(F.when(here, w)), F.lit(0.0)).alias(f"w{a}"),
                 F.coalesce(F.sum(F.when(here, w * y)), F.lit(0.0)).alias(f"wy{a}"),
                 F.coalesce(F.sum(F.when(here, w * w)), F.lit(0.0)).alias(f"ww{a}"),
                 F.min(F.when(here, y)).alias(f"lo{a}"), F.max(F.when(here, y)).alias(f"hi{a}")]
    clusters = df.groupBy(*design.cluster).agg(*sums)
    units = clusters.groupBy(unit).agg(
        *[F.sum(f"{c}{a}").alias(f"{c}{a}") for a in (0, 1) for c in ("n", "w", "wy", "ww")],
        *[F.min(f"lo{a}").alias(f"lo{a}") for a in (0, 1)], *[F.max(f"hi{a}").alias(f"hi{a}") for a in (0, 1)])
    units = units.select("*", *[F.try_divide(F.col(f"wy{a}"), F.col(f"w{a}")).alias(f"p{a}") for a in (0, 1)])
    linear = {f"t{a}": F.coalesce(F.try_divide(F.col(f"wy{a}") - F.col(f"p{a}") * F.col(f"w{a}"), F.col(f"_W{a}")),
                                  F.lit(0.0)) for a in (0, 1)}
    shares = units.select(unit, "p0", "p1", F.col("w0").alias("_W0"), F.col("w1").alias("_W1"))
    totals = clusters.join(shares, unit).select(*design.cluster, *[v.alias(k) for k, v in linear.items()]).withColumn(
        "t2", F.col("t1") - F.col("t0"))
    values = ["t0", "t1", "t2"]
    strata = align_zero(totals, roster, design.cluster, values).groupBy(*design.strata).agg(
        F.count("*").alias("_n"), F.count_if("in_domain").alias("_domain"), *[F.sum(v).alias(f"_s{v}") for v in values],
        *[F.sum(F.col(v) * F.col(v)).alias(f"_q{v}") for v in values]).where("_domain > 0")
    single, n = F.col("_n") == 1, F.col("_n")
    zero = F.lit(0.0)
    moments = strata.groupBy(unit).agg(
        F.sum(n).alias("_psus"), F.count_if(single).alias("_k"), F.count_if(n > 1).alias("_regular"),
        (F.sum(n) - F.count("*")).alias("design_df"),
        *[F.sum(f"_s{v}").alias(f"_g{v}") for v in values],
        *[F.coalesce(F.sum(F.when(single, F.col(f"_s{v}"))), zero).alias(f"_l{v}") for v in values],
        *[F.coalesce(F.sum(F.when(single, F.col(f"_q{v}"))), zero).alias(f"_m{v}") for v in values],
        *[F.coalesce(F.sum(F.greatest(between_clusters(n, F.col(f"_s{v}"), F.col(f"_q{v}")), zero)), zero)
          .alias(f"_b{v}") for v in values])
    rows = []
    for m, name in enumerate(METRICS):
        arms = (m,) if m < 2 else (0, 1)
        point = F.col(f"p{m}") if m < 2 else F.col("p1") - F.col("p0")
        v, k = values[m], F.col("_k")
        mean = F.col(f"_g{v}") / F.col("_psus")
        variance = {"adjust": F.col(f"_b{v}") + F.col(f"_m{v}") - 2 * mean * F.col(f"_l{v}") + k * mean * mean,
                    "average": F.col(f"_b{v}") * (1 + F.coalesce(F.try_divide(k, F.col("_regular")), zero)),
                    "zero": F.col(f"_b{v}")}
        absent = boundary = few = light = F.lit(False)
        effective = []
        for a in arms:
            count = F.coalesce(F.col(f"n{a}"), F.lit(0))
            ess = F.coalesce(F.try_divide(F.col(f"w{a}") * F.col(f"w{a}"), F.col(f"ww{a}")), zero)
            effective.append(ess)
            absent = absent | (count == 0)
            few = few | ((count > 0) & (count < sparse))
            boundary = boundary | F.coalesce((count > 0) & (F.col(f"lo{a}") == F.col(f"hi{a}")), F.lit(False))
            light = light | ((ess > 0) & (ess < sparse))
        flags = [F.when(absent, F.lit("absent_sector_nonestimable")), F.when(few, F.lit(f"sparse_n_below_{sparse}")),
                 F.when(boundary, F.lit("boundary_outcome_no_reliable_wald_interval")),
                 F.when(light, F.lit(f"weight_only_effective_n_below_{sparse}"))]
        least_ess = effective[0] if len(effective) == 1 else F.least(*effective)
        for rule in SINGLETON_RULES:
            rows.append(F.struct(
                F.lit(name).alias("metric"), F.lit(rule).alias("singleton"), F.lit(m < 2).alias("_bounded"),
                (100 * point).alias("estimate"), variance[rule].alias("_variance"), boundary.alias("_boundary"),
                F.concat_ws(";", *flags).alias("flags"), least_ess.alias("minimum_effective_n")))
    base = labels.select(unit, label).join(units, unit, "left").join(moments, unit, "left")
    long = base.select(unit, label, F.coalesce("n0", F.lit(0)).alias("n_control"),
                       F.coalesce("n1", F.lit(0)).alias("n_treated"), "design_df", "_regular",
                       F.inline(F.array(*rows)))
    usable = (F.col("estimate").isNotNull() & (F.coalesce(F.col("_regular"), F.lit(0)) > 0)
              & (F.coalesce(F.col("design_df"), F.lit(0)) > 0) & ~F.col("_boundary"))
    se = F.when(usable & (F.col("_variance") > 0), 100 * F.sqrt(F.greatest("_variance", zero)))
    t = F.lit(float(critical)) if critical is not None else t_critical_of(F.col("design_df").cast("double"))
    out = long.withColumn("se", se).withColumns({"ci_low": F.col("estimate") - t * F.col("se"),
                                                 "ci_high": F.col("estimate") + t * F.col("se")})
    outside = F.col("_bounded") & ((F.col("ci_low") < 0) | (F.col("ci_high") > 100))
    status = (F.when(F.col("estimate").isNull(), "nonestimable")
              .when((F.coalesce(F.col("_regular"), F.lit(0)) == 0) | (F.coalesce(F.col("design_df"), F.lit(0)) <= 0),
                    "point_only_insufficient_design")
              .when(F.col("_boundary"), "point_only_boundary_outcome")
              .when(F.col("se").isNull(), "point_only_zero_variance")
              .when(outside, "approximate_interval_outside_bounds")
              .when(F.col("flags") != "", "approximate_interval_sparse").otherwise("approximate_interval"))
    marks = F.when(F.col("se").isNotNull() & outside,
                   F.concat_ws(";", F.when(F.col("flags") != "", F.col("flags")), F.lit("wald_interval_outside_0_100")))
    return out.withColumns({"status": status, "flags": F.coalesce(marks, F.col("flags"))}).drop(
        "_regular", "_bounded", "_variance", "_boundary")


def roster_audit(analytic: DataFrame, file_frame: DataFrame, roster: DataFrame, design: SurveyDesign,
                 region: str) -> DataFrame:
    """Counts that tell whether the cluster keys of cohort, file and roster fit together."""
    keys, strata = design.cluster, list(design.strata)
    cohort = analytic.select(*keys).distinct()
    file_keys = file_frame.select(*keys).distinct()
    whole = roster.select(*keys).distinct()
    active = whole.join(cohort.select(*strata).distinct(), strata, "left_semi")
    one = lambda df, value: df.agg(value.alias("v")).scalar()
    count = F.count("*")
    short = [c for c in keys if c != region]
    sizes = active.groupBy(*strata).agg(count.alias("_n"))
    inner = [c for c in strata if c != region]
    shared = whole.select(*strata).distinct().groupBy(*inner).agg(count.alias("_n"))
    return whole.agg(count.alias("roster_psus")).select(
        "roster_psus", one(cohort, count).alias("cohort_psus"), one(active, count).alias("active_roster_psus"),
        one(active.join(cohort, keys, "left_anti"), count).alias("zero_domain_psus"),
        one(file_keys.join(whole, keys, "left_anti"), count).alias("file_psus_outside_roster"),
        one(sizes, F.count_if(F.col("_n") == 1)).alias("singleton_strata"),
        one(shared, F.count_if(F.col("_n") > 1)).alias("strata_shared_by_regions"),
        (one(whole, count) - one(whole.select(*short).distinct(), count)).alias("keys_lost_without_region"))


def cohort_scope(df: DataFrame, design: SurveyDesign, outcome: str, arm: str) -> DataFrame:
    """Arm counts, invalid values, key counts and the observed weighted gap in percentage points."""
    w, y, a = F.col(design.weight), F.col(outcome), F.col(arm)
    valid = F.coalesce(y.isin(0, 1), F.lit(False))
    mean = lambda v: F.try_divide(F.sum(F.when(a == v, w * y)), F.sum(F.when(a == v, w)))
    keys = df.select(*design.cluster).distinct()
    count = F.count("*")
    return df.agg(
        count.alias("n"), F.count_if(a == 0).alias("n_control"), F.count_if(a == 1).alias("n_treated"),
        F.count_if(~valid).alias("invalid_outcomes"),
        F.count_if(~F.coalesce((w > 0) & ~F.isnan(w), F.lit(False))).alias("invalid_weights"),
        (100 * (mean(1) - mean(0))).alias("observed_gap_pp")).select(
        "*", keys.agg(count.alias("v")).scalar().alias("design_psus"),
        keys.select(*design.strata).distinct().agg(count.alias("v")).scalar().alias("design_strata"))
