"""Weighted summaries, missingness, codes, keys and support of survey tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.recode import MISSING
from surveyloom.operators.scale import exact_quantiles, running_sums, stored_side

QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def _long(df: DataFrame, keep: Sequence, columns: Sequence[str], kind: str, variable: str = "variable",
          value: str = "value") -> DataFrame:
    """One row per original row and column."""
    cells = F.array(*[F.struct(F.lit(c).alias(variable), F.col(c).cast(kind).alias(value)) for c in columns])
    return df.select(*keep, F.inline(cells))


def grouped_levels(df: DataFrame, keep: Sequence, by: Sequence[str], group: str = "group",
                   level: str = "level") -> DataFrame:
    """Repeat rows for "all" and for each grouping column, to share one aggregate."""
    cells = F.array(F.struct(F.lit("all").alias(group), F.lit("all").alias(level)),
                    *[F.struct(F.lit(c).alias(group), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(level))
                      for c in by])
    return df.select(*keep, F.inline(cells))


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """``sum(w*y)/sum(w)`` over rows with a value."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*by).agg(F.try_divide(F.sum(w * F.col(value)), F.sum(w)).alias("weighted_mean"))


def prevalence_table(df: DataFrame, outcome: str, weight: str, by: Sequence[str]) -> DataFrame:
    """Counts, raw and weighted prevalence for every subset of the grouping columns with totals.

    A grouped-out column is null and ``grouping_id`` tells it from a real null.
    """
    return df.cube(*by).agg(
        F.grouping_id().alias("grouping_id"), F.count("*").alias("n"), F.sum(outcome).alias("events"),
        F.sum(weight).alias("weight"), F.avg(outcome).alias("raw_prevalence"),
        (F.sum(F.col(weight) * F.col(outcome)) / F.sum(weight)).alias("weighted_prevalence"))


def weight_share(df: DataFrame, weight: str, by: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Share of the weight of each cell inside its ``within`` group."""
    cells = df.groupBy(*by).agg(F.sum(weight).alias("weight"))
    if not within:
        return cells.withColumn("share", F.col("weight") / cells.agg(F.sum("weight").alias("v")).scalar())
    totals = cells.groupBy(*within).agg(F.sum("weight").alias("_total"))
    return cells.join(totals, list(within)).withColumn("share", F.col("weight") / F.col("_total")).drop("_total")


def kish_ess(df: DataFrame, weights: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Effective sample size of one or more weights per group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[
        F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)).alias(f"ess_{name}") for name, w in weights.items()])


def weighted_quantile(df: DataFrame, value: str, weight: str, probs: Mapping[str, float],
                      by: Sequence[str] = ()) -> DataFrame:
    """Weighted quantiles on mid-cumulative weights with linear interpolation.

    Equal values are merged first, so the result does not depend on row order.
    Outside the first and last mid-point the extreme value is returned.
    """
    cells = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(
        F.sum(weight).alias("_w"))
    run = running_sums(cells, by, value, {"_w": F.col("_w")})
    at = (F.col("_w_before") + 0.5 * F.col("_w")) / F.col("_w_total")
    placed = run.select(*by, F.struct(at.alias("at"), F.col(value).cast("double").alias("x")).alias("_s"),
                        at.alias("_at"))
    picks, out = [], []
    for name, p in probs.items():
        picks += [F.max(F.when(F.col("_at") <= p, F.col("_s"))).alias(f"_a_{name}"),
                  F.min(F.when(F.col("_at") >= p, F.col("_s"))).alias(f"_b_{name}")]
        a, b = F.col(f"_a_{name}"), F.col(f"_b_{name}")
        slope = F.try_divide(F.lit(float(p)) - a["at"], b["at"] - a["at"])
        out.append(F.when(a.isNull(), b["x"]).when(b.isNull() | (a["at"] == b["at"]), a["x"])
                   .otherwise(a["x"] + (b["x"] - a["x"]) * slope).alias(name))
    return placed.groupBy(*by).agg(*picks).select(*by, *out)


def weighted_sd_corr(df: DataFrame, x: str, y: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted population SDs and correlation of two columns, centred on the overall weighted means."""
    w = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(weight))
    mean = lambda c: df.agg((F.sum(w * F.col(c)) / F.sum(w)).alias("v")).scalar()
    a, b = F.col(x) - mean(x), F.col(y) - mean(y)
    s = df.select(*by, w.alias("_w"), a.alias("_a"), b.alias("_b"))
    m = lambda *cols: F.sum(F.col("_w") * _product(cols)) / F.sum("_w")
    moments = s.groupBy(*by).agg(m("_a").alias("_ma"), m("_b").alias("_mb"), m("_a", "_a").alias("_aa"),
                                 m("_b", "_b").alias("_bb"), m("_a", "_b").alias("_ab"))
    va, vb = F.col("_aa") - F.col("_ma") ** 2, F.col("_bb") - F.col("_mb") ** 2
    cov = F.col("_ab") - F.col("_ma") * F.col("_mb")
    return moments.select(*by, F.sqrt(F.greatest(va, F.lit(0.0))).alias(f"sd_{x}"),
                          F.sqrt(F.greatest(vb, F.lit(0.0))).alias(f"sd_{y}"),
                          F.try_divide(cov, F.sqrt(F.greatest(va * vb, F.lit(0.0)))).alias("correlation"))


def _product(names: Sequence[str]) -> Column:
    out = F.col(names[0])
    for name in names[1:]:
        out = out * F.col(name)
    return out


def smd_of_moments(m1: Column, v1: Column, m0: Column, v0: Column) -> Column:
    """Standardised mean difference; null when the pooled SD is zero."""
    pooled = F.sqrt((v1 + v0) / 2.0)
    return F.when(pooled > 0, (m1 - m0) / pooled)


def smd(df: DataFrame, columns: Sequence[str], group: str, weight: Column | None = None) -> DataFrame:
    """Weighted standardised mean difference (population variances) of each column between two arms."""
    w = F.lit(1.0) if weight is None else weight
    long = _long(df.withColumn("_w", w), [group, "_w"], columns, "double").where("value is not null")
    means = long.groupBy("variable").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("_c"))
    centred = long.join(F.broadcast(means), "variable").withColumn("_x", F.col("value") - F.col("_c"))
    arms = centred.groupBy("variable", group).agg(
        (F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_m"),
        (F.sum(F.col("_w") * F.col("_x") * F.col("_x")) / F.sum("_w")).alias("_q"))
    pick = lambda a, c: F.max(F.when(F.col(group) == a, F.col(c)))
    both = arms.groupBy("variable").agg(*[pick(a, c).alias(f"{c}{a}") for a in (0, 1) for c in ("_m", "_q")])
    var = lambda a: F.greatest(F.col(f"_q{a}") - F.col(f"_m{a}") ** 2, F.lit(0.0))
    return both.select("variable", smd_of_moments(F.col("_m1"), var(1), F.col("_m0"), var(0)).alias("smd"))


def missing_profile(df: DataFrame, columns: Sequence[str], weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Missing count, percent and weighted percent of each column, overall and per grouping level."""
    flags = [F.col(c).isNull().cast("int").alias(c) for c in columns]
    marked = grouped_levels(df.withColumn("_w", F.col(weight)), ["_w", *flags], by)
    sums = marked.groupBy("group", "level").agg(
        F.count("*").alias("n"), F.sum("_w").alias("_tw"), *[F.sum(c).alias(c) for c in columns],
        *[F.sum(F.col("_w") * F.col(c)).alias(f"_w_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("missing_n"),
                              (100.0 * F.col(c) / F.col("n")).alias("missing_pct"),
                              (100.0 * F.col(f"_w_{c}") / F.col("_tw")).alias("weighted_missing_pct"))
                     for c in columns])
    return sums.select("group", "level", "n", F.inline(rows))


def code_frequencies(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts of every code of every column; nulls count as their own code."""
    return _long(df, by, columns, "string", value="code").groupBy(
        *by, "variable", F.coalesce("code", F.lit(MISSING)).alias("code")).agg(F.count("*").alias("n"))


def missing_patterns(df: DataFrame, columns: Sequence[str], weight: str) -> DataFrame:
    """Joint missingness patterns as joined column names, ``COMPLETE`` for none."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    pattern = F.when(F.size(names) == 0, F.lit("COMPLETE")).otherwise(F.array_join(names, "|"))
    total = df.agg(F.sum(weight).alias("v")).scalar()
    return df.groupBy(pattern.alias("pattern")).agg(
        F.count("*").alias("n"), (100 * F.sum(weight) / total).alias("weight_pct"))


def numeric_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample SD, range and exact quartiles of each numeric column."""
    keys = [*by, "variable"]
    long = _long(df, by, columns, "double").where("value is not null")
    basic = long.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"),
                                    F.stddev_samp("value").alias("sd"), F.min("value").alias("min"),
                                    F.max("value").alias("max"))
    return basic.join(exact_quantiles(long, keys, "value", QUARTILES), keys)


def categorical_profile(df: DataFrame, columns: Sequence[str], outcome: str, small: int) -> DataFrame:
    """Count, share and outcome rate of every level, with a flag for small groups."""
    long = _long(df, [outcome], columns, "string", value="level")
    n = df.agg(F.count("*").alias("v")).scalar()
    return long.groupBy("variable", F.coalesce("level", F.lit(MISSING)).alias("level")).agg(
        F.count("*").alias("n"), (100.0 * F.count("*") / n).alias("pct"), F.avg(outcome).alias("rate"),
        (F.count("*") < small).alias("small_group"))


def binary_profile(df: DataFrame, columns: Sequence[str], outcome: str) -> DataFrame:
    """Yes/no counts of 0/1 columns and the outcome rate on both sides."""
    long = _long(df, [outcome], columns, "int")
    yes, no = F.col("value") == 1, F.col("value") == 0
    return long.groupBy("variable").agg(
        F.count_if(yes).alias("n_yes"), F.count_if(no).alias("n_no"), F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.avg(F.when(yes, F.col(outcome))).alias("rate_yes"), F.avg(F.when(no, F.col(outcome))).alias("rate_no"))


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence, normalize: bool = False) -> DataFrame:
    """Contingency table with one column per level; ``normalize`` gives row percentages."""
    counts = [F.count_if(F.col(column) == v) for v in levels]
    total = F.count(F.when(F.col(column).isin(list(levels)), 1))
    return df.groupBy(row).agg(*[
        (F.try_divide(100.0 * c, total) if normalize else c).alias(f"{column}_{v}") for c, v in zip(counts, levels)])


def distinct_key_counts(df: DataFrame, keys: Mapping[str, Sequence[str]], published: Mapping[str, int]) -> DataFrame:
    """Distinct keys under several key definitions and their difference to a published count."""
    out = None
    for name, columns in keys.items():
        row = df.select(*columns).distinct().agg(F.count("*").alias("distinct_keys")).select(
            F.lit(name).alias("key_name"), "distinct_keys",
            (F.col("distinct_keys") - F.lit(published.get(name))).alias("difference"))
        out = row if out is None else out.unionByName(row)
    return out


def id_gaps(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct ids, their range and the integers of the range that are not used."""
    return df.groupBy(*by).agg(
        F.count_distinct(column).alias("distinct_ids"), F.min(column).alias("min_id"), F.max(column).alias("max_id"),
        (F.max(column) - F.min(column) + 1 - F.count_distinct(column)).alias("unused_ids"))


def key_consistency(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """For each column: number of keys, keys with more than one value (null counts as a value).

    Minimum and maximum decide whether a column varies, so no value set is collected.
    """
    varies = [((F.min(c) != F.max(c)) | (F.count_if(F.col(c).isNull()).between(1, F.count("*") - 1))) for c in columns]
    per_key = df.groupBy(*key).agg(*[F.coalesce(v, F.lit(False)).alias(c) for v, c in zip(varies, columns)])
    sums = per_key.agg(F.count("*").alias("keys"), *[F.count_if(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("inconsistent_keys")) for c in columns])
    return sums.select("keys", F.inline(rows))


def unit_rollup(df: DataFrame, unit: Sequence[str], order: Sequence[str], means: Sequence[str] = (),
                any_of: Sequence[str] = (), first: Sequence[str] = ()) -> DataFrame:
    """Features of a unit over its rows: size, means, "any" flags and the value at the first row."""
    at = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*unit).agg(
        F.count("*").alias("size"), *[F.avg(c).alias(f"mean_{c}") for c in means],
        *[F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"any_{c}") for c in any_of],
        *[F.min_by(c, at).alias(f"first_{c}") for c in first])


def support_cells(df: DataFrame, cells: Sequence[str], arm: str, minimum: int, weight: str,
                  also: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Rows per arm in every cell, whether each reaches the minimum, and the cell's weight share.

    ``also`` asks for the minimum in every combination of an extra column's values too.
    """
    tests = {f"n_{a}": F.col(arm) == a for a in (0, 1)}
    if also:
        (extra, values), = also.items()
        tests = {f"n_{a}_{v}": (F.col(arm) == a) & (F.col(extra) == v) for a in (0, 1) for v in values}
    total = df.agg(F.sum(weight).alias("v")).scalar()
    tokens = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in cells]
    out = df.groupBy(*tokens).agg(*[F.count_if(t).alias(n) for n, t in tests.items()],
                                  (100 * F.sum(weight) / total).alias("weight_pct"))
    adequate = None
    for name in tests:
        test = F.col(name) >= minimum
        adequate = test if adequate is None else adequate & test
    return out.withColumn("adequate", adequate)


def with_support(df: DataFrame, cells: Sequence[str], arm: str, minimum: int, weight: str, out: str = "supported",
                 also: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Mark rows whose cell has enough rows in every arm.

    The cells are stored first, so that the rows are not shuffled to meet a small table.
    """
    good = stored_side(support_cells(df, cells, arm, minimum, weight, also).where("adequate").select(
        *[F.col(c).alias(f"_cell_{c}") for c in cells], F.lit(True).alias("_ok")))
    match = None
    for c in cells:
        test = F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) == F.col(f"_cell_{c}")
        match = test if match is None else match & test
    return df.join(good, match, "left").withColumn(out, F.coalesce("_ok", F.lit(False))).drop(
        "_ok", *[f"_cell_{c}" for c in cells])


def marginal_support(train: DataFrame, target: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
                     arm: str, weight: str) -> DataFrame:
    """Target weight percent on levels absent from, or values outside the range of, each training arm."""
    total = target.agg(F.sum(weight).alias("v")).scalar()
    out = []
    if categorical:
        levels = lambda df, keep: _long(df, keep, categorical, "string", value="level").withColumn(
            "level", F.coalesce("level", F.lit(MISSING)))
        weights = levels(target, [weight]).groupBy("variable", "level").agg(F.sum(weight).alias("_w"))
        arms = levels(train.where(F.col(arm).isin(0, 1)), [arm]).groupBy("variable", "level").agg(
            *[(F.count_if(F.col(arm) == a) > 0).alias(f"_in{a}") for a in (0, 1)])
        joined = weights.join(arms, ["variable", "level"], "left")
        cells = F.array(*[F.struct(F.lit(a).alias("arm"), F.when(F.coalesce(f"_in{a}", F.lit(False)), 0.0).otherwise(
            F.col("_w")).alias("_out")) for a in (0, 1)])
        out.append(joined.select("variable", F.inline(cells)).groupBy("variable", "arm").agg(
            (100 * F.sum("_out") / total).alias("target_weight_pct")).withColumn("check", F.lit("absent_level")))
    if numeric:
        bounds = train.agg(*[f(F.when(F.col(arm) == a, F.col(c))).alias(f"_{n}_{c}_{a}")
                             for c in numeric for a in (0, 1) for n, f in (("lo", F.min), ("hi", F.max))])
        edge = lambda name: bounds.select(name).scalar()
        sums = [F.coalesce(F.sum(F.when(~F.col(c).between(edge(f"_lo_{c}_{a}"), edge(f"_hi_{c}_{a}")), F.col(weight))),
                           F.lit(0.0)).alias(f"_o_{c}_{a}") for c in numeric for a in (0, 1)]
        rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.lit(a).alias("arm"),
                                  (100 * F.col(f"_o_{c}_{a}") / F.col("_t")).alias("target_weight_pct"))
                         for c in numeric for a in (0, 1)])
        out.append(target.agg(F.sum(weight).alias("_t"), *sums).select(F.inline(rows)).withColumn(
            "check", F.lit("outside_range")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def pure_cells(train: DataFrame, reference: DataFrame, columns: Sequence[str], outcome: str, weight: str) -> DataFrame:
    """Levels whose training rows all share one outcome, with the reference weight they carry."""
    level = F.coalesce("level", F.lit(MISSING)).alias("level")
    cells = _long(train, [outcome], columns, "string", value="level").groupBy("variable", level).agg(
        F.count("*").alias("n"), F.sum(outcome).alias("events"), F.min(outcome).alias("_lo"), F.max(outcome).alias("_hi"))
    shares = _long(reference, [weight], columns, "string", value="level").groupBy("variable", level).agg(
        F.sum(weight).alias("_w"))
    total = reference.agg(F.sum(weight).alias("v")).scalar()
    return cells.where("_lo = _hi").join(shares, ["variable", "level"], "left").select(
        "variable", "level", "n", "events", (100 * F.coalesce("_w", F.lit(0.0)) / total).alias("reference_weight_pct"))


def duplicate_keys(df: DataFrame, key: Sequence[str], reject: bool = False) -> DataFrame:
    """Keys that occur more than once; with ``reject`` their presence is an error."""
    repeated = df.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")
    if reject and repeated.limit(1).count():
        raise ValueError(f"Duplicate keys {list(key)}")
    return repeated


def rollup_importance(scores: DataFrame, mapping: DataFrame, feature: str, score: str, original: str,
                      domain: str) -> DataFrame:
    """Sum encoded-feature scores by original feature with domain totals and shares in percent."""
    originals = scores.join(mapping, feature).groupBy(domain, original).agg(F.sum(score).alias("importance"))
    domains = originals.groupBy(domain).agg(F.sum("importance").alias("domain_importance"))
    total = domains.agg(F.sum("domain_importance").alias("v")).scalar()
    return originals.join(domains, domain).select(
        domain, original, "importance", (100 * F.col("importance") / total).alias("share_pct"),
        "domain_importance", (100 * F.col("domain_importance") / total).alias("domain_share_pct"))


def coverage_audit(df: DataFrame, eligible: Column, cells: Sequence[str], weight: str) -> DataFrame:
    """Matched rows and weight per cell, as percent of the cell and of the cohort."""
    total = df.agg(F.sum(weight).alias("v")).scalar()
    ok, w = F.coalesce(eligible, F.lit(False)), F.col(weight)
    matched = F.coalesce(F.sum(F.when(ok, w)), F.lit(0.0))
    return df.groupBy(*cells).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("matched_n"), matched.alias("matched_weight"),
        (100 * matched / F.sum(w)).alias("matched_pct_of_cell"), (100 * matched / total).alias("matched_pct_of_cohort"))
