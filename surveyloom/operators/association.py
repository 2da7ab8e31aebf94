"""Rank tests, contingency tests and correlations from aggregates of distinct values."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.recode import MISSING
from surveyloom.functions.special import chi2_p_value, normal_p_value
from surveyloom.operators.profile import _long, code_frequencies, missing_profile
from surveyloom.operators.scale import cut, exact_quantiles, running_sums


def effect_label(effect: Column) -> Column:
    size = F.abs(effect)
    return (F.when(effect.isNull(), "Not available").when(size < 0.10, "Negligible").when(size < 0.30, "Small")
            .when(size < 0.50, "Moderate").otherwise("Large"))


def _middle(arm: int) -> Column:
    """Median of one group from running counts: mean of the values at the two middle positions."""
    n, before, here = F.col(f"c{arm}_total"), F.col(f"c{arm}_before"), F.col(f"_c{arm}")
    at = lambda i: F.max(F.when((before <= i) & (i < before + here), F.col("value")))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def mann_whitney(df: DataFrame, columns: Sequence[str], group: str, p_value: bool = True) -> DataFrame:
    """Two-sample rank test of each column between group 0 and group 1.

    U counts pairs won by group 0 with ties as half. The p-value is the two-sided
    normal approximation with tie and continuity correction.
    """
    long = _long(df, [group], columns, "double").where(f"value is not null and {group} in (0, 1)")
    cells = long.groupBy("variable", "value").agg(
        F.count_if(F.col(group) == 0).alias("_c0"), F.count_if(F.col(group) == 1).alias("_c1"))
    run = running_sums(cells, ["variable"], "value", {"c0": F.col("_c0"), "c1": F.col("_c1")})
    c0, c1 = F.col("_c0").cast("double"), F.col("_c1").cast("double")
    t = c0 + c1
    sums = run.groupBy("variable").agg(
        F.sum("_c0").alias("n_0"), F.sum("_c1").alias("n_1"),
        F.sum(c0 * (F.col("c1_before") + 0.5 * c1)).alias("u_statistic"), F.sum(t * t * t - t).alias("_ties"),
        *[_middle(a).alias(f"median_{a}") for a in (0, 1)])
    n0, n1, u = F.col("n_0").cast("double"), F.col("n_1").cast("double"), F.col("u_statistic")
    n = n0 + n1
    sd = F.sqrt(n0 * n1 / 12.0 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = F.try_divide(F.greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5, sd)
    effect = 1 - 2 * u / (n0 * n1)
    out = sums.select(
        "variable", "n_0", "n_1", "median_0", "median_1",
        (F.col("median_1") - F.col("median_0")).alias("median_difference"), "u_statistic",
        z.alias("z"), effect.alias("rank_biserial"), effect_label(effect).alias("magnitude"))
    return out.withColumn("p_value", F.least(F.lit(1.0), normal_p_value("z"))) if p_value else out


def contingency(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson statistic of each column against the target from one contingency aggregate.

    Rows with a null on either side are left out. Two-by-two tables get the
    continuity correction, limited to the size of the deviation.
    """
    long = _long(df.where(F.col(target).isNotNull()), [F.col(target).cast("string").alias("_t")], columns, "string",
                 value="_l").where("_l is not null")
    cells = long.groupBy("variable", "_l", "_t").agg(F.count("*").cast("double").alias("_o"))
    rows = cells.groupBy("variable", "_l").agg(F.sum("_o").alias("_r"), F.sum(F.lit(1)).alias("_filled"))
    cols = cells.groupBy("variable", "_t").agg(F.sum("_o").alias("_c"))
    shape = rows.groupBy("variable").agg(F.count("*").alias("rows"), F.sum("_r").alias("n")).join(
        cols.groupBy("variable").agg(F.count("*").alias("columns")), "variable")
    expected = rows.join(cols, "variable").join(cells, ["variable", "_l", "_t"], "left").join(shape, "variable")
    e = F.col("_r") * F.col("_c") / F.col("n")
    gap = F.abs(F.coalesce("_o", F.lit(0.0)) - e)
    small = (F.col("rows") == 2) & (F.col("columns") == 2)
    gap = F.when(small, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    return expected.groupBy("variable", "rows", "columns", "n").agg(F.sum(gap * gap / e).alias("chi_square"))


def chi_square(df: DataFrame, columns: Sequence[str], target: str, p_value: bool = True) -> DataFrame:
    """Chi-square statistic, degrees of freedom and p-value of each column against the target."""
    out = contingency(df, columns, target).select(
        "variable", "n", "chi_square", ((F.col("rows") - 1) * (F.col("columns") - 1)).alias("df"))
    return out.withColumn("p_value", chi2_p_value("chi_square", F.col("df").cast("double"))) if p_value else out


def cramers_v(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Bias-corrected Cramer's V and its magnitude label."""
    n, r, c = F.col("n"), F.col("rows"), F.col("columns")
    phi = F.greatest(F.lit(0.0), F.try_divide(F.col("chi_square"), n) - F.try_divide((c - 1) * (r - 1), n - 1))
    depth = F.least(r - F.try_divide((r - 1) * (r - 1), n - 1) - 1, c - F.try_divide((c - 1) * (c - 1), n - 1) - 1)
    v = F.when(depth > 0, F.sqrt(phi / depth))
    return contingency(df, columns, target).select(
        "variable", "n", "chi_square", v.alias("cramers_v"), effect_label(v).alias("magnitude"))


def spearman_pairs(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """Pairwise-complete Spearman correlation of every column pair and whether it reaches the threshold.

    A value's rank among the rows that also have another column follows from counts per distinct value and
    other column, so each column is ranked once for all its pairs. Rows are stored once; a value meets
    its ranks in one shuffle and its row in a second, and all pairs are sums of one aggregate.
    """
    k, names = range(len(columns)), list(combinations(range(len(columns)), 2))
    stored = cut(df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).withColumn(
        "_row", F.monotonically_increasing_id()))
    present = F.array(*[F.col(f"_{i}").isNotNull().cast("int") for i in k])
    long = stored.select("_row", present.alias("_with"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("column"), F.col(f"_{i}").alias("value")) for i in k]))).where("value is not null")
    counts = long.groupBy("column", "value").agg(*[F.sum(F.col("_with")[j]).alias(f"_c{j}") for j in k])
    run = running_sums(counts, ["column"], "value", {f"n{j}": F.col(f"_c{j}") for j in k})
    ranks = run.select("column", "value", F.array(*[
        F.col(f"n{j}_before") + (F.col(f"_c{j}") + 1) / 2.0 - (F.col(f"n{j}_total") + 1) / 2.0 for j in k]).alias("_rank"))
    rows = long.select("_row", "column", "value").join(ranks, ["column", "value"]).groupBy("_row").agg(
        *[F.max(F.when(F.col("column") == i, F.col("_rank"))).alias(f"_r{i}") for i in k])
    sums = []
    for q, (i, j) in enumerate(names):
        a, b = F.col(f"_r{i}")[j], F.col(f"_r{j}")[i]
        both = a.isNotNull() & b.isNotNull()
        total = lambda v: F.sum(F.when(both, v))  # noqa: B023,E731
        rho = F.try_divide(total(a * b), F.sqrt(total(a * a) * total(b * b)))
        sums.append(F.struct(F.lit(columns[i]).alias("first"), F.lit(columns[j]).alias("second"), F.count_if(both).alias("n"), rho.alias("spearman")))
    return rows.agg(F.array(*sums).alias("_pairs")).select(F.inline("_pairs")).where("n > 0").withColumn(
        "flagged", F.coalesce(F.abs("spearman") >= threshold, F.lit(False)))


def two_wave_profile(df: DataFrame, wave: str, columns: Sequence[str], weight: str) -> DataFrame:
    """Per wave and column: rows, missing percent, distinct codes and the most frequent code's count."""
    missing = missing_profile(df, columns, weight, [wave]).where(F.col("group") == wave).select(
        F.col("level").alias(wave), "variable", "n", "missing_pct", "weighted_missing_pct")
    codes = code_frequencies(df, columns, [wave]).where(F.col("code") != MISSING).groupBy(
        F.col(wave).cast("string").alias(wave), "variable").agg(
        F.count("*").alias("distinct_codes"), F.max("n").alias("largest_code_n"))
    return missing.join(codes, [wave, "variable"], "left")


def two_wave_weights(df: DataFrame, wave: str, weight: str) -> DataFrame:
    """Weight quantiles per wave."""
    return exact_quantiles(df, [wave], weight, {"min": 0.0, "p05": 0.05, "median": 0.5, "p95": 0.95, "max": 1.0})


__all__ = ["chi_square", "contingency", "cramers_v", "effect_label", "mann_whitney",
           "spearman_pairs", "two_wave_profile", "two_wave_weights"]
