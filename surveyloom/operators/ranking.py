"""Latest records, ranks, bins, hash splits, folds and samples.

Orders over whole groups are split into buckets (see ``scale``); per-key maxima are
aggregates. Only tables of bounded size (test families, cells) use plain windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions.hashing import digest
from surveyloom.operators.scale import exact_quantiles, growing_side, hash_ranks, running_sums


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key: the largest in ``order``. A hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*key, "_row.*").select(*df.columns)


def holm(df: DataFrame, p: str, family: Sequence[str], tie: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values within a family of tests; ties keep ``tie`` order.

    Tests without a p-value rank last, do not count and stay unadjusted.
    """
    ordered = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last(), *tie)
    size = F.count(p).over(Window.partitionBy(*family))
    ranked = df.withColumns({"holm_rank": F.row_number().over(ordered), "family_size": size})
    step = (F.col("family_size") - F.col("holm_rank") + 1) * F.col(p)
    running = F.max("_step").over(
        Window.partitionBy(*family).orderBy("holm_rank").rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.withColumn("_step", step).withColumn(
        "holm_p", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), running))).drop("_step")
    return out.withColumns({
        "reject": F.col("holm_p") <= alpha,
        "overturned": (F.col(p) <= alpha) & ~(F.col("holm_p") <= alpha)})


def quantile_bins(df: DataFrame, value: str, reference: Column, bins: int, out: str = "bin") -> DataFrame:
    """Bins cut at quantiles of the reference rows; repeated or extreme cuts are dropped, outer edges are open."""
    chosen = df.where(reference)
    names = {f"q{i}": i / bins for i in range(1, bins)}
    extremes = chosen.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    cuts = exact_quantiles(chosen, [], value, names).select(
        F.array_distinct(F.array(*names)).alias("edges"), extremes.select("low").scalar().alias("low"),
        extremes.select("high").scalar().alias("high"))
    inner = cuts.select(F.filter("edges", lambda e: (e > F.col("low")) & (e < F.col("high"))).alias("v")).scalar()
    number = 1 + F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return df.withColumn("_edges", inner).withColumn(out, F.concat(F.lit("Q"), number.cast("string"))).drop("_edges")


def hash_split(df: DataFrame, units: Sequence[str], by: Sequence[str], fraction: float, seed: int,
               out: str = "holdout") -> DataFrame:
    """Hold out a fixed share of whole units in every group, chosen by hash order.

    ``max(1, round(fraction * n))`` but at most ``n - 1`` of a group's ``n`` units.
    """
    keys = [*by, *units]
    ranked = hash_ranks(df.select(*keys).distinct().withColumn("_h", digest(seed, *keys)), by, "_h")
    n = F.col("group_size")
    held = F.least(n - 1, F.greatest(F.lit(1), F.bround(n * F.lit(float(fraction)), 0).cast("long")))
    return df.join(ranked.select(*keys, (F.col("rank") <= held).alias(out)), keys)


def grouped_partition(df: DataFrame, group: str, label: str, fractions: tuple[float, float, float],
                      seed: int, out: str = "partition") -> DataFrame:
    """Train, validation and test parts that never split a group, balanced on the group's label rate."""
    if abs(sum(fractions) - 1) > 1e-9 or any(not 0 < f < 1 for f in fractions):
        raise ValueError("Expected three positive fractions that sum to 1")
    groups = df.groupBy(group).agg((F.avg(label) >= 0.5).cast("int").alias("_majority"))
    ranked = hash_ranks(groups.withColumn("_h", digest(seed, group)), ["_majority"], "_h")
    cut = lambda f: F.bround(F.col("group_size") * F.lit(f), 0)
    part = (F.when(F.col("rank") <= cut(fractions[0]), "train")
            .when(F.col("rank") <= cut(fractions[0] + fractions[1]), "validation").otherwise("test"))
    return df.join(ranked.select(group, part.alias(out)), group)


def stratified_group_folds(df: DataFrame, group: Sequence[str], label: str, k: int, seed: int,
                           out: str = "fold", within: Sequence[str] = ()) -> DataFrame:
    """Folds 0..k-1 that keep groups whole and spread label rates: hash order dealt out per rate class.

    Each level of ``within`` is dealt out alone, as if the others did not exist.
    """
    group = [*within, *group]
    groups = df.groupBy(*group).agg(F.floor(F.avg(F.col(label).cast("double")) * 4).cast("int").alias("_class"))
    ranked = hash_ranks(groups.withColumn("_h", digest(seed, *group[len(within):])), [*within, "_class"], "_h")
    fold = F.pmod(F.col("rank") - 1 + F.col("_class"), F.lit(k)).cast("int")
    return df.join(growing_side(ranked.select(*group, fold.alias(out))), list(group))


def stratified_sample(df: DataFrame, label: str, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) with class shares kept, repeatable.

    Each class gets the whole part of ``n * class share``; the rows still missing go to the classes
    with the largest remainders, ties to the smaller label.
    """
    ranked = hash_ranks(df.withColumn("_h", digest(seed, *key)), [label], "_h", "_rank", "_size")
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy()  # over one row per class
    share = sizes.withColumn("_all", F.sum("_n").over(whole)).withColumn("_exact", F.least(F.lit(n), F.col("_all")) * F.col("_n"))
    base = share.withColumn("_base", F.expr("_exact div _all")).withColumn("_left", F.expr("_exact % _all"))
    spare = F.least(F.lit(n), F.col("_all")) - F.sum("_base").over(whole)
    turn = F.row_number().over(whole.orderBy(F.desc("_left"), F.col(label)))
    quotas = base.select(F.col(label).alias("_label"), (F.col("_base") + (turn <= spare).cast("long")).alias("_quota"))
    return (ranked.join(quotas, F.col(label).eqNullSafe(F.col("_label"))).where(F.col("_rank") <= F.col("_quota")).select(*df.columns))


def ranked_table(df: DataFrame, metric: str, k: int, tie: Sequence[str], ascending: bool = False) -> DataFrame:
    """Top ``k`` rows of a result table with their rank."""
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    top = df.orderBy(order, *tie).limit(k)
    return top.withColumn("rank", F.rank().over(Window.orderBy(order)))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mid-rank of every distinct value, with the number of rows that share it."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    run = running_sums(counts, by, value, {"n": F.col("ties")})
    return run.select(*by, value, "ties", (F.col("n_before") + (F.col("ties") + 1) / 2.0).alias("average_rank"))
