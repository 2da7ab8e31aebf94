"""Set operations on units, codes and design keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.design import SurveyDesign


def common_units(df: DataFrame, unit: str, period: str, arm: str, arms: Sequence, periods: Sequence,
                 minimum: int) -> DataFrame:
    """Units with at least ``minimum`` rows in every arm of every listed period."""
    enough = None
    counts = df.where(F.col(period).isin(list(periods))).groupBy(unit, period).agg(
        *[F.count_if(F.col(arm) == value).alias(f"_n{i}") for i, value in enumerate(arms)])
    for i in range(len(arms)):
        test = F.col(f"_n{i}") >= minimum
        enough = test if enough is None else enough & test
    return counts.where(enough).groupBy(unit).agg(F.count("*").alias("periods")).where(
        F.col("periods") == len(periods))


def codes_only_in(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes that occur in only one of two tables, for each variable."""
    def codes(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("code"))
                          for c in columns])
        return df.select(F.inline(pairs)).where("code is not null").distinct()

    first, second = codes(a), codes(b)
    return first.exceptAll(second).withColumn("only_in", F.lit("first")).unionByName(
        second.exceptAll(first).withColumn("only_in", F.lit("second")))


def union_waves(frames: Mapping[str, DataFrame], tag: str = "wave") -> DataFrame:
    """Stack tables by column name with a tag column."""
    out = None
    for value, df in frames.items():
        tagged = df.withColumn(tag, F.lit(value))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def frame_difference(first: DataFrame, second: DataFrame, design: SurveyDesign) -> DataFrame:
    """Clusters shared by two design frames, extra in either, and singleton strata the second resolves."""
    keys = design.cluster
    a, b = first.select(*keys).distinct(), second.select(*keys).distinct()
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), keys, "full_outer")
    strata = both.groupBy(*design.strata).agg(
        F.sum(F.coalesce("_a", F.lit(0))).alias("_na"), F.sum(F.coalesce("_b", F.lit(0))).alias("_nb"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("_shared"))
    return strata.agg(
        F.sum("_shared").alias("shared_psus"),
        F.sum(F.col("_na") - F.col("_shared")).alias("only_first_psus"),
        F.sum(F.col("_nb") - F.col("_shared")).alias("only_second_psus"),
        F.count_if(F.col("_na") == 1).alias("first_singleton_strata"),
        F.count_if(F.col("_nb") == 1).alias("second_singleton_strata"),
        F.count_if((F.col("_na") == 1) & (F.col("_nb") > 1)).alias("singletons_resolved"))
