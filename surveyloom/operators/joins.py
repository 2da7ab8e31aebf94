"""Audited joins, zero alignment, time-aware lookups and linear contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.scale import broadcast_if_small, running_last


def _require_unique(df: DataFrame, on: Sequence[str], side: str) -> None:
    if df.groupBy(*on).count().where("count > 1").limit(1).count():
        raise ValueError(f"{side} side repeats join keys {list(on)}")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "m:1",
                 require_match: bool = False, indicator: str | None = None) -> DataFrame:
    """Equi join with a cardinality check and, on request, a complete-match check."""
    if validate not in ("m:1", "1:1"):
        raise ValueError("validate must be 'm:1' or '1:1'")
    on = list(on)
    _require_unique(right, on, "right")
    if validate == "1:1":
        _require_unique(left, on, "left")
    if require_match and left.join(right.select(*on), on, "left_anti").limit(1).count():
        raise ValueError(f"Left rows without a match on {on}")
    if indicator:
        right = right.withColumn(indicator, F.lit(True))
    joined = left.join(broadcast_if_small(right), on, how)
    return joined.withColumn(indicator, F.coalesce(indicator, F.lit(False))) if indicator else joined


def missing_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys of the left table that the right one lacks."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), list(on), "left_anti")


def member_rows(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows whose key occurs in the right table."""
    return left.join(right.select(*on).distinct(), list(on), "left_semi")


def align_zero(totals: DataFrame, roster: DataFrame, keys: Sequence[str], values: Sequence[str],
               marker: str = "in_domain") -> DataFrame:
    """Extend cluster totals by the roster's other clusters, with zeros.

    Totals of a cluster outside the roster make the job fail when it runs; the check
    rides on the join instead of a pass of its own.
    """
    keys = list(keys)
    joined = roster.select(*keys, F.lit(True).alias("_known")).join(
        totals.withColumn(marker, F.lit(True)), keys, "full_outer")
    checked = joined.where(F.assert_true("_known", "Totals contain clusters that are absent from the roster").isNull())
    return checked.select(*keys, *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values],
                          F.coalesce(marker, F.lit(False)).alias(marker))


def asof_snapshot(events: DataFrame, snapshots: DataFrame, by: str, at: str, snapshot_at: str, value: str,
                  eligible: str, max_age: float | None = None) -> DataFrame:
    """Newest snapshot strictly before each event.

    A flagged (ineligible) snapshot gives null instead of an older one, and so does
    one older than ``max_age``. ``(by, snapshot_at)`` must be unique. Only distinct
    event times take part in the search, inside time buckets of each unit.
    """
    _require_unique(snapshots, [by, snapshot_at], "snapshot")
    found = F.struct(F.col(snapshot_at).alias("snapshot_at"), F.col(value).alias("value"),
                     F.col(eligible).alias("eligible"))
    marks = snapshots.where(F.col(snapshot_at).isNotNull()).select(
        by, F.col(snapshot_at).alias(at), F.lit(1).alias("_kind"), found.alias("_snapshot"))
    times = events.where(F.col(at).isNotNull() & F.col(by).isNotNull()).select(by, at).distinct().withColumn(
        "_kind", F.lit(0))
    line = times.unionByName(marks, allowMissingColumns=True)
    placed = running_last(line, [by], at, "_kind", "_snapshot", "_found").where("_kind = 0").select(
        by, at, "_found")
    age = F.col(at) - F.col("_found.snapshot_at")
    usable = F.col("_found.eligible")
    if max_age is not None:
        usable = usable & (age <= max_age)
    return events.join(placed, [by, at], "left").select(
        *events.columns, F.col("_found.snapshot_at").alias("snapshot_at"), age.alias("snapshot_age"),
        F.when(usable, F.col("_found.value")).alias(value))


def lagged_period_lookup(df: DataFrame, table: DataFrame, unit: str, year: Column, month: Column, period: str,
                         value: str, fiscal_start_month: int = 4, lag: int = 1,
                         unstable: Column | None = None, out_period: str = "lookup_period") -> DataFrame:
    """Value of the unit's preceding fiscal year; null where the unit's borders were unstable.

    ``unstable`` may use the derived column ``out_period``.
    """
    _require_unique(table, [unit, period], "lookup")
    keyed = df.withColumn(out_period, (year - F.when(month < fiscal_start_month, 1).otherwise(0) - lag).cast("int"))
    side = table.select(unit, F.col(period).alias(out_period), F.col(value).alias("_value"))
    joined = keyed.join(broadcast_if_small(side), [unit, out_period], "left")
    result = F.col("_value") if unstable is None else F.when(~unstable, F.col("_value"))
    return joined.withColumn(value, result).drop("_value")


def leave_one_group_out(df: DataFrame, group: str, numerator: Column, denominator: Column) -> DataFrame:
    """Ratio of sums without each group, from one set of group sums."""
    sums = df.groupBy(group).agg(F.sum(numerator).alias("_num"), F.sum(denominator).alias("_den"))
    num = sums.agg(F.sum("_num").alias("v")).scalar()
    den = sums.agg(F.sum("_den").alias("v")).scalar()
    return sums.select(group, (num / den).alias("all_groups"),
                       F.try_divide(num - F.col("_num"), den - F.col("_den")).alias("without_group"))


def apply_contrasts(theta: DataFrame, contrasts: DataFrame) -> DataFrame:
    """Linear combinations: ``theta(key, estimate)`` with ``contrasts(contrast, key, coef)``."""
    return contrasts.join(theta, "key").groupBy("contrast").agg(
        F.sum(F.col("coef") * F.col("estimate")).alias("estimate"))


def contrast_covariance(cov: DataFrame, contrasts: DataFrame) -> DataFrame:
    """``L V L'`` for long tables ``cov(row_key, col_key, cov)`` and ``contrasts(contrast, key, coef)``."""
    left = contrasts.select(F.col("contrast").alias("row_contrast"), F.col("key").alias("row_key"),
                            F.col("coef").alias("_c1"))
    right = contrasts.select(F.col("contrast").alias("col_contrast"), F.col("key").alias("col_key"),
                             F.col("coef").alias("_c2"))
    return cov.join(left, "row_key").join(right, "col_key").groupBy("row_contrast", "col_contrast").agg(
        F.sum(F.col("_c1") * F.col("_c2") * F.col("cov")).alias("cov"))


def compare_to_baseline(new: DataFrame, old: DataFrame, keys: Sequence[str], values: Sequence[str],
                        tolerance: float) -> DataFrame:
    """One row per value column: matched and unmatched keys, largest difference, verdict."""
    keys = list(keys)
    _require_unique(new, keys, "new")
    _require_unique(old, keys, "old")
    a = new.select(*keys, F.lit(True).alias("_new"), *[F.col(v).alias(f"_a_{v}") for v in values])
    b = old.select(*keys, F.lit(True).alias("_old"), *[F.col(v).alias(f"_b_{v}") for v in values])
    both = a.join(b, keys, "full_outer")
    rows = F.array(*[F.struct(F.lit(v).alias("value"), F.abs(F.col(f"_a_{v}") - F.col(f"_b_{v}")).alias("gap"))
                     for v in values])
    return both.select("_new", "_old", F.inline(rows)).groupBy("value").agg(
        F.count_if(F.col("_new") & F.col("_old")).alias("matched"),
        F.count_if(F.col("_old").isNull()).alias("only_new"),
        F.count_if(F.col("_new").isNull()).alias("only_old"),
        F.max("gap").alias("max_abs_difference"),
    ).withColumn("reproduced", (F.col("only_new") == 0) & (F.col("only_old") == 0)
                 & F.coalesce(F.col("max_abs_difference") <= tolerance, F.lit(False)))


def broadcast_group_value(df: DataFrame, unit_values: DataFrame, unit: str) -> DataFrame:
    """Give every row the value of its unit (for example a person's value on all their events)."""
    return checked_join(df, unit_values, [unit], "left", "m:1")
