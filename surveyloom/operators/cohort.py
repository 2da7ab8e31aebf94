"""Eligibility, wave mapping and unit harmonisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.scale import broadcast_if_small


def rename_map(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename mnemonic columns; a missing source column is an error."""
    absent = set(names) - set(df.columns)
    if absent:
        raise ValueError(f"Columns to rename are absent: {sorted(absent)}")
    return df.withColumnsRenamed(dict(names))


def first_failed_rule(rules: Sequence[tuple[str, Column]], kept: str = "kept") -> Column:
    """Name of the first eligibility rule a row does not meet; null tests count as not met."""
    out = None
    for name, passes in rules:
        failed = ~F.coalesce(passes, F.lit(False))
        out = F.when(failed, F.lit(name)) if out is None else out.when(failed, F.lit(name))
    return out.otherwise(F.lit(kept))


def cohort_waterfall(df: DataFrame, rules: Sequence[tuple[str, Column]], weight: str,
                     arms: Mapping[str, Column]) -> DataFrame:
    """Rows, arm counts and weight share by first failed rule, from one pass over the data.

    Rows that pass everything are reported under ``kept``; filter the input with
    ``first_failed_rule(rules) == 'kept'`` for the cohort itself.
    """
    stage = df.groupBy(first_failed_rule(rules).alias("rule")).agg(
        F.count("*").alias("n"),
        *[F.count_if(condition).alias(f"n_{arm}") for arm, condition in arms.items()],
        F.sum(weight).alias("weight"))
    total = df.agg(F.sum(weight).alias("v")).scalar()
    return stage.select("rule", "n", *[f"n_{arm}" for arm in arms], (100 * F.col("weight") / total).alias("weight_pct"))


def map_wave_columns(df: DataFrame, wave: str, mapping: Mapping[str, Mapping], values: Mapping) -> DataFrame:
    """Bring one construct that has a different column per wave under one name.

    ``mapping[construct][wave value]`` names the raw column; ``values`` recodes the
    raw codes. A code outside ``values`` is an error.
    """
    pairs = [F.lit(x) for item in values.items() for x in item]
    codes = F.create_map(*pairs)
    out, checks = df, []
    for construct, raw in mapping.items():
        picked = None
        for value, column in raw.items():
            test = F.col(wave) == value
            picked = F.when(test, F.col(column)) if picked is None else picked.when(test, F.col(column))
        checks.append(F.count_if(picked.isNotNull() & ~picked.isin(list(values))).alias(construct))
        out = out.withColumn(construct, F.try_element_at(codes, picked))
    bad = {k: n for k, n in df.agg(*checks).first().asDict().items() if n}
    if bad:
        raise ValueError(f"Codes outside the declared set: {bad}")
    return out


def harmonize_units(df: DataFrame, crosswalk: DataFrame, keys: Sequence[str], unit: str,
                    require_all: bool = True) -> DataFrame:
    """Map round-specific codes to a common unit and keep the original code.

    ``crosswalk`` has one row per key; an unmapped code is an error unless
    ``require_all`` is off.
    """
    used = df.select(*keys).distinct()
    if require_all:
        lost = used.join(crosswalk.select(*keys).distinct(), list(keys), "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"Unmapped codes: {[tuple(r) for r in lost]}")
    return df.join(broadcast_if_small(crosswalk.select(*keys, unit)), list(keys), "left")


def same_unit_sets(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: units only in the first and only in the second table, and equality."""
    left, right = a.select(column).distinct(), b.select(column).distinct()
    only_left = left.join(right, column, "left_anti").agg(F.count("*").alias("v")).scalar()
    only_right = right.join(left, column, "left_anti").agg(F.count("*").alias("v")).scalar()
    return left.agg(F.count("*").alias("n_first")).select(
        "n_first", only_left.alias("only_first"), only_right.alias("only_second"),
        ((only_left == 0) & (only_right == 0)).alias("same_units"))


def restrict_binary_exposure(df: DataFrame, column: str, treated, control, required: Sequence[str] = (),
                             out: str = "exposure") -> DataFrame:
    """Keep two exposure values and code them 1 and 0; nulls in required columns are an error."""
    kept = df.where(F.col(column).isin(treated, control)).withColumn(
        out, F.when(F.col(column) == treated, 1).otherwise(0))
    if required:
        nulls = kept.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first().asDict()
        bad = {k: n for k, n in nulls.items() if n}
        if bad:
            raise ValueError(f"Null values in required columns: {bad}")
    return kept
