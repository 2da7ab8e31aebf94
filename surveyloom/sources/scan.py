"""Readers. Checks run as one aggregate before the lazy result is returned."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.design import SurveyDesign
from surveyloom.operators.scale import broadcast_if_small


def scan_microdata(spark: SparkSession, path: str, columns: Sequence[str], schema: str | None = None) -> DataFrame:
    """Read only the needed columns of a Parquet table; a known ``schema`` saves the look into the files."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path).select(*columns)


def scan_lookup(spark: SparkSession, path: str, schema: str, key: Sequence[str],
                ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Read a CSV context table; reject repeated keys and non-finite or out-of-range values."""
    df = spark.read.schema(schema).csv(path, header=True)
    bad = [F.count_if(~F.coalesce(F.col(c).between(low, high) & ~F.isnan(F.col(c).cast("double")), F.lit(False)))
           .alias(c) for c, (low, high) in ranges.items()]
    if bad:
        counts = df.agg(*bad).first().asDict()
        wrong = {c: n for c, n in counts.items() if n}
        if wrong:
            raise ValueError(f"Values missing or out of range: {wrong}")
    if df.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError(f"Duplicate keys in lookup table: {list(key)}")
    return df


def bind_labels(df: DataFrame, labels: DataFrame, code: str, label: str, label_code: str | None = None) -> DataFrame:
    """Add the label of a code; fail when a used code has no label or several."""
    label_code = label_code or code
    bound = labels.select(F.col(label_code).alias(code), F.col(label).alias(label)).distinct()
    codes = df.select(code).distinct()
    audit = codes.join(bound, code, "left").groupBy(code).agg(F.count(label).alias("n")).where("n <> 1")
    problem = audit.limit(5).collect()
    if problem:
        raise ValueError(f"Codes without exactly one label: {[r[code] for r in problem]}")
    return df.join(broadcast_if_small(bound), code, "left")


def design_roster(df: DataFrame, design: SurveyDesign) -> DataFrame:
    """Distinct design keys of a complete file.

    A key value that is not a non-negative integer makes the job fail when it runs. Integers keep
    every digit; a value that is only readable as a double must lie below 2**53, where doubles
    still tell neighbouring integers apart.
    """
    checked = []
    for c in design.cluster:
        text = F.col(c).cast("string")
        whole, number = text.try_cast("long"), text.try_cast("double")
        exact = (number == F.floor(number)) & (F.abs(number) < 2.0**53)
        key = F.coalesce(whole, F.when(exact, number.try_cast("long")))
        checked.append(F.when(F.coalesce(key >= 0, F.lit(False)), key).otherwise(
            F.raise_error(F.lit(f"Invalid design identifier in {c}"))).alias(c))
    return df.select(*checked).distinct()
