"""Helpers the corpus operators share: table access, row keys and lineage cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.operators.scale import cut

__all__ = ["cut", "held_out", "table", "vocabulary", "with_row_key"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; operators take such a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def with_row_key(df: DataFrame, name: str = "_row") -> DataFrame:
    """Number the rows of a scan: unique, and the same whenever a partition is read again."""
    return df.withColumn(name, F.monotonically_increasing_id())


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """True for the rows no fit may see: crc32 of the id's text divides by ``parts``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))
