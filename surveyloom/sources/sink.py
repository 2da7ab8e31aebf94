"""Writers of aggregate results. Existing output is never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.scale import broadcast_if_small


def write_results(df: DataFrame, path: str, format: str = "parquet") -> str:
    """Write to a new folder as Parquet, CSV or JSON; an existing folder is an error."""
    writer = df.write.mode("errorifexists").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return path


def write_by_site(df: DataFrame, path: str, site: str, rows_per_file: int = 1_000_000) -> str:
    """One partition folder per site, with as many files as its rows need.

    Rows are counted per site first. A site larger than a file is salted by a hash of its rows, so a hot site is several
    tasks and several files of like size; a small one is a single file. Sites share tasks.
    """
    files = F.ceil(F.count("*") / rows_per_file).cast("int")
    sizes = df.groupBy(site).agg(files.alias("_files"))
    total = int(sizes.agg(F.sum("_files")).first()[0] or 1)
    tasks = min(total, 4 * df.sparkSession.sparkContext.defaultParallelism)
    keyed = df.withColumn("_row_hash", F.xxhash64(*[F.col(c).cast("string") for c in df.columns]))
    placed = keyed.join(broadcast_if_small(sizes), keyed[site].eqNullSafe(sizes[site]), "left").drop(sizes[site]).withColumn(
        "_salt", F.pmod("_row_hash", F.coalesce("_files", F.lit(1))))
    placed.repartition(max(tasks, 1), F.col(site), F.col("_salt")).drop("_row_hash", "_files", "_salt").write.mode(
        "errorifexists").partitionBy(site).parquet(path)
    return path
