"""Plan helpers: size-checked broadcast, lineage cuts and ordering without one big sort task.

A window over a hot group would put that whole group into one task. The functions
here split every group into ordered buckets first, carry small per-bucket totals
across buckets, and open windows only inside a bucket.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20
#: Plan bytes up to which a side that grows with the tables may still be broadcast.
GROWING_BYTES = 1 << 20
LEAST_BUCKETS, MOST_BUCKETS = 64, 4096
_SEARCHED = 31
_ALL = "_all_rows"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session; a local session without one gets a scratch folder."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared checkpoint folder: fixed values, short lineage, survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def planned_bytes(df: DataFrame) -> int:
    """Upper estimate of a frame's size from its plan, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint if the plan bounds the side by ``limit`` bytes.

    Otherwise the join stays open: adaptive execution broadcasts a side whose measured bytes are
    small and shuffles any other one.
    """
    return F.broadcast(df) if planned_bytes(df) <= limit else df


def growing_side(df: DataFrame, limit: int = GROWING_BYTES) -> DataFrame:
    """A join side that grows with the tables, joined by sorting unless the plan bounds it by ``limit`` bytes.

    Left open, the planner goes by bytes of files and adaptive execution by those of a shuffle. Both are compressed:
    rows that look small there are collected and hashed on the driver at many times that size.
    """
    return df if planned_bytes(df) <= limit else df.hint("merge")


def stored_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Compute an aggregate once for use as a join side."""
    return broadcast_if_small(cut(df), limit)


def buckets_for(df: DataFrame) -> int:
    """Buckets for one group that may hold all rows: twice the cluster's cores, within bounds."""
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, 2 * df.sparkSession.sparkContext.defaultParallelism))


def _grouping(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if "_bucket" in df.columns:
        raise ValueError("Column name _bucket is used by this operator")
    return (df, list(by)) if by else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def count_below(cuts: Column, size: int, value: Column) -> Column:
    """Number of the ``size`` ascending cut points below a value.

    A compiled binary search finds the stretch of cut points; a long stretch is then counted through.
    """
    step = 1 if size <= 2 * _SEARCHED else -(-size // (_SEARCHED + 1))

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(cuts[(middle + 1) * step - 1] < value, search(middle + 1, high)).otherwise(search(low, middle))

    found = search(0, size // step)
    return found if step == 1 else found * step + F.size(F.filter(F.slice(cuts, found * step + 1, step), lambda c: c < value))


def with_buckets(df: DataFrame, by: Sequence[str], order: str, buckets: int | None = None):
    """Add ``_bucket``, increasing in ``order`` inside each group.

    Approximate quantiles serve only as cut points: any cut points give the same
    final result, they only balance the work. They are stored once so that every
    branch of the plan sees the same ones. Returns (df, group columns, small) where
    ``small`` says that the number of groups was checked to allow broadcasts.
    """
    df, keys = _grouping(df, by)
    buckets = buckets or buckets_for(df)
    cuts = cut(df.groupBy(*keys).agg(
        F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 2000).alias("_cuts")))
    most = BROADCAST_BYTES // (8 * buckets)  # groups whose cut points fit
    small = cuts.limit(most + 1).count() <= most
    side = F.broadcast(cuts) if small else cuts
    placed = df.join(side, keys).withColumn("_bucket", count_below(F.col("_cuts"), buckets - 1, F.col(order))).drop("_cuts")
    return placed, keys, small


def running_sums(df: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, Column],
                 buckets: int | None = None) -> DataFrame:
    """Exclusive running sums ``<name>_before`` and group totals ``<name>_total``.

    ``df`` must hold each ``(by, order)`` pair once; group keys must not be null.
    """
    for name, value in sums.items():
        df = df.withColumn(f"_v_{name}", value)
    placed, keys, small = with_buckets(df, by, order, buckets)
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    offsets = placed.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums]).select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_s_{n}").over(ahead), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(group).alias(f"{n}_total") for n in sums])
    if small:
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(offsets, [*keys, "_bucket"])
    for n in sums:
        out = out.withColumn(f"{n}_before", F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)))
    return out.drop("_bucket", _ALL, *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def hash_ranks(df: DataFrame, by: Sequence[str], digest: str, rank: str = "rank", size: str = "group_size",
               digits: int = 3) -> DataFrame:
    """Rank rows by a hex digest inside each group and add the group size.

    The leading hex digits are evenly spread, so they bucket even a hot group.
    """
    df, keys = _grouping(df, by)
    placed = df.withColumn("_bucket", F.substring(digest, 1, digits))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(size))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(digest)
    return (placed.join(growing_side(counts), [*keys, "_bucket"])
            .withColumn(rank, F.col("_offset") + F.row_number().over(inside))
            .drop("_bucket", "_offset", _ALL))


def running_last(df: DataFrame, by: Sequence[str], order: str, tie: str, value: str, out: str,
                 buckets: int | None = None) -> DataFrame:
    """Last non-null ``value`` strictly before each row in ``(order, tie)`` order."""
    placed, keys, small = with_buckets(df, by, order, buckets)
    position = F.struct(F.col(order), F.col(tie))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy(*keys, "_bucket").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), position)).alias("_last")).select(
        *keys, "_bucket", F.last("_last", ignorenulls=True).over(ahead).alias("_carried"))
    if small:
        carried = F.broadcast(carried)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.join(carried, [*keys, "_bucket"])
            .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried")))
            .drop("_bucket", "_carried", _ALL))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles, one column per entry of ``probs``.

    Works on distinct values with counts, so no task holds a whole group's values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    run = running_sums(counts, by, value, {"_n": F.col("_n")})
    last = (F.col("_n_total") - 1).cast("double")
    covers = lambda i: (F.col("_n_before") <= i) & (i < F.col("_n_before") + F.col("_n"))
    picks, results = [], []
    for name, p in probs.items():
        at = last * F.lit(float(p))
        picks += [F.max(F.when(covers(F.floor(at)), F.col(value))).alias(f"_lo_{name}"),
                  F.max(F.when(covers(F.ceil(at)), F.col(value))).alias(f"_hi_{name}"),
                  F.max(at - F.floor(at)).alias(f"_fr_{name}")]
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        results.append((low + (high - low) * F.col(f"_fr_{name}")).alias(name))
    return run.groupBy(*by).agg(*picks).select(*by, *results)
