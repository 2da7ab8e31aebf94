"""Exact top-k search by inner product: tiled matrix products, a selection per tile, merged top lists.

Vectors are stored as tiles of rows. Query tiles meet every candidate tile: a copy of each goes to
every shard of candidate tiles, the product of two tiles is one matrix product, and only the best k
of each query leave a task. Top lists merge first within a shard group, then over all groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.common import cut

_TILE = "tile long, dim int, ids binary, keys binary, cells binary, wide boolean"
_TILE_NAMES = [x.split()[0] for x in _TILE.split(", ")]
_LONG = 2**63 - 1


def _tile_batch(tile: int, dim: int, ids: np.ndarray, keys: np.ndarray, cells: np.ndarray, wide: bool) -> pa.RecordBatch:
    order = np.lexsort((keys, ids))
    return pa.RecordBatch.from_pylist([{
        "tile": tile, "dim": dim, "ids": ids[order].astype("<i8").tobytes(), "keys": keys[order].astype("<i8").tobytes(),
        "cells": np.ascontiguousarray(cells[order]).tobytes(), "wide": wide}],
        schema=pa.schema([("tile", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()),
                          ("cells", pa.binary()), ("wide", pa.bool_())]))


def _make_tiles(scale: float, rows: int):
    """Arrow function: scaled floors of usable vectors, ``rows`` to a tile, one length of vector to a tile."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def emit(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, keys, cells = zip(*held.pop(dim))
            cells = np.concatenate(cells)
            made += 1
            # floats beyond 2**53 are whole numbers that fit no long in general: kept as doubles
            wide = bool(cells.size and np.abs(cells).max() >= 2**31)
            return _tile_batch((part << 33) + made, dim, np.concatenate(ids), np.concatenate(keys),
                               cells.astype("<f8" if wide else "<i4"), wide)

        for batch in batches:
            column = batch.column(2)
            offsets = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            sizes = np.diff(offsets)
            bad = np.zeros(len(values) + 1, np.int64)
            np.cumsum(~np.isfinite(values), out=bad[1:])
            fine = (bad[offsets[1:]] == bad[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            with np.errstate(over="ignore"):
                scaled = np.clip(np.floor(scale * values), -np.finfo(float).max, np.finfo(float).max)
            for dim in np.unique(sizes[fine]).tolist():
                picked = np.flatnonzero(fine & (sizes == dim))
                for at in range(0, len(picked), rows):
                    some = picked[at:at + rows]
                    held.setdefault(dim, []).append((ids[some], keys[some], scaled[offsets[some][:, None] + np.arange(dim)]))
                    if sum(len(x[0]) for x in held[dim]) >= rows:
                        yield emit(dim)
        for dim in list(held):
            yield emit(dim)
    return run


def _query_tiles(every: int, rows: int):
    """Arrow function: the query rows of candidate tiles, gathered into query tiles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, bool], list] = {}

        def emit(kind: tuple[int, bool]) -> pa.RecordBatch:
            nonlocal made
            ids, keys, cells = (np.concatenate(x) for x in zip(*held.pop(kind)))
            made += 1
            return _tile_batch((part << 33) + made, kind[0], ids, keys, cells, kind[1])

        for batch in batches:
            for row in batch.to_pylist():
                ids, keys, cells = _read(row)
                picked = np.flatnonzero(ids % every == 0)
                if len(picked):
                    kind = row["dim"], row["wide"]
                    held.setdefault(kind, []).append((ids[picked], keys[picked], cells[picked]))
                    if sum(len(x[0]) for x in held[kind]) >= rows:
                        yield emit(kind)
        for kind in list(held):
            yield emit(kind)
    return run


def _read(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, keys = (np.frombuffer(row[prefix + n], "<i8") for n in ("ids", "keys"))
    cells = np.frombuffer(row[prefix + "cells"], "<f8" if row[prefix + "wide"] else "<i4")
    return ids, keys, cells.reshape(len(ids), row[prefix + "dim"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: the narrowest type that holds every sum without rounding."""
    size = a.shape[1]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, size)
    if bound < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.float64)
    if bound < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    whole = [np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (a, b)]
    return whole[0] @ whole[1].T if size else np.zeros((len(a), len(b)))


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k highest scores of each row, ties to the earlier column: k passes of argmax.

    A row with fewer candidates gets minus infinity for what it lacks.
    """
    low = -np.inf
    left = scores.astype(object).copy() if scores.dtype == object else scores.copy()
    out = np.zeros((len(left), min(k, left.shape[1])), np.int64)
    values, rows = np.empty(out.shape, left.dtype), np.arange(len(left))
    for i in range(out.shape[1]):
        out[:, i] = left.argmax(axis=1)
        values[:, i] = left[rows, out[:, i]]
        left[rows, out[:, i]] = low
    return out, values


def _match(k: int):
    """Arrow function over pairs of tiles: the best k of every query of a pair."""
    names = ["query_key", "query_id", "vec_id", "score", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                q_ids, q_keys, q = _read(row, "q_")
                ids, keys, cells = _read(row)
                scores = products(q, cells)
                # a query's own row is no candidate
                spot = np.searchsorted(ids, q_ids)
                own = []
                for i, (s, key) in enumerate(zip(spot, q_keys)):
                    while s < len(ids) and ids[s] == q_ids[i]:
                        if keys[s] == key:
                            own.append((i, s))
                        s += 1
                if own:
                    if scores.dtype != object:
                        scores[tuple(np.array(own).T)] = -np.inf
                    else:
                        for i, s in own:
                            scores[i, s] = -np.inf
                picks, found = best(scores, k)
                real = (found > -np.inf).astype(bool)
                n = np.repeat(np.arange(len(q_ids)), picks.shape[1]).reshape(picks.shape)[real]
                exact = [int(v) for v in found[real]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(q_keys[n]), pa.array(q_ids[n]), pa.array(ids[picks[real]]),
                    pa.array([max(-_LONG - 1, min(_LONG, v)) for v in exact], pa.int64()),
                    pa.array([float(v) if abs(v) < 1e308 else (np.inf if v > 0 else -np.inf) for v in exact], pa.float64())], names)
    return run


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: float = 256.0, rows: int = 2048, query_rows: int = 1024,
          shards: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest inner products of each query with all other rows.

    Queries are the rows whose id divides by ``query_every``. Components are floored after scaling.
    Vectors that are null or hold null or non-finite components, and rows with a null id, take no part; a vector
    meets only vectors of its own length. Ties go to the smaller id. Rows with a repeated id stay
    rows of their own: only the query's own row is left out, and each query row gets its own
    list. Scores beyond the range of a long are cut to it, but ranked as they are up to double
    precision. Fewer candidates give fewer rows; an empty table gives none.
    """
    rows_of = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("key"),
        F.col(embedding).cast("array<double>").alias("v"))
    tiles = cut(rows_of.mapInArrow(_make_tiles(scale, rows), _TILE))
    shards = shards or max(1, vectors.sparkSession.sparkContext.defaultParallelism * 2)
    queries = tiles.mapInArrow(_query_tiles(query_every, query_rows), _TILE)
    sent = queries.select(*[F.col(n).alias(f"q_{n}") for n in _TILE_NAMES],
                          F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    placed = tiles.withColumn("shard", F.pmod(F.xxhash64("tile"), F.lit(shards)).cast("int"))
    pairs = placed.join(sent, (placed["shard"] == sent["shard"]) & (F.col("dim") == F.col("q_dim"))).drop("shard")
    lists = pairs.select(*_TILE_NAMES, *[f"q_{n}" for n in _TILE_NAMES]).mapInArrow(
        _match(k), "query_key long, query_id long, vec_id long, score long, exact double")
    order = [F.desc("exact"), F.desc("score"), F.asc("vec_id")]
    near = Window.partitionBy("query_key", "group").orderBy(*order)
    last = Window.partitionBy("query_key").orderBy(*order)
    merged = (lists.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(16)))
              .withColumn("place", F.row_number().over(near)).where(F.col("place") <= k))
    return (merged.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
