"""Whitening of embeddings by an incremental eigendecomposition.

1. Every partition keeps a spectrum (count, sums, eigenvalues and eigenvectors of its scatter) and
   applies centred rank-one updates to it. The eigenvalues after an update are the roots of a
   secular equation; entries that the update hardly touches, and equal eigenvalues, are deflated
   first. Rows come in blocks: an orthogonal reduction turns a centred block into as many rows as
   there are dimensions, with the same scatter, and these rows and the shift of the mean are the updates.
2. Spectra are combined in a tree: each eigenvector of one, times the root of its eigenvalue, is a
   rank-one update of the other, and so is the difference of their means.
3. Rayleigh-Ritz refinement: the covariance is projected on the combined eigenvectors in one pass over
   all rows, and the projected matrix, nearly diagonal by then, is solved to double precision.

All numbers that leave a task are at most a square of the dimension in size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = np.finfo(float).eps
BLOCK, FAN = 4096, 8
#: Beyond this a scaled entry has no exact double.
MOST = float(1 << 53)
_STATE = "slot long, n long, sums binary, spectrum binary, vectors binary"
_STATE_NAMES = [x.split()[0] for x in _STATE.split(", ")]


def secular_roots(poles: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z2 / (poles - x))``: one to the right of each (ascending, distinct) pole.

    A root is given as the nearer pole's index and the distance from it, so that differences to
    poles keep full relative accuracy. Steps follow a two-pole rational model of the function and
    fall back to halving a bracket of the root.
    """
    k = len(poles)
    last, rows = k - 1, np.arange(k)
    right = np.r_[poles[1:], poles[-1] + z2.sum()]
    gap = right - poles
    half = gap / 2
    middle = 1 + (z2 / ((poles - poles[:, None]) - half[:, None])).sum(axis=1)
    origin = np.where((middle >= 0) | (rows == last), rows, np.minimum(rows + 1, last))
    near = origin == rows
    low = np.where(near, np.where(middle >= 0, 0.0, half), -half)
    high = np.where(near, np.where(middle >= 0, half, gap), 0.0)
    delta = poles[None, :] - poles[origin][:, None]
    below = rows[None, :] <= rows[:, None]
    left_pole, right_pole = delta[rows, rows], delta[rows, np.minimum(rows + 1, last)]
    tau = (low + high) / 2
    for _ in range(120):
        apart = delta - tau[:, None]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            parts = z2 / apart
            slopes = parts / apart
            value = 1 + parts.sum(axis=1)
            psi1, phi1 = np.where(below, slopes, 0).sum(axis=1), np.where(below, 0, slopes).sum(axis=1)
            low, high = np.where(value < 0, tau, low), np.where(value < 0, high, tau)
            if np.all((np.abs(value) <= 4 * EPS * (1 + np.abs(parts).sum(axis=1))) | (high - low <= 2 * EPS * np.abs(tau))):
                break
            a1, a2 = left_pole - tau, right_pole - tau
            c = value - a1 * psi1 - a2 * phi1
            a = (a1 + a2) * value - a1 * a2 * (psi1 + phi1)
            b = a1 * a2 * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # the last root has one pole to its left only
            own = a1[last] * psi1[last]
            step[last] = a1[last] + psi1[last] * a1[last] ** 2 / (value[last] - own)
        new = tau + step
        tau = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
    return origin, tau


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``vectors diag(values) vectors' + v v'``."""
    z = vectors.T @ v
    size = math.sqrt(z @ z)
    if size == 0:
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    tolerance = 8 * EPS * max(np.abs(values).max(), size * size)
    active: list[int] = []
    for j in np.flatnonzero(np.abs(z) * size > tolerance).tolist():
        if active:
            i = active[-1]
            length = math.hypot(z[i], z[j])
            c, s = z[j] / length, z[i] / length
            if abs(c * s * (values[j] - values[i])) <= tolerance:
                # equal eigenvalues: turn their plane so that the update meets only one of the two
                one, other = vectors[:, i].copy(), vectors[:, j].copy()
                vectors[:, i], vectors[:, j] = c * one - s * other, s * one + c * other
                values[i], values[j] = c * c * values[i] + s * s * values[j], s * s * values[i] + c * c * values[j]
                z[i], z[j] = 0.0, length
                active.pop()
        active.append(j)
    if not active:
        return values, vectors
    place = np.array(active)
    order = np.argsort(values[place], kind="stable")
    place = place[order]
    poles, some = values[place], z[place]
    origin, tau = secular_roots(poles, some * some)
    # differences root - pole (row: root), then the update for which these roots are exact
    differ = tau[:, None] - (poles[None, :] - poles[origin][:, None])
    k = len(place)
    between = poles[:, None] - poles[None, :]
    # the denominators pair a root with the pole beside it, away from the entry's own pole
    shifted = np.where(np.arange(k)[:, None] < np.arange(k)[None, :], between, np.vstack([between[1:], np.ones((1, k))]))
    with np.errstate(divide="ignore"):
        logs = np.log(np.abs(differ)) - np.log(np.abs(shifted))
    exact = np.copysign(np.exp(logs.sum(axis=0) / 2), some)
    turn = exact[:, None] / -differ.T
    turn /= np.linalg.norm(turn, axis=0)
    vectors[:, place] = vectors[:, place] @ turn
    values[place] = poles[origin] + tau
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Rows seen so far: count, exact sums, and the eigendecomposition of their scatter about the mean."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim, np.int64), np.zeros(dim), np.eye(dim))

    def update(self, v: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, v)

    def shift(self, n: int, sums: np.ndarray) -> None:
        """Account for the distance between the mean of ``n`` further rows and the mean so far."""
        if self.n and n:
            self.update((self.sums / self.n - sums / n) * math.sqrt(self.n / (self.n + n) * n))
        self.n, self.sums = self.n + n, self.sums + sums

    def add_rows(self, rows: np.ndarray) -> None:
        """Rank-one updates for a block of whole-number rows."""
        sums = rows.sum(axis=0)
        centred = rows - sums / len(rows)
        if len(rows) > rows.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        for v in centred:
            self.update(v)
        self.shift(len(rows), sums)

    def merge(self, other: Spectrum) -> None:
        if not self.n:
            self.values, self.vectors = other.values, other.vectors
        elif other.n:
            for value, vector in zip(other.values, other.vectors.T):
                if value > 0:
                    self.update(math.sqrt(value) * vector)
        self.shift(other.n, other.sums)

    def row(self, slot: int) -> dict:
        return dict(slot=slot, n=self.n, sums=self.sums.tobytes(), spectrum=self.values.tobytes(), vectors=np.ascontiguousarray(self.vectors).tobytes())

    @classmethod
    def of(cls, row) -> Spectrum:
        sums = np.frombuffer(row["sums"], np.int64)
        values, vectors = np.frombuffer(row["spectrum"]), np.frombuffer(row["vectors"])
        return cls(int(row["n"]), sums, values, vectors.reshape(len(sums), len(sums)))


def _entries(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch that take part, and their scaled floors (without the offset) as whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = np.floor(scale * column.values.to_numpy(zero_copy_only=False).astype(np.float64))  # null entries become NaN
    with np.errstate(invalid="ignore"):
        bad = np.r_[0, np.cumsum(~(np.abs(values) < MOST))]
    fine = (bad[offsets[1:]] == bad[offsets[:-1]]) & (np.diff(offsets) == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fine)
    return rows, values[offsets[:-1][rows, None] + np.arange(dim)].astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: float) -> Iterator[np.ndarray]:
    held, count = [], 0
    for batch in batches:
        _, cells = _entries(batch.column(0), dim, scale)
        for at in range(0, len(cells), BLOCK):
            held.append(cells[at:at + BLOCK])
            count += len(held[-1])
            if count >= BLOCK:
                yield np.concatenate(held)
                held, count = [], 0
    if count:
        yield np.concatenate(held)


def _spectra(dim: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Spectrum.empty(dim)
        for block in _blocks(batches, dim, scale):
            state.add_rows(block)
        if state.n:
            yield _states([state.row(TaskContext.get().partitionId())])
    return run


def _states(rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(_STATE_NAMES, kinds))))


def _merge_spectra(frame: pd.DataFrame) -> dict:
    total = None
    for row in frame.sort_values("slot").to_dict("records"):
        one = Spectrum.of(row)
        if total is None:
            total = one
        else:
            total.merge(one)
    return total.row(int(frame["slot"].min()) // FAN)


def _merge_sums(frame: pd.DataFrame) -> dict:
    rows = frame.sort_values("slot").to_dict("records")
    cells = sum(np.frombuffer(r["vectors"]) for r in rows)
    return dict(slot=rows[0]["slot"] // FAN, n=sum(r["n"] for r in rows), sums=b"", spectrum=b"", vectors=cells.tobytes())


def _tree(states: DataFrame, parts: int, merge: Callable[[pd.DataFrame], dict]) -> dict | None:
    """One state out of one per partition, ``FAN`` of them merged at a time."""
    while True:
        states = states.groupBy(F.floor(F.col("slot") / FAN)).applyInPandas(lambda f: pd.DataFrame([merge(f)], columns=_STATE_NAMES), _STATE)
        parts = -(-parts // FAN)
        if parts <= 1:
            break
    rows = states.collect()  # a single row, a square of the dimension in size
    return rows[0].asDict() if rows else None


def _products(dim: int, scale: float, mean: np.ndarray, basis: np.ndarray):
    """Arrow function: sums of products of the centred rows in a basis, with a constant 1 as further column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((basis.shape[1] + 1,) * 2), 0
        for block in _blocks(batches, dim, scale):
            turned = np.c_[(block - mean) @ basis, np.ones(len(block))]
            total += turned.T @ turned
            n += len(block)
        if n:
            yield _states([dict(slot=TaskContext.get().partitionId(), n=n, sums=b"", spectrum=b"", vectors=total.tobytes())])
    return run


@dataclass
class Whitening:
    """A fitted transformation: ``(x - mean) @ basis / sqrt(variances)``; all but the offset is in units of the scaled entries."""

    n: int
    sums: np.ndarray
    basis: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float
    scale: float
    offset: int

    @property
    def mean(self) -> np.ndarray:
        return self.sums / max(self.n, 1)

    @property
    def turned(self) -> np.ndarray:
        """Basis over the standard deviations; a direction without variance gives 0."""
        return self.basis / np.where(self.variances > 0, np.sqrt(self.variances), np.inf)


def fit_whitening(vectors: DataFrame, components: int = 32, scale: float = 64.0, offset: int = 1_000_000, vector: str = "embedding") -> Whitening | None:
    """Fit on all usable vectors: three passes after one that looks for the usual length; None without any.

    The entries become ``floor(scale * c) + offset``. Null vectors, those with null or non-finite entries, with
    entries that exceed 2^53 when scaled, and those whose length is not the commonest one (the longer, on
    ties) take no part.
    """
    column = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    usual = column.where("v is not null").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if usual is None or usual["dim"] == 0:
        return None
    dim, parts = usual["dim"], column.rdd.getNumPartitions()
    found = _tree(column.mapInArrow(_spectra(dim, scale), _STATE), parts, _merge_spectra)
    if found is None:
        return None
    state = Spectrum.of(found)
    mean = state.sums / state.n
    basis = np.linalg.qr(state.vectors)[0]
    projected = _centred(_tree(column.mapInArrow(_products(dim, scale, mean, basis), _STATE), parts, _merge_sums))
    values, turn = np.linalg.eigh(projected)
    values, basis = np.maximum(values[::-1], 0), (basis @ turn)[:, ::-1]
    values[values <= dim * EPS * values[0]] = 0
    explained = values / values.sum() if values.sum() > 0 else values
    fit = Whitening(state.n, state.sums, basis[:, :components], values[:components], explained[:components], 0.0, scale, offset)
    real = fit.variances > 0
    if real.any():
        white = _centred(_tree(column.mapInArrow(_products(dim, scale, mean, fit.turned[:, real]), _STATE), parts, _merge_sums))
        fit.identity_error = float(np.abs(white - np.eye(real.sum())).max())
    return fit


def _centred(found: dict) -> np.ndarray:
    """Covariance out of the sums of products; the constant's column holds the sums."""
    n, width = found["n"], math.isqrt(len(found["vectors"]) // 8)
    cells = np.frombuffer(found["vectors"]).reshape(width, width)
    means = cells[-1, :-1] / n
    out = cells[:-1, :-1] / n - np.outer(means, means)
    return (out + out.T) / 2


def deviations(cells: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sum over the dimensions of ``(n * x - sums) ** 2``; whole numbers of Python where 64 bits do not suffice."""
    most = n * int(np.abs(cells).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if most * most * len(sums) < 1 << 63:
        return pa.array(((n * cells - sums) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    wide = ((n * cells.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    return pa.array([Decimal(x) for x in wide], pa.decimal128(38, 0))


def whitened(vectors: DataFrame, fit: Whitening | None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, component, deviation, whitened)`` for every usable vector and component, as long form rows.

    ``deviation`` is a decimal, exact at any size. Repeated rows and rows with a null id keep rows of their own. A
    component without variance (fewer independent rows than components) gives 0.0. Other columns are ignored; no
    usable vector gives no rows.
    """
    schema = "vec_id long, component int, deviation decimal(38,0), whitened double"
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, count, turned = len(fit.sums), len(fit.variances), fit.turned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = _entries(batch.column(1), dim, fit.scale)
            white = (cells - fit.mean) @ turned
            each = pa.array(np.repeat(np.arange(len(rows)), count))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows))),
                deviations(cells, fit.n, fit.sums).take(each), pa.array(white.ravel())], ["vec_id", "component", "deviation", "whitened"])

    return vectors.select(F.col(vec_id).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, schema)
