"""Many weighted logistic fits at once: every pass over the covariate cells serves all of them.

A problem is a domain and a column of weights: bootstrap multipliers of the clusters, fold masks or
imputations. Rows hold the covariates once and all weights of their domain, so one Newton pass is one job
whatever the number of fits. Each task sums derivatives of its rows per block of fits, blocks are added
up and solved in tasks of their own, and only steps (one vector per fit) reach the driver, which keeps the
state of each fit: step halving, convergence, failure.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.design import SurveyDesign
from surveyloom.operators.bootstrap import OUTSIDE, with_times_drawn
from surveyloom.operators.encoding import Encoding
from surveyloom.operators.scale import cut

#: Fits to a block, rows of dense terms held at once, and blocks added up together.
BLOCK, ROWS, FAN = 25, 2048, 32
#: Rows times fits whose probabilities are held at once (1 MB of doubles, so that they stay in the cache).
HELD = 1 << 17
#: Rows per covariate combination from which summed weights (eight bytes a replicate) take no more room than multipliers (one byte).
SUMMED = 8
_SCALARS = ("weight", "events", "treated_weight", "loss", "q0", "q1")


@dataclass
class Fits:
    """Fits of one domain: a row of ``beta`` per column of weights, and what the last pass summed."""

    beta: np.ndarray
    status: list[str]
    sums: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def gap(self) -> np.ndarray:
        """Weighted mean prediction with exposure 1 less that with 0, over the weighted rows of each fit; NaN without a fit."""
        return np.where(np.array(self.status) == "ok", (self.sums["q1"] - self.sums["q0"]) / self.sums["weight"], np.nan)


def multiplier_bytes(clusters: DataFrame, design: SurveyDesign, reps: int, seed: int) -> DataFrame:
    """``multipliers`` of every cluster: a byte for the sample itself (1), then how often each replicate draws the cluster.

    As many clusters as a stratum has are drawn with replacement, so one alone in its stratum is always drawn once.
    """
    own = clusters.select(*design.cluster).distinct()

    def run(rows: pd.DataFrame, times: np.ndarray) -> pd.DataFrame:
        if times.max(initial=0) > 255:
            raise ValueError("A cluster is drawn more than 255 times in one replicate")
        every = np.concatenate([np.ones((len(rows), 1), np.uint8), times.astype(np.uint8)], axis=1)
        return rows[list(design.cluster)].assign(multipliers=[x.tobytes() for x in every])

    kinds = dict(own.dtypes)
    return with_times_drawn(own, design, reps, seed, run, ", ".join(f"{c} {kinds[c]}" for c in design.cluster) + ", multipliers binary")


def weighted_cells(df: DataFrame, encoding: Encoding, outcome: str, weight: Column, domain: Column, cluster: Sequence[str] = ()) -> DataFrame:
    """Weight sums per domain, cluster (if named), covariate combination and outcome."""
    return encoding.prepare(df).groupBy(domain.alias("domain"), *cluster, *encoding.keys, F.col(outcome).cast("double").alias("_y")).agg(
        F.sum(weight).alias("_w"))


def replicate_sums(cells: DataFrame, encoding: Encoding, design: SurveyDesign, roster: DataFrame, reps: int, seed: int, held: int) -> DataFrame:
    """``sums`` of every domain, covariate combination and outcome, stored: its weight in the sample and in every replicate (packed doubles).

    ``cells`` come from :func:`weighted_cells` with clusters. Weights are summed where draws meet their clusters if that takes
    less room, and then over all ``held`` cells, combinations in sorted order, so that a task holds few of them at once.
    """
    names, kinds = ["domain", *encoding.keys, "_y"], dict(cells.dtypes)

    def run(rows: pd.DataFrame, times: np.ndarray) -> pd.DataFrame:
        code = rows.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
        sizes = np.diff(np.r_[starts, len(order)])
        # combinations with few rows here send them as they are, the others one row of sums
        single = np.repeat((sizes < SUMMED) & (np.maximum.reduceat(times.max(axis=1, initial=0)[order], starts) < 256), sizes)
        mine, rest = order[single], order[~single]
        every = np.concatenate([np.ones((len(mine), 1), np.uint8), times[mine].astype(np.uint8)], axis=1)
        out = [rows.iloc[mine][[*names, "_w"]].assign(multipliers=[x.tobytes() for x in every], sums=None)]
        if len(rest):
            starts = np.flatnonzero(np.r_[True, np.diff(code[rest]) > 0])
            w, sums = rows["_w"].to_numpy(float), np.zeros((len(starts), reps + 1))
            own = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rest)]))
            for at in range(0, len(rest), ROWS):
                part, to = rest[at:at + ROWS], own[at:at + ROWS]
                firsts = np.flatnonzero(np.r_[True, np.diff(to) > 0])
                sums[to[firsts], 0] += np.add.reduceat(w[part], firsts)
                sums[to[firsts], 1:] += np.add.reduceat(w[part, None] * times[part], firsts, axis=0)
            out.append(rows.iloc[rest[starts]][names].assign(_w=np.nan, multipliers=None, sums=[x.tobytes() for x in sums]))
        return pd.concat(out) if len(out) > 1 else out[0]

    def total(batches):
        last = None  # the last combination of a part may go on in the next
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at:at + ROWS]
                weights, packed = np.empty((len(part), reps + 1)), part["sums"].isna().to_numpy()
                for some, columns in ((packed, ["_w", "multipliers"]), (~packed, ["sums"])):
                    if some.any():
                        weights[some] = _weights(part.loc[some, columns])
                starts = _starts_of(part[names])
                sums, keys = np.add.reduceat(weights, starts, axis=0), part[names].iloc[starts]
                if last is not None:
                    if len(_starts_of(pd.concat([last[0], keys.iloc[:1]]))) == 1:
                        sums[0] += last[1][0]
                    else:
                        yield last[0].assign(sums=[last[1][0].tobytes()])
                last = keys.iloc[-1:], sums[-1:].copy()
                if len(keys) > 1:
                    yield keys.iloc[:-1].assign(sums=[x.tobytes() for x in sums[:-1]])
        if last is not None:
            yield last[0].assign(sums=[last[1][0].tobytes()])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    parts = with_times_drawn(cells, design, reps, seed, run, f"{schema}, _w double, multipliers binary, sums binary", roster=roster)
    return cut(_side_by_side(parts, names, held, reps).mapInPandas(total, f"{schema}, sums binary"))


def _side_by_side(rows: DataFrame, names: Sequence[str], held: int, reps: int) -> DataFrame:
    """Rows of one combination lie in one partition, outcomes last in its order.

    At most 128 MB of the ``held`` rows (a byte per replicate each) to a partition; few rows get fewer partitions, since each sends sums of all fits.
    """
    tasks = max(1, min(3 * rows.sparkSession.sparkContext.defaultParallelism, held >> 13), held * (reps + 1) >> 27)
    return rows.repartition(tasks, *names[:-1]).sortWithinPartitions(*names)


def _starts_of(keys: pd.DataFrame) -> np.ndarray:
    """First row of every run of equal keys; missing values are equal to each other."""
    fresh = np.zeros(max(len(keys) - 1, 0), bool)
    for c in keys.columns:
        value, none = keys[c].to_numpy(), keys[c].isna().to_numpy()
        fresh |= (value[1:] != value[:-1]) & ~(none[1:] & none[:-1])
    return np.flatnonzero(np.r_[True, fresh]) if len(keys) else np.empty(0, int)


def _weights(rows: pd.DataFrame) -> np.ndarray:
    """Rows times columns of weights: multipliers times the row's weight, packed sums, or the array itself."""
    if "multipliers" in rows:
        return rows["_w"].to_numpy(float)[:, None] * np.frombuffer(b"".join(rows["multipliers"]), np.uint8).reshape(len(rows), -1)
    if "sums" in rows:
        return np.frombuffer(b"".join(rows["sums"])).reshape(len(rows), -1)
    return np.stack(rows["_ws"].to_numpy())


def _expit(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _block_sums(encoding: Encoding, active: dict[str, tuple[np.ndarray, np.ndarray]]):
    """pandas function: per domain and block of fits the sums of scalars, gradient and upper triangle of the Hessian.

    The first term is the intercept, the second the exposure (if any).
    """
    d = len(encoding.labels)
    upper = np.triu_indices(d)

    def run(batches):
        totals: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, mine in batch.groupby("domain", sort=False):
                if name not in active:
                    continue
                columns, beta = active[name]
                for at in range(0, len(mine), ROWS):
                    rows = mine.iloc[at:at + ROWS]
                    x, y = encoding.matrix(rows), rows["_y"].to_numpy(float)
                    w = _weights(rows)[:, columns]
                    pull, none = w.T @ (y[:, None] * x), w.T @ (1 - y)
                    # outcomes of one combination that lie side by side share all else
                    starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)])
                    if len(starts) < len(x):
                        rows, x, w = rows.iloc[starts], x[starts], np.add.reduceat(w, starts, axis=0)
                    arms = [encoding.matrix(rows, a) for a in (0.0, 1.0)] if encoding.exposure else []
                    shown = (x != 0).astype(float)
                    pairs = np.flatnonzero((shown.T @ shown)[upper])  # terms that meet in a row
                    left, right = upper[0][pairs], upper[1][pairs]
                    all_sums = np.zeros((len(columns), len(_SCALARS) + d + len(upper[0])))
                    scalars, gradient, hessian = np.split(all_sums, [len(_SCALARS), len(_SCALARS) + d], axis=1)
                    mass = w.T @ x
                    # one outcome or arm only must give the very sum of the weights
                    scalars[:, 0], scalars[:, 1], scalars[:, 3] = mass[:, 0], np.where(none == 0, mass[:, 0], pull[:, 0]), -(pull * beta).sum(axis=1)
                    if arms:
                        scalars[:, 2] = np.where(w.T @ (1 - x[:, 1]) == 0, mass[:, 0], mass[:, 1])
                    gradient -= pull
                    step = max(1, HELD // len(columns))
                    for some in [slice(i, i + step) for i in range(0, len(x), step)]:
                        v, t = w[some], x[some]
                        z = t @ beta.T
                        p = _expit(z)
                        scalars[:, 3] += np.einsum("ij,ij->j", v, np.maximum(z, 0) - np.log(np.maximum(p, 1 - p)))  # log(1 + exp(z))
                        for i, arm in enumerate(arms):
                            q, other = p, np.flatnonzero((arm[some] != t).any(axis=1))
                            if len(other):
                                q = p.copy()
                                q[other] = _expit(arm[some][other] @ beta.T)
                            scalars[:, 4 + i] += np.einsum("ij,ij->j", v, q)
                        v = v * p
                        gradient += v.T @ t
                        v *= 1 - p
                        hessian[:, pairs] += v.T @ (t[:, left] * t[:, right])
                    for b in range(0, len(columns), BLOCK):
                        key = (name, b // BLOCK)
                        part = all_sums[b:b + BLOCK]
                        totals[key] = part if key not in totals else totals[key] + part
        slot = TaskContext.get().partitionId() % FAN
        if totals:
            yield pd.DataFrame([(n, b, slot, v.tobytes()) for (n, b), v in totals.items()], columns=["domain", "block", "slot", "sums"])

    return run


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x) for x in frame["sums"])
    return frame.iloc[:1].assign(sums=[total.tobytes()])


def _solve(d: int, ridge: float):
    upper = np.triu_indices(d)
    penalty = np.full(d, ridge)
    penalty[0] = 0.0

    def run(frame: pd.DataFrame, beta: dict) -> pd.DataFrame:
        name, block = frame["domain"].iloc[0], int(frame["block"].iloc[0])
        sums = sum(np.frombuffer(x) for x in frame["sums"]).reshape(-1, len(_SCALARS) + d + len(upper[0]))
        out = []
        for i, row in enumerate(sums):
            b = beta[name][1][block * BLOCK + i]
            scalars, total = row[:len(_SCALARS)], max(row[0], 1e-300)
            gradient = row[len(_SCALARS):len(_SCALARS) + d] / total + penalty * b
            hessian = np.zeros((d, d))
            hessian[upper] = row[len(_SCALARS) + d:] / total
            hessian = hessian + np.triu(hessian, 1).T + np.diag(penalty)
            finite = np.isfinite(row).all()
            step = np.linalg.lstsq(hessian, gradient, rcond=1e-13)[0] if finite else np.zeros(d)
            loss = scalars[3] / total + 0.5 * float(penalty @ (b * b))
            out.append((name, block * BLOCK + i, float(loss) if finite else np.inf, float(np.abs(gradient).max()) if finite else np.inf,
                        scalars.tobytes(), step.tobytes()))
        return pd.DataFrame(out, columns=["domain", "at", "loss", "slope", "scalars", "step"])

    return run


def _pass(rows: DataFrame, block_sums, solve, active: dict) -> dict[str, list]:
    """One job: sums per task and block of fits, added up and solved in tasks; a step per fit comes back."""
    block = "domain string, block int, slot int, sums binary"
    sums = rows.mapInPandas(block_sums(active), block)
    if rows.rdd.getNumPartitions() > FAN:
        sums = sums.groupBy("domain", "block", "slot").applyInPandas(_add, block)
    found = sums.groupBy("domain", "block").applyInPandas(
        lambda f: solve(f, active), "domain string, at int, loss double, slope double, scalars binary, step binary").collect()
    out: dict[str, list] = {name: [None] * len(columns) for name, (columns, _) in active.items()}
    for r in found:
        out[r["domain"]][r["at"]] = (r["loss"], r["slope"], np.frombuffer(r["scalars"]), np.frombuffer(r["step"]))
    return out


def fit_many(rows: DataFrame, encoding: Encoding, ridge: float, columns: dict[str, int], first: bool = False,
             tolerance: float = 1e-10, passes: int = 40, start: dict[str, np.ndarray] | None = None) -> dict[str, Fits]:
    """Fit every column of weights of every domain; ``columns`` gives their number per domain.

    ``rows`` (stored by the caller) hold ``domain``, the encoding's keys, ``_y`` and either ``_w`` with ``multipliers`` or
    the array ``_ws``. With ``first`` the first column of each domain is fitted alone and starts the others. A fit
    without weight, with one outcome only, or with one arm only has status ``one_sided``; one that does not
    settle has ``not_converged``. ``start`` may give the coefficients to begin with.
    """
    two_arms = bool(encoding.exposure)

    def one_sided(scalars: np.ndarray) -> bool:
        weight, events, treated = scalars[:3]
        return not 0 < events < weight or (two_arms and not 0 < treated < weight)

    out = {name: Fits(np.zeros((n, len(encoding.labels))), ["open"] * n, {k: np.full(n, np.nan) for k in _SCALARS}) for name, n in columns.items()}
    for name, beta in (start or {}).items():
        out[name].beta[:] = beta
    tasks = 3 * rows.sparkSession.sparkContext.defaultParallelism  # each sends sums of all fits
    if rows.rdd.getNumPartitions() > tasks:
        rows = rows.coalesce(tasks)
    solve = _solve(len(encoding.labels), ridge)
    run = lambda active: _pass(rows, lambda a: _block_sums(encoding, a), solve, active)
    if first:
        _settle(run, out, {name: np.array([0]) for name in columns}, one_sided, tolerance, passes)
        for fits in out.values():
            if fits.status[0] == "ok":
                fits.beta[1:] = fits.beta[0]
    _settle(run, out, {name: np.arange(1 if first else 0, n) for name, n in columns.items()}, one_sided, tolerance, passes)
    return out


def _settle(run, out: dict[str, Fits], some: dict[str, np.ndarray], one_sided, tolerance: float, passes: int) -> None:
    """Newton steps of all open fits together; a step that raises a fit's loss is halved for that fit alone."""
    # per fit: accepted coefficients and loss, and the step under trial
    base = {(n, i): (out[n].beta[i].copy(), np.inf, None) for n, at in some.items() for i in at}
    for _ in range(passes):
        active = {n: np.array([i for i in at if out[n].status[i] == "open"], int) for n, at in some.items()}
        active = {n: (at, out[n].beta[at]) for n, at in active.items() if len(at)}
        if not active:
            return
        for name, found in run(active).items():
            fits = out[name]
            for i, result in zip(active[name][0].tolist(), found):
                if result is None:
                    fits.status[i] = "one_sided"
                    continue
                loss, slope, scalars, step = result
                for label, value in zip(fits.sums, scalars):
                    fits.sums[label][i] = value
                if one_sided(scalars):
                    fits.status[i] = "one_sided"
                elif slope < tolerance:
                    fits.status[i] = "ok"
                else:
                    kept, least, trial = base[name, i]
                    if trial is None or loss <= least + 1e-12 * abs(least):
                        base[name, i] = (fits.beta[i].copy(), loss, -step)
                    else:
                        base[name, i] = (kept, least, trial / 2)
                    kept, _, trial = base[name, i]
                    fits.beta[i] = kept + trial
    for name, at in some.items():
        for i in at:
            if out[name].status[i] == "open":
                out[name].status[i] = "not_converged"


def refit_replicates(df: DataFrame, encoding: Encoding, design: SurveyDesign, outcome: str, domain: Column, roster: DataFrame, reps: int,
                     seed: int, ridge: float, domains: Sequence[str]) -> tuple[dict[str, Fits], DataFrame]:
    """Adjusted gap of every domain, refitted in every replicate of a bootstrap of the roster's clusters (see :func:`refit_cells`)."""
    cells = cut(weighted_cells(df, encoding, outcome, F.col(design.weight), domain, design.cluster))
    return refit_cells(cells, encoding, design, roster, reps, seed, ridge, domains)


def refit_cells(cells: DataFrame, encoding: Encoding, design: SurveyDesign, roster: DataFrame, reps: int, seed: int, ridge: float,
                domains: Sequence[str]) -> tuple[dict[str, Fits], DataFrame]:
    """Adjusted gap of every domain of :func:`weighted_cells` with clusters, refitted in every replicate of a bootstrap of the roster's clusters.

    The roster holds all clusters of the design, also those without rows here; it must hold every cluster of the rows.
    Once each covariate combination stands in ``SUMMED`` clusters on average, its weights are summed per replicate before the
    fits, so that passes run over combinations, however many clusters there are; below that each row carries its multipliers.
    Either way rows of one combination lie side by side, and a pass works out its probabilities once.
    The sample itself is fitted first, on its combinations, and starts the others.

    Returns (fits per domain, the sample itself in column 0; table of replicates with ``gap_pp`` and ``status``).
    All domains share the draws.
    """
    names = ["domain", *encoding.keys, "_y"]
    sample = cut(cells.groupBy(*names).agg(F.sum("_w").alias("_w"), F.count("*").alias("_n")))
    kinds, held = sample.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    whole = fit_many(sample.select(*names, F.array("_w").alias("_ws")), encoding, ridge, dict.fromkeys(domains, 1))
    if SUMMED * kinds <= held:
        rows = replicate_sums(cells, encoding, design, roster, reps, seed, held)
    else:
        joined = cells.join(multiplier_bytes(roster, design, reps, seed), list(design.cluster), "left")
        drawn = F.coalesce("multipliers", F.raise_error(F.lit(OUTSIDE)).cast("binary"))
        rows = cut(_side_by_side(joined.withColumn("multipliers", drawn).select(*names, "_w", "multipliers"), names, held, reps))
    fits = fit_many(rows, encoding, ridge, {name: reps + 1 for name in domains},
                    start={name: f.beta[0] for name, f in whole.items() if f.status[0] == "ok"})
    table = [(name, b, float(g) * 100 if np.isfinite(g) else None, s) for name, f in fits.items()
             for b, (g, s) in enumerate(zip(f.gap, f.status)) if b]
    return fits, cells.sparkSession.createDataFrame(table, "domain string, replicate int, gap_pp double, status string")


def softmax_scores(z: np.ndarray) -> np.ndarray:
    """Probabilities of the classes for scores of all but the first one (its score is 0), along the last axis."""
    z = np.concatenate([np.zeros((*z.shape[:-1], 1)), z], axis=-1)
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _class_sums(encoding: Encoding, classes: int, active: dict):
    d, k = len(encoding.labels), classes - 1
    upper = np.triu_indices(d)

    def run(batches):
        totals: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, mine in batch.groupby("domain", sort=False):
                if name not in active:
                    continue
                columns, beta = active[name]
                for at in range(0, len(mine), ROWS):
                    rows = mine.iloc[at:at + ROWS]
                    x, y, w = encoding.matrix(rows), rows["_y"].to_numpy(int), _weights(rows)[:, columns]
                    z = np.einsum("nd,jkd->njk", x, beta.reshape(-1, k, d))
                    p = softmax_scores(z)
                    loss = -np.log(np.maximum(np.take_along_axis(p, y[:, None, None], axis=2)[:, :, 0], 1e-300))
                    parts = [w.sum(axis=0)[:, None], (w * loss).sum(axis=0)[:, None]]
                    parts += [(w * (p[:, :, c + 1] - (y == c + 1)[:, None])).T @ x for c in range(k)]
                    products = x[:, upper[0]] * x[:, upper[1]]
                    parts += [(w * p[:, :, a + 1] * ((a == b) - p[:, :, b + 1])).T @ products for a in range(k) for b in range(a, k)]
                    every = np.concatenate(parts, axis=1)
                    for b in range(0, len(columns), BLOCK):
                        key, part = (name, b // BLOCK), every[b:b + BLOCK]
                        totals[key] = part if key not in totals else totals[key] + part
        if totals:
            slot = TaskContext.get().partitionId() % FAN
            yield pd.DataFrame([(n, b, slot, v.tobytes()) for (n, b), v in totals.items()], columns=["domain", "block", "slot", "sums"])

    return run


def _solve_classes(d: int, classes: int, ridge: float):
    k, upper = classes - 1, np.triu_indices(d)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    penalty = np.tile(np.r_[0.0, np.full(d - 1, ridge)], k)

    def run(frame: pd.DataFrame, active: dict) -> pd.DataFrame:
        name, block, t = frame["domain"].iloc[0], int(frame["block"].iloc[0]), len(upper[0])
        sums = sum(np.frombuffer(x) for x in frame["sums"]).reshape(-1, 2 + k * d + len(pairs) * t)
        out = []
        for i, row in enumerate(sums):
            b, total = active[name][1][block * BLOCK + i], max(row[0], 1e-300)
            gradient = row[2:2 + k * d] / total + penalty * b
            hessian = np.diag(penalty)
            for q, (one, other) in enumerate(pairs):
                part = np.zeros((d, d))
                part[upper] = row[2 + k * d + q * t:2 + k * d + (q + 1) * t] / total
                part = part + np.triu(part, 1).T
                hessian[one * d:(one + 1) * d, other * d:(other + 1) * d] += part
                if one != other:
                    hessian[other * d:(other + 1) * d, one * d:(one + 1) * d] += part
            step = np.linalg.lstsq(hessian, gradient, rcond=1e-13)[0]
            out.append((name, block * BLOCK + i, float(row[1] / total + 0.5 * penalty @ (b * b)), float(np.abs(gradient).max()), row[:2].tobytes(), step.tobytes()))
        return pd.DataFrame(out, columns=["domain", "at", "loss", "slope", "scalars", "step"])

    return run


def fit_many_classes(rows: DataFrame, encoding: Encoding, ridge: float, columns: dict[str, int], classes: int, tolerance: float = 1e-10,
                     passes: int = 40) -> dict[str, Fits]:
    """Multinomial logits with the first class as reference; ``_y`` holds 0 to ``classes`` - 1.

    A fit's row of ``beta`` holds the terms of class 1, then of class 2, and so on. Penalty on all terms but the intercepts.
    """
    size = (classes - 1) * len(encoding.labels)
    out = {name: Fits(np.zeros((n, size)), ["open"] * n, {k: np.full(n, np.nan) for k in ("weight", "loss")}) for name, n in columns.items()}
    solve = _solve_classes(len(encoding.labels), classes, ridge)
    _settle(lambda active: _pass(rows, lambda a: _class_sums(encoding, classes, a), solve, active), out,
            {name: np.arange(n) for name, n in columns.items()}, lambda scalars: not scalars[0] > 0, tolerance, passes)
    return out


GAP_METRICS = tuple(f"{kind}_{arm}" for kind in ("observed", "adjusted") for arm in ("control", "treated", "gap"))


def _curvature_sums(encoding: Encoding, active: dict):
    d = len(encoding.labels)
    upper = np.triu_indices(d)

    def run(batches):
        totals: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, mine in batch.groupby("domain", sort=False):
                if name not in active:
                    continue
                columns, beta = active[name]
                for at in range(0, len(mine), ROWS):
                    rows = mine.iloc[at:at + ROWS]
                    x, y, w = encoding.matrix(rows), rows["_y"].to_numpy(float), _weights(rows)[:, columns]
                    p = _expit(x @ beta.T)
                    arms = [w * (x[:, 1] == a)[:, None] for a in (0, 1)]
                    parts = [w.sum(axis=0)[:, None], *[v.sum(axis=0)[:, None] for v in arms], *[(v * y[:, None]).sum(axis=0)[:, None] for v in arms]]
                    for a in (0.0, 1.0):
                        xa = encoding.matrix(rows, a)
                        q = _expit(xa @ beta.T)
                        parts += [(w * q).sum(axis=0)[:, None], (w * q * (1 - q)).T @ xa]
                    parts.append((w * p * (1 - p)).T @ (x[:, upper[0]] * x[:, upper[1]]))
                    every = np.concatenate(parts, axis=1)
                    for b in range(0, len(columns), BLOCK):
                        key, part = (name, b // BLOCK), every[b:b + BLOCK]
                        totals[key] = part if key not in totals else totals[key] + part
        if totals:
            slot = TaskContext.get().partitionId() % FAN
            yield pd.DataFrame([(n, b, slot, v.tobytes()) for (n, b), v in totals.items()], columns=["domain", "block", "slot", "sums"])

    return run


def _solve_directions(d: int, ridge: float):
    upper, penalty = np.triu_indices(d), np.r_[0.0, np.full(d - 1, ridge)]

    def run(frame: pd.DataFrame, active: dict) -> pd.DataFrame:
        name, block = frame["domain"].iloc[0], int(frame["block"].iloc[0])
        sums = sum(np.frombuffer(x) for x in frame["sums"]).reshape(-1, 7 + 2 * d + len(upper[0]))
        out = []
        for i, row in enumerate(sums):
            total, curvature = row[0], np.zeros((d, d))
            curvature[upper] = row[7 + 2 * d:] / total
            curvature = curvature + np.triu(curvature, 1).T + np.diag(penalty)
            means, slopes = (row[5] / total, row[6 + d] / total), (row[6:6 + d] / total, row[7 + d:7 + 2 * d] / total)
            directions = [np.linalg.lstsq(curvature, s, rcond=1e-12)[0] for s in slopes]
            scalars = np.array([total, *row[1:3], *(row[3:5] / row[1:3]), *means])
            out.append((name, block * BLOCK + i, 0.0, 0.0, scalars.tobytes(), np.concatenate(directions).tobytes()))
        return pd.DataFrame(out, columns=["domain", "at", "loss", "slope", "scalars", "step"])

    return run


def gap_influence_strata(rows: DataFrame, cells: DataFrame, encoding: Encoding, ridge: float, fits: dict[str, Fits], design: SurveyDesign) -> tuple[DataFrame, DataFrame]:
    """Arm means and gaps of every fit, and per stratum the sums and squares of the cluster totals of their influence values.

    Points come from a pass over ``cells``, the sums of ``rows`` over clusters. ``rows`` lie sorted by domain and cluster, each
    cluster in one partition, so a cluster's totals (all fits and metrics) are known in its task and never leave it.
    Returns (``domain, fit, metric, estimate``; ``domain, fit, metric``, strata, ``_s`` and ``_q``).
    """
    d, strata = len(encoding.labels), ["domain", *design.strata]
    penalty = np.r_[0.0, np.full(d - 1, ridge)]
    active = {name: (np.arange(len(f.beta)), f.beta) for name, f in fits.items()}
    solved = _pass(cells, lambda a: _curvature_sums(encoding, a), _solve_directions(d, ridge), active)
    scalars = {name: np.stack([r[2] for r in found]) for name, found in solved.items()}
    directions = {name: np.stack([r[3] for r in found]) for name, found in solved.items()}
    points = []
    for name, s in scalars.items():
        for j, (_, _, _, o0, o1, m0, m1) in enumerate(s.tolist()):
            points += [(name, j, k, v) for k, v in zip(GAP_METRICS, (o0, o1, o1 - o0, m0, m1, m1 - m0))]

    def values(part: pd.DataFrame, name: str) -> np.ndarray:
        """Rows times (metrics times fits)."""
        beta, s, turn = active[name][1], scalars[name], directions[name]
        x, y, w = encoding.matrix(part), part["_y"].to_numpy(float)[:, None], _weights(part)
        share, out = w / s[:, 0], {}
        residual = y - _expit(x @ beta.T)
        for a, arm in ((0, "control"), (1, "treated")):
            direction = turn[:, a * d:(a + 1) * d]
            q = _expit(encoding.matrix(part, float(a)) @ beta.T)
            offset = (penalty * beta * direction).sum(axis=1)
            out[f"adjusted_{arm}"] = share * (residual * (x @ direction.T) - offset + q - s[:, 5 + a])
            out[f"observed_{arm}"] = w * (x[:, 1] == a)[:, None] * (y - s[:, 3 + a]) / s[:, 1 + a]
        for kind in ("observed", "adjusted"):
            out[f"{kind}_gap"] = out[f"{kind}_treated"] - out[f"{kind}_control"]
        return np.concatenate([out[k] for k in GAP_METRICS], axis=1)

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        held = None  # the last cluster of a part may go on in the next

        def add(keys: pd.DataFrame, totals: np.ndarray) -> None:
            at = _starts_of(keys[strata])
            pairs = zip(np.add.reduceat(totals, at, axis=0), np.add.reduceat(totals * totals, at, axis=0))
            for key, pair in zip(keys[strata].iloc[at].itertuples(index=False, name=None), pairs):
                sums[key] = np.stack(pair) + sums.get(key, 0.0)

        def packed() -> pd.DataFrame:
            found = pd.DataFrame(list(sums), columns=strata).assign(_sums=[v[0] for v in sums.values()], _squares=[v[1] for v in sums.values()])
            sums.clear()
            return found

        for batch in batches:
            for name, mine in batch.groupby("domain", sort=False):
                for at in range(0, len(mine), ROWS):
                    part = mine.iloc[at:at + ROWS]
                    keys = part[["domain", *design.cluster]].reset_index(drop=True)
                    starts = _starts_of(keys)
                    totals, keys = np.add.reduceat(values(part, name), starts, axis=0), keys.iloc[starts].reset_index(drop=True)
                    if held is not None:
                        if len(_starts_of(pd.concat([held[0], keys.iloc[:1]], ignore_index=True))) == 1:
                            totals[0] += held[1][0]
                        else:
                            add(*held)
                    held = (keys.iloc[-1:].reset_index(drop=True), totals[-1:])
                    if len(keys) > 1:
                        add(keys.iloc[:-1], totals[:-1])
                    if len(sums) > ROWS:
                        yield packed()
        if held is not None:
            add(*held)
        if sums:
            yield packed()

    kinds, fit_count = dict(rows.dtypes), {name: len(f.beta) for name, f in fits.items()}
    schema = ", ".join(f"{c} {kinds[c]}" for c in strata) + ", _sums array<double>, _squares array<double>"
    size = F.create_map(*[F.lit(x) for item in fit_count.items() for x in item])[F.col("domain")]
    long = rows.where(F.col("domain").isin(list(active))).mapInPandas(run, schema).select(
        *strata, size.alias("_fits"), F.posexplode(F.arrays_zip("_sums", "_squares")).alias("_at", "_v"))
    totals = long.groupBy("domain", (F.col("_at") % F.col("_fits")).alias("fit"), *design.strata,
                          F.array(*[F.lit(k) for k in GAP_METRICS])[F.floor(F.col("_at") / F.col("_fits")).cast("int")].alias("metric")).agg(
        F.sum("_v._sums").alias("_s"), F.sum("_v._squares").alias("_q"))
    return rows.sparkSession.createDataFrame(points, "domain string, fit int, metric string, estimate double"), totals


def adjusted_variances(totals: DataFrame, by: Sequence[str], design: SurveyDesign, roster: DataFrame) -> DataFrame:
    """Design variance of every metric for every level of ``by`` from sums (``_s``) and squares (``_q``) per stratum, clusters of the roster without rows counting as zeros.

    Strata with at least one row count; a cluster alone in its stratum is centred on the mean of all totals.
    """
    sizes = roster.groupBy(*design.strata).agg(F.count("*").alias("_n"))
    strata = totals.join(sizes, list(design.strata))
    n, s, q, one = F.col("_n"), F.col("_s"), F.col("_q"), F.col("_n") == 1
    sums = strata.groupBy(*by, "metric").agg(
        F.sum(F.when(~one, n / (n - 1) * (q - s * s / n)).otherwise(0.0)).alias("_base"), F.sum(s).alias("_g"), F.sum(n).alias("_clusters"),
        F.sum(F.when(one, s).otherwise(0.0)).alias("_l"), F.sum(F.when(one, q).otherwise(0.0)).alias("_m"),
        F.count_if(one).alias("_k"), F.count("*").alias("_strata"))
    mean = F.col("_g") / F.col("_clusters")
    return sums.select(*by, "metric", (F.col("_base") + F.col("_m") - 2 * mean * F.col("_l") + F.col("_k") * mean * mean).alias("variance"),
                       (F.col("_clusters") - F.col("_strata")).alias("design_df"))
