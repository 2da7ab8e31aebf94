"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is binned; shallow trees are boosted in turn, feature by feature, on the logistic loss,
so that every feature ends as one lookup table. Then the pairs that still explain most of the
residual get two-dimensional tables in the same way. A score is a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import cut, held_out
from surveyloom.llm.text_statistics import NAMES, STATISTICS_SCHEMA, add_statistics

FEATURES = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
    "equal_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_upper", "n_letters"),
    "digits": ("n_digits", "n_bytes"), "exclamations": ("n_exclaim", "n_words"), "pipes": ("n_pipes", "n_words"),
    "distinct": ("n_distinct", "n_words"), "stutter": ("n_adjacent", "n_words"), "closed_lines": ("n_closed_lines", "n_lines"),
    "line_words": ("n_words", "n_lines"), "non_ascii": ("n_non_ascii", "n_bytes"), "stops": ("n_stops", "n_words"),
}


def feature_matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios of the statistics (0 where the whole is 0), one column per feature."""
    return np.stack([stats[a] / np.maximum(stats[b], 1) if b else stats[a].astype(float) for a, b in FEATURES.values()], axis=1)


@dataclass
class AdditiveModel:
    """Bin edges, one table per feature and one table per chosen pair, all on the log-odds scale."""

    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def log_odds(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for j, values in enumerate(self.tables):
            out += values[bins[:, j]]
        for a, b, values in self.pairs:
            out += values[bins[:, a], bins[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(self.bins(x))))


def _sums(index: np.ndarray, size: int, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(index, grad, size), np.bincount(index, hess, size)


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Gain and place of the best split of ordered bins."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total_g, total_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + ridge) + (total_g - left_g)**2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
    gain[(left_h < least) | (total_h - left_h < least)] = 0
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Newton values of a tree with few leaves over ordered bins."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    while len(parts) < leaves:
        gain, at, place = max((*_best_cut(g[a:b], h[a:b], ridge, least), i) for i, (a, b) in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts.pop(place)
        parts += [(a, a + at), (a + at, b)]
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int, int]:
    """Best pair of cuts of a grid of sums: gain over no cut, row and column."""
    cum_g, cum_h = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    all_g, all_h = cum_g[-1, -1], cum_h[-1, -1]
    top_g, top_h, left_g, left_h = cum_g[:-1, -1:], cum_h[:-1, -1:], cum_g[-1:, :-1], cum_h[-1:, :-1]
    aa_g, aa_h = cum_g[:-1, :-1], cum_h[:-1, :-1]
    gain, small = -all_g**2 / (all_h + ridge), False
    for x, y in ((aa_g, aa_h), (top_g - aa_g, top_h - aa_h), (left_g - aa_g, left_h - aa_h),
                 (all_g - top_g - left_g + aa_g, all_h - top_h - left_h + aa_h)):
        gain = gain + x**2 / (np.maximum(y, 0) + ridge)
        small = small | (y < least)
    gain = np.where(small, 0, gain)
    if not gain.size:
        return 0.0, 0, 0
    row, column = np.unravel_index(gain.argmax(), gain.shape)
    return float(gain[row, column]), int(row) + 1, int(column) + 1


def fit(x: np.ndarray, y: np.ndarray, max_bins: int = 32, rounds: int = 150, rate: float = 0.1, leaves: int = 3,
        pairs: int = 6, pair_rounds: int = 60, ridge: float = 1.0, least: float = 3.0, settled: float = 0.002) -> AdditiveModel:
    """Fit to rows of features and labels 0 or 1. Without both labels the model is the smoothed share alone.

    Boosting of single features stops early once the mean residual is below ``settled``.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])) if len(x) else np.zeros(0)
             for j in range(x.shape[1])]
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges])
    if len(np.unique(y)) < 2:
        return model
    bins = model.bins(x)
    odds = model.log_odds(bins)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        if np.abs(slopes()[0]).mean() < settled:
            break
        for j, values in enumerate(model.tables):
            step = rate * _tree(*_sums(bins[:, j], len(values), *slopes()), leaves, ridge, least)
            values += step
            odds += step[bins[:, j]]
    sizes = [len(t) for t in model.tables]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = _sums(bins[:, a] * sizes[b] + bins[:, b], sizes[a] * sizes[b], *slopes())
        return g.reshape(sizes[a], sizes[b]), h.reshape(sizes[a], sizes[b])

    gains = sorted(((-_quadrants(*grid(a, b), ridge, least)[0], a, b) for a, b in combinations(range(len(sizes)), 2)
                    if min(sizes[a], sizes[b]) > 1))
    model.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for gain, a, b in gains[:pairs] if gain < 0]
    for _ in range(pair_rounds):
        for a, b, values in model.pairs:
            g, h = grid(a, b)
            gain, row, column = _quadrants(g, h, ridge, least)
            if gain <= 1e-9:
                continue
            step = np.zeros_like(values)
            for rows in (slice(0, row), slice(row, None)):
                for columns in (slice(0, column), slice(column, None)):
                    step[rows, columns] = -rate * g[rows, columns].sum() / (h[rows, columns].sum() + ridge)
            values += step
            odds += step[bins[:, a], bins[:, b]]
    return model


def _score(model: AdditiveModel, keep: list[str]):
    def run(batches):
        for batch in batches:
            stats = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES}
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(model.score(feature_matrix(stats)))],
                                             [*keep, "score"])
    return run


def quality_scores(documents: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3,
                   max_rows: int = 40_000, seed: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``documents``.

    The model is fitted on at most ``max_rows`` labelled rows, the first by a hash of the id, and
    never on held-out rows. Inputs are counts over the whole text. A null text scores as an empty
    one; a null id is not held out and has no label; labels that are null or neither 0 nor 1 are
    ignored; repeated rows keep a row each. An empty table gives no rows, and without usable labels
    every score is the smoothed share of label 1.
    """
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    stats = cut(texts.mapInArrow(add_statistics(["doc_id"]), f"doc_id long, {STATISTICS_SCHEMA}"))
    known = (labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
             .where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))))
    sample = stats.join(known, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows).toPandas()
    columns = {n: sample[n].to_numpy(np.float64) for n in NAMES}
    model = fit(feature_matrix(columns), sample["y"].to_numpy(np.float64))
    scored = stats.mapInArrow(_score(model, ["doc_id"]), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
