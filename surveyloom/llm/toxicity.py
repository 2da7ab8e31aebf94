"""Toxicity by compression distance: two zstandard dictionaries and the lengths they give to windows.

One dictionary is trained on ordinary text. The other one is trained on what toxic text has beyond
it: the stretches of the labelled toxic texts whose byte sequences are far more common in toxic
than in ordinary documents. It is put in front of the ordinary one, so both agree on
ordinary text and the difference of two compressed lengths shows toxic content only. Thresholds
on the window differences are calibrated on other labelled texts than the dictionaries saw.

Training reads whole texts on the executors; the driver gets the samples of the two dictionaries, the marked
byte runs, counts, and six numbers per text.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.common import cut, held_out, with_row_key
from surveyloom.llm.textarrays import mix

WINDOW, STRIDE, GRAM, LEVEL = 96, 64, 5, 9
#: Gram counts held by a task before it hands them on; longest piece of a stretch.
FLUSH_GRAMS, PIECE = 4_000_000, 4096
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def windows(text: bytes) -> list[bytes]:
    """Overlapping windows over the whole text; a short text is one window."""
    return [text[i:i + WINDOW] for i in range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE)]


@functools.cache
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=max(8, len(content)), source_size=WINDOW, write_content_size=0, write_checksum=0, write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=parameters)
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=parameters)


def lengths(content: bytes, parts: list[bytes]) -> np.ndarray:
    """Compressed length of each window under a dictionary."""
    out = np.zeros(len(parts), np.int64)
    full = [i for i, p in enumerate(parts) if p]
    if full:
        packed = _compressor(content).multi_compress_to_buffer([parts[i] for i in full], threads=1)
        out[full] = [len(packed[i]) for i in range(len(packed))]
    return out


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    #: How often a window of ordinary text has at least this difference, by difference from 0 on.
    tail: np.ndarray
    weights: np.ndarray

    def features(self, texts: list[bytes]) -> np.ndarray:
        parts = [windows(t) for t in texts]
        flat = [w for p in parts for w in p]
        gaps = lengths(self.ordinary, flat) - lengths(self.toxic + self.ordinary, flat)
        out, at = np.zeros((len(texts), 6)), 0
        for i, p in enumerate(parts):
            own = np.sort(gaps[at:at + len(p)])[::-1]
            at += len(p)
            top = np.maximum(own[:3], 0)
            rare = -np.log(self.tail[np.minimum(top.astype(int), len(self.tail) - 1)])
            n = np.log(len(p))
            # surprise of the highest windows, given how many windows the text has
            out[i] = (1, rare[0] - n, n, rare[1] if len(rare) > 1 else 0, rare[2] if len(rare) > 2 else 0,
                      np.log1p((own >= 4).sum()))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def _grams(text: bytes) -> np.ndarray:
    """Runs of GRAM bytes as integers, without white space after the first byte; else 0."""
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    count = len(data) - GRAM + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out, blank = np.zeros(count, np.uint64), np.zeros(count, bool)
    for i in range(GRAM):
        part = data[i:i + count]
        out = (out << np.uint64(8)) | np.where(_SPACE[part], 32, part).astype(np.uint64)
        if i:
            blank |= _SPACE[part]
    out[blank] = 0
    return out


def even_quota(sizes: list[int], bound: int) -> int:
    """The largest share per text, so that texts of these sizes give at most ``bound`` together."""
    sizes, left = sorted(sizes), bound
    for i, size in enumerate(sizes):
        if size * (len(sizes) - i) > left:
            return left // (len(sizes) - i)
        left -= size
    return max(sizes, default=0)


def _chosen_windows(quota: int):
    """Arrow function over ``(place, text)``: the windows of each text, at most ``quota`` of them, the first by a hash."""
    def run(batches):
        for batch in batches:
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                count = len(range(0, max(1, text.as_buffer().size - WINDOW + STRIDE), STRIDE))
                body, kept = text.as_buffer(), np.arange(count)
                if count > quota:
                    with np.errstate(over="ignore"):
                        drawn = mix(kept.astype(np.uint64) + mix(np.array([place + 1], np.uint64)))
                    kept = np.sort(np.argsort(drawn, kind="stable")[:quota])
                for at in range(0, len(kept), 10_000):
                    some = kept[at:at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), place)), pa.array(some),
                                                      pa.array([body[i:i + WINDOW].to_pybytes() for i in (some * STRIDE).tolist()], pa.binary())],
                                                     ["place", "at", "part"])
    return run


def _gram_counts(batches):
    """Arrow function over ``(label, text)``: in how many texts of the batches a gram is, by label."""
    held, count = ([], []), 0

    def flush():
        for label in (0, 1):
            if held[label]:
                grams, seen = np.unique(np.concatenate(held[label]), return_counts=True)
                held[label].clear()
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.where(label, seen, 0)), pa.array(np.where(label, 0, seen))],
                                                 ["gram", "toxic", "ordinary"])

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held[label].append(np.unique(_grams(text.as_py())))
            count += len(held[label][-1])
            if count >= FLUSH_GRAMS:
                yield from flush()
                count = 0
    yield from flush()


def _stretches(marked: np.ndarray):
    """Arrow function over ``(place, text)``: the stretches of each text that marked grams cover."""
    def run(batches):
        for batch in batches:
            for place, scalar in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = scalar.as_py()
                hit = np.isin(_grams(text), marked)
                covered = np.zeros(len(text) + 2, bool)
                for i in range(GRAM):
                    covered[i:i + len(hit)] |= hit
                edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
                padded = b" " + text + b" "
                found = [(i, padded[i:min(b, i + PIECE)]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) for i in range(a, b, PIECE)]
                if found:
                    at, parts = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([place] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(parts, pa.binary())],
                                                     ["place", "at", "part"])
    return run


def toxic_stretches(learn: DataFrame, toxic: int, ordinary: int, max_bytes: int, ratio: float = 10.0, share: float = 0.02,
                    least: int = 3) -> list[bytes]:
    """Stretches of the toxic texts made of byte runs that are ``ratio`` times as common there as in ordinary texts.

    ``learn`` has ``(place, label, text)``. More than ``max_bytes`` are taken evenly from the texts, by a hash of the place.
    """
    counts = learn.select("label", "text").mapInArrow(_gram_counts, "gram long, toxic long, ordinary long").groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    marked = counts.where((F.col("gram") != 0) & (F.col("toxic") >= max(least, share * toxic))
                          & (F.col("toxic") / max(1, toxic) > ratio * (F.col("ordinary") + 1) / max(1, ordinary))).select("gram").toPandas()
    grams = np.sort(marked["gram"].to_numpy(np.int64).view(np.uint64))
    if not len(grams):
        return []
    found = cut(learn.where("label = 1").select("place", "text").mapInArrow(_stretches(grams), "place long, at long, part binary"))
    size = F.length("part").cast("long")
    sizes = [r["n"] for r in found.groupBy("place").agg(F.sum(size).alias("n")).collect()]
    if sum(sizes) > max_bytes:
        so_far = F.sum(size).over(Window.partitionBy("place").orderBy(F.xxhash64("place", "at"), "at"))
        found = found.withColumn("_sum", so_far).where(F.col("_sum") <= even_quota(sizes, max_bytes))
    return _in_order(found)


def _in_order(parts: DataFrame) -> list[bytes]:
    rows = parts.select("place", "at", "part").toArrow().sort_by([("place", "ascending"), ("at", "ascending")])
    return rows["part"].to_pylist()


def _gap_counts(model: ToxicityModel):
    """Arrow function over ``(text)``: how many windows have which difference of lengths, 0 to 40."""
    def run(batches):
        counts = np.zeros(41, np.int64)
        for batch in batches:
            for text in batch.column(0):
                flat = windows(text.as_py())
                gaps = lengths(model.ordinary, flat) - lengths(model.toxic + model.ordinary, flat)
                counts += np.bincount(np.clip(gaps, 0, 40), minlength=41)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(41)), pa.array(counts)], ["gap", "n"])
    return run


def _features(model: ToxicityModel):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = model.features(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(found), pa.list_(pa.float64()))], ["place", "x"])
    return run


def _dictionary(samples: list[bytes], size: int, **how) -> bytes:
    """Content of a trained dictionary; too few samples to train on are used as they are."""
    try:
        return zstandard.train_dictionary(size, samples, level=3, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def fit_model(texts: DataFrame, ordinary_size: int = 16384, toxic_size: int = 2048, max_windows: int = 200_000) -> ToxicityModel:
    """Dictionaries from one half of the texts, thresholds and weights from the other half.

    ``texts`` has ``(row, label, text)``, different rows, in an order given by ``first`` and ``second``. Without toxic texts
    there is nothing to tell apart and every score is the smoothed share. The ordinary dictionary learns from at
    most ``max_windows`` windows: if the texts have more, each gives the same number, chosen by a hash, or all it
    has. The toxic one learns from as many bytes at most, taken likewise. Everything else reads whole texts.
    """
    rows = texts.select("row", "label", F.length("text").alias("size"), "first", "second").collect()
    rows.sort(key=lambda r: (-r["label"], r["first"], r["second"], r["row"]))
    toxic, ordinary = ([r for r in rows if r["label"] == y] for y in (1, 0))
    share = (len(toxic) + 1) / (len(toxic) + len(ordinary) + 2)
    if len(toxic) < 2 or len(ordinary) < 2:
        return ToxicityModel(b"", b"", np.ones(1), np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0]))
    places = [(r["row"], i, i % 2 == 0) for some in (toxic, ordinary) for i, r in enumerate(some)]
    halves = texts.sparkSession.createDataFrame(places, "row long, place long, learns boolean")
    placed = texts.join(F.broadcast(halves), "row").select("place", "learns", "label", "text")
    learn, check = placed.where("learns"), placed.where("not learns")
    quota = even_quota([len(range(0, max(1, r["size"] - WINDOW + STRIDE), STRIDE)) for r in ordinary[::2]], max_windows)
    base = _dictionary(_in_order(learn.where("label = 0").select("place", "text").mapInArrow(_chosen_windows(quota), "place long, at long, part binary")),
                       ordinary_size)
    found = toxic_stretches(learn, len(toxic[::2]), len(ordinary[::2]), max_windows * WINDOW)
    extra = _dictionary([b"".join(found[i:i + 4]) for i in range(0, len(found), 4)], toxic_size, k=16, d=6) if found else b""
    model = ToxicityModel(base, extra, np.ones(1), np.zeros(6))
    gaps = check.where("label = 0").select("text").mapInArrow(_gap_counts(model), "gap long, n long").groupBy("gap").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(41, np.int64)
    counts[[r["gap"] for r in gaps]] = [r["n"] for r in gaps]
    model.tail = (counts[::-1].cumsum()[::-1] + 1) / (counts.sum() + 1)
    known = [check.where(F.col("label") == y).select("place", "text").mapInArrow(_features(model), "place long, x array<double>").collect() for y in (1, 0)]
    x = np.array([r["x"] for some in known for r in sorted(some, key=lambda r: r["place"])])
    y = np.r_[np.ones(len(known[0])), np.zeros(len(known[1]))]
    model.weights = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; the first column is the constant and is not shrunk."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.r_[0.0, np.ones(x.shape[1] - 1)]

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (penalty * v * v).sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (p - y) + penalty * w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), slope)
        scale = 1.0
        while scale > 1e-6 and loss(w - scale * move) > loss(w):
            scale /= 2
        w = w - scale * move
        if np.abs(scale * move).max() < 1e-8:
            break
    return w


def _score(model: ToxicityModel, keep_text: bool = False):
    """Arrow function: the last column is the text; it is followed (with ``keep_text``) or replaced by its score."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pc.fill_null(part.column(part.num_columns - 1).cast(pa.large_binary()), b"").to_pylist()
                kept = part.num_columns - (not keep_text)
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.array(model.score(texts))], [*part.schema.names[:kept], "score"])
    return run


def training_texts(documents: DataFrame, labels: DataFrame, label: str, max_toxic: int, max_ordinary: int, seed: int,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, label, text, first, second)`` of at most so many labelled texts of each class, the first by a hash of the id, never held-out ones.

    The ids are chosen from the labels alone, so only the chosen texts are read into the sample.
    Equal texts count once, else groups of copies would look like frequent wording.
    """
    known = (labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
             .where(F.col("_y").isin(0, 1) & ~held_out(F.col("_id"))).distinct())
    order = [F.xxhash64("_id", F.lit(seed)), F.col("_id")]
    chosen = (known.where("_y = 1").orderBy(*order).limit(max_toxic)
              .unionAll(known.where("_y = 0").orderBy(*order).limit(max_ordinary)))
    texts = documents.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = (texts.join(F.broadcast(chosen), "_id")  # at most max_toxic + max_ordinary rows
            .where(F.length("_text") > 0).groupBy("_y", "_text").agg(F.min("_id").alias("_id")))
    return cut(with_row_key(rows, "row").select("row", F.col("_y").alias("label"), F.col("_text").cast("binary").alias("text"),
                                                order[0].alias("first"), order[1].alias("second")))


def toxicity_model(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_toxic: int = 3000,
                   max_ordinary: int = 5000, seed: int = 11, max_windows: int = 200_000) -> ToxicityModel:
    """A model of at most so many labelled texts; ``max_windows`` bounds the samples of the dictionaries (see ``fit_model``)."""
    return fit_model(training_texts(documents, labels, label, max_toxic, max_ordinary, seed), max_windows=max_windows)


def toxicity_scores(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",),
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep`` columns, ``held_out``, ``score`` and ``predicted`` for every row of ``documents``.

    Whole texts are cut into windows; a null text scores as an empty one. A null id is not held
    out. Repeated rows keep a row each, other columns are ignored, an empty table gives no rows.
    """
    fields = {f.name: f.dataType.simpleString() for f in documents.schema}
    own = text in keep  # a kept text is sent to Python once
    names = ["_text" if c == text else f"_keep_{i}" for i, c in enumerate(keep)]
    others = [(k, c) for k, c in zip(names, keep) if c != text]
    texts = documents.select(*[F.col(c).alias(k) for k, c in others], F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    schema = ", ".join([*[f"{k} {fields[c]}" for k, c in others], "_id long", *([f"_text {fields[text]}"] if own else []), "score double"])
    scored = texts.mapInArrow(_score(model, own), schema)
    return scored.select(*[F.col(k).alias(c) for k, c in zip(names, keep)], held_out(F.col("_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
