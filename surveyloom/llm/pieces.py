"""Sampled SentencePiece segmentations and lossless decoding.

A text, with one space put in front, is cut before each run of spaces; no piece of the vocabulary
reaches over such a cut, so the piece lattice of a text is the chain of the lattices of its parts.
The forward sums are computed once per distinct part and kept for the later runs of a task. Each occurrence is then
sampled backward from its end: an edge is chosen with the probability its start's forward sum gives it. The draws
are a hash of (seed, row key, part, step), so a row's segmentation does not depend on how rows are
partitioned. Characters without a piece fall back to byte pieces; a literal word-start mark in a text
does too, which keeps decoding lossless.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.textarrays import _BASE, _BYTE, _powers, chunks, mix

_MARK = "▁"
_SPACE = 0x20
_FILTER_BITS = 22
CHUNK_BYTES = 1 << 20
#: Places that all parts of a run take together, and occurrences beyond which sampling works on arrays.
SIDE_BY_SIDE, FEW = 48, 24
#: Edges of parts that a task keeps for its later runs (44 bytes each).
EDGES_KEPT = 2_000_000
_ONE, _FULL = 1 << 30, (1 << 64) - 1
#: Bytes of a UTF-8 character by its first byte.
_WIDTH = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(_BASE)) >> np.uint64(64 - _FILTER_BITS)


def _order(values: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative integers, 16 bits at a time."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    top = int(values.max(initial=0)) >> 16
    while top:
        values = values >> 16
        order = order[np.argsort((values[order] & 0xFFFF).astype(np.uint16), kind="stable")]
        top >>= 16
    return order


class Lattice:
    """Pieces of a vocabulary by the hashes of their bytes, and the hashes of all their prefixes."""

    def __init__(self, model_file: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.surface = [b""] * size
        forms: dict[int, list] = {}
        prefixes: dict[int, set] = {}
        first = None
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.surface[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                first = i if first is None else first
                form = model.id_to_piece(i).replace(_MARK, " ").encode()
                self.surface[i] = form
                forms.setdefault(len(form), []).append((form, i))
                for n in range(1, len(form) + 1):
                    prefixes.setdefault(n, set()).add(form[:n])
        # the rank of a piece stands for its frequency, as in Zipf's law; single bytes are the last resort
        self.weight = -sharpness * np.log(2.0 + np.maximum(0, np.arange(size) - first))
        self.weight[self.byte_ids] = -sharpness * np.log(4.0 * size)
        self.longest = max(forms)
        self.pieces = {n: self._sorted([f for f, _ in x], [i for _, i in x]) for n, x in forms.items()}
        # filters by the top bits of a hash: what passes them wrongly fails the exact look-up
        self.begun, self.whole = np.zeros(1 << _FILTER_BITS, bool), np.zeros(1 << _FILTER_BITS, bool)
        for n, x in prefixes.items():
            self.begun[_slot(self._hash(list(x)))] = True
            if n in self.pieces:
                self.whole[_slot(self.pieces[n][0])] = True
        self.lengths = np.array([len(s) for s in self.surface])
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self.bytes = np.frombuffer(b"".join(self.surface), np.uint8)

    @staticmethod
    def _hash(forms: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(forms), np.uint8).reshape(len(forms), -1)
        up, _ = _powers(data.shape[1])
        return (_BYTE[data] * up[:data.shape[1]]).sum(axis=1, dtype=np.uint64)

    def _sorted(self, forms: list[bytes], ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        hashes = self._hash(forms)
        order = np.argsort(hashes)
        return hashes[order], np.array(ids)[order]

    def edges(self, data: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every edge over ``data``; ``last`` is where the part of each byte ends."""
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
        alive, found = np.arange(len(data)), []
        # bytes of characters that have a piece of their own need no byte pieces
        alone = np.ones(len(data), bool)
        width = _WIDTH[data]
        for n in range(1, self.longest + 1):
            alive = alive[alive + n <= last[alive]]
            if not len(alive):
                break
            hashes = (sums[alive + n] - sums[alive]) * down[alive]
            slots = _slot(hashes)
            fits = self.begun[slots]
            alive, hashes, slots = alive[fits], hashes[fits], slots[fits]
            if n in self.pieces:
                table, ids = self.pieces[n]
                maybe = self.whole[slots]
                starts, sought = alive[maybe], hashes[maybe]
                at = np.minimum(np.searchsorted(table, sought), len(table) - 1)
                hit = table[at] == sought
                starts = starts[hit]
                found.append((starts, starts + n, ids[at[hit]]))
                for i in range(n if n <= 4 else 0):
                    alone[starts[width[starts] == n] + i] = False
        rest = np.flatnonzero(alone)
        found.append((rest, rest + 1, self.byte_ids[data[rest]]))
        return tuple(np.concatenate(x) for x in zip(*found))


@functools.cache
def lattice(model_file: str, sharpness: float) -> Lattice:
    return Lattice(model_file, sharpness)


def _forward(kit: Lattice, data: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """Edges sorted by end, with the running probability of the edges into each end in units of 2^-30.

    Ends are numbered so that part p's local place t is ``begins[p] + p + t``. Whole units that add up to 2^30
    at every end keep the running sums exact, so a draw does not depend on what else is in the table.
    """
    last = np.repeat(ends, ends - begins)
    part = np.repeat(np.arange(len(begins)), ends - begins)
    start, end, piece = kit.edges(data, last)
    own = part[start]
    source, target = start + own, end + own
    order = _order(target)
    source, target, piece = source[order], target[order], piece[order]
    local = target - (begins + np.arange(len(begins)))[own[order]]
    weight, alpha = kit.weight[piece], np.zeros(len(data) + len(begins))
    first = np.searchsorted(target, np.arange(len(alpha) + 1))
    # the forward sums of all parts at once, one local place after the other
    turn = _order(local)
    turn = turn[:int(np.searchsorted(local[turn], SIDE_BY_SIDE, side="right"))]
    steps = np.r_[0, np.flatnonzero(np.diff(local[turn])) + 1, len(turn)] if len(turn) else np.zeros(1, int)
    for a, b in zip(steps[:-1], steps[1:]):
        own_edges = turn[a:b]
        into = target[own_edges]
        inner = np.r_[0, np.flatnonzero(np.diff(into)) + 1]
        value = alpha[source[own_edges]] + weight[own_edges]
        top = np.maximum.reduceat(value, inner)
        sizes = np.diff(np.r_[inner, b - a])
        alpha[into[inner]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, sizes)), inner))
    for p in np.flatnonzero(ends - begins > SIDE_BY_SIDE).tolist():
        _forward_alone(alpha, int(begins[p]) + p, int(ends[p] - begins[p]), source, weight, first)
    units = np.floor(np.exp(alpha[source] + weight - alpha[target]) * _ONE).astype(np.int64)
    reached = np.flatnonzero(np.diff(first))
    total = np.add.reduceat(units, first[:-1][reached]) if len(units) else units
    units[first[1:][reached] - 1] += _ONE - total
    return source, piece, units, first


def _forward_alone(alpha: np.ndarray, floor: int, size: int, source: np.ndarray, weight: np.ndarray, first: np.ndarray) -> None:
    """Forward sums of the places of a long part beyond those that all parts take together: plain numbers are faster than arrays here."""
    values, base = alpha[floor:floor + size + 1].tolist(), int(first[floor + SIDE_BY_SIDE + 1])
    edges = first[floor + SIDE_BY_SIDE + 1:floor + size + 2].tolist()
    into, heavy = (source[base:edges[-1]] - floor).tolist(), weight[base:edges[-1]].tolist()
    for t in range(SIDE_BY_SIDE + 1, size + 1):
        a, b = edges[t - SIDE_BY_SIDE - 1] - base, edges[t - SIDE_BY_SIDE] - base
        if b - a == 1:
            values[t] = values[into[a]] + heavy[a]
        elif b > a:
            found = [values[into[i]] + heavy[i] for i in range(a, b)]
            top = max(found)
            values[t] = top + math.log(sum([math.exp(v - top) for v in found]))
    alpha[floor:floor + size + 1] = values


class Memory:
    """Edges of the parts of earlier runs of a task, up to ``EDGES_KEPT`` edges; then it begins anew."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.hashes, self.rank = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.floor, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.source, self.piece = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.running, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.rank[at], -1)

    def add(self, kit: Lattice, data: np.ndarray, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        source, piece, units, first = _forward(kit, data, begins, ends)
        places, edges, base = len(self.first) - 1, len(self.source), self.running[-1] if len(self.running) else 0
        self.floor = np.r_[self.floor, begins + np.arange(len(begins)) + places]
        self.size = np.r_[self.size, ends - begins]
        self.source, self.piece = np.r_[self.source, source + places], np.r_[self.piece, piece]
        self.running, self.first = np.r_[self.running, base + np.cumsum(units)], np.r_[self.first, first[1:] + edges]
        every = np.r_[self.hashes, hashes]
        ranks = np.r_[self.rank, len(self.rank) + np.arange(len(hashes))]
        order = np.argsort(every)
        self.hashes, self.rank = every[order], ranks[order]


def sample(kit: Lattice, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int, memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the texts ``data[offsets[i]:offsets[i + 1]]`` and where each text's ids begin.

    Each text must begin with its added space. ``memory`` may hold parts of earlier calls.
    """
    memory = Memory() if memory is None else memory
    space = data == _SPACE
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[offsets[:-1]] = True
    begins = np.flatnonzero(cut)
    ends = np.r_[begins[1:], len(data)]
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * np.uint64(_BASE))
    names, shown, kind = np.unique(hashes, return_index=True, return_inverse=True)
    if len(memory.source) > EDGES_KEPT:
        memory.clear()
    fresh = shown[memory.find(names) < 0]
    if len(fresh):
        sizes = (ends - begins)[fresh]
        own_begins = np.r_[0, np.cumsum(sizes)[:-1]]
        gather = np.repeat(begins[fresh] - own_begins, sizes) + np.arange(sizes.sum())
        memory.add(kit, data[gather], hashes[fresh], own_begins, own_begins + sizes)
    rank = memory.find(names)
    floor, size = memory.floor[rank], memory.size[rank]
    source, piece, running, first = memory.source, memory.piece, memory.running, memory.first
    text_of = np.searchsorted(offsets, begins, side="right") - 1
    number = np.arange(len(begins)) - np.searchsorted(begins, offsets[:-1])[text_of]
    state = mix(keys[text_of].astype(np.uint64) * np.uint64(_BASE) + np.uint64(seed))
    state = mix(state + number.astype(np.uint64) * np.uint64(_BASE))
    at = (floor + size)[kind]
    # occurrences of a part next to each other: their look-ups fall in the same place
    active, counts, chosen = _order(kind), np.zeros(len(begins), np.int64), []
    bottom = floor[kind]
    while len(active) > FEW:
        here = at[active]
        draw = mix(state[active] + counts[active].astype(np.uint64)) >> np.uint64(34)
        low = first[here]
        before = np.where(low > 0, running[np.maximum(low, 1) - 1], 0)
        edge = np.searchsorted(running, before + draw.astype(np.int64), side="right")
        chosen.append((active, counts[active], piece[edge]))
        counts[active] += 1
        at[active] = source[edge]
        active = active[at[active] > bottom[active]]
    alone = {}
    for who in active.tolist():
        alone[who] = _walk(memory, int(at[who]), int(bottom[who]), int(state[who]), int(counts[who]))
        counts[who] += len(alone[who])
    place = np.r_[0, np.cumsum(counts)]
    out = np.zeros(place[-1], np.int32)
    for who, step, ids in chosen:
        out[place[who] + counts[who] - 1 - step] = ids
    for who, ids in alone.items():
        out[place[who]:place[who] + len(ids)] = ids[::-1]
    return out, place[np.searchsorted(begins, offsets)]


def _walk(memory: Memory, at: int, bottom: int, state: int, step: int) -> list[int]:
    """The rest of one part's way back, edge by edge: the same draws as those of many parts together."""
    base = int(memory.first[bottom])
    first = memory.first[bottom:at + 2].tolist()
    end = first[-1]
    running = memory.running[base:end].tolist()
    source, piece = memory.source[base:end].tolist(), memory.piece[base:end].tolist()
    start, out = int(memory.running[base - 1]) if base else 0, []
    while at > bottom:
        x = state + step & _FULL
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _FULL
        x = (x ^ x >> 27) * 0x94D049BB133111EB & _FULL
        low = first[at - bottom] - base
        edge = bisect.bisect_right(running, (running[low - 1] if low else start) + ((x ^ x >> 31) >> 34), low)
        out.append(piece[edge])
        at = source[edge]
        step += 1
    return out


def _encode(model_file: str, sharpness: float, seed: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit, memory = lattice(model_file, sharpness), Memory()
        for batch in batches:
            keys, texts = pc.fill_null(batch.column(keep), 0).to_numpy(), batch.column(keep + 1)
            for begin, end, data, offsets in chunks(texts, CHUNK_BYTES):
                # one space in front of every text that is not empty
                full = np.diff(offsets) > 0
                spaced = np.insert(data, offsets[:-1][full], _SPACE)
                shifted = offsets + np.r_[0, np.cumsum(full)]
                ids, first = np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
                if full.any():
                    used = np.r_[shifted[:-1][full], shifted[-1]]
                    ids, own = sample(kit, spaced, used, keys[begin:end][full], seed, memory)
                    counts = np.zeros(len(full), np.int64)
                    counts[full] = np.diff(own)
                    first[1:] = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[c.slice(begin, end - begin) for c in batch.columns[:keep]], lists],
                                                 [*batch.schema.names[:keep], "ids"])
    return run


def encode(documents: DataFrame, model_file: str, sharpness: float = 1.0, seed: int = 0, key: str = "doc_id", text: str = "text",
           ids: str = "ids") -> DataFrame:
    """Adds ``ids``, a sampled segmentation of the whole text, to the rows of ``documents``.

    Segmentations are drawn in proportion to the product of their pieces' weights; a larger
    ``sharpness`` comes closer to the best one. The same key, text and seed give the same ids
    anywhere; rows with equal keys and texts get equal ids. A null or empty text has no ids and a
    null key counts as 0. All columns stay; ``ids`` must not be among them. An empty table stays empty.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema]
    n = len(fields)
    texts = documents.select(*[F.col(f"`{c}`") for c in documents.columns], F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    return texts.mapInArrow(_encode(model_file, sharpness, seed, n), ", ".join([*fields, "ids array<int>"])).withColumnRenamed("ids", ids)


def surface(kit: Lattice, ids: np.ndarray) -> np.ndarray:
    """Bytes that piece ids stand for."""
    sizes = kit.lengths[ids]
    ends = np.cumsum(sizes)
    return kit.bytes[np.repeat(kit.starts[ids] - np.r_[0, ends[:-1]], sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _decode(model_file: str, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = lattice(model_file, 1.0)
        for batch in batches:
            lists = batch.column(keep)
            first, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
            for at in range(0, len(lists), 256):
                bounds = first[at:min(at + 256, len(lists)) + 1]
                data = surface(kit, ids[bounds[0]:bounds[-1]]).tobytes()
                ends = np.r_[0, np.cumsum(kit.lengths[ids[bounds[0]:bounds[-1]]])][bounds - bounds[0]]
                texts = [data[a + 1:b].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*[c.slice(at, 256) for c in batch.columns[:keep]], pa.array(texts, pa.string())],
                                                 [*batch.schema.names[:keep], "decoded"])
    return run


def decode(encoded: DataFrame, model_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text that ``ids`` stand for, without the space put in front; no ids give an empty text."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema]
    rows = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns], F.coalesce(F.col(ids), F.expr("array()")).cast("array<int>").alias("_ids"))
    return rows.mapInArrow(_decode(model_file, len(fields)), ", ".join([*fields, "decoded string"])).withColumnRenamed("decoded", decoded)
