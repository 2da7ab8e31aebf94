"""SimHash near duplicates: 64-bit fingerprints linked by a Gray-order hierarchical index.

Two fingerprints that differ in at most ``bits`` places agree in ``shared`` of ``shared + bits``
neighbouring pieces, so every choice of ``shared`` pieces is an index key, and linked fingerprints
meet in a bucket of some key. A bucket is one index: its members in the order of their Gray rank,
which puts fingerprints with few differences side by side. Neighbours form a group and groups
form larger groups; a group keeps only the bits that all members share and that its upper group
does not state already. A search goes down from the top, adds up the differences from the stated
bits, and drops a whole group once they exceed ``bits``. It also drops groups that lie wholly in
the searcher's component, so a dense cluster is not expanded into its pairs.

A bucket gives at most one link per member (to the root of its component inside the bucket); the
components of all buckets' links are the result. Buckets beyond ``tile`` members are dealt into
tiles by hash, and every two tiles are searched in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import cut, with_row_key
from surveyloom.llm.jaccard_join import components
from surveyloom.llm.textarrays import mix

FAN = 16
#: (searcher, group) pairs looked at together: bounds the memory of a search.
FRONTIER = 1 << 20
_PART = 1 << 16


def bit_votes(words: list[bytes], length: int, seed: int) -> tuple[np.ndarray, int]:
    """How many of the shingles' hashes have each bit set (bit 0 first), and the number of shingles."""
    if len(words) < length:
        words = [b" ".join(words)]
        length = 1
    votes, count = np.zeros(64, np.int64), len(words) - length + 1
    for at in range(0, count, _PART):
        part = words[at:at + _PART + length - 1]
        line = b" ".join(part)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(sizes + 1) - 1
        begins = (ends - sizes)[:len(part) - length + 1]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(begins.tolist(), ends[length - 1:].tolist())), "<u8", len(begins))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return votes, count


def fingerprint(text: str | None, length: int = 4, seed: int = 42) -> int:
    """Bits set in over half of the hashes of a text's shingles, repeats included; 0 without words."""
    # bytes.lower and bytes.split know ASCII letters and the six ASCII spaces only, as wanted here
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    votes, count = bit_votes(words, length, seed)
    return int(np.packbits(2 * votes > count, bitorder="little").view("<u8")[0])


def _fingerprints(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(x.as_py(), length, seed) for x in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks.view(np.int64))], ["row", "doc_id", "mark"])
    return run


def fingerprints(documents: DataFrame, length: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, doc_id, mark)``: the fingerprint of every whole text as a signed long."""
    texts = with_row_key(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "row")
    return texts.select("row", "doc_id", "text").mapInArrow(_fingerprints(length, seed), "row long, doc_id long, mark long")


def gray_rank(marks: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the reflected Gray code: running exclusive-or from the top bit."""
    rank = marks.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Groups of ``FAN`` neighbours in Gray order, level by level; a group states bits its upper group does not."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks[np.argsort(gray_rank(marks), kind="stable")]
        ones, zeros = [self.marks], [~self.marks]
        while len(ones[-1]) > FAN:
            starts = np.arange(0, len(ones[-1]), FAN)
            ones.append(np.bitwise_and.reduceat(ones[-1], starts))
            zeros.append(np.bitwise_and.reduceat(zeros[-1], starts))
        self.ones, self.stated = ones, []
        for level in range(len(ones)):
            common = ones[level] | zeros[level]
            if level + 1 < len(ones):
                upper = ones[level + 1] | zeros[level + 1]
                common = common & ~upper[np.arange(len(common)) // FAN]
            self.stated.append(common)
        self.same: list[np.ndarray] = []

    def mark_components(self, root: np.ndarray) -> None:
        """Note for each group the component that holds all of it, or -1."""
        self.same = [root]
        for _ in self.ones[1:]:
            below, starts = self.same[-1], np.arange(0, len(self.same[-1]), FAN)
            low, high = np.minimum.reduceat(below, starts), np.maximum.reduceat(below, starts)
            self.same.append(np.where(low == high, low, -1))

    def search(self, who: np.ndarray, marks: np.ndarray, bits: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (searcher, place) with at most ``bits`` differences, outside the searcher's own component ``own``."""
        top = len(self.ones) - 1
        width = len(self.ones[top])
        found_a, found_b = [], []
        step = max(1, FRONTIER // (FAN * FAN))
        for at in range(0, len(who), step):
            # groups are taken depth first in blocks, so the frontier stays bounded
            stack = [(top, np.repeat(np.arange(at, min(at + step, len(who))), width), np.tile(np.arange(width), min(step, len(who) - at)), None)]
            while stack:
                level, one, group, total = stack.pop()
                if len(one) > FRONTIER:
                    half = len(one) // 2
                    cut_total = (None, None) if total is None else (total[:half], total[half:])
                    stack += [(level, one[half:], group[half:], cut_total[1]), (level, one[:half], group[:half], cut_total[0])]
                    continue
                differ = np.bitwise_count((marks[one] ^ self.ones[level][group]) & self.stated[level][group])
                total = differ if total is None else total + differ
                keep = (total <= bits) & (self.same[level][group] != own[one])
                one, group, total = one[keep], group[keep], total[keep]
                if not len(one):
                    continue
                if level == 0:
                    found_a.append(who[one])
                    found_b.append(group)
                    continue
                below = len(self.ones[level - 1])
                first = group * FAN
                many = np.minimum(first + FAN, below) - first
                inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                stack.append((level - 1, np.repeat(one, many), np.repeat(first, many) + inside, np.repeat(total, many)))
        if not found_a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_a), np.concatenate(found_b)


def _join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after adding links: the smaller root is handed on until nothing changes, then paths are shortened."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            shorter = root[root]
            if np.array_equal(shorter, root):
                break
            root = shorter


def linked(marks: np.ndarray, bits: int, sides: np.ndarray | None = None) -> np.ndarray:
    """Root of each of the distinct ``marks``: its component under links of at most ``bits`` differences.

    With ``sides``, only links between side 0 and side 1 are looked for.
    """
    order = np.argsort(gray_rank(marks), kind="stable")
    sorted_marks, root = marks[order], np.arange(len(marks))
    if sides is None:
        index, places = GrayIndex(sorted_marks), np.arange(len(marks))
        searchers = places
    else:
        side = sides[order]
        searchers, places = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(searchers) or not len(places):
            return np.arange(len(marks))
        index = GrayIndex(sorted_marks[places])
    # Gray neighbours first: most members of a dense cluster are joined before any search
    a = np.arange(len(marks) - 1)
    close = np.bitwise_count(sorted_marks[a] ^ sorted_marks[a + 1]) <= bits
    root = _join_roots(root, a[close], a[close] + 1)
    size = 64
    for at in _blocks(len(searchers), size):
        some = searchers[at]
        index.mark_components(root[places])
        one, place = index.search(some, sorted_marks[some], bits, root[some])
        root = _join_roots(root, one, places[place])
    out = np.empty(len(marks), np.int64)
    out[order] = order[root]
    return out


def _blocks(count: int, size: int) -> Iterator[slice]:
    """Slices that double in size: early links shorten later searches."""
    at = 0
    while at < count:
        yield slice(at, min(at + size, count))
        at, size = at + size, min(2 * size, 8192)


def _pieces(bits: int, shared: int) -> list[tuple[int, np.uint64]]:
    """Keys of the index: a number and the mask of ``shared`` of ``shared + bits`` neighbouring pieces of the 64 bits."""
    edges = np.linspace(0, 64, bits + shared + 1).astype(int)
    masks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    return [(i, np.uint64(sum(masks[j] for j in chosen))) for i, chosen in enumerate(combinations(range(bits + shared), shared))]


def _keyed(bits: int, shared: int):
    pieces = _pieces(bits, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(0).to_numpy().view(np.uint64)
            for number, mask in pieces:
                keys = mix((marks & mask) ^ mix(np.array([number + 1], np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0)], ["key", "mark"])
    return run


def _star(marks: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    apart = root != np.arange(len(root))
    return pa.RecordBatch.from_arrays([pa.array(marks[apart].view(np.int64)), pa.array(marks[root[apart]].view(np.int64))], ["a", "b"])


def _bucket_links(bits: int):
    """Arrow function over rows sorted by key: the links of each bucket to the roots inside it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, marks = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def solve(keys: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            out = [_small_buckets(marks, starts, ends, bits)]
            for a, b in zip(starts.tolist(), ends.tolist()):
                if b - a > FAN:
                    out.append(_star(marks[a:b], linked(marks[a:b], bits)))
            return pa.Table.from_batches(out).combine_chunks().to_batches() or out[:1]

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            marks = np.concatenate([marks, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys) >= _PART:
                last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
                if last:
                    yield from solve(keys[:last], marks[:last])
                    keys, marks = keys[last:], marks[last:]
        if len(keys):
            yield from solve(keys, marks)
    return run


def _small_buckets(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> pa.RecordBatch:
    """Links of all buckets that are a single group of the index, compared by distance of places."""
    size = ends - starts
    end = np.repeat(ends, size)
    small = np.repeat(size <= FAN, size)
    a, b = [], []
    for apart in range(1, FAN):
        at = np.flatnonzero(small[:len(marks) - apart] & (np.arange(len(marks) - apart) + apart < end[:len(marks) - apart])) if apart < len(marks) else []
        if not len(at):
            break
        near = at[np.bitwise_count(marks[at] ^ marks[at + apart]) <= bits]
        a.append(marks[near])
        b.append(marks[near + apart])
    one, other = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(other.view(np.int64))], ["a", "b"])


def _tile_links(bits: int):
    """Arrow function over one group (two tiles of a bucket, or one with itself)."""
    def run(rows: pa.Table) -> pa.Table:
        marks = rows.column("mark").to_numpy().view(np.uint64)
        tiles = rows.column("tile").to_numpy()
        sides = None if tiles.min() == tiles.max() else (tiles == tiles.max()).astype(np.int8)
        return pa.Table.from_batches([_star(marks, linked(marks, bits, sides))])
    return run


def _links(marks: DataFrame, bits: int, shared: int, tile: int) -> DataFrame:
    """``(a, b)``: links that join the same components as all pairs within ``bits`` differences.

    The bucket's key and member are all that is shuffled, twice: for the sizes of the buckets, which are
    combined before the shuffle, and for the buckets themselves.
    """
    keyed = marks.select("mark").mapInArrow(_keyed(bits, shared), "key long, mark long")
    sizes = keyed.groupBy("key").count().where(F.col("count") > 1)
    large = cut(sizes.where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    usual = keyed
    links = []
    if not large.isEmpty():
        usual = keyed.join(large, "key", "left_anti")
        dealt = keyed.join(large, "key").withColumn("tile", F.pmod(F.xxhash64("mark"), "tiles").cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        pairs = dealt.withColumn("other", other).select(
            "key", "mark", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
        links.append(pairs.groupBy("key", "low", "high").applyInArrow(_tile_links(bits), "a long, b long"))
    links.append(usual.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(bits), "a long, b long"))
    return links[0] if len(links) == 1 else links[0].unionAll(links[1])


def simhash_components(documents: DataFrame, bits: int = 4, length: int = 4, seed: int = 42, shared: int | None = None, tile: int = 1 << 15,
                       doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row: the smallest id that links reach from it.

    Words are runs without the six ASCII spaces, A-Z lower-cased; a shingle is ``length`` words joined by a
    blank, a text with fewer words is one shingle. Two rows link when their fingerprints differ in at most
    ``bits`` bits. ``shared`` pieces of the fingerprint make an index key: by default 1 up to two
    million distinct fingerprints and 2 beyond; any number gives the same components. Null and empty texts have
    fingerprint zero and link like any others. Rows with a null id take part, with an id that counts as
    larger than every other; a component of such rows only has a null id. Repeated rows share a component, other columns are ignored, and an
    empty table gives no rows.
    """
    rows = cut(fingerprints(documents, length, seed, doc_id, text))
    marks = cut(rows.groupBy("mark").agg(F.min("doc_id").alias("lowest")))
    if shared is None:
        shared = 1 if marks.count() <= 2_000_000 else 2
    roots = components(_links(marks, bits, shared, tile))
    classes = marks.join(roots.withColumnRenamed("node", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    least = classes.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = classes.join(least, "root").select("mark", "component_id")
    return rows.join(named, "mark").select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")
