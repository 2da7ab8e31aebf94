"""Exact Jaccard join of word-shingle sets with token-combination prefixes, and its components.

Order the tokens of every set by how often the corpus has them, rare ones first. With
``need = ceil(t * size)`` shared tokens required, two similar sets share a token in their first
``size - need + 1`` tokens, and at least k tokens in their first ``size - need + k``. Therefore

* rare tokens of the plain prefix are indexed alone: if any shared prefix token is rare, the first
  shared one is, and it lies in both plain prefixes;
* otherwise all shared prefix tokens are frequent, k of them lie in the prefixes extended by
  k - 1, and only combinations of frequent tokens are indexed. Frequent tokens are dealt into m
  groups by hash; with k = m + 1 some group holds two shared tokens, so pairs within a group suffice.
  m grows with the set, which keeps the number of pairs in proportion to the set's size.

The order needs no exact frequencies, only to be the same everywhere: tokens are hashed to a fixed
number of slots, and their order is that of (class of the slot's count, token).

Sets that are equal are one node. Inside a bucket, one leader is compared with the other members;
members that end in the leader's component need no more comparing among each other. After a few
rounds of leaders, the members of a bucket that still lie in different components, and may have a
partner there, are dealt into tiles, and two tiles at a time are compared by one matrix product. So
no link between components is lost and no group is expanded into all its pairs.

Before texts are fetched, bitmaps of their sets are compared: a bit is the parity of the tokens that
fall on it, so two sets differ in at least as many tokens as their bitmaps differ in bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import cut, with_row_key
from surveyloom.llm.textarrays import _BASE, _STEP, chunks, mix, shingle_sets, split_words

#: Tokens of a run, whose equal sets count once; tokens that are held at once.
FLUSH_TOKENS, HELD_TOKENS = 4_000_000, 500_000
#: Slots of the table of token frequencies (half a byte each is broadcast), and slots to a row of it.
SLOT_BITS, SLOT_ROW = 25, 1 << 15
#: Nodes of a join filter that may be broadcast.
MAX_BROADCAST_NODES = 1_000_000
LEADER_ROUNDS = 1
#: A tile of sets: members and tokens, about; members of a bucket that are searched for partners before texts are fetched.
TILE, TILE_TOKENS, SEARCHED = 2048, 2_000_000, 4096
#: Bits of a parity bitmap: a power of two, about twice the set's size.
LEAST_BITS, MOST_BITS = 256, 8192
#: Cells of a matrix that a task makes at once, and index keys that it holds.
_CELLS, HELD_KEYS = 1 << 20, 250_000


def _stripes(n: int, width: int) -> Iterator[slice]:
    """Rows of a matrix of ``n`` rows in stretches of about ``_CELLS`` cells, so that no task holds several whole matrices of numbers."""
    step = max(1, _CELLS // max(1, width))
    for at in range(0, n, step):
        yield slice(at, min(n, at + step))


def node_of(tokens: np.ndarray) -> int:
    """One 64-bit name for a set of tokens, as a signed long."""
    with np.errstate(over="ignore"):
        total = (mix(tokens + np.uint64(_BASE))).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in chunks(column):
        yield from shingle_sets(split_words(data, offsets, lower=True), words)


def slots_of(tokens: np.ndarray) -> np.ndarray:
    """Slot of each token in the table of frequencies."""
    return (mix(tokens ^ np.uint64(_STEP)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def class_of(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Class of each token: the number of bits of its slot's count, 15 at most; two slots share a byte of the table."""
    slots = slots_of(tokens)
    return (table[slots >> 1] >> ((slots & 1) << 2).astype(np.uint8)) & np.uint8(15)


def _first_pass(words: int):
    """Arrow function: a row per document, and rows of the partition's token counts per slot, over distinct sets of a run."""
    names = ["row", "doc_id", "size", "node", "chunk", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        held, count, waiting, total = [], 0, 0, np.zeros(1 << SLOT_BITS, np.uint8)

        def flush() -> None:
            nonlocal waiting
            # a partition counts up to 255 per slot, which is enough for an order
            slots, times = np.unique(slots_of(np.concatenate(held)), return_counts=True)
            total[slots] = np.minimum(255, total[slots] + times)
            held.clear()
            waiting = 0

        for batch in batches:
            sizes, nodes = [], []
            for tokens in _sets(batch.column(2), words):
                node = node_of(tokens)
                sizes.append(len(tokens))
                nodes.append(node if len(tokens) else None)
                if len(tokens) and node not in known:
                    known.add(node)
                    held.append(tokens)
                    count += len(tokens)
                    waiting += len(tokens)
                    if waiting >= HELD_TOKENS:
                        flush()
                    if count >= FLUSH_TOKENS:
                        known.clear()
                        count = 0
            nothing = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                                              pa.nulls(nothing, pa.int32()), pa.nulls(nothing, pa.binary())], schema=schema)
        if held:
            flush()
        packer, rows = zstandard.ZstdCompressor(level=1), total.reshape(-1, SLOT_ROW)
        used = np.flatnonzero(rows.any(axis=1))
        if len(used):
            nothing = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing] * 4 + [pa.array(used, pa.int32()), pa.array([packer.compress(rows[i].tobytes()) for i in used])],
                                             schema=schema)
    return run


def _added_counts(rows: pa.Table) -> pa.Table:
    """Arrow function over rows of one stretch of slots: their sum."""
    unpacker, total = zstandard.ZstdDecompressor(), np.zeros(SLOT_ROW, np.int64)
    for body in rows.column("counts"):
        total += np.frombuffer(unpacker.decompress(body.as_py()), np.uint8)
    return pa.table({"chunk": rows.column("chunk").slice(0, 1), "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())])})


def _classes(rows: pa.Table) -> pa.Table:
    """Arrow function: half a byte per slot, the number of bits of its count, and the tokens counted."""
    unpacker, total = zstandard.ZstdDecompressor(), np.zeros(SLOT_ROW, np.int64)
    for body in rows.column("counts"):
        total += np.frombuffer(unpacker.decompress(body.as_py()), np.int64)
    bits = np.minimum(15, np.frexp(total.astype(np.float64))[1]).astype(np.uint8)
    return pa.table({"chunk": rows.column("chunk").slice(0, 1), "classes": pa.array([(bits[::2] | bits[1::2] << 4).tobytes()]), "tokens": pa.array([int(total.sum())])})


def slot_classes(first: DataFrame) -> tuple[np.ndarray, int]:
    """Class of every slot (16 MB, whatever the corpus) and the number of tokens counted."""
    counts = first.where("chunk is not null").select("chunk", "counts", (F.spark_partition_id() % 64).alias("_some"))
    found = (counts.groupBy("chunk", "_some").applyInArrow(_added_counts, "chunk int, counts binary")
             .groupBy("chunk").applyInArrow(_classes, "chunk int, classes binary, tokens long").collect())
    out = np.zeros(1 << SLOT_BITS - 1, np.uint8).reshape(-1, SLOT_ROW // 2)
    for r in found:
        out[r["chunk"]] = np.frombuffer(r["classes"], np.uint8)
    return out.ravel(), sum(r["tokens"] for r in found)


def groups_of(size: int) -> int:
    """Hash groups for the frequent tokens of sets whose smaller partner has ``size`` tokens."""
    return 1 << max(0, (size // 16).bit_length() - 1)


def signatures(tokens: np.ndarray, classes: np.ndarray, first_frequent: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set: single rare prefix tokens and pairs of frequent tokens of extended prefixes.

    ``classes`` holds the class of each slot; the order of tokens is that of class, then value. Tokens of
    class ``first_frequent`` and up are the frequent ones.
    """
    size = len(tokens)
    need = -(-size * percent // 100)
    if size < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    place = class_of(classes, tokens)
    ordered = np.argsort(place, kind="stable")
    rare = int((place < first_frequent).sum())
    single, out = tokens[ordered[:min(rare, size - need + 1)]], [tokens[:0]]
    if rare > size - need:
        return single, tokens[:0]  # too few frequent tokens to be all that a partner shares
    usual = tokens[ordered[rare:]]
    for groups in sorted({groups_of(need), groups_of(size)}):
        some = usual[:max(0, size - need + groups + 1 - rare)]
        if len(some) < 2:
            continue
        group = mix(some ^ np.uint64(_BASE)) % np.uint64(groups)
        for g in np.unique(group):
            own = some[group == g]
            a, b = np.triu_indices(len(own), 1)
            low, high = np.minimum(own[a], own[b]), np.maximum(own[a], own[b])
            out.append(mix(mix(low + np.uint64(groups)) + high))
    return single, np.unique(np.concatenate(out))


def _signatures(words: int, percent: int, table, first_frequent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        classes = table.value
        keys, nodes, sizes, reach = [], [], [], []
        held = 0

        def packed() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(x)) for x in (keys, nodes, sizes, reach)]
            for x in (keys, nodes, sizes, reach):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["sig", "node", "size", "reach"])

        for batch in batches:
            for tokens in _sets(batch.column(0), words):
                node = node_of(tokens)
                if len(tokens) and node not in known:
                    known.add(node)
                    single, pairs = signatures(tokens, classes, first_frequent, percent)
                    found = np.concatenate([single, pairs])
                    keys.append(found.view(np.int64))
                    nodes.append(np.full(len(found), node, np.int64))
                    sizes.append(np.full(len(found), len(tokens), np.int32))
                    # pairs come only with all rare tokens as singles, which they leave unshared
                    reach.append((len(tokens) - np.minimum(np.arange(len(found)), len(single))).astype(np.int32))
                    held += len(found)
                    if held >= HELD_KEYS:
                        yield packed()
                        held = 0
        if keys:
            yield packed()
    return run


def parity_bits(tokens: np.ndarray) -> bytes:
    """Bitmap of a set: bit i is the parity of the tokens whose hash is i modulo the number of bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(tokens) - 1).bit_length()))
    place = (mix(tokens + np.uint64(_STEP)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits) & 1).tobytes()


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    """The bitmap as it would be with ``size`` bytes: the exclusive-or of its stretches."""
    return np.bitwise_xor.reduce(np.frombuffer(bitmap, np.uint8).reshape(-1, size), axis=0)


def _near(bitmaps: list[bytes], size: np.ndarray, percent: int) -> np.ndarray:
    """Matrix of the sets that their bitmaps let be similar: differing bits within the differing tokens of a link."""
    lengths, near = np.array([len(x) for x in bitmaps]), np.zeros((len(bitmaps), len(bitmaps)), bool)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths >= n)
        folded = np.stack([_folded(bitmaps[i], n) for i in at])
        ones = np.bitwise_count(folded).sum(axis=1, dtype=np.int64)
        own, short = size[at], lengths[at] == n
        for some in _stripes(len(at), len(at)):
            shared = np.zeros((some.stop - some.start, len(at)), np.float32)
            for part in _stripes(n, 8 * len(at)):  # bytes of all bitmaps, their bits as numbers
                bits = np.unpackbits(folded[:, part], axis=1).astype(np.float32)
                shared += bits[some] @ bits.T
            both = own[some, None] + own[None, :]
            good = ones[some, None] + ones[None, :] - 2 * shared <= both - 2 * -(-percent * both // (100 + percent))
            # a pair counts at the length of its shorter bitmap
            here = short[some, None] | short[None, :]
            near[np.ix_(at[some], at)] = np.where(here, good, near[np.ix_(at[some], at)])
    return near


def _close(percent: int):
    """Arrow function over ``(a, b, left, right, a_size, b_size)``: the pairs that their bitmaps let be similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right, one, other in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                n = min(len(left), len(right))
                differ = int(np.bitwise_count(_folded(left, n) ^ _folded(right, n)).sum())
                keep.append(differ <= one + other - 2 * -(-percent * (one + other) // (100 + percent)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _stored_texts(words: int):
    """Arrow function: every node with its size, its bitmap and its lower-cased text, compressed: a third of the size of its token hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            nodes, sizes, bits, texts = [], [], [], []
            for _, _, data, offsets in chunks(batch.column(0)):
                split = split_words(data, offsets, lower=True)
                for i, tokens in enumerate(shingle_sets(split, words)):
                    node = node_of(tokens)
                    if len(tokens) and node not in known:
                        known.add(node)
                        nodes.append(node)
                        sizes.append(len(tokens))
                        bits.append(parity_bits(tokens))
                        texts.append(packer.compress(split.data[offsets[i]:offsets[i + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()),
                                              pa.array(texts, pa.binary())], ["node", "tokens", "bits", "body"])
    return run


def _compare(words: int, percent: int):
    """Arrow function over ``(a, b, left, right)``: the pairs whose sets reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, recent = zstandard.ZstdDecompressor(), {}

        def tokens_of(node: int, body: pa.Scalar) -> np.ndarray:
            if node not in recent:
                if len(recent) >= 64:
                    recent.clear()
                data = np.frombuffer(unpacker.decompress(body.as_py()), np.uint8)
                recent[node] = next(shingle_sets(split_words(data, np.array([0, len(data)])), words))
            return recent[node]

        for batch in batches:
            keep = []
            for a, b, left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                one, other = tokens_of(a, left), tokens_of(b, right)
                shared = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * shared >= percent * (len(one) + len(other) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node with a link, the root being the smallest node reachable.

    Alternating large and small stars (Kiveris et al., 2014): in each step every node hands its
    neighbours to the smallest one it knows. The number of steps grows with the logarithm of the size.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .unionAll(least.select("u", F.col("m").alias("v"))))
        edges = cut(small.distinct())
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = found


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Whether two rows of a bucket, as structs of ``size`` and ``reach``, can be a pair to find in this bucket.

    ``reach`` is what a set can share if the first token it shares is that of the bucket or, in the bucket of
    a pair, a frequent one: the tokens from there on. The first shared token of a link is the same on
    both sides, so every link is admitted by some bucket, wherever else its tokens lie in the two orders.
    """
    a, b = ({c: x[c].cast("long") for c in ("size", "reach")} for x in (a, b))
    shared = F.least(a["size"], b["size"], a["reach"], b["reach"])
    return (100 + percent) * shared >= percent * (a["size"] + b["size"])


def _only(stored: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of ``stored`` whose node is wanted; the list is broadcast behind a bound or count, else both sides are shuffled."""
    if most is None:
        most = nodes.limit(MAX_BROADCAST_NODES + 1).count()
    return stored.join(F.broadcast(nodes) if most <= MAX_BROADCAST_NODES else nodes, "node", "left_semi")


def _verified(pairs: DataFrame, count: int, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Pairs whose token sets reach the similarity. Bitmaps of the pairs are shuffled, then texts of those that are left."""
    side = lambda of, most, c, *columns: _only(texts, of.select(F.col(c).alias("node")).distinct(), most).select(
        F.col("node").alias(c), *[F.col(x).alias(y) for x, y in columns])
    close = cut(pairs.join(side(pairs, count, "a", ("bits", "left"), ("tokens", "a_size")), "a")
                .join(side(pairs, count, "b", ("bits", "right"), ("tokens", "b_size")), "b")
                .select("a", "b", "left", "right", "a_size", "b_size").mapInArrow(_close(percent), "a long, b long"))
    left = close.count()
    return close.join(side(close, left, "a", ("body", "left")), "a").join(side(close, left, "b", ("body", "right")), "b").select(
        "a", "b", "left", "right").mapInArrow(_compare(words, percent), "a long, b long")


def _possible(size: np.ndarray, reach: np.ndarray, root: np.ndarray, percent: int) -> np.ndarray:
    """Matrix of the members of a bucket (``_alike`` in arrays) that may be a pair and lie in different components."""
    least, out = np.minimum(size, reach), np.empty((len(size), len(size)), bool)
    for some in _stripes(len(size), len(size)):
        shared = np.minimum(least[some, None], least[None, :])
        out[some] = ((100 + percent) * shared >= percent * (size[some, None] + size[None, :])) & (root[some, None] != root[None, :])
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], budget: int) -> Iterator[pa.Table]:
    """Rows sorted by ``keys`` as runs of whole groups of about ``budget`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= budget:
            rows = pa.Table.from_batches(held).combine_chunks()
            same = np.ones(len(rows), bool)
            for c in keys:
                x = rows.column(c).to_numpy()
                same &= x == x[-1]
            last = int(np.argmax(same))
            if last:
                yield rows.slice(0, last)
                rest = rows.slice(last).combine_chunks()
                held, size = rest.to_batches(), rest.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _borders(rows: pa.Table, keys: list[str]) -> list[int]:
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in keys:
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return [*np.flatnonzero(new).tolist(), len(rows)]


def _with_partner(percent: int):
    """Arrow function over open buckets in order: members that may have a partner in another component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["sig"], 8 << 20):
            size, reach = (rows.column(c).to_numpy().astype(np.int64) for c in ("size", "reach"))
            root = rows.column("root").to_numpy()
            keep, edges = np.zeros(len(rows), bool), _borders(rows, ["sig"])
            for a, b in zip(edges, edges[1:]):
                # a larger bucket goes to its tiles unsearched
                keep[a:b] = b - a > SEARCHED or _possible(size[a:b], reach[a:b], root[a:b], percent).any(axis=1)
            yield from rows.filter(pa.array(keep)).to_batches()
    return run


def _buckets(percent: int):
    """Arrow function over index rows sorted by key and node: members of buckets, each once, that may have a partner there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["sig"], 8 << 20):
            sig, node = (rows.column(c).to_numpy() for c in ("sig", "node"))
            fresh = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
            edges = np.r_[np.flatnonzero(np.r_[True, np.diff(sig[fresh]) != 0]), len(fresh)]
            many = np.diff(edges)
            size, reach = (rows.column(c).to_numpy().astype(np.int64)[fresh] for c in ("size", "reach"))
            keep = np.zeros(len(fresh), bool)
            pair = edges[:-1][many == 2]
            shared = np.minimum.reduce([size[pair], size[pair + 1], reach[pair], reach[pair + 1]])
            good = pair[(100 + percent) * shared >= percent * (size[pair] + size[pair + 1])]
            keep[good] = keep[good + 1] = True
            for a, n in zip(edges[:-1][many > 2].tolist(), many[many > 2].tolist()):
                # a larger bucket stays whole
                keep[a:a + n] = n > SEARCHED or _possible(size[a:a + n], reach[a:a + n], np.arange(n), percent).any(axis=1)
            yield from rows.take(pa.array(fresh[keep])).combine_chunks().to_batches()
    return run


def _across(tile: np.ndarray) -> np.ndarray | bool:
    """Pairs to compare here: those of two tiles; pairs of one tile are compared where it is alone."""
    return True if tile.min() == tile.max() else tile[:, None] != tile[None, :]


def _tile_candidates(percent: int):
    """Arrow function over tiles in order, with bitmaps: the members that may still have a partner, without the bitmaps."""
    keys = ["sig", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, keys, 8 << 20):
            size, reach, root, tile = (rows.column(c).to_numpy().astype(np.int64) for c in ("size", "reach", "root", "tile"))
            bits, keep, edges = rows.column("bits"), np.zeros(len(rows), bool), _borders(rows, keys)
            for a, b in zip(edges, edges[1:]):
                possible = _possible(size[a:b], reach[a:b], root[a:b], percent) & _across(tile[a:b])
                members = np.flatnonzero(possible.any(axis=1))
                if len(members):
                    near = _near([bits[a + int(i)].as_py() for i in members], size[a:b][members], percent)
                    keep[a + members] = (near & possible[np.ix_(members, members)]).any(axis=1)
            yield from rows.drop_columns(["bits"]).filter(pa.array(keep)).to_batches()
    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of shared tokens between all sets: products of 0/1 matrices over stretches of tokens."""
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    several = np.bincount(at, minlength=len(tokens)) > 1
    place = np.cumsum(several) - 1
    kept = several[at]
    owner, column = owner[kept], place[at[kept]]
    total = np.zeros((len(sets), len(sets)), np.int32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width, shared = max(1, 4 * _CELLS // len(sets)), int(several.sum())
    for first in range(0, shared, width):
        a, b = np.searchsorted(column, [first, first + width])
        block = np.zeros((len(sets), min(width, shared - first)), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        for some in _stripes(len(sets), len(sets)):
            total[some] += (block[some] @ block.T).astype(np.int32)
    return total


def _tile_links(words: int, percent: int):
    """Arrow function over tiles in order (one, or two of the same bucket): links that join the components of all links there."""
    keys = ["sig", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()

        def tokens_of(body: bytes) -> np.ndarray:
            data = np.frombuffer(unpacker.decompress(body), np.uint8)
            return next(shingle_sets(split_words(data, np.array([0, len(data)])), words))

        for rows in _groups(batches, keys, 16 << 20):
            ones, others = [], []
            size, reach, root, tile, node = (rows.column(c).to_numpy().astype(np.int64) for c in ("size", "reach", "root", "tile", "node"))
            edges = _borders(rows, keys)
            for a, b in zip(edges, edges[1:]):
                possible = _possible(size[a:b], reach[a:b], root[a:b], percent) & _across(tile[a:b])
                members = np.flatnonzero(possible.any(axis=1))
                if not len(members):
                    continue
                sets = [tokens_of(rows.column("body")[a + int(i)].as_py()) for i in members]
                shared = _overlaps(sets)
                own = size[a:b][members]
                good = possible[np.ix_(members, members)]
                for some in _stripes(len(members), len(members)):
                    good[some] &= 100 * shared[some].astype(np.int64) >= percent * (own[some, None] + own[None, :] - shared[some])
                labels, names = np.arange(len(members)), node[a:b][members]
                while True:
                    lower = [np.where(good[some], labels[None, :], len(labels)).min(axis=1, initial=len(labels)) for some in _stripes(len(labels), len(labels))]
                    fresh = np.minimum(labels, np.concatenate(lower))
                    if np.array_equal(fresh, labels):
                        break
                    labels = fresh[fresh]
                apart = labels != np.arange(len(labels))
                ones.append(names[apart])
                others.append(names[labels[apart]])
            empty = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else empty, pa.int64()) for x in (ones, others)], ["a", "b"])
    return run


def _rest(open_rows: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Links between members of a bucket that lie in different components."""
    kept = cut(open_rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(
        _with_partner(percent), "sig long, node long, size int, reach int, root long"))
    sizes = kept.groupBy("sig").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TILE_TOKENS)).cast("int").alias("tiles"))
    dealt = kept.join(sizes, "sig").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    member = ["sig", "node", "size", "reach", "root", "tile"]
    keys, schema = ["sig", "low", "high"], "sig long, node long, size int, reach int, root long, tile int, low int, high int"
    tiles = dealt.select(*member, other.alias("other")).select(*member, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    bits = _only(texts, kept.select("node").distinct()).select("node", "bits")
    close = cut(tiles.join(bits, "node").select(*member, "low", "high", "bits").repartition(*keys).sortWithinPartitions(*keys)
                .mapInArrow(_tile_candidates(percent), schema))
    bodies = _only(texts, close.select("node").distinct()).select("node", "body")
    return (close.join(bodies, "node").select(*member, "low", "high", "body").repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(_tile_links(words, percent), "a long, b long"))


def linked_components(buckets: DataFrame, texts: DataFrame, percent: int, words: int, rounds: int = LEADER_ROUNDS) -> DataFrame:
    """``(node, root)`` of the components that links between members of a bucket make.

    ``buckets`` holds ``(sig, node, size, reach)`` with two or more members each.
    """
    tried, roots, rows, here = None, None, buckets, F.struct("size", "reach")
    for turn in range(rounds + 1):
        own = (rows.withColumn("root", F.col("node")) if roots is None else
               rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        facts = own.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                       # the set that can share most is the likeliest centre of a group
                                       F.max_by(F.struct("node", "size", "reach", "root"), F.struct(F.col("reach") / F.col("size"), F.xxhash64("node"))).alias("lead"))
        open_rows = own.join(facts.where("low != high").drop("low", "high"), "sig")
        if turn == rounds:
            found = _rest(open_rows.select("sig", "node", "size", "reach", "root"), texts, percent, words)
        else:
            rows = cut(open_rows.where("node != lead.node"))
            pairs = rows.where((F.col("root") != F.col("lead.root")) & _alike(here, F.col("lead"), percent)).select(
                F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
            rows = rows.drop("lead")
            pairs = pairs.distinct()
            pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
            tried = pairs if tried is None else tried.unionAll(pairs)
            found = _verified(pairs, pairs.count(), texts, percent, words)
        # the stars of earlier rounds stand for their links
        roots = components(found if roots is None else found.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return roots


def classes(documents: DataFrame, percent: int, words: int, least_frequent: int, doc_id: str, text: str) -> DataFrame:
    """``(row, doc_id, size, class)``: rows of a class are linked; empty sets have no class."""
    spark = documents.sparkSession
    texts = with_row_key(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "row").select("row", "doc_id", "text")
    first = cut(texts.mapInArrow(_first_pass(words), "row long, doc_id long, size long, node long, chunk int, counts binary"))
    docs = first.where("row is not null").select("row", "doc_id", "size", "node")
    found, tokens = slot_classes(first)
    # where the corpus has many more tokens than slots, a rare token shares its slot with many others
    usual = min(max(least_frequent, 4 * tokens >> SLOT_BITS), 1 << 14)
    table = spark.sparkContext.broadcast(found)
    keyed = (texts.select("text").mapInArrow(_signatures(words, percent, table, usual.bit_length()), "sig long, node long, size int, reach int")
             .repartition("sig"))
    buckets = cut(keyed.sortWithinPartitions("sig", "node").mapInArrow(_buckets(percent), "sig long, node long, size int, reach int"))
    nodes = cut(buckets.select("node").distinct())
    stored = cut(_only(texts.select("text").mapInArrow(_stored_texts(words), "node long, tokens long, bits binary, body binary"), nodes).dropDuplicates(["node"]))
    roots = linked_components(buckets, stored, percent, words)
    return docs.join(roots, "node", "left").select("row", "doc_id", "size", F.coalesce("root", "node").alias("class"))


def jaccard_components(documents: DataFrame, percent: int = 80, words: int = 5, least_frequent: int = 16,
                       doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row: the smallest id that links reach from it.

    A set holds the distinct shingles of ``words`` lower-cased (A-Z) words of the whole text; a text
    with fewer words is one shingle. Two rows link when 100 times the shared shingles reach
    ``percent`` times the union. Null and empty texts have empty sets and link with nothing. Rows
    with a null id take part with id null, which counts as larger than every id. Repeated rows are
    equal sets and share a component. An empty table gives no rows.
    """
    named = classes(documents, percent, words, least_frequent, doc_id, text)
    lowest = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("lowest"))
    return (named.join(lowest, "class", "left")
            .select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id")))


def without_copies(documents: DataFrame, percent: int = 80, words: int = 5, least_frequent: int = 16,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row left of each class of linked rows: the smallest id, then the earliest row.

    Rows without words stay; all columns are kept.
    """
    named = cut(classes(documents, percent, words, least_frequent, doc_id, text).where("class is not null"))
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    first = named.groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    dropped = cut(named.join(first, "class").where("row != first.row").select(F.col("row").alias("_copy_row")))
    few = dropped.limit(MAX_BROADCAST_NODES + 1).count() <= MAX_BROADCAST_NODES
    keyed = with_row_key(documents, "_document_row")
    return keyed.join(F.broadcast(dropped) if few else dropped, keyed["_document_row"] == F.col("_copy_row"), "left_anti").drop("_document_row")
