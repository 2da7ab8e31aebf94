"""Token counts without token ids: pieces are counted once per distinct pre-token and joined back.

1. Each run of documents becomes one block per hash bucket of pre-tokens: the bucket's distinct pre-tokens and their
   postings (document, frequency) as packed, compressed arrays. Pre-tokens that are entries of the
   vocabulary itself (a table no larger than the vocabulary) are added up on the spot, so the very
   frequent ones never reach the shuffle.
2. A bucket's task counts the pieces of each distinct pre-token once, joins them to the postings of every block and
   sums pieces times frequency per document of the block. A pre-token that fills much of a run
   goes to a bucket that depends on the run, too, so no bucket gets all of a frequent one.
3. The blocks' sums, packed again, go to the documents' partition and are added up there.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm import pretokens
from surveyloom.llm.common import with_row_key

FLUSH = 400_000
HOT_POSTINGS, SALTS = 2_000, 64
LEAST_BUCKETS, MOST_BUCKETS = 64, 4096
#: Distinct pre-tokens whose pieces a bucket's task remembers; beyond, it forgets them and counts anew.
REMEMBERED = 1_000_000
_ORDINAL = (1 << 33) - 1
_SCHEMA = "bucket int, part int, documents boolean, body binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def pack(*arrays: np.ndarray, texts: list[bytes] | None = None, level: int = 3) -> bytes:
    """Whole-number arrays, each in its narrowest type, and byte strings, compressed together."""
    if texts is not None:
        arrays = (*arrays, np.fromiter(map(len, texts), np.int64, len(texts)))
    parts = [len(arrays).to_bytes(1, "little")]
    for x in arrays:
        x = np.asarray(x)
        kind = next((t for t in ("<u1", "<u2", "<u4") if not len(x) or (x.min() >= 0 and x.max() <= np.iinfo(t).max)), "<i8")
        parts += [kind.encode(), len(x).to_bytes(8, "little"), x.astype(kind).tobytes()]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts + (texts or [])))


def unpack(body: bytes) -> tuple[list[np.ndarray], bytes]:
    """The arrays of :func:`pack` and the bytes after them."""
    data = zstandard.ZstdDecompressor().decompress(body)
    at, out = 1, []
    for _ in range(data[0]):
        kind, n = data[at:at + 3].decode(), int.from_bytes(data[at + 3:at + 11], "little")
        out.append(np.frombuffer(data, kind, n, at + 11).astype(np.int64))
        at += 11 + n * int(kind[2])
    return out, data[at:]


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], _NAMES)


def _blocks(json_file: str, buckets: int):
    """Arrow function over ``(row, doc_id, text)``: blocks of unknown pre-tokens, and per run its documents with their known sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, made = pretokens.entry_counts(json_file), 0, 0
        tokens, at, counts = [], [], []
        documents: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            made += 1
            first = documents[0][0]
            ids = np.array([0 if d is None else d for _, d, _, _ in documents], np.int64)
            nulls = np.array([d is None for _, d, _, _ in documents])
            rows = [(made % buckets, part, True, pack(np.array([first]), ids, nulls, *(np.array([d[i] for d in documents]) for i in (2, 3))))]
            if tokens:
                rows += posted(first)
            documents.clear()
            for x in (tokens, at, counts):
                x.clear()
            return _rows(rows)

        def posted(first: int) -> list[tuple]:
            coded = pa.array(tokens, pa.string()).dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()
            sizes = np.bincount(codes, minlength=len(names))
            hashes = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
            salt = (part * 31 + made) % SALTS
            bucket = (hashes + np.where(sizes >= HOT_POSTINGS, salt, 0)) % buckets
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            posting = np.argsort(rank[codes], kind="stable")
            where, often = np.array(at, np.int64)[posting] - first, np.array(counts, np.int64)[posting]
            sizes = sizes[order]
            ends = np.r_[0, np.cumsum(sizes)]
            edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
            return [(int(bucket[order[a]]), part, False, pack(np.array([first]), sizes[a:b], where[ends[a]:ends[b]], often[ends[a]:ends[b]],
                                                              texts=[names[i] for i in order[a:b].tolist()])) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)])]

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            for key, doc_id, text, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), sizes):
                part, row = key >> 33, key & _ORDINAL
                found, total = pretokens.pretokens(text or "")
                for token, count in Counter(found).items():
                    pieces = known.get(token)
                    if pieces is None:
                        tokens.append(token)
                        at.append(row)
                        counts.append(count)
                    else:
                        total += pieces * count
                documents.append((row, doc_id, size, total))
                if len(tokens) + len(documents) >= FLUSH:
                    yield flush()
        if documents:
            yield flush()
    return run


def _counted(json_file: str):
    """Arrow function over the blocks of some buckets: pieces per document of each block; rows of documents pass through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, pieces = pretokens.tokenizer(json_file), {}
        for batch in batches:
            out = []
            for bucket, part, documents, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if documents:
                    out.append((bucket, part, True, body))
                    continue
                ((first,), sizes, where, often, lengths), rest = unpack(body)
                ends = np.cumsum(lengths)
                names = [rest[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                fresh = [x for x in names if x not in pieces]
                if fresh:
                    if len(pieces) + len(fresh) > REMEMBERED:
                        pieces.clear()
                        fresh = names
                    found = tok.encode_batch_fast([x.decode() for x in fresh], add_special_tokens=False)
                    pieces.update(zip(fresh, map(len, found)))
                total = np.repeat(np.array([pieces[x] for x in names], np.int64), sizes) * often
                rows, place = np.unique(where, return_inverse=True)
                summed = np.zeros(len(rows), np.int64)
                np.add.at(summed, place, total)
                out.append((bucket, part, False, pack(np.array([first]), np.diff(rows, prepend=0), summed, level=1)))
            yield _rows(out)
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function over rows sorted by partition: counts of each document, one batch per partition of the scan."""
    part, documents, sums = None, [], []

    def finish() -> pa.RecordBatch:
        runs = sorted(documents, key=lambda x: x[0])
        starts = np.array([r[0] for r in runs])
        totals = [r[4].copy() for r in runs]
        for first, rows, extra in sums:
            totals[int(np.searchsorted(starts, first))][rows] += extra
        ids = pa.array(np.concatenate([r[1] for r in runs]), mask=np.concatenate([r[2] for r in runs]).astype(bool))
        return pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([r[3] for r in runs])), pa.array(np.concatenate(totals))], ["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        for own, is_documents, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if own != part:
                if documents:
                    yield finish()
                part, documents, sums = own, [], []
            arrays, _ = unpack(body)
            first = int(arrays[0][0])
            if is_documents:
                documents.append((first, *arrays[1:]))
            else:
                sums.append((first, np.cumsum(arrays[1]), arrays[2]))
    if documents:
        yield finish()


def token_counts(documents: DataFrame, json_file: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row for each row of ``documents``.

    Null and empty texts have no bytes and no tokens. Rows with a repeated or null id keep a row
    each, with the id as it is. Other columns are ignored, an empty table gives no rows, and texts
    of any length are read whole.
    """
    texts = with_row_key(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    parts = texts.rdd.getNumPartitions()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (2 * parts).bit_length()))
    blocks = texts.select("_row", "doc_id", "text").mapInArrow(_blocks(json_file, buckets), _SCHEMA)
    summed = blocks.repartition("bucket").mapInArrow(_counted(json_file), _SCHEMA)
    return (summed.select("part", "documents", "body").repartition("part").sortWithinPartitions("part")
            .mapInArrow(_added, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit))
