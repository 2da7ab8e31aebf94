"""Word and word-sequence hashes of whole texts, computed on Arrow buffers without a Python loop over words.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r; on UTF-8 that is the
same as the run of characters. Hashes are 64-bit: a random value per byte, a polynomial over the
word, then a bit mixer. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd step and of its inverse modulo 2**64, at least ``size`` of them."""
    if not _POWERS or len(_POWERS[0]) < size:
        size = max(size, CHUNK_BYTES + 1)
        inverse = pow(_STEP, -1, 1 << 64)
        _POWERS[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (_STEP, inverse)]
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """Words of a run of texts: ``first[i]:first[i + 1]`` are the words of text ``i``."""

    data: np.ndarray
    offsets: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes (a longer text alone): first row, end row, bytes, offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    # bytes are read where they lie; only nulls make a copy
    if texts.null_count:
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, n + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Find and hash the words of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    if lower:
        data = _LOWER[data]
    size = len(data)
    inside = np.zeros(size + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    begins, stops = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    # at a border between two texts a word ends and the next one begins
    edges = offsets[1:-1]
    edges = edges[inside[edges] & inside[edges + 1]]
    begins[edges] = True
    stops[edges] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    up, down = _powers(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:size], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE))
    return Words(data, offsets, np.searchsorted(starts, offsets), starts, ends, hashes)


def sequence_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` neighbouring words; runs over a text border are the caller's to skip."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, length, np.uint64)
    for i in range(length):
        total = total * np.uint64(_STEP) + hashes[i:i + count]
    return mix(total)


def shingle_sets(words: Words, length: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text; a shorter text is one shingle, a text without words none."""
    runs = sequence_hashes(words.hashes, length)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= length:
            yield np.unique(runs[a:b - length + 1])
        elif b > a:
            yield sequence_hashes(words.hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
