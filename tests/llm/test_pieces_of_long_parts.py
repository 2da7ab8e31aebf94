import time

import numpy as np
import pytest

from surveyloom.llm import pieces
from surveyloom.llm.common import vocabulary

PIECES = vocabulary("piece_bpe_32k.model")


def ids_of(texts, keys=None, memory=None, seed=3):
    kit = pieces.lattice(PIECES, 1.0)
    data = [b" " + t.encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(x) for x in data])]
    keys = np.arange(len(texts)) if keys is None else np.array(keys)
    ids, first = pieces.sample(kit, np.frombuffer(b"".join(data), np.uint8), offsets, keys, seed, memory)
    assert [pieces.surface(kit, ids[a:b]).tobytes() for a, b in zip(first, first[1:])] == data
    return [ids[a:b].tolist() for a, b in zip(first, first[1:])]


TEXTS = ["hello world " * 5, "unbroken" * 40, "中文字符" * 60, "a", "x" * 300 + " " + "y" * 90, "hello hello worlds"]


@pytest.mark.parametrize("side, few", [(48, 24), (1 << 30, 0), (1, 1 << 30), (5, 3)])
def test_long_and_short_parts_take_the_same_way(monkeypatch, side, few):
    usual = ids_of(TEXTS)
    monkeypatch.setattr(pieces, "SIDE_BY_SIDE", side)
    monkeypatch.setattr(pieces, "FEW", few)
    assert ids_of(TEXTS) == usual


def test_memory_of_earlier_runs_changes_nothing(monkeypatch):
    memory = pieces.Memory()
    keys = list(range(len(TEXTS)))
    usual = ids_of(TEXTS)
    monkeypatch.setattr(pieces, "EDGES_KEPT", 3000)
    for _ in range(3):
        for i in (3, 0, 5, 2, 1, 4):
            assert ids_of([TEXTS[i]], [keys[i]], memory) == [usual[i]]


@pytest.mark.parametrize("text", ["kq" * 500_000, "中文字符没有空格" * 42_000, "ab cd " * 170_000])
def test_a_megabyte_takes_seconds(text):
    start = time.process_time()
    ids_of([text])
    assert time.process_time() - start < 12


def test_segmentations_of_several_words_come_in_proportion():
    """Three words of a few pieces: frequencies of their segmentations against all paths of the lattice."""
    kit = pieces.lattice(PIECES, 1.0)
    for word in ("cats", "thin", "oned"):
        n, data = 20_000, np.frombuffer(b" " + word.encode(), np.uint8)
        start, end, piece = kit.edges(data, np.full(len(data), len(data)))
        paths = {0: [((), 0.0)]}
        for t in range(1, len(data) + 1):
            paths[t] = [(p + (int(i),), w + kit.weight[i]) for a, b, i in zip(start, end, piece) if b == t for p, w in paths[a]]
        total = np.array([np.exp(w) for _, w in paths[len(data)]])
        share = dict(zip((p for p, _ in paths[len(data)]), total / total.sum()))
        ids, first = pieces.sample(kit, np.tile(data, n), np.arange(n + 1) * len(data), np.arange(n), 5)
        seen = {}
        for a, b in zip(first, first[1:]):
            seen[tuple(ids[a:b].tolist())] = seen.get(tuple(ids[a:b].tolist()), 0) + 1
        for path, p in share.items():
            assert abs(seen.get(path, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4
