import hashlib
import random
import zlib

import numpy as np
import pytest

from surveyloom.llm import prefix_trie
from surveyloom.llm.common import table


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.md5(
                f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        base = c - abs(c) % 5 * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[b] for b in below) if below else 1
        saved[p] = sum(saved[b] for b in below) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def found(df):
    return sorted(map(tuple, prefix_trie.prefix_trie(df).collect()))


SCHEMA = "conv_id long, turn long, role string, text string"


def test_conversations_equal_brute_force(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    assert found(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def planted(seed, convs, longest, low=0, text="ab"):
    """Conversations over few different turns, a first turn that most share, some of many turns."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(low, low + convs * 2), convs):
        for t in range(rng.choice([1, 2, 3, 5, 9, 12, longest])):
            rows.append((c, t, "user", "hello" if t == 0 and rng.random() < 0.8 else rng.choice(text) * rng.randint(1, 2)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, convs, longest, low, shard", [(1, 60, 40, 0, 25), (2, 80, 12, -70, 10), (3, 12, 300, 0, 40), (4, 200, 4, -200, 6), (5, 40, 9, 10**15, 3)])
def test_planted_conversations_over_many_shards(spark, monkeypatch, seed, convs, longest, low, shard):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = planted(seed, convs, longest, low)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_one_conversation_and_one_turn_hold_most_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", 50)
    rows = [(5, t, "user", "x" * (t % 3)) for t in range(900)] + [(c, 0, "user", "") for c in range(10, 400)]
    rows += [(7, t, "user", "x" * (t % 3)) for t in range(900)] + [(6, t, "user", "same") for t in range(3)]
    rows += [(8, None, "user", "again")] * 300  # repeated rows: one place in the order
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "nobody"), (1, 0, "user", "own"), (1, None, "system", None), (1, 1, None, "é"), (2, 0, None, None), (2, 0, "", ""), (5, 3, "user", "a" * 300_000),
            (5, 1, "user", "b"), (5, 1, "user", "b"), (6, 2, "ab", "c"), (6, 2, "a", "bc"), (-3, 0, "user", "minus"), (-5, 0, "user", "minus"), (-7, 0, "user", "minus")]
    rows += [(c, 0, "user", "short") for c in range(100, 140)]  # some take over nothing and keep nothing: turnless
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", depth int, conv string").repartition(4)
    expected = brute(rows)
    assert found(df) == expected and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in expected)
    assert found(df.where("false")) == [] and found(df.where("conv_id is null")) == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 40_000])
def test_slots_are_minimal_perfect_and_verified(n):
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(0, 50, n).astype(np.uint64), rng.permutation(n).astype(np.uint64)
    tried = prefix_trie.NodeTable(hi, lo)
    assert sorted(tried.slots(hi, lo).tolist()) == list(range(n))
    assert (tried.slots(hi + np.uint64(100), lo) == -1).all()
    if n:
        with pytest.raises(ValueError):
            prefix_trie.NodeTable(np.r_[hi, hi[:1]], np.r_[lo, lo[:1]])
