import random
import re

import numpy as np
import pytest
import xxhash

from surveyloom.llm import simhash
from surveyloom.llm.common import table
from tests.llm.brute import ASCII, WORD


def brute_mark(text):
    words = WORD.findall((text or "").translate(ASCII))
    if not words:
        return 0
    runs = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(marks, bits):
    root = list(range(len(marks)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(marks):
        for j in range(i):
            if (a ^ marks[j]).bit_count() <= bits and top(i) != top(j):
                root[top(i)] = top(j)
    return [top(i) for i in range(len(marks))]


def brute(rows, bits=4):
    marks = [brute_mark(t) for _, t in rows]
    roots, lowest = brute_roots(marks, bits), {}
    for (i, _), r in zip(rows, roots):
        lowest[r] = min(filter(lambda x: x is not None, (lowest.get(r), i)), default=None)
    return sorted(((i, f"{m:016x}", lowest[r]) for (i, _), m, r in zip(rows, marks, roots)), key=repr)


def found(df, **how):
    return sorted(map(tuple, simhash.simhash_components(df, **how).collect()), key=repr)


def test_documents_equal_all_pairs(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert found(df) == brute(rows)
    assert found(df, shared=2, tile=3) == brute(rows)


def planted(seed, count, flips):
    """Clusters of near fingerprints, chains among them, and fingerprints of their own."""
    rng = random.Random(seed)
    marks = set()
    for _ in range(4):
        mark = rng.getrandbits(64)
        for _ in range(count):
            other = mark
            for _ in range(rng.randint(0, flips)):
                other ^= 1 << rng.randrange(64)
            marks.add(other)
            mark = other if rng.random() < 0.1 else mark
    marks |= {rng.getrandbits(64) for _ in range(count)} | {0, 1, 31, (1 << 64) - 1}
    return np.array(sorted(marks, key=lambda _: rng.random()), np.uint64)


def same(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("seed, count, flips, bits", [(1, 150, 6, 4), (2, 300, 9, 4), (3, 60, 3, 1), (4, 5, 4, 0), (5, 400, 14, 4)])
def test_index_equals_all_pairs(seed, count, flips, bits):
    marks = planted(seed, count, flips)
    expected = brute_roots([int(x) for x in marks], bits)
    assert same(simhash.linked(marks, bits).tolist(), expected)


def test_sides_find_links_between_them():
    marks = planted(6, 200, 8)
    sides = (np.arange(len(marks)) % 2).astype(np.int8)
    got = simhash.linked(marks, 4, sides)
    within = [simhash.linked(marks[sides == s], 4) for s in (0, 1)]
    links = [(np.flatnonzero(sides == s)[w], np.flatnonzero(sides == s)) for s, w in zip((0, 1), within)] + [(got, np.arange(len(marks)))]
    root = np.arange(len(marks))
    for a, b in links:
        root = simhash._join_roots(root, a, b)
    assert same(root.tolist(), brute_roots([int(x) for x in marks], 4))


def test_groups_state_only_bits_that_upper_groups_do_not():
    index = simhash.GrayIndex(planted(7, 500, 5))
    assert len(index.ones) > 2
    for level, stated in enumerate(index.stated[:-1]):
        place = np.arange(len(stated)) // simhash.FAN
        upper = index.stated[level + 1][place]
        assert not (stated & upper).any()
        assert not ((index.ones[level] ^ index.ones[level + 1][place]) & upper).any()
    assert (np.diff(simhash.gray_rank(index.marks).astype(object)) > 0).all()


@pytest.mark.parametrize("shared, tile", [(1, 1 << 15), (2, 1 << 15), (1, 40), (3, 10)])
def test_links_of_buckets_and_tiles_equal_all_pairs(spark, shared, tile):
    marks = planted(8, 150, 7)
    df = spark.createDataFrame([(int(x),) for x in marks.view(np.int64)], "mark long").repartition(5)
    links = simhash._links(df, 4, shared, tile).collect()
    place = {int(m): i for i, m in enumerate(marks.view(np.int64))}
    root = simhash._join_roots(np.arange(len(marks)), np.array([place[r.a] for r in links]), np.array([place[r.b] for r in links]))
    assert same(root.tolist(), brute_roots([int(x) for x in marks], 4))
    assert len(links) < 6 * len(marks) * len(simhash._pieces(4, shared)) * (1 if tile > 100 else 20)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(90_000))
    rows = [(5, "A b"), (3, "a  B"), (9, None), (8, ""), (7, " \n\t\x0b"), (4, "a b c d"), (4, "a b c d"), (2, "a\x85b\xa0c É"), (11, long), (10, long + " end"), (None, "a b"),
            (None, "no other text has these words"), (1, "x" * 200_000)]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, mark int, row string")
    assert found(df) == brute(rows)
    assert found(df.where("false")) == []
    assert not re.search("[A-Z]", "".join(r[1] for r in found(df)))
