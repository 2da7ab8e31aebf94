import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from surveyloom.llm import jaccard_join
from surveyloom.llm.common import table
from tests.llm.brute import components, shingles


def found(df, **how):
    return sorted(tuple(r) for r in jaccard_join.jaccard_components(df, **how).collect())


def test_documents_equal_all_pairs(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    assert found(df) == components([tuple(r) for r in df.select("doc_id", "text").collect()])


def planted(seed, copies=60, words=90):
    """A chain and a group of near copies, a passage that many texts share, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, passage, rows = [word() for _ in range(words)], [word() for _ in range(60)], []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = word()
        rows.append(own)
    chain = list(base)
    for _ in range(20):
        chain = list(chain)
        chain[rng.randrange(len(chain))] = word()
        rows.append(chain)
    for _ in range(40):
        rows.append(passage + [word() for _ in range(rng.randint(0, 40))])
    rows += [rows[0]] * 7
    texts = [" ".join(r) for r in rows]
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("seed, least, rounds", [(1, 16, 4), (2, 3, 0), (3, 4, 1)])
def test_groups_chains_and_passages_equal_all_pairs(spark, monkeypatch, seed, least, rounds):
    monkeypatch.setattr(jaccard_join, "LEADER_ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join.linked_components, "__defaults__", (rounds,))
    rows = planted(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df, least_frequent=least) == components(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, "A b"), (3, "a B"), (9, None), (8, ""), (7, " \n\t"), (4, "a b c d e f g h i"), (2, "a b c d e f g h i j"), (11, long), (10, long + " end"), (4, "a b c d e f g h i"),
            (1, "one two three four five")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, row int")
    assert found(df) == sorted([(5, 1, 3), (3, 1, 3), (9, 0, 9), (8, 0, 8), (7, 0, 7), (4, 5, 2), (2, 6, 2), (11, 29996, 10), (10, 29997, 10), (4, 5, 2), (1, 1, 1)])
    left = jaccard_join.without_copies(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 7, 8, 9, 10]
    assert found(df.where("false")) == []


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    for _ in range(300):
        size = int(rng.integers(2, 400))
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.int64)).view(np.uint64)
        other = base[rng.random(len(base)) > 0.09]
        other = np.unique(np.r_[other, rng.integers(0, 2**63, int(size * 0.08), dtype=np.int64).view(np.uint64)])
        shared = len(np.intersect1d(base, other))
        if 100 * shared < 80 * (len(base) + len(other) - shared):
            continue
        classes = rng.integers(0, 256, 1 << jaccard_join.SLOT_BITS - 1).astype(np.uint8)
        first = int(rng.integers(0, 17))
        a, b = (np.concatenate(jaccard_join.signatures(s, classes, first, 80)) for s in (base, other))
        assert len(base) == len(other) == shared or len(np.intersect1d(a, b)), (len(base), len(other), shared, first)


def test_shingles_are_counted_as_words_are():
    assert len(shingles("a b c d e f")) == 2


@pytest.mark.parametrize("seed, parts, least", [(1, 1, 16), (2, 1, 3), (3, 3, 16)])
def test_appended_and_truncated_copies_equal_all_pairs(spark, seed, parts, least):
    """A partner's own tokens can fill its prefix, so shared tokens of the other one's prefix lie beyond it."""
    rng = random.Random(seed)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    texts = []
    for percent in range(2, 26):
        base = words(rng.choice((84, 104, 204)))
        more = len(base) * percent // 100
        texts += [base, base + words(more)] if percent % 3 else [base, words(more) + base]
        base = words(120)
        texts += [base, base[:len(base) * (100 - percent) // 100]]
    rows = list(enumerate((" ".join(t) for t in texts), 10))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert found(df, least_frequent=least) == components(rows)


def test_stated_broadcast_bound_is_the_one_that_runs():
    stated = (Path(__file__).parents[2] / "README.md").read_text()
    assert f"{1 << jaccard_join.SLOT_BITS:,} slots" in stated


def test_slot_classes_are_the_bits_of_summed_counts(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 300)) for _ in range(40)] + [None, "", "one two"]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string").repartition(5)
    first = df.mapInArrow(jaccard_join._first_pass(2), "row long, doc_id long, size long, node long, chunk int, counts binary")
    table, tokens = jaccard_join.slot_classes(first)
    counts, every = np.zeros(1 << jaccard_join.SLOT_BITS, int), []
    for own in jaccard_join._sets(pa.array(texts, pa.string()), 2):
        counts[jaccard_join.slots_of(own)] += 1
        every.append(own)
    every = np.concatenate(every)
    assert tokens == counts.sum() and jaccard_join.class_of(table, every).tolist() == [int(x).bit_length() for x in counts[jaccard_join.slots_of(every)]]
    assert len(table) == 1 << jaccard_join.SLOT_BITS - 1 and np.bitwise_count(table).astype(int).sum() == sum(int(x).bit_length().bit_count() for x in counts[counts > 0])


def links_of(texts, percent=80):
    """All links of many texts by counting shared shingles token by token."""
    sets, members = [shingles(t) for t in texts], {}
    for i, own in enumerate(sets):
        for token in own:
            members.setdefault(token, []).append(i)
    shared = np.zeros((len(texts), len(texts)), np.int32)
    for own in members.values():
        if len(own) > 1:
            shared[np.ix_(own, own)] += 1
    size = np.array([len(x) for x in sets])
    return 100 * shared >= percent * (size[:, None] + size[None, :] - shared)


@pytest.mark.parametrize("tile, searched", [(256, 4096), (700, 100)])
def test_a_bucket_of_5000_members_equals_all_pairs(spark, monkeypatch, tile, searched):
    """Copies of one text with so many changes that most lie apart: nothing is settled by the leader."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "SEARCHED", searched)
    rng = random.Random(11)
    base = [f"word{i}" for i in range(100)]
    texts = []
    for i in range(5000):
        own = list(base)
        for _ in range(rng.randint(2, 5)):
            own[rng.randrange(5, 100)] = f"new{rng.randrange(40)}"
        texts.append(" ".join(own))
    good, labels = links_of(texts), np.arange(5000)
    while True:
        fresh = np.where(good, labels[None, :], 5000).min(axis=1)
        if np.array_equal(fresh, labels):
            break
        labels = fresh[fresh]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert [r[2] for r in got] == labels.tolist() and len(set(labels.tolist())) > 300


def test_bitmaps_let_every_link_pass():
    rng = np.random.default_rng(9)
    token = lambda n: rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
    sets = []
    for size in (1, 3, 40, 100, 130, 700, 5000):
        base = np.unique(token(size))
        for share in (0, 0.03, 0.1, 0.11, 0.2, 0.6):
            changed = base[rng.random(len(base)) >= share]
            sets.append(np.unique(np.r_[changed, token(int(share * size / 2))]) if len(changed) else base)
    size = np.array([len(x) for x in sets])
    maps = [jaccard_join.parity_bits(x) for x in sets]
    near = jaccard_join._near(maps, size, 80)
    shared = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    linked = 100 * shared >= 80 * (size[:, None] + size[None, :] - shared)
    alike = 100 * np.minimum(size[:, None], size) >= 80 * np.maximum(size[:, None], size)  # other sizes never come here
    assert not (linked & ~near).any() and (near & alike).sum() < 1.5 * linked.sum()
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*[(i, j, maps[i], maps[j], len(sets[i]), len(sets[j])) for i, j in pairs])], list("abcdef"))
    kept = next(jaccard_join._close(80)(iter([batch])))
    assert set(zip(kept.column(0).to_pylist(), kept.column(1).to_pylist())) == {(i, j) for i, j in pairs if near[i, j]}
