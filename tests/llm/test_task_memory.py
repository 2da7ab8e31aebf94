"""Tasks of the pipeline hold little beside their rows: no whole matrices of numbers, no second copy of texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from surveyloom.llm import jaccard_join
from surveyloom.llm.textarrays import chunks


def peak_mb(run) -> float:
    tracemalloc.start()
    run()
    found = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    return found


def test_members_of_a_large_bucket_are_compared_in_stripes():
    rng, n = np.random.default_rng(1), 3000
    size = rng.integers(50, 400, n)
    reach, root = size - rng.integers(0, 50, n), rng.integers(0, n, n)
    assert peak_mb(lambda: jaccard_join._possible(size, reach, root, 80)) < 60
    got = jaccard_join._possible(size, reach, root, 80)
    for i in (0, 1, 1499, n - 1):
        shared = np.minimum(min(size[i], reach[i]), np.minimum(size, reach))
        assert (got[i] == ((180 * shared >= 80 * (size[i] + size)) & (root != root[i]))).all()


def test_bitmaps_of_many_lengths_are_compared_in_stripes():
    rng, n = np.random.default_rng(2), 1500
    size = rng.integers(60, 700, n)
    sets = [np.unique(rng.integers(0, 900, s).astype(np.uint64)) for s in size]
    size = np.array([len(s) for s in sets])
    bitmaps = [jaccard_join.parity_bits(s) for s in sets]
    assert len({len(b) for b in bitmaps}) > 1
    assert peak_mb(lambda: jaccard_join._near(bitmaps, size, 80)) < 50
    near = jaccard_join._near(bitmaps, size, 80)
    for i, j in rng.integers(0, n, (300, 2)).tolist():
        length = min(len(bitmaps[i]), len(bitmaps[j]))
        differ = int(np.bitwise_count(jaccard_join._folded(bitmaps[i], length) ^ jaccard_join._folded(bitmaps[j], length)).sum())
        both = int(size[i] + size[j])
        assert near[i, j] == (differ <= both - 2 * -(-80 * both // 180))


def test_overlaps_are_counted_in_stripes():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 500, 60).astype(np.uint64)) for _ in range(2500)]
    assert peak_mb(lambda: jaccard_join._overlaps(sets)) < 55
    shared = jaccard_join._overlaps(sets)
    for i, j in rng.integers(0, len(sets), (200, 2)).tolist():
        assert i == j or shared[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_tokens_are_counted_before_many_are_held():
    texts = [" ".join(f"w{i}x{j}" for j in range(3000)) for i in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(range(800)), pa.array(texts)], ["row", "doc_id", "text"])
    alone = peak_mb(lambda: list(jaccard_join._first_pass(5)(iter([batch.slice(0, 1)]))))
    assert peak_mb(lambda: list(jaccard_join._first_pass(5)(iter([batch])))) < alone + 40


def test_a_text_is_there_once_and_read_where_it_lies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = corpus_pipeline.boxed(docs)
    assert len(rows.schema["_document"].dataType.fields) == len(docs.columns) - 1
    assert corpus_pipeline.unboxed(rows, docs).columns == docs.columns
    texts = pa.array(["first text", "second", ""] * 100)
    body = np.frombuffer(texts.buffers()[2], np.uint8)
    for _, _, data, offsets in chunks(texts.slice(3, 30)):
        assert np.shares_memory(data, body) and bytes(data[offsets[1]:offsets[2]]) == b"second"
    assert [bytes(d[o[0]:o[1]]) for _, _, d, o in chunks(pa.array([None, "x", "y"]).slice(1, 1))] == [b"x"]
