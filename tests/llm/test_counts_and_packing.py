import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from surveyloom.llm import packing, pretokens, token_counts
from surveyloom.llm.common import table, vocabulary

SPECIAL = pretokens.SPECIAL
JSON, RANKS = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
ODD = [(1, None), (2, ""), (3, "a <|endoftext|>  b<|endoftext|>"), (4, "x" * 30_000), (4, "x" * 30_000), (None, "it's  ½ Ⅷ ²_a \n\n \t\x1c!"),
       (7, "<|endoftext|>"), (8, "🙂中文 " * 700)]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(JSON)


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in ODD], "doc_id long, text string, n_tokens int, row string").repartition(3)


def test_pretokens_give_the_vocabularys_ids(tok):
    for base in range(0, 0x30000, 211):
        text = "".join(f"a{chr(c)}1 {chr(c)}b !{chr(c)} " for c in range(base, base + 211) if not 0xD800 <= c < 0xE000)
        expected = tok.encode(text, add_special_tokens=False).ids
        assert pretokens.text_ids(RANKS, text).tolist() == expected
        assert sum(len(x) for x in tok.encode_batch(pretokens.split(text), add_special_tokens=False)) == len(expected)
    for text in ("", " ", "x  ", "\n\n", " \n x", SPECIAL, f"a {SPECIAL}  {SPECIAL}b", "''s 'S", "a\x1cb \x85 c"):
        assert pretokens.text_ids(RANKS, text).tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("flush", [400_000, 50])
def test_token_counts_equal_the_tokenizer(spark, sf_dir, tok, odd, monkeypatch, flush):
    monkeypatch.setattr(token_counts, "FLUSH", flush)
    for df in (table(spark, sf_dir, "documents"), odd):
        rows = df.select("doc_id", "text").collect()
        expected = [(d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
        got = [tuple(r) for r in token_counts.token_counts(df, JSON).collect()]
        key = lambda r: tuple(-1 if v is None else v for v in r)
        assert sorted(got, key=key) == sorted([(*e, e[2] > 512) for e in expected], key=key)


def test_token_counts_of_an_empty_table(spark, odd):
    assert token_counts.token_counts(odd.where("false"), JSON).count() == 0
    assert packing.pack(odd.where("false"), RANKS).count() == 0


@pytest.mark.parametrize("size, windows, merge", [(1024, 16, 64), (64, 2, 2)])
def test_packing_is_a_partition_of_all_ids(spark, sf_dir, tok, odd, size, windows, merge):
    for df in (table(spark, sf_dir, "documents").repartition(5), odd.where("doc_id is not null and doc_id <> 4")):
        texts = {d: t for d, t in df.select("doc_id", "text").collect()}
        rows = packing.pack(df, RANKS, size=size, windows=windows, merge_parts=merge).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            pieces[r["doc_id"]].append(r)
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert pieces.keys() == texts.keys()
        for d, own in pieces.items():
            ids = np.array(tok.encode(texts[d] or "", add_special_tokens=False).ids + [0], "<u4")
            at = 0
            for r in sorted(own, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
                at += r["length"]
                assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:at].tobytes())
            assert at == len(ids)
        partial = 0
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= size
            partial += at < size
        assert partial <= -(-df.rdd.getNumPartitions() // merge)


def test_packing_keeps_repeated_and_null_ids_apart(spark, odd):
    rows = packing.pack(odd, RANKS, size=128).where("doc_id = 4 or doc_id is null").collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 4)
    assert any(r["doc_id"] is None for r in rows)


def test_best_fit_places_in_the_fullest_window_that_has_room():
    state = packing.Windows(10, 2, 0)
    for doc, n in ((1, 6), (2, 8), (3, 4), (4, 2)):
        state.place(doc, 0, bytes(4 * n), n)
    # 4 tops window 1 up to 10, then 2 does so with window 2
    assert sorted((r[0], r[5]) for r in state.rows) == [(1, 0), (2, 1), (3, 0), (4, 1)]
    state.place(5, 0, bytes(4 * 9), 9)
    state.place(6, 0, bytes(4 * 9), 9)
    state.place(7, 0, bytes(4 * 3), 3)  # fits none: its head fills a window
    assert [(r[0], r[2]) for r in state.rows if r[5] == 2] == [(5, 9), (7, 1)]
    assert [(p[0], p[1], len(p[2]) // 4) for p in state.drain()] == [(7, 2, 1)]


def test_blocks_keep_whole_numbers_and_texts():
    arrays = [np.array([0, 255]), np.array([65536]), np.array([-1, 1 << 40]), np.zeros(0, int)]
    got, rest = token_counts.unpack(token_counts.pack(*arrays, texts=[b"a", b"", "é".encode()]))
    assert [x.tolist() for x in got] == [x.tolist() for x in arrays] + [[1, 0, 2]] and rest == "aé".encode()


def test_a_task_that_forgets_pieces_counts_the_same(spark, sf_dir, monkeypatch):
    df = table(spark, sf_dir, "documents")
    usual = sorted(map(tuple, token_counts.token_counts(df, JSON).collect()))
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    monkeypatch.setattr(token_counts, "HOT_POSTINGS", 2)
    monkeypatch.setattr(token_counts, "FLUSH", 900)
    assert sorted(map(tuple, token_counts.token_counts(df.repartition(3), JSON).collect())) == usual
