from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from surveyloom.llm.common import cut
from tests.llm.brute import base_counts, base_spans, components, shingles


def test_stages_are_in_order_and_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "jaccard_join", "secret_scan", "packing"]
    assert contract.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in contract.queries()}


def test_every_stage_does_its_part(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, out = docs.columns, [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{tmp_path}/{i}")
        out.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(d.columns == names for d in out[:-1])
    rules, civil, single, clean = ({r["doc_id"]: r for r in d.collect()} for d in out[1:5])
    assert not any(base_counts(r["text"])[-1] for r in rules.values())
    assert set(civil) <= set(rules) and set(single) <= set(civil)
    classes = {}
    for doc, _, least in components([(d, r["text"]) for d, r in civil.items()]):
        classes.setdefault(least if shingles(civil[doc]["text"]) else ("empty", doc), []).append(doc)
    assert sorted(single) == sorted(min(c) for c in classes.values())
    assert set(clean) == set(single)
    for d, r in clean.items():
        assert not base_spans(r["text"])[2] and r["n_chars"] == len(r["text"])
        if not base_spans(single[d]["text"])[2]:
            assert r["text"] == single[d]["text"] or "[SECRET]" in r["text"]
    assert {r["doc_id"] for r in out[5].select("doc_id").distinct().collect()} == set(clean)


def test_run_gives_the_stages_result(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir)
    per = packed.groupBy("doc_id").agg(F.sum("length").alias("got"), F.max("doc_tokens").alias("expected"))
    assert per.where("got <> expected").count() == 0 and per.count() > 100


def test_columns_with_the_stages_own_names_stay(spark, sf_dir):
    """Extra columns that clash with what the operators add inside."""
    own = ["kept", "votes", "n_words", "score", "predicted", "held_out", "_copy_row", "_document_row", "_row", "row", "class", "node", "base", "added", "_document", "_base",
           "label", "toxic", "a.b"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").select("*", *[F.lit(i).alias(c) for i, c in enumerate(own)])
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        seen = cut(stage(spark, seen, sf_dir))
        assert seen.columns == docs.columns
        rows = seen.limit(3).collect()
        assert rows and all([r[c] for c in own] == list(range(len(own))) for r in rows)
    assert corpus_pipeline.STAGES[4][1](spark, seen, sf_dir).count() > 0
