"""The queries of the corpus operators: each operator with its production parameters on a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm import (jaccard_join, licenses, packing, pieces, prefix_trie, quality_model, quality_rules, secret_scan, simhash,
                            token_counts, topk, toxicity, whitening)
from surveyloom.llm.common import table, vocabulary


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op1_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wording of licenses anywhere in the texts; ``op1_license_scan`` sees whole texts and single lines only."""
    return licenses.license_passages(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and checksum of each sampled segmentation, and whether it decodes to the text."""
    model = vocabulary("piece_bpe_32k.model")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = pieces.decode(pieces.encode(texts, model, seed=17), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.hash("ids").alias("ids_hash"),
                       (F.col("decoded") == F.col("text")).alias("lossless"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(documents, toxicity.toxicity_model(documents, table(spark, sf_dir, "labels")))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, query_every=50, scale=256.0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), size=1024)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), percent=80, words=5)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = secret_scan.secret_spans(documents, secret_scan.fit_model(documents))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(secret_scan.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.joined(F.concat("base", "added")).alias("spans"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    fit = whitening.fit_whitening(vectors, components=32, scale=64.0, offset=1_000_000)
    explained = F.array(*[F.lit(float(x)) for x in (fit.explained if fit else [0.0])])
    return whitening.whitened(vectors, fit).select(
        "vec_id", "component", F.lit(fit.n if fit else 0).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened",
        F.get(explained, F.col("component") - 1).alias("explained"), F.lit(fit.identity_error if fit else 0.0).alias("identity_error"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), bits=4, length=4, seed=42)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op1_license_passages, op2_token_counts, op3_sentencepiece, op4_toxicity, op5_exact_topk, op6_packing,
                            op7_jaccard_join, op8_quality_model, op9_quality_rules, op10_secret_scan, op11_whitening, op12_prefix_trie,
                            op13_simhash)}
ORACLES = {"op1_license_scan": licenses.oracle()}
