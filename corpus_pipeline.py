"""The corpus pipeline: documents to packed training sequences, one operator to a stage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm import jaccard_join, packing, quality_rules, secret_scan, toxicity
from surveyloom.llm.common import table, vocabulary
from surveyloom.operators.scale import ensure_checkpoint_dir


def boxed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the rest of the row in one column, so that no column of the row can clash with a stage's own.

    The text is there once: it is most of a row, and rows travel to Python and back in batches of many.
    """
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"])
    return docs.select("doc_id", "text", rest.alias("_document"))


def unboxed(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, the text as it is in ``rows``, some others replaced."""
    own = lambda i, c: F.col("text") if c == "text" else F.col(f"_document.c{i}")
    return rows.select(*[changed.get(c, own(i, c)).alias(c) for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voted quality rules keep."""
    found = quality_rules.quality_verdicts(boxed(docs), keep=("_document", "text"), store=False)
    return unboxed(found.where("kept"), docs)


def civility(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not predict to be toxic."""
    rows = boxed(docs)
    model = toxicity.toxicity_model(rows.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return unboxed(toxicity.toxicity_scores(rows, model, keep=("_document", "text")).where("predicted = 0"), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return unboxed(jaccard_join.without_copies(boxed(docs)), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; ``n_chars``, if there, follows the text."""
    rows = boxed(docs)
    found = secret_scan.secret_spans(rows, secret_scan.fit_model(rows), base="_base", added="_added")
    clean = found.withColumn("text", secret_scan.redacted(F.col("text"), F.concat("_base", "_added")))
    changed = {}
    if "n_chars" in docs.columns:
        own = F.col(f"_document.c{docs.columns.index('n_chars')}").cast("long")
        changed["n_chars"] = F.when(F.size("_base") + F.size("_added") > 0, F.char_length("text").cast("long")).otherwise(own)
    return unboxed(clean, docs, **changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024 ids: one row per piece of a document."""
    return packing.pack(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken"), size=1024)


STAGES = [("quality_rules", quality), ("toxicity", civility), ("jaccard_join", near_copies), ("secret_scan", secrets), ("packing", pack)]
#: Votes, compression lengths and packing are not SQL: the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next one."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
