"""Replicate weights of many clusters: small on their way to the sums, right across batches, and from one reading of the rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from surveyloom.operators import refits
from surveyloom.operators import standardize as S
from surveyloom.operators.encoding import learn_encoding
from surveyloom.operators.scale import cut
from surveyloom.plans.models import with_periods
from surveyloom.plans.tables import DESIGN, cohort, roster

REPS = 12


def cells_of(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    encoding = learn_encoding(rows, "sector", {"education_years": 20.0}, ["residence"])
    return encoding, cut(refits.weighted_cells(rows, encoding, "outcome", F.col("weight"), F.col("wave").cast("string"), DESIGN.cluster))


def test_sums_equal_multipliers_across_batches(spark, sf_dir):
    encoding, cells = cells_of(spark, sf_dir)
    every, names = roster(spark, sf_dir), ["domain", *encoding.keys, "_y"]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # combinations go on in later batches
    try:
        got = refits.replicate_sums(cells, encoding, DESIGN, every, REPS, 3, cells.count()).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = cells.toPandas().merge(refits.multiplier_bytes(every, DESIGN, REPS, 3).toPandas(), on=list(DESIGN.cluster))
    weights = pd.DataFrame(rows["_w"].to_numpy()[:, None] * np.stack([np.frombuffer(b, np.uint8) for b in rows["multipliers"]]))
    expected = pd.concat([rows[names], weights], axis=1).groupby(names, dropna=False).sum().sort_index()
    assert len(got) == len(expected) < len(rows) and rows["education_years"].isna().any()
    found = pd.concat([got[names], pd.DataFrame(np.stack([np.frombuffer(b) for b in got["sums"]]))], axis=1).groupby(names, dropna=False).sum().sort_index()
    assert np.allclose(found.to_numpy(), expected.to_numpy(), rtol=1e-12)


def test_cells_of_rare_combinations_travel_as_multipliers(spark, sf_dir, monkeypatch):
    """Eight bytes per replicate and cell, before their sums, would be eight times the room at any size of the tables."""
    encoding, cells = cells_of(spark, sf_dir)
    seen, plain = [], refits.with_times_drawn
    monkeypatch.setattr(refits, "with_times_drawn", lambda *a, **k: seen.append(plain(*a, **k)) or seen[-1])
    refits.replicate_sums(cells, encoding, DESIGN, roster(spark, sf_dir), REPS, 3, cells.count())
    size = sum(F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in seen[0].columns if dict(seen[0].dtypes)[c] == "binary")
    assert seen[0].agg(size).first()[0] <= cells.count() * (REPS + 1)


def test_period_gaps_reads_its_rows_once(spark, sf_dir):
    rows = cut(with_periods(spark, sf_dir))
    encoding, read = learn_encoding(rows, "sector", {}, ["residence"]), spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    S.period_gaps(rows.mapInPandas(count, rows.schema), encoding, DESIGN, "outcome", ["wave", "period"], "state", 3, 1e-6, roster(spark, sf_dir), REPS, 3).collect()
    assert read.value == rows.count()


def test_one_outcome_or_arm_is_exactly_one_sided(spark):
    """Sums of the weights and of those with the event must not differ by rounding if all rows have it."""
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"a": np.arange(3000) % 2, "c": rng.integers(0, 9, 3000), "w": rng.random(3000) / 3, "y": 1.0})
    for change in ({}, {"y": 0.0}, {"a": 1, "y": frame.index % 3 == 0}, {"a": 0, "y": frame.index % 3 == 0}):
        df = spark.createDataFrame(frame.assign(**change).astype({"y": float}))
        encoding = learn_encoding(df, "a", {}, ["c"])
        cells = encoding.prepare(df).select(F.lit("all").alias("domain"), *encoding.keys, F.col("y").alias("_y"), F.array(*[F.col("w") * k for k in (1.0, 0.7, 0.1)]).alias("_ws"))
        assert refits.fit_many(cut(cells), encoding, 1e-3, {"all": 3})["all"].status == ["one_sided"] * 3
