"""Packed draws against one hash per draw, over long, short and single-cluster strata and odd values."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import bootstrap as B
from surveyloom.plans.tables import DESIGN

REPS, SEED = 7, 5


def drawn(frame, size):
    """Times each cluster is drawn, from the definition of a draw."""
    times = {}
    for (state, stratum), part in frame.groupby(["state", "stratum"]):
        psus = sorted(part.psu.unique(), key=lambda p: hashlib.sha256(f"slot|{state}|{stratum}|{p}".encode()).hexdigest())
        for slot in range(1, size(len(psus)) + 1):
            for r in range(1, REPS + 1):
                u = int(hashlib.sha256(f"{SEED}|{state}|{stratum}|{slot}|{r}".encode()).hexdigest()[:8], 16) / 2.0**32
                key = (state, stratum, psus[int(np.floor(u * len(psus)))], r)
                times[key] = times.get(key, 0) + 1
    return times


@pytest.fixture(scope="module")
def clusters():
    sizes = {(0, 0): 5000, (0, 1): 2048, (1, 0): 2049, (1, 11): 3, (11, 1): 3, (2, 0): 1, (2, 1): 1}
    rows = [(s, h, p) for (s, h), n in sizes.items() for p in range(n)]
    return pd.DataFrame(rows, columns=["state", "stratum", "psu"])


def test_factors_count_the_draws_of_every_cluster(spark, clusters):
    df = spark.createDataFrame(clusters).repartition(5)
    for rescaled in (False, True):
        times = drawn(clusters, lambda n: n - 1 if rescaled else n)
        sizes = clusters.groupby(["state", "stratum"]).psu.count().to_dict()
        got = B.psu_factors(df, DESIGN, REPS, SEED, rescaled).toPandas()
        assert len(got) == len(clusters) * REPS
        for state, stratum, psu, r, f in got[["state", "stratum", "psu", "replicate", "factor"]].itertuples(index=False):
            n, k = sizes[state, stratum], times.get((state, stratum, psu, r), 0)
            assert f == pytest.approx(1.0 if n == 1 else (k * n / (n - 1) if rescaled else k))
        summary = B.psu_factor_summary(df, DESIGN, REPS, SEED, rescaled).toPandas().set_index(["state", "stratum", "psu"])
        each = got.groupby(["state", "stratum", "psu"]).factor
        assert np.allclose(summary.total.sort_index(), each.sum().sort_index())
        assert (summary.never.sort_index() == each.apply(lambda f: (f == 0).sum()).sort_index()).all()


def test_sums_of_levels_and_values_that_are_not_finite(spark, clusters):
    frame = clusters[clusters.stratum != 0].assign(v=lambda d: np.arange(len(d)) * 0.5, level="a")
    frame = pd.concat([frame, frame[frame.psu < 2].assign(level="b", v=1.0)])
    frame.iloc[10, frame.columns.get_loc("v")] = -1.0
    df = spark.createDataFrame(frame).withColumn("v", F.when(F.col("v") >= 0, F.col("v")).otherwise(float("nan")))
    frame = frame.assign(v=frame.v.where(frame.v >= 0))
    times = drawn(frame, lambda n: n)
    expected = {}
    for row in frame.itertuples():
        for r in range(1, REPS + 1):
            k = times.get((row.state, row.stratum, row.psu, r), 0)
            if k:
                expected[row.level, r] = expected.get((row.level, r), 0.0) + k * row.v
    got = B.psu_bootstrap(df, DESIGN, REPS, SEED, ["level"]).collect()
    assert {(r["level"], r["replicate"]) for r in got} == set(expected)
    assert any(np.isnan(v) for v in expected.values()) and any(np.isfinite(v) for v in expected.values())
    for r in got:
        assert r["v"] == pytest.approx(expected[r["level"], r["replicate"]], nan_ok=True)


def test_no_row_stands_for_a_draw(spark, clusters):
    """The rows that meet the clusters hold many draws each, and the sums of replicates are stored."""
    slots = B.cluster_slots(spark.createDataFrame(clusters), DESIGN)
    packed = B._packed_draws(slots, DESIGN, 500, SEED, slots["stratum_psus"], 1).selectExpr(
        "count(*) as rows", "sum(length(_places)) / 2 as draws").first()
    assert packed["draws"] == 500 * (5000 + 2048 + 2049 + 6) and packed["rows"] < 1000
    totals = spark.createDataFrame(clusters.assign(one=1.0))
    assert "Exchange" not in B.psu_bootstrap(totals, DESIGN, 3, SEED)._jdf.queryExecution().executedPlan().toString()
