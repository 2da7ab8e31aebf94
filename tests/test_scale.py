"""Ordering helpers against brute force, with one hot group and odd partition counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyloom.functions.hashing import digest
from surveyloom.operators import bootstrap as B
from surveyloom.operators import evaluate as E
from surveyloom.operators import joins as J
from surveyloom.operators import profile as P
from surveyloom.operators import ranking as R
from surveyloom.operators import scale as S
from surveyloom.plans.tables import DESIGN


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(5)
    n = 3000
    frame = pd.DataFrame({"id": np.arange(n), "g": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 6, n)),
                          "x": np.round(rng.lognormal(0, 2, n), 2), "w": rng.random(n) + 0.1,
                          "y": rng.integers(0, 2, n)})
    return frame, spark.createDataFrame(frame).repartition(7)


def test_running_sums(values):
    frame, df = values
    cells = df.groupBy("g", "x").agg(F.count("*").alias("c"))
    got = S.running_sums(cells, ["g"], "x", {"n": F.col("c")}, buckets=9).toPandas()
    for g, part in got.groupby("g"):
        source = frame.loc[frame.g == g, "x"].to_numpy()
        assert (part.n_total == len(source)).all()
        assert all(row.n_before == (source < row.x).sum() for row in part.itertuples())


@pytest.mark.parametrize("size", [1, 5, 62, 63, 200, 1023])
def test_count_below_any_number_of_cut_points(spark, size):
    cuts = [2.0 * i for i in range(size)]
    df = spark.range(-1, 2 * size + 2, 7).withColumn("cuts", F.array(*[F.lit(c) for c in cuts]))
    for row in df.select("id", S.count_below(F.col("cuts"), size, F.col("id")).alias("n")).collect():
        assert row["n"] == sum(c < row["id"] for c in cuts)


def test_exact_quantiles_match_numpy(values):
    frame, df = values
    probs = {"a": 0.0, "b": 0.037, "c": 0.5, "d": 0.99, "e": 1.0}
    got = S.exact_quantiles(df, ["g"], "x", probs).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        assert np.allclose(got.loc[g, list(probs)].astype(float), np.quantile(part.x, list(probs.values())))


def test_hash_ranks_are_dense(values):
    frame, df = values
    got = S.hash_ranks(df.withColumn("h", digest(1, "id")), ["g"], "h").toPandas()
    for g, part in got.groupby("g"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
        assert part.sort_values("rank").h.is_monotonic_increasing
        assert (part.group_size == len(part)).all()


def test_auc_matches_all_pairs(values):
    frame, df = values
    got = E.ranking_metrics(df, "y", "x", "w").first()
    pos, neg = frame[frame.y == 1], frame[frame.y == 0]
    wins = (pos.x.to_numpy()[:, None] > neg.x.to_numpy()) + 0.5 * (pos.x.to_numpy()[:, None] == neg.x.to_numpy())
    pair_weight = pos.w.to_numpy()[:, None] * neg.w.to_numpy()
    assert got["roc_auc"] == pytest.approx((wins * pair_weight).sum() / pair_weight.sum())


def test_weighted_quantile_is_hazen_without_ties(spark):
    rng = np.random.default_rng(2)
    x, w = rng.permutation(np.arange(200.0)), rng.random(200)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "w": w}))
    order = np.argsort(x)
    at = (np.cumsum(w[order]) - 0.5 * w[order]) / w.sum()
    probs = {"a": 0.0001, "b": 0.3, "c": 0.5, "d": 0.9999}
    got = P.weighted_quantile(df, "x", "w", probs).first()
    assert np.allclose([got[k] for k in probs], np.interp(list(probs.values()), at, x[order]))


def test_latest_per_key_ignores_partitioning(values):
    frame, df = values
    a = R.latest_per_key(df, ["g"], ["x", "id"]).toPandas().sort_values("g")
    b = R.latest_per_key(df.repartition(3), ["g"], ["x", "id"]).toPandas().sort_values("g")
    best = frame.sort_values(["x", "id"]).groupby("g").tail(1).sort_values("g")
    assert list(a.id) == list(b.id) == list(best.id)


def test_asof_has_no_fallback(spark):
    events = spark.createDataFrame([("a", 5), ("a", 6), ("a", 10), ("a", 40), ("b", 7)], "u string, t long")
    snaps = spark.createDataFrame([("a", 5, 1.0, True), ("a", 8, 2.0, False), ("a", 20, 3.0, True)],
                                  "u string, s long, v double, ok boolean")
    got = {(r["u"], r["t"]): (r["snapshot_at"], r["v"])
           for r in J.asof_snapshot(events, snaps, "u", "t", "s", "v", "ok", 12).collect()}
    assert got == {("a", 5): (None, None), ("a", 6): (5, 1.0), ("a", 10): (8, None), ("a", 40): (20, None), ("b", 7): (None, None)}


def test_bootstrap_draws_one_cluster_per_slot(spark):
    rows = [(0, s, p, 1.0) for s in range(4) for p in range(s * 3 + 1)]
    clusters = spark.createDataFrame(rows, "state long, stratum long, psu long, one double")
    factors = B.psu_factors(clusters, DESIGN, 20, 3, False).toPandas()
    totals = factors.groupby(["replicate", "stratum"]).factor.sum()
    assert all(total == stratum * 3 + 1 for (_, stratum), total in totals.items())
    scaled = B.psu_factors(clusters, DESIGN, 20, 3, True).toPandas()
    assert (scaled[scaled.stratum == 0].factor == 1).all()
    sums = B.psu_bootstrap(clusters, DESIGN, 20, 3).toPandas()
    assert (sums.one == len(rows)).all()


def test_align_zero_rejects_unknown_clusters(spark):
    roster = spark.createDataFrame([(1, 1, 1)], "state long, stratum long, psu long")
    totals = spark.createDataFrame([(1, 1, 2, 3.0)], "state long, stratum long, psu long, t double")
    with pytest.raises(Exception, match="absent from the roster"):
        J.align_zero(totals, roster, DESIGN.cluster, ["t"]).collect()
