import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyloom import SurveyDesign
from surveyloom.operators import refits
from surveyloom.operators.encoding import learn_encoding
from surveyloom.operators.standardize import covariate_cells, fit_cells
from surveyloom.plans.models import encoding_of
from surveyloom.plans.tables import DESIGN, cohort, roster


def newton(x, y, w, ridge):
    beta, penalty = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (w * (p - y)) / w.sum() + penalty * beta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x / w.sum() + np.diag(penalty)
        beta = beta - np.linalg.lstsq(hessian, gradient, rcond=1e-13)[0]
    return beta


def test_blocks_of_terms_equal_the_columns(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    encoding = encoding_of(rows, interactions=[("residence", "2")])
    ready = encoding.prepare(rows)
    frame = ready.select(*encoding.keys, F.array(*encoding.terms()).alias("x"), F.array(*encoding.terms(F.lit(1.0))).alias("x1")).toPandas()
    assert np.array_equal(encoding.matrix(frame), np.stack(frame["x"])) and np.array_equal(encoding.matrix(frame, 1.0), np.stack(frame["x1"]))


def test_every_replicate_equals_a_fit_of_its_own(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(refits, "BLOCK", 7)
    rows = cohort(spark, sf_dir)
    encoding = learn_encoding(rows, "sector", {"education_years": 20.0}, ["residence", "wealth_index"])
    fits, table = refits.refit_replicates(rows, encoding, DESIGN, "outcome", F.col("wave").cast("string"), roster(spark, sf_dir), 20, 3, 1e-4, ["4", "5"])
    factors = refits.multiplier_bytes(roster(spark, sf_dir), DESIGN, 20, 3).toPandas()
    frame = encoding.prepare(rows).toPandas().merge(factors, on=["state", "stratum", "psu"])
    assert table.where("status = 'ok'").count() == 40
    for wave in (4, 5):
        mine = frame[frame["wave"] == wave]
        x, y = encoding.matrix(mine), mine["outcome"].to_numpy(float)
        times = np.stack([np.frombuffer(b, np.uint8) for b in mine["multipliers"]])
        for j in range(21):
            w = mine["weight"].to_numpy() * times[:, j]
            beta = newton(x, y, w, 1e-4)
            used = w @ x > 0  # a level that the replicate lacks has no say
            assert np.allclose(fits[str(wave)].beta[j][used], beta[used], atol=1e-6)
            gap = [w @ (1 / (1 + np.exp(-encoding.matrix(mine, a) @ beta))) / w.sum() for a in (0.0, 1.0)]
            assert abs(fits[str(wave)].gap[j] - (gap[1] - gap[0])) < 1e-8


def test_multipliers_draw_as_many_clusters_as_a_stratum_has(spark):
    clusters = spark.createDataFrame([(1, 1, i) for i in range(6)] + [(1, 2, 9)], "state int, stratum int, psu int")
    frame = refits.multiplier_bytes(clusters.unionAll(clusters), DESIGN, 300, 8).toPandas()
    times = np.stack([np.frombuffer(b, np.uint8) for b in frame["multipliers"]]).astype(int)
    assert len(frame) == 7 and (times[:, 0] == 1).all() and (times[frame["stratum"] == 1].sum(axis=0) == 6).all()
    assert (times[frame["stratum"] == 2] == 1).all() and times[:, 1:].std() > 0.5


def test_each_fit_has_a_status_of_its_own(spark):
    rows = [(a, c, y, 1.0 + a + c) for a in (0, 1) for c in (0, 1) for y in (0, 1) for _ in range(3)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "a int, c int, y int, w double, i int")
    encoding = learn_encoding(df, "a", {}, ["c"])
    cells = refits.weighted_cells(df, encoding, "y", F.col("w"), F.lit("all"), ["i"])
    both, y, a = F.col("_w"), F.col("_y"), F.col("a")
    stored = cells.withColumn("_ws", F.array(both, both * y, both * a, both * 0, F.when((a == 1) & (y == 0), 0.0).otherwise(both), both * (F.col("i") % 2 + 1)))
    fits = refits.fit_many(stored, encoding, 0.0, {"all": 6})["all"]
    assert fits.status[:4] == ["ok", "one_sided", "one_sided", "one_sided"] and fits.status[5] == "ok"
    assert np.isnan(fits.gap[1]) and abs(fits.gap[0]) < 1e-9
    one = fit_cells(covariate_cells(df.withColumn("v", F.col("w") * (F.col("i") % 2 + 1)), encoding, "y", {"_w": F.col("v")}), encoding, 0.0)
    assert np.allclose(one.beta[:3], fits.beta[5][:3], atol=1e-8)


def test_a_cluster_outside_the_roster_fails(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    encoding = learn_encoding(rows, "sector", {}, ["residence"])
    with pytest.raises(Exception, match="not in the roster"):
        refits.refit_replicates(rows, encoding, DESIGN, "outcome", F.lit("x"), roster(spark, sf_dir).where("psu > 20"), 3, 1, 1e-4, ["x"])


def test_summed_replicates_equal_multipliers(spark, sf_dir, monkeypatch):
    """Weights summed per combination give the same fits, and their rows do not follow the number of clusters."""
    rows = cohort(spark, sf_dir)
    encoding = learn_encoding(rows, "sector", {}, ["residence"])
    every = roster(spark, sf_dir)
    refit = lambda: refits.refit_replicates(rows, encoding, DESIGN, "outcome", F.col("wave").cast("string"), every, 12, 3, 1e-4, ["4", "5"])[0]
    monkeypatch.setattr(refits, "SUMMED", 1 << 40)
    carried = refit()
    monkeypatch.setattr(refits, "SUMMED", 0)
    seen, plain = [], refits.replicate_sums
    monkeypatch.setattr(refits, "replicate_sums", lambda *a: seen.append(plain(*a)) or seen[-1])
    summed = refit()
    assert seen[0].count() == 2 * 2 * 2 * 2  # waves, arms, levels, outcomes
    for wave in ("4", "5"):
        assert summed[wave].status == carried[wave].status
        assert np.allclose(summed[wave].gap, carried[wave].gap, atol=1e-10)
    with pytest.raises(Exception, match="not in the roster"):
        refits.refit_replicates(rows, encoding, DESIGN, "outcome", F.lit("x"), every.where("psu > 20"), 3, 1, 1e-4, ["x"])
