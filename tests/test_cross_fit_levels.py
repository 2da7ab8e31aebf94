"""Levels of a column are cross-fitted together with the results of fitting each alone."""

import pytest
from pyspark.sql import functions as F

from surveyloom.operators import nuisance as N
from surveyloom.plans.tables import cohort

ARGS = ({"education_years": 20.0}, ["residence"], "sector", "outcome", "weight", ["mother_id"], 2, 7, "logistic")


def test_levels_share_their_passes_and_stay_apart(spark, sf_dir, monkeypatch):
    rows = cohort(spark, sf_dir).withColumn("part", (F.col("row_id") % 3).cast("string")).where("residence is not null")
    calls, plain = [], N.fit_many
    monkeypatch.setattr(N, "fit_many", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = {r["row_id"]: r for r in N.cross_fit_within(rows, ["part"], *ARGS).collect()}
    assert len(calls) == 2  # one call per model, not per level
    for level in "012":
        for r in N.cross_fit(rows.where(F.col("part") == level), *ARGS).collect():
            assert r["fold"] == got[r["row_id"]]["fold"]
            for c in ("e_fit", "mu1_fit", "mu0_fit"):
                assert got[r["row_id"]][c] == pytest.approx(r[c], abs=1e-9)
