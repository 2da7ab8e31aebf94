"""Replicates from power series about the sample's root equal those from passes over the rows."""

import numpy as np
import pandas as pd

from surveyloom.operators import nuisance as N
from surveyloom.plans.tables import DESIGN

REPS = 9


def data(spark, clusters, size):
    rng = np.random.default_rng(3)
    n = clusters * size
    frame = pd.DataFrame({"state": 0, "stratum": np.arange(n) % clusters % 2, "psu": np.arange(n) % clusters + (1 << 53), "weight": rng.random(n) + 0.5,
                          "outcome": rng.integers(0, 2, n), "sector": rng.integers(0, 2, n), "e": rng.uniform(0.2, 0.8, n),
                          "m1": rng.uniform(0.2, 0.7, n), "m0": rng.uniform(0.2, 0.7, n)})
    return spark.createDataFrame(frame).repartition(3)


def run(df):
    return [r.asDict() for r in N.targeted(df, DESIGN, "outcome", "sector", "e", "m1", "m0", reps=REPS, seed=1).orderBy("method").collect()]


def test_series_and_passes_agree(spark, monkeypatch):
    df, calls, plain = data(spark, 400, 5), [], N.multiplier_bytes
    monkeypatch.setattr(N, "multiplier_bytes", lambda *a: calls.append(1) or plain(*a))
    by_series = run(df)
    assert not calls  # no row carries multipliers
    series = N._series_risks
    monkeypatch.setattr(N, "_series_risks", lambda *a: (series(*a)[0], np.arange(REPS) % 2 == 0))
    for a, b in zip(by_series, run(df)):
        assert all(x is None or a[k] == x or abs(a[k] - x) < 1e-9 for k, x in b.items() if k != "method") and b["replicates"] == REPS
    assert calls
