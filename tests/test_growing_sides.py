"""Sides that grow with the tables are never collected on the driver, however small their compressed bytes look."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from surveyloom.operators import bootstrap as B
from surveyloom.operators import scale as S
from surveyloom.plans.tables import DESIGN, cohort


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_survey_rows_meet_their_clusters_by_sorting(spark, sf_dir):
    plan = plan_of(cohort(spark, sf_dir).select("row_id", "nation", "residence"))
    assert "SortMergeJoin [psu" in plan or "SortMergeJoin [o_custkey" in plan
    assert plan.count("BroadcastHashJoin") <= 2 * plan.count("n_nationkey")


def test_clusters_meet_their_slots_by_sorting(spark, monkeypatch):
    monkeypatch.setattr(S, "GROWING_BYTES", 0)
    n = 3000
    frame = pd.DataFrame({"state": 0, "stratum": np.arange(n) % 3, "psu": np.arange(n), "level": "a", "one": 1.0})
    df = spark.createDataFrame(frame)
    seen, plain = [], S.growing_side
    monkeypatch.setattr(B, "growing_side", lambda d: seen.append(d) or plain(d, 0))
    total = B.psu_bootstrap(df, DESIGN, 5, 1, ["level"]).agg(F.sum("one").alias("v")).first()["v"]
    assert seen and total == 5 * n
    small, large = spark.range(10).withColumnRenamed("id", "k"), spark.range(50).withColumnRenamed("id", "k")
    assert "SortMergeJoin" in plan_of(large.join(S.growing_side(small, 0), "k"))
    assert "BroadcastHashJoin" in plan_of(large.join(S.growing_side(small, 1 << 20), "k"))
