import glob
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import association, contracts
from surveyloom.sources import write_by_site


def ranks(values):
    order = sorted(values)
    return [(order.index(v) + len(order) - 1 - order[::-1].index(v)) / 2 for v in values]


def test_rank_correlations_with_gaps_equal_pairwise_complete_ranks(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(None if rng.random() < 0.2 else int(rng.integers(0, 9)) for _ in range(4)) for _ in range(300)] + [(1, None, None, 5)] * 80
    df = spark.createDataFrame([(*r, None) for r in rows], "a int, b int, c int, d int, e int").repartition(5)
    got = {(r["first"], r["second"]): r for r in association.spearman_pairs(df, ["a", "b", "c", "d", "e"], 0.05).collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            rho = np.corrcoef(ranks([x for x, _ in both]), ranks([y for _, y in both]))[0, 1]
            r = got["abcd"[i], "abcd"[j]]
            assert r["n"] == len(both) and r["spearman"] == pytest.approx(rho, abs=1e-12) and r["flagged"] == (abs(rho) >= 0.05)
    assert len(got) == 6  # the column without values is in no pair


def test_a_site_has_as_many_files_as_its_rows_need(spark):
    sites = ["hot"] * 5000 + [f"s{i}" for i in range(20) for _ in range(30)] + [None] * 10
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sites)], "row long, site string").repartition(13)
    path = f"{tempfile.mkdtemp(prefix='spark-')}/sites"
    write_by_site(df, path, "site", rows_per_file=1000)
    assert 2 <= len(glob.glob(f"{path}/site=hot/*.parquet")) <= 5
    assert all(len(glob.glob(f"{folder}/*.parquet")) == 1 for folder in glob.glob(f"{path}/site=s*"))
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select("row", "site").collect()), key=repr) == sorted(((i, s) for i, s in enumerate(sites)), key=repr)


def test_codes_of_a_continuous_column_are_counted_not_listed(spark):
    labels = spark.createDataFrame([("age", "1", "one"), ("sex", "1", "Male"), ("sex", "2", "Female")], "variable string, code string, label string")
    df = spark.range(5000).select(F.col("id").alias("age"), (F.col("id") % 3).alias("sex"), F.when(F.col("id") % 5 > 0, F.col("id") % 9).alias("group"))
    codes, profile = contracts.code_profile(df, {"age": F.col("age"), "sex": F.col("sex"), "group": F.col("group")}, {"group": [8], "sex": [0]})
    other, _ = contracts.code_profile(df.where("id < 2"), {"age": F.col("age"), "sex": F.col("sex")})
    rows = {r["variable"]: r for r in contracts.compare_codebooks(labels, labels, codes, other, profile, most=50).collect()}
    assert rows["age"]["only_first"] is None and rows["age"]["only_first_n"] == 4998 and rows["sex"]["only_first"] == "2"
    assert rows["sex"]["special_first"] == 1667 and rows["age"]["special_first"] is None and rows["sex"]["missing_first"] == 0
    found = {r["variable"]: r for r in profile.collect()}
    assert found["group"]["missing"] == 1000 and found["group"]["special"] == sum(i % 5 > 0 and i % 9 == 8 for i in range(5000))
