"""Nested folds read their input twice at most, and scores of all folds come from one projection."""

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from surveyloom.operators import nuisance as N
from surveyloom.operators.encoding import learn_encoding


def data(spark):
    n = 600
    frame = pd.DataFrame({"mother": [i // 3 for i in range(n)], "arm": [i * 7 % 5 % 2 for i in range(n)], "y": [i * 11 % 7 % 2 for i in range(n)],
                          "weight": [1.0 + i % 4 for i in range(n)], "place": [1 + i // 3 % 2 for i in range(n)]})
    return spark.createDataFrame(frame).repartition(3)


def test_nested_folds_read_each_row_twice_and_equal_plain_ranks(spark):
    df = data(spark)
    reads = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    found = N._nested_folds(df.mapInPandas(through, df.schema), "arm", "y", ["mother"], 5, 3, 42)
    rows = found.toPandas()
    assert len(rows) == 600 and reads.value == 2 * 600
    groups = rows.groupby("mother").agg(fold=("fold", "max"), least=("fold", "min"), e=("_inner_e", "first"), q=("_inner_q", "first"))
    assert (groups["fold"] == groups["least"]).all()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for label, column, shift in (("arm", "e", 0), ("y", "q", 100)):
        classes = (rows.groupby("mother")[label].mean() * 4).apply(int)
        for f in range(5):
            for c in set(classes):
                mine = [m for m in groups.index if groups["fold"][m] != f and classes[m] == c]
                for rank, m in enumerate(sorted(mine, key=lambda m: sha(f"{42 + shift + f}|{m}"))):
                    assert groups[column][m][f] == (rank + c) % 3
        assert all(groups[column][m][groups["fold"][m]] is None or pd.isna(groups[column][m][groups["fold"][m]]) for m in groups.index)


def test_one_projection_scores_all_folds_as_folds_one_by_one(spark, monkeypatch):
    df = data(spark)
    fine = learn_encoding(df, "arm", {}, ["place"], interactions=[("place", "2")])
    plain = N.Encoding(None, (), fine.categorical)
    learners = [N.LogitLearner(plain), N.LogitLearner(N.Encoding(None, (), ()))], [N.LogitLearner(fine), N.LogitLearner(N.Encoding("arm", (), ()))]
    run = lambda: N.cross_fit_stacked(df, *learners, "arm", "y", "weight", ["mother"], 5, 3, 42)[0].groupBy("mother", "arm", "y").agg(
        *[F.sum(c).alias(c) for c in ("e_fit", "mu1_fit", "mu0_fit")]).orderBy("mother", "arm", "y").collect()
    plain_score, asked = N.LogitLearner.score, []
    monkeypatch.setattr(N.LogitLearner, "score", lambda self, *a: asked.append(1) or plain_score(self, *a))
    shared = run()
    assert not asked
    monkeypatch.delattr(N.LogitLearner, "score_held_out")
    for a, b in zip(shared, run(), strict=True):
        assert a[:3] == b[:3] and all(abs(x - y) < 1e-12 for x, y in zip(a[3:], b[3:]))
    assert asked
