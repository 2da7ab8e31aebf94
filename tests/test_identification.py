import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom import SurveyDesign
from surveyloom.operators import standardize
from surveyloom.operators.encoding import learn_encoding
from surveyloom.operators.standardize import covariate_cells, identify, span_error

DESIGN = SurveyDesign("w", ("stratum",), ("psu",))


def survey(spark, n=400, **odd):
    """Two periods; b doubles c in period one, level z occurs there with a single outcome."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        period, c = "one" if i % 2 else "two", int(rng.integers(0, 3))
        y = int(rng.random() < 0.4)
        level = "z" if odd.get("lonely") and period == "one" and i % 40 == 1 else ("p", "q")[int(rng.integers(0, 2))]
        rows.append((i % 20, i % 4, float(1 + i % 3), y if level != "z" else 1, int(rng.integers(0, 2)), c,
                     2 * c if period == "one" or odd.get("alias_everywhere") else int(rng.integers(0, 3)), level, period))
    return spark.createDataFrame(rows, "psu int, stratum int, w double, y int, a int, c int, b int, level string, period string").withColumn(
        "psu", F.col("psu") * 4 + F.col("stratum"))


def terms(df):
    return learn_encoding(df, "a", {}, ["level"], {"c": 1.0, "b": 1.0})


def test_rank_and_relation_equal_a_dense_factorisation(spark):
    df = survey(spark, alias_everywhere=True)
    encoding = terms(df)
    found = identify(covariate_cells(df, encoding, "y", {"_w": F.col("w")}), encoding)
    x = encoding.matrix(encoding.prepare(df).toPandas())
    assert len(found.kept) == np.linalg.matrix_rank(x) and [encoding.labels[j] for j in found.dropped][0] == "b"
    assert np.allclose(x[:, found.kept] @ found.relation, x, atol=1e-9) and span_error(df, encoding, found) < 1e-9


def influence(df, ridge=0.0, reference=None):
    roster = df.select("stratum", "psu").distinct()
    return standardize.period_influence(df, terms(df), DESIGN, "y", roster, "period", ["one", "two"], [("two", "one")], ridge, 1.96, reference).where(
        "singleton = 'zero'").collect()


def test_an_aliased_term_is_dropped_and_named(spark):
    rows = {r["metric"]: r for r in influence(survey(spark, alias_everywhere=True))}
    assert rows["one"]["dropped_terms"].split("|")[0] == "b" and rows["one"]["design_rank"] == 4 and rows["one"]["span_error"] < 1e-9
    plain = survey(spark, alias_everywhere=True)
    encoding = learn_encoding(plain, "a", {}, ["level"], {"c": 1.0})
    model = standardize.fit_weighted_logit(plain, encoding, "y", "w", 0.0, F.col("period") == "one")
    gap = standardize.standardize(plain, model, "w").first()["standardized_gap"]
    assert rows["one"]["estimate"] == pytest.approx(100 * gap, abs=1e-7)


def test_a_target_outside_the_span_is_refused(spark):
    with pytest.raises(ValueError, match="do not identify"):
        influence(survey(spark))  # b and c part ways in the other period, which is in the target


def test_a_single_outcome_level_is_refused_or_set_aside(spark):
    df = survey(spark, alias_everywhere=True, lonely=True)
    with pytest.raises(ValueError, match="single-outcome|without training rows"):
        influence(df)
    rows = {r["metric"]: r for r in influence(df, reference=F.col("level") != "z")}
    assert rows["one"]["rows_set_aside"] == 10 and rows["one"]["single_outcome_levels"] == 1
    kept = {r["metric"]: r for r in influence(df.where("level <> 'z'"))}
    assert rows["one"]["estimate"] == pytest.approx(kept["one"]["estimate"], abs=1e-7)
