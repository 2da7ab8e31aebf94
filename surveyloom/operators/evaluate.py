"""Prediction metrics from aggregates of distinct scores or score cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.profile import _long
from surveyloom.operators.scale import count_below, exact_quantiles, running_sums


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight)


def metrics_of_counts(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Classification rates; precision and F1 are 0 when undefined, recall and specificity null."""
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(tp, tp + fp), zero)
    recall, specificity = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    filled = F.coalesce(recall, zero)
    return {"accuracy": F.try_divide(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall,
            "specificity": specificity,
            "f1": F.coalesce(F.try_divide(2 * precision * filled, precision + filled), zero)}


def confusion_metrics(df: DataFrame, y: str, p: str, threshold: float, weight: str | None = None,
                      by: Sequence[str] = ()) -> DataFrame:
    """Weighted confusion counts and rates at one threshold."""
    w, hit, pos = _weight(weight), F.col(p) >= threshold, F.col(y) == 1
    cell = lambda test: F.coalesce(F.sum(F.when(test, w)), F.lit(0.0))
    counts = df.groupBy(*by).agg(cell(hit & pos).alias("tp"), cell(hit & ~pos).alias("fp"),
                                 cell(~hit & pos).alias("fn"), cell(~hit & ~pos).alias("tn"))
    rates = metrics_of_counts(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return counts.select(*by, "tp", "fp", "fn", "tn", *[v.alias(k) for k, v in rates.items()])


def _score_sums(df: DataFrame, y: str, p: str, weight: str | None, by: Sequence[str]) -> DataFrame:
    """Positive and negative weight at every distinct score with running sums."""
    w = _weight(weight)
    cells = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).alias("_p")).agg(
        F.coalesce(F.sum(F.when(F.col(y) == 1, w)), F.lit(0.0)).alias("_pos"),
        F.coalesce(F.sum(F.when(F.col(y) == 0, w)), F.lit(0.0)).alias("_neg"))
    return running_sums(cells, by, "_p", {"pos": F.col("_pos"), "neg": F.col("_neg")})


def ranking_metrics(df: DataFrame, y: str, p: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision (step sum) from one ordering of the scores."""
    at_least_pos = F.col("pos_total") - F.col("pos_before")
    at_least_all = at_least_pos + F.col("neg_total") - F.col("neg_before")
    return _score_sums(df, y, p, weight, by).groupBy(*by).agg(
        F.try_divide(F.sum(F.col("_pos") * (F.col("neg_before") + 0.5 * F.col("_neg"))),
                     F.max("pos_total") * F.max("neg_total")).alias("roc_auc"),
        F.try_divide(F.sum(F.col("_pos") * at_least_pos / at_least_all), F.max("pos_total")).alias("average_precision"))


def roc_auc(df: DataFrame, y: str, p: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, y, p, weight, by).select(*by, "roc_auc")


def average_precision(df: DataFrame, y: str, p: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, y, p, weight, by).select(*by, "average_precision")


def brier(df: DataFrame, y: str, p: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean squared error of a probability."""
    w, error = _weight(weight), F.col(p) - F.col(y)
    return df.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(w * error * error) / F.sum(w)).alias("brier"))


def calibration_curve(df: DataFrame, y: str, p: str, bins: int) -> DataFrame:
    """Mean prediction and observed rate per quantile bin; empty bins are absent."""
    names = {f"q{i:03d}": i / bins for i in range(1, bins)}
    edges = exact_quantiles(df, [], p, names).select(F.array(*names).alias("v")).scalar()
    number = count_below(F.col("_edges"), bins - 1, F.col(p))
    return df.withColumn("_edges", edges).groupBy(number.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(y).alias("fraction_positive"))


def threshold_sweep(df: DataFrame, y: str, p: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Metrics at every threshold from one pass: rows are counted in the cell between two thresholds."""
    thresholds = sorted(float(t) for t in thresholds)
    grid = F.array(*[F.lit(-t) for t in reversed(thresholds)])
    index = len(thresholds) - count_below(grid, len(thresholds), -F.col(p))
    cells = df.groupBy(*by, index.alias("_cell")).agg(
        F.count_if(F.col(y) == 1).cast("double").alias("_pos"), F.count_if(F.col(y) == 0).cast("double").alias("_neg"))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("_i"), F.lit(float(t)).alias("threshold"))
                      for i, t in enumerate(thresholds)])
    hit = F.col("_cell") >= F.col("_i")
    count = lambda name, test: F.coalesce(F.sum(F.when(test, F.col(name))), F.lit(0.0))
    counts = cells.select(*by, "_cell", "_pos", "_neg", F.inline(steps)).groupBy(*by, "threshold").agg(
        count("_pos", hit).alias("tp"), count("_neg", hit).alias("fp"),
        count("_pos", ~hit).alias("fn"), count("_neg", ~hit).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = metrics_of_counts(tp, fp, fn, tn)
    return counts.select(*by, "threshold", *[v.alias(k) for k, v in rates.items()],
                         (rates["recall"] + rates["specificity"] - 1).alias("youden_j"),
                         F.try_divide(tp + fp, tp + fp + fn + tn).alias("positive_rate"))


def choose_thresholds(sweep: DataFrame, target_recall: float, default: float = 0.5) -> DataFrame:
    """Named thresholds: nearest to the default, best F1, best Youden J, largest that keeps the recall."""
    t = F.col("threshold")
    first = lambda score: F.max_by(t, F.struct(score, -t))
    picks = {"default": F.min_by(t, F.struct(F.abs(t - default), t)), "max_f1": first(F.col("f1")),
             "max_youden": first(F.col("youden_j")),
             "target_recall": F.max(F.when(F.col("recall") >= target_recall, t))}
    rows = F.array(*[F.struct(F.lit(k).alias("strategy"), F.col(f"_{k}").alias("threshold")) for k in picks])
    chosen = sweep.agg(*[v.alias(f"_{k}") for k, v in picks.items()]).select(F.inline(rows)).where("threshold is not null")
    return chosen.join(sweep, "threshold")


def linear_attribution(df: DataFrame, coefficients: Mapping[str, float], weight: str | None = None) -> DataFrame:
    """Mean absolute log-odds contribution ``|coef * (x - mean)|`` of every feature."""
    w = _weight(weight)
    long = _long(df.withColumn("_w", w), ["_w"], list(coefficients), "double", "feature").where("value is not null")
    means = long.groupBy("feature").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("_m"))
    pairs = [F.lit(x) for item in coefficients.items() for x in (item[0], float(item[1]))]
    part = F.abs(F.create_map(*pairs)[F.col("feature")] * (F.col("value") - F.col("_m")))
    return long.join(F.broadcast(means), "feature").groupBy("feature").agg(
        (F.sum(F.col("_w") * part) / F.sum("_w")).alias("mean_abs_contribution"))


def split_missingness(df: DataFrame, columns: Sequence[str], partition: str, train: str, test: str) -> DataFrame:
    """Missing percent of each column in two partitions and the difference."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).isNull().cast("int").alias("_m")) for c in columns])
    share = lambda part: 100.0 * F.avg(F.when(F.col(partition) == part, F.col("_m")))
    return df.select(partition, F.inline(cells)).groupBy("variable").agg(
        share(train).alias("train_missing_pct"), share(test).alias("test_missing_pct")).withColumn(
        "difference", F.col("test_missing_pct") - F.col("train_missing_pct"))


def evaluation_sums(df: DataFrame, y: str, p: str, q1: str, q0: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Additive log loss, Brier, standardised and observed percentages, rolled up over sites."""
    w, tiny = F.col(weight), F.lit(1e-15)
    prob = F.least(F.greatest(F.col(p), tiny), 1 - tiny)
    loss = -(F.col(y) * F.ln(prob) + (1 - F.col(y)) * F.ln(1 - prob))
    sums = df.groupBy(*by).agg(
        F.sum(w).alias("_w"), F.sum(w * loss).alias("_l"), F.sum(w * (F.col(p) - F.col(y)) ** 2).alias("_b"),
        F.sum(w * F.col(q0)).alias("_q0"), F.sum(w * F.col(q1)).alias("_q1"), F.sum(w * F.col(y)).alias("_y"),
        F.sum(w * F.col(p)).alias("_p"))
    total = sums.rollup(*by).agg(*[F.sum(c).alias(c) for c in ("_w", "_l", "_b", "_q0", "_q1", "_y", "_p")]) if by else sums
    t = F.col("_w")
    return total.select(
        *by, t.alias("weight_sum"), (F.col("_l") / t).alias("log_loss"), (F.col("_b") / t).alias("brier"),
        (100 * F.col("_q0") / t).alias("standardized_control_pct"), (100 * F.col("_q1") / t).alias("standardized_treated_pct"),
        (100 * (F.col("_q1") - F.col("_q0")) / t).alias("standardized_gap_pp"), (100 * F.col("_y") / t).alias("observed_pct"),
        (100 * F.col("_p") / t).alias("predicted_pct"))
