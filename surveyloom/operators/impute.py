"""Stochastic level draws and pooling of repeated estimates."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.design import SurveyDesign
from surveyloom.functions.hashing import uniform
from surveyloom.operators.encoding import Encoding
from surveyloom.operators.refits import (adjusted_variances, fit_many, fit_many_classes, gap_influence_strata, softmax_scores)
from surveyloom.operators.scale import broadcast_if_small, cut


def draw_category(df: DataFrame, levels: Sequence, probabilities: Sequence[Column], keys: Sequence[str], seed,
                  observed: str, out: str) -> DataFrame:
    """Keep an observed level; otherwise draw one from the row's probabilities by a hash uniform of its unit."""
    u = uniform(seed, *keys)
    cumulative, drawn = F.lit(0.0), None
    for level, p in list(zip(levels, probabilities))[:-1]:
        cumulative = cumulative + p
        test = u < cumulative
        drawn = F.when(test, F.lit(level)) if drawn is None else drawn.when(test, F.lit(level))
    return df.withColumn(out, F.coalesce(F.col(observed), drawn.otherwise(F.lit(levels[-1]))))


def rubin_pool(estimates: DataFrame, by: Sequence[str], estimate: str, variance: str, design_df: str) -> DataFrame:
    """Pool repeated estimates: within, between and total variance and small-sample degrees of freedom."""
    m = F.col("imputations")
    pooled = estimates.groupBy(*by).agg(
        F.count("*").alias("imputations"), F.avg(estimate).alias("pooled"), F.avg(variance).alias("within"),
        F.coalesce(F.var_samp(estimate), F.lit(0.0)).alias("between"), F.min(design_df).cast("double").alias("_d"))
    extra = (1 + 1 / m) * F.col("between")
    pooled = pooled.withColumn("total", F.col("within") + extra)
    pooled = pooled.withColumn("between_fraction", F.coalesce(F.try_divide(extra, F.col("total")), F.lit(0.0)))
    f, d = F.col("between_fraction"), F.col("_d")
    seen = F.greatest((d + 1) / (d + 3) * d * (1 - f), F.lit(1e-12))
    df = F.when(F.col("total") == 0, d).when(f == 0, seen).otherwise(1 / (f * f / F.greatest(m - 1, F.lit(1)) + 1 / seen))
    return pooled.select(*by, "imputations", "pooled", "within", "between", "total",
                         F.sqrt("total").alias("se"), df.alias("pooling_df"), "between_fraction",
                         F.sqrt(F.col("between") / m).alias("monte_carlo_se"))


def bayesian_factors(units: DataFrame, design: SurveyDesign, by: Sequence[str], draws: int) -> DataFrame:
    """``factors`` of every cluster and level of ``by``: an exponential weight per draw (seeds 1 to ``draws``) with mean one in its stratum."""
    clusters = units.select(*by, *design.cluster).distinct()
    drawn = clusters.select("*", F.array(*[-F.log1p(-uniform(m, *design.cluster)) for m in range(1, draws + 1)]).alias("_e"))
    means = drawn.groupBy(*by, *design.strata).agg(F.array(*[F.avg(F.col("_e")[m]) for m in range(draws)]).alias("_m"))
    factor = F.zip_with("_e", "_m", lambda e, m: F.when(m > 0, e / m).otherwise(F.lit(1.0)))
    return drawn.join(means, [*by, *design.strata]).select(*by, *design.cluster, factor.alias("factors"))


def draw_many(units: DataFrame, encoding: Encoding, level: str, levels: Sequence, weight: str, design: SurveyDesign, domain: str,
              keys: Sequence[str], draws: int, ridge: float, seed: str = "impute") -> tuple[DataFrame, dict]:
    """Levels drawn for the units that lack one: ``draws`` holds the place in ``levels`` for each imputation.

    Per domain and imputation a multinomial logit is fitted to the observed units under exponential cluster weights
    of its own; all fits share the passes. A draw is a hash uniform of the seed with the imputation's number and the
    unit's keys. Returns (``domain``, keys and ``draws`` of the units without a level; fits per domain).
    """
    ready = encoding.prepare(units.withColumn("domain", F.col(domain).cast("string")))
    place = F.create_map(*[F.lit(x) for i, v in enumerate(levels) for x in (v, float(i))])[F.col(level)]
    weighted = ready.where(F.col(level).isNotNull()).join(bayesian_factors(units, design, [domain], draws), [domain, *design.cluster])
    cells = cut(weighted.groupBy("domain", *encoding.keys, place.alias("_y")).agg(
        F.array(*[F.sum(F.col(weight) * F.col("factors")[m]) for m in range(draws)]).alias("_ws")))
    names = [r[0] for r in cells.select("domain").distinct().collect()]  # as many as domains
    fits = fit_many_classes(cells, encoding, ridge, dict.fromkeys(names, draws), len(levels))
    bad = {n: f.status for n, f in fits.items() if set(f.status) != {"ok"}}
    if bad:
        raise RuntimeError(f"Imputation models that did not settle: {bad}")
    beta = {n: f.beta.reshape(draws, len(levels) - 1, -1) for n, f in fits.items()}

    def run(batches):
        for batch in batches:
            for name, mine in batch.groupby("domain", sort=False):
                p = softmax_scores(np.einsum("nd,jkd->njk", encoding.matrix(mine), beta[name])).cumsum(axis=2)[:, :, :-1]
                texts = ["|".join(map(str, k)) for k in mine[list(keys)].itertuples(index=False)]
                u = np.array([[int(hashlib.sha256(f"{seed}{m + 1}|{t}".encode()).hexdigest()[:8], 16) for m in range(draws)] for t in texts]) / 2.0**32
                yield mine[list(keys)].assign(domain=name, draws=list((u[:, :, None] >= p).sum(axis=2).astype(np.int32)))[["domain", *keys, "draws"]]

    kinds = dict(ready.dtypes)
    needed = list(dict.fromkeys(["domain", *keys, *encoding.keys]))
    missing = ready.where(F.col(level).isNull()).select(*needed)
    return missing.mapInPandas(run, "domain string, " + ", ".join(f"{k} {kinds[k]}" for k in keys) + ", draws array<int>"), fits


def completed_cells(rows: DataFrame, drawn: DataFrame, encoding: Encoding, level: str, levels: Sequence, domain: str, outcome: str, weight: str,
                    cluster: Sequence[str], keys: Sequence[str], draws: int) -> DataFrame:
    """Covariate cells per cluster of the data without imputation (first weight) and of every imputation, stored once for all.

    Each cluster lies in one partition, sorted by domain and cluster.

    A row without a level stands once for each level that some imputation draws for it, weighted in those imputations
    only, and once without a level in the first weight.
    """
    joined = rows.withColumn("domain", F.col(domain).cast("string")).join(broadcast_if_small(drawn), ["domain", *keys], "left")
    none = F.lit(-1)
    candidates = F.when(F.col("draws").isNull(), F.array(none)).otherwise(F.array_union(F.array(none), F.array_distinct("draws")))
    spread = joined.withColumn("_at", F.explode(candidates))
    value = F.when(F.col("_at") < 0, F.col(level)).otherwise(F.element_at(F.array(*[F.lit(v) for v in levels]), F.greatest("_at", F.lit(0)) + 1))
    known, at = F.col("draws").isNull(), F.col("_at")
    w = F.col(weight)
    weights = [F.when(at < 0, w).otherwise(0.0)] + [
        F.when(known | (at == F.col("draws")[m]), w).otherwise(0.0) for m in range(draws)]
    ready = encoding.prepare(spread.withColumn(level, value))
    return cut(ready.groupBy("domain", *cluster, *encoding.keys, F.col(outcome).cast("double").alias("_y")).agg(
        F.array(*[F.sum(v) for v in weights]).alias("_ws")).repartition(*cluster).sortWithinPartitions("domain", *cluster))


def impute_and_pool(rows: DataFrame, drawn: DataFrame, encoding: Encoding, level: str, levels: Sequence, domain: str, design: SurveyDesign,
                    outcome: str, roster: DataFrame, keys: Sequence[str], draws: int, ridge: float) -> DataFrame:
    """Pooled arm means and gaps over the imputations of every domain, in percent, beside those without imputation.

    One stored table serves all fits, their influence values and the design variances; nothing is fitted one by one. Fits pass over
    its sums per covariate combination, whose number does not follow that of clusters.
    """
    owned = completed_cells(rows, drawn, encoding, level, levels, domain, outcome, design.weight, design.cluster, keys, draws)
    cells = cut(owned.groupBy("domain", *encoding.keys, "_y").agg(F.array(*[F.sum(F.col("_ws")[m]) for m in range(draws + 1)]).alias("_ws")))
    names = [r[0] for r in cells.select("domain").distinct().collect()]  # as many as domains
    fits = fit_many(cells, encoding, ridge, dict.fromkeys(names, draws + 1), first=True)
    bad = {n: f.status for n, f in fits.items() if set(f.status) != {"ok"}}
    if bad:
        raise RuntimeError(f"Gap models that did not settle: {bad}")
    points, totals = gap_influence_strata(owned, cells, encoding, ridge, fits, design)
    each = cut(points.join(adjusted_variances(totals, ["domain", "fit"], design, roster), ["domain", "fit", "metric"]).select(
        "domain", "fit", "metric", (100 * F.col("estimate")).alias("estimate"), (1e4 * F.col("variance")).alias("variance"), "design_df"))
    pooled = rubin_pool(each.where("fit > 0"), ["domain", "metric"], "estimate", "variance", "design_df")
    base = each.where("fit = 0").select("domain", "metric", F.col("estimate").alias("baseline"), F.sqrt("variance").alias("baseline_se"))
    return pooled.join(base, ["domain", "metric"]).withColumn("change_from_baseline", F.col("pooled") - F.col("baseline"))
