"""Model-standardised gaps with joint influence functions.

All covariates are coded, so rows are first summed to covariate cells (one row per
distinct combination and outcome). Fitting and derivative sums run on cells, which
give exactly the row-level objective; influence values are row expressions that feed
the design variance.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.design import SurveyDesign
from surveyloom.functions.recode import category_token
from surveyloom.operators.bootstrap import cluster_totals, percentile_intervals, psu_bootstrap, ratio_sums
from surveyloom.operators.encoding import Encoding, token_name
from surveyloom.operators.evaluate import evaluation_sums
from surveyloom.operators.joins import apply_contrasts, contrast_covariance
from surveyloom.operators.profile import grouped_levels, weighted_quantile
from surveyloom.operators.ranking import hash_split
from surveyloom.operators.refits import Fits, fit_many, refit_cells
from surveyloom.operators.scale import BROADCAST_BYTES, broadcast_if_small, cut
from surveyloom.operators.variance import intervals, roster_covariance, roster_variances

METRICS = ("observed_control", "observed_treated", "observed_gap",
           "adjusted_control", "adjusted_treated", "adjusted_gap")


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


@dataclass(frozen=True)
class LogitModel:
    encoding: Encoding
    beta: np.ndarray
    ridge: float

    @property
    def penalty(self) -> np.ndarray:
        out = np.full(len(self.beta), self.ridge)
        out[0] = 0.0
        return out

    def probability(self, exposure: Column | None = None) -> Column:
        """Predicted probability on a prepared frame."""
        return sigmoid(self.encoding.linear(self.beta, exposure))


@dataclass(frozen=True)
class Reference:
    """Sums of predictions and derivatives over one reference population (normalised by its weight)."""

    weight: float
    mean: np.ndarray
    derivative: np.ndarray
    arm_weight: np.ndarray
    observed: np.ndarray


@dataclass(frozen=True)
class Moments:
    weight: float
    hessian: np.ndarray
    gradient: np.ndarray
    references: dict[str, Reference]


def covariate_cells(df: DataFrame, encoding: Encoding, outcome: str, sums: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Weight sums per level of ``by``, distinct covariate combination and outcome."""
    return encoding.prepare(df).groupBy(*by, *encoding.keys, F.col(outcome).cast("double").alias("_y")).agg(
        *[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in sums.items()])


def _summed(rows: DataFrame, block) -> np.ndarray:
    """Sum of ``block(pandas batch)`` vectors: per task first, then by position."""
    def partial(batches):
        total = None
        for batch in batches:
            part = block(batch)
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total), dtype="int32"), "v": total})

    summed = rows.mapInPandas(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    if summed.empty:
        raise ValueError("No rows to summarise")
    out = np.zeros(int(summed["at"].max()) + 1)
    out[summed["at"].to_numpy()] = summed["v"].to_numpy()
    return out


def moments(cells: DataFrame, encoding: Encoding, beta: np.ndarray, train: str,
            references: Sequence[str] = ()) -> Moments:
    """Hessian and gradient of the weighted mean log loss plus reference sums, in one pass over the cells.

    Only coefficient-sized matrices reach the driver.
    """
    d, beta = len(encoding.labels), np.asarray(beta, float)
    columns = [*encoding.keys, F.col("_y"), F.col(train).alias("_w")] + ([F.array(*references).alias("_r")] if references else [])

    def block(batch: pd.DataFrame) -> np.ndarray:
        expit = lambda z: 1.0 / (1.0 + np.exp(-z))
        x, y, w = encoding.matrix(batch), batch["_y"].to_numpy(float), batch["_w"].to_numpy(float)
        p = expit(x @ beta)
        parts = [[w.sum(), w @ y], (x.T @ ((w * p * (1 - p))[:, None] * x)).ravel(), x.T @ (w * (p - y))]
        if references:
            x0, x1, r, a = encoding.matrix(batch, 0.0), encoding.matrix(batch, 1.0), np.stack(batch["_r"]), x[:, 1]
            q0, q1 = expit(x0 @ beta), expit(x1 @ beta)
            for j in range(r.shape[1]):
                v = r[:, j]
                parts += [[v.sum(), v @ q0, v @ q1], x0.T @ (v * q0 * (1 - q0)), x1.T @ (v * q1 * (1 - q1)),
                          [v[a == 0].sum(), v[a == 1].sum(), (v * y)[a == 0].sum(), (v * y)[a == 1].sum()]]
        return np.concatenate([np.asarray(part, float) for part in parts])

    total = _summed(cells.select(*columns), block)
    weight, at = total[0], 2 + d * d
    if not 0 < total[1] < weight:
        raise ValueError("Both outcome classes are required")
    hessian, gradient = total[2:at].reshape(d, d) / weight, total[at:at + d] / weight
    at, out = at + d, {}
    for name in references:
        size, mean = total[at], total[at + 1:at + 3]
        derivative = total[at + 3:at + 3 + 2 * d].reshape(2, d)
        arms = total[at + 3 + 2 * d:at + 7 + 2 * d]
        if size <= 0:
            raise ValueError(f"Empty reference population: {name}")
        with np.errstate(invalid="ignore", divide="ignore"):
            out[name] = Reference(size, mean / size, derivative / size, arms[:2], arms[2:] / arms[:2])
        at += 7 + 2 * d
    return Moments(float(weight), hessian, gradient, out)


def _newton(cells: DataFrame, encoding: Encoding, ridge: float, weight: str, start: np.ndarray,
            steps: int) -> LogitModel | None:
    """Newton steps, one pass over the cells each, until the gradient vanishes; None when they do not settle."""
    beta = np.asarray(start, float)
    for _ in range(steps):
        model = LogitModel(encoding, beta, ridge)
        sums = moments(cells, encoding, beta, weight)
        gradient = sums.gradient + model.penalty * beta
        if not np.isfinite(gradient).all():
            return None
        if np.max(np.abs(gradient)) < 1e-10:
            return model
        beta = beta - np.linalg.lstsq(sums.hessian + np.diag(model.penalty), gradient, rcond=1e-12)[0]
    return None


def fit_cells(cells: DataFrame, encoding: Encoding, ridge: float, weight: str = "_w",
              start: np.ndarray | None = None) -> LogitModel:
    """Minimise weighted mean log loss plus ridge/2 on all terms but the intercept.

    Newton steps on summed derivatives usually settle within ten passes; otherwise the
    built-in line-search solver provides the starting point for them.
    """
    used = cells.where(F.col(weight) > 0).select(*encoding.keys, "_y", weight).persist()
    try:
        first = np.zeros(len(encoding.labels)) if start is None else start
        with np.errstate(over="ignore"):
            model = _newton(used, encoding, ridge, weight, first, 12)
        if model is None:
            vectors = used.select(array_to_vector(F.array(*encoding.terms()[1:])).alias("features"), "_y", weight)
            fitted = LogisticRegression(labelCol="_y", weightCol=weight, regParam=ridge, elasticNetParam=0.0,
                                        standardization=False, tol=1e-9, maxIter=500).fit(vectors)
            model = _newton(used, encoding, ridge, weight,
                            np.concatenate([[fitted.intercept], fitted.coefficients.toArray()]), 30)
        if model is None:
            raise RuntimeError("The weighted logistic fit did not converge; add a penalty or check for separation")
        return model
    finally:
        used.unpersist()


def fit_weighted_logit(df: DataFrame, encoding: Encoding, outcome: str, weight: str, ridge: float,
                       where: Column | None = None) -> LogitModel:
    """Weighted ridge logistic regression on the rows that satisfy ``where``."""
    w = F.col(weight) if where is None else F.when(where, F.col(weight))
    return fit_cells(covariate_cells(df, encoding, outcome, {"_w": w}), encoding, ridge)


def coefficients(df: DataFrame, model: LogitModel) -> DataFrame:
    """Model terms and coefficients as a small table in the session of ``df``."""
    rows = [(label, float(b)) for label, b in zip(model.encoding.labels, model.beta)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def standardize(df: DataFrame, model: LogitModel, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean prediction with the exposure set to 0 and to 1 for every row, and the gap."""
    ready = model.encoding.prepare(df)
    w = F.col(weight)
    mean = lambda a: F.sum(w * model.probability(F.lit(a))) / F.sum(w)
    return ready.groupBy(*by).agg(mean(0.0).alias("standardized_control"), mean(1.0).alias("standardized_treated")).withColumn(
        "standardized_gap", F.col("standardized_treated") - F.col("standardized_control"))


def _within(test: Column | None) -> Column:
    return F.lit(True) if test is None else F.coalesce(test, F.lit(False))


def reference_influence(df: DataFrame, model: LogitModel, outcome: str, weight: str,
                        references: Mapping[str, Column | None], train: Column | None = None,
                        metrics: Sequence[str] = METRICS,
                        cells: DataFrame | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Points and influence columns ``<reference>__<metric>`` for one or more reference populations.

    The fit used the ``train`` rows (all by default). Each influence adds the
    coefficient part on training rows and the empirical part on reference rows; rows
    outside either get zero there. ``cells`` may hold the matching covariate sums
    (``_w`` and ``_r0``, ``_r1``...) when the caller already has them.
    """
    encoding, w, y = model.encoding, F.col(weight), F.col(outcome).cast("double")
    names = list(references)
    sums = {"_w": F.when(_within(train), w)}
    sums |= {f"_r{i}": F.when(_within(references[name]), w) for i, name in enumerate(names)}
    if cells is None:
        cells = covariate_cells(df, encoding, outcome, sums)
    result = moments(cells, encoding, model.beta, "_w", [f"_r{i}" for i in range(len(names))])
    ready = encoding.prepare(df)
    residual = y - model.probability()
    q = [model.probability(F.lit(float(a))) for a in (0, 1)]
    a_col = F.col(encoding.exposure)
    ready = ready.withColumns({"_res": F.when(_within(train), w / result.weight * residual).otherwise(F.lit(0.0)),
                               "_wt": F.when(_within(train), w / result.weight).otherwise(F.lit(0.0)),
                               "_q0": q[0], "_q1": q[1]})
    curvature = result.hessian + np.diag(model.penalty)
    points, columns, gaps = {}, {}, {}
    for i, name in enumerate(names):
        ref = result.references[f"_r{i}"]
        inside = _within(references[name])
        share = F.when(inside, w / F.lit(float(ref.weight))).otherwise(F.lit(0.0))
        values, influence = {}, {}
        for a, arm in ((0, "control"), (1, "treated")):
            direction = np.linalg.lstsq(curvature, ref.derivative[a], rcond=1e-12)[0]
            offset = float((model.penalty * model.beta) @ direction)
            influence[f"adjusted_{arm}"] = (F.col("_res") * encoding.linear(direction) - F.col("_wt") * offset
                                            + share * (F.col(f"_q{a}") - float(ref.mean[a])))
            values[f"adjusted_{arm}"] = float(ref.mean[a])
            if ref.arm_weight[a] <= 0:
                raise ValueError(f"Reference {name} lacks one arm")
            observed = float(ref.observed[a])
            influence[f"observed_{arm}"] = F.when(inside & (a_col == a), w * (y - observed) / float(ref.arm_weight[a])).otherwise(
                F.lit(0.0))
            values[f"observed_{arm}"] = observed
        for kind in ("observed", "adjusted"):
            values[f"{kind}_gap"] = values[f"{kind}_treated"] - values[f"{kind}_control"]
            if f"{kind}_gap" in metrics:
                gaps[f"{name}__{kind}_gap"] = F.col(f"{name}__{kind}_treated") - F.col(f"{name}__{kind}_control")
        points |= {f"{name}__{metric}": values[metric] for metric in metrics}
        columns |= {f"{name}__{metric}": u for metric, u in influence.items()}
    unused = [c for c in columns if c not in points]
    tokens = [token_name(c) for c, _ in encoding.categorical]
    return ready.withColumns(columns).withColumns(gaps).drop("_res", "_wt", "_q0", "_q1", *tokens, *unused), points


def estimate_rows(df: DataFrame, points: Mapping[str, float], design: SurveyDesign, roster: DataFrame,
                  critical: float | None = None, scale: float = 100.0) -> DataFrame:
    """Estimate, SE and interval of every influence column under the three single-cluster rules."""
    cov = roster_variances(df, design, list(points), roster)
    return interval_rows(cov, points, critical, scale)


def interval_rows(cov: DataFrame, points: Mapping[str, float], critical: float | None, scale: float) -> DataFrame:
    pairs = [F.lit(x) for key, value in points.items() for x in (key, float(value))]
    rows = cov.where("row_key = col_key").select(
        F.col("row_key").alias("metric"), "singleton", (scale * F.create_map(*pairs)[F.col("row_key")]).alias("estimate"),
        (scale * F.sqrt(F.greatest("cov", F.lit(0.0)))).alias("se"), "design_df")
    return intervals(rows, "estimate", "se", critical, None if critical else "design_df")


def standardized_gap(df: DataFrame, encoding: Encoding, design: SurveyDesign, outcome: str, roster: DataFrame,
                     ridge: float, critical: float | None = None) -> DataFrame:
    """Observed and adjusted arm means and gaps with joint design intervals, in percent."""
    w = F.col(design.weight)
    cells = cut(covariate_cells(df, encoding, outcome, {"_w": w, "_r0": w}))
    model = fit_cells(cells, encoding, ridge)
    linear, points = reference_influence(df, model, outcome, design.weight, {"full": None}, cells=cells)
    renamed = linear.withColumnsRenamed({f"full__{m}": m for m in METRICS})
    return estimate_rows(renamed, {m: points[f"full__{m}"] for m in METRICS}, design, roster, critical)


def support_scenarios(df: DataFrame, encoding: Encoding, design: SurveyDesign, outcome: str, roster: DataFrame,
                      ridge: float, masks: Mapping[str, str], refit: Sequence[str],
                      critical: float | None = None) -> DataFrame:
    """Adjusted gap with the reference restricted to support masks, with and without refitting.

    ``masks`` maps scenario names to boolean columns. Without refitting the gap can
    move by at most twice the excluded weight share; that bound is checked.
    """
    weight = design.weight
    model = fit_weighted_logit(df, encoding, outcome, weight, ridge)
    references = {"full_reference": None} | {name: F.col(column) for name, column in masks.items()}
    linear, points = reference_influence(df, model, outcome, weight, references, metrics=["adjusted_gap"])
    kept = {}
    for name in refit:
        mask = F.col(masks[name])
        refitted = fit_weighted_logit(df, encoding, outcome, weight, ridge, mask)
        linear, more = reference_influence(linear, refitted, outcome, weight, {f"{name}_refit": mask}, mask, ["adjusted_gap"])
        points |= more
        kept[f"{name}_refit"] = masks[name]
    shares = df.agg(*[(100 * F.coalesce(F.sum(F.when(~F.col(c), F.col(weight))), F.lit(0.0)) / F.sum(weight)).alias(c)
                      for c in masks.values()],
                    *[F.count_if(F.col(c)).alias(f"_n_{c}") for c in masks.values()], F.count("*").alias("_n")).first()
    full = points["full_reference__adjusted_gap"]
    meta = []
    for name in [*references, *kept]:
        column = {**masks, **kept}.get(name)
        excluded = 0.0 if column is None else float(shares[column])
        change = 100 * (points[f"{name}__adjusted_gap"] - full)
        if name in masks and abs(change) > 2 * excluded + 1e-6:
            raise RuntimeError(f"{name}: restriction moved the gap beyond its bound")
        meta.append((f"{name}__adjusted_gap", name, int(shares["_n"] if column is None else shares[f"_n_{column}"]), excluded,
                     change, None if name in kept else 2 * excluded))
    table = df.sparkSession.createDataFrame(
        meta, "metric string, scenario string, reference_n long, excluded_weight_pct double, change_from_full_pp double, "
              "change_bound_pp double")
    return table.join(estimate_rows(linear, points, design, roster, critical), "metric").drop("metric")


def shared_reference_gap(df: DataFrame, encoding: Encoding, design: SurveyDesign, outcome: str, wave: str,
                         waves: Sequence, supported: str, groups: Mapping[str, Column],
                         ridge: float) -> tuple[DataFrame, dict[str, float]]:
    """Per-wave models judged on one reference: half of each wave's supported rows.

    Adds influence columns ``<group>__<wave>`` and ``<group>__change`` (second wave minus first).
    """
    w, y = F.col(design.weight), F.col(outcome).cast("double")
    half = 1.0 / len(waves)
    tests = {(g, r): F.col(supported) & test & (F.col(wave) == r) for g, test in groups.items() for r in waves}
    names = {key: f"_r{i}" for i, key in enumerate(tests)}
    points, columns = {}, {}
    out = encoding.prepare(df)
    for m in waves:
        train = F.col(wave) == m
        sums = {"_w": F.when(train, w)} | {names[key]: F.when(test, w) for key, test in tests.items()}
        cells = cut(covariate_cells(df, encoding, outcome, sums))
        model = fit_cells(cells, encoding, ridge)
        result = moments(cells, encoding, model.beta, "_w", list(names.values()))
        total = result.weight
        delta = model.probability(F.lit(1.0)) - model.probability(F.lit(0.0))
        out = out.withColumns({f"_res{m}": F.when(train, w / total * (y - model.probability())).otherwise(F.lit(0.0)),
                               f"_wt{m}": F.when(train, w / total).otherwise(F.lit(0.0)), f"_delta{m}": delta})
        for g in groups:
            refs = [result.references[names[g, r]] for r in waves]
            gradient = sum(half * (ref.derivative[1] - ref.derivative[0]) for ref in refs)
            direction = np.linalg.lstsq(result.hessian + np.diag(model.penalty), gradient, rcond=1e-12)[0]
            u = (F.col(f"_res{m}") * encoding.linear(direction)
                 - F.col(f"_wt{m}") * float((model.penalty * model.beta) @ direction))
            for r, ref in zip(waves, refs):
                mean = float(ref.mean[1] - ref.mean[0])
                u = u + F.when(tests[g, r], half * w / float(ref.weight) * (F.col(f"_delta{m}") - mean)).otherwise(F.lit(0.0))
            points[f"{g}__{m}"] = float(sum(half * (ref.mean[1] - ref.mean[0]) for ref in refs))
            columns[f"{g}__{m}"] = u
    for g in groups:
        points[f"{g}__change"] = points[f"{g}__{waves[-1]}"] - points[f"{g}__{waves[0]}"]
        columns[f"{g}__change"] = columns[f"{g}__{waves[-1]}"] - columns[f"{g}__{waves[0]}"]
    return out.withColumns(columns), points


def covariance_by_wave(df: DataFrame, design: SurveyDesign, metrics: Sequence[str], rosters: Mapping, wave: str) -> DataFrame:
    """Sum of the waves' roster covariances (independent samples); the smallest df is kept."""
    out = None
    for value, roster in rosters.items():
        part = roster_covariance(df.where(F.col(wave) == value), design, metrics, roster)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("singleton", "row_key", "col_key").agg(F.sum("cov").alias("cov"), F.min("design_df").alias("design_df"))


def training_population_contrast(df: DataFrame, encoding: Encoding, design: SurveyDesign, outcome: str, roster: DataFrame,
                                 ridge: float, subset: Column, reference: Column | None,
                                 critical: float | None = None) -> DataFrame:
    """Adjusted gap of a model trained on all rows and of one trained on a subset, on the same reference."""
    w = design.weight
    linear, points = df, {}
    for name, rows in (("all_rows", None), ("subset", subset)):
        model = fit_weighted_logit(df, encoding, outcome, w, ridge, rows)
        linear, more = reference_influence(linear, model, outcome, w, {name: reference}, rows, ["adjusted_gap"])
        points |= more
    points = {k.split("__")[0]: v for k, v in points.items()}
    linear = linear.withColumnsRenamed({f"{k}__adjusted_gap": k for k in points}).withColumn(
        "difference", F.col("subset") - F.col("all_rows"))
    points["difference"] = points["subset"] - points["all_rows"]
    return estimate_rows(linear, points, design, roster, critical)


def exclusion_sensitivity(df: DataFrame, encoding: Encoding, design: SurveyDesign, outcome: str, roster: DataFrame,
                          ridge: float, keep: Column, critical: float | None = None) -> DataFrame:
    """Full analysis, reference-only exclusion, refit after exclusion, and their paired differences."""
    w = design.weight
    full = fit_weighted_logit(df, encoding, outcome, w, ridge)
    linear, points = reference_influence(df, full, outcome, w, {"full": None, "reference_only": keep}, None, ["adjusted_gap"])
    refit = fit_weighted_logit(df, encoding, outcome, w, ridge, keep)
    linear, more = reference_influence(linear, refit, outcome, w, {"refit": keep}, keep, ["adjusted_gap"])
    points = {k.split("__")[0]: v for k, v in (points | more).items()}
    linear = linear.withColumnsRenamed({f"{k}__adjusted_gap": k for k in points})
    for name, (a, b) in {"reference_only_minus_full": ("reference_only", "full"), "refit_minus_reference_only":
                         ("refit", "reference_only"), "refit_minus_full": ("refit", "full")}.items():
        linear = linear.withColumn(name, F.col(a) - F.col(b))
        points[name] = points[a] - points[b]
    return estimate_rows(linear, points, design, roster, critical)


@dataclass(frozen=True)
class Identification:
    """Which terms a design identifies, in the order of its labels, and how the others follow from them."""

    kept: list[int]
    dropped: list[int]
    relation: np.ndarray


def identify(cells: DataFrame, encoding: Encoding, tolerance: float = 1e-9) -> Identification:
    """Factor the summed Gram matrix term by term: a term that earlier ones explain is dropped.

    ``relation[:, j]`` gives term j as a combination of the kept terms. Terms are scaled to unit length first; a term whose
    remaining length is within ``tolerance`` is explained.
    """
    def block(batch: pd.DataFrame) -> np.ndarray:
        x = encoding.matrix(batch)
        return (x.T @ (batch["_w"].to_numpy(float)[:, None] * x)).ravel()

    d = len(encoding.labels)
    gram = _summed(cells.select(*encoding.keys, "_w"), block).reshape(d, d)
    size = np.sqrt(np.diag(gram))
    scaled = gram / np.outer(np.where(size > 0, size, 1), np.where(size > 0, size, 1))
    kept: list[int] = []
    left, factor = np.where(size > 0, 1.0, 0.0), np.zeros((d, d))
    for j in range(d):
        if left[j] <= tolerance:
            continue
        k = len(kept)
        factor[k] = (scaled[j] - factor[:k].T @ factor[:k, j]) / np.sqrt(left[j])
        left = left - factor[k] ** 2
        kept.append(j)
    unit = np.linalg.lstsq(scaled[np.ix_(kept, kept)], scaled[kept], rcond=1e-14)[0]
    relation = unit * np.where(size > 0, size, 0)[None, :] / size[kept][:, None]
    return Identification(kept, [j for j in range(d) if j not in set(kept)], relation)


def span_error(df: DataFrame, encoding: Encoding, found: Identification) -> float:
    """Largest difference, over rows and both exposures, between a dropped term and what the kept ones make of it."""
    if not found.dropped:
        return 0.0
    worst = []
    for j in found.dropped:
        gap = np.zeros(len(encoding.labels))
        gap[found.kept] = -found.relation[:, j]
        gap[j] += 1.0
        worst += [F.max(F.abs(encoding.linear(gap, F.lit(a)))) for a in (0.0, 1.0)]
    row = encoding.prepare(df).agg(*[w.alias(f"w{i}") for i, w in enumerate(worst)]).first()
    return max((float(x) for x in row if x is not None), default=0.0)


def period_gaps(df: DataFrame, encoding: Encoding, design: SurveyDesign, outcome: str, by: Sequence[str], unit: str, minimum: int,
                ridge: float, roster: DataFrame | None = None, reps: int = 0, seed: int = 0, least_rows: int = 100,
                least_success: int = 200, share: float = 0.95) -> DataFrame:
    """Adjusted gap of every domain (a combination of ``by``) on its own supported units and on the target common to all domains.

    A unit supports a domain with ``minimum`` rows in each arm there; the others are listed. A domain with fewer than
    ``least_rows`` rows in supported units, one arm or one outcome only is reported without estimates. With
    ``reps``, the model is refitted in every replicate of a bootstrap of the roster's clusters, all domains and replicates
    at once; limits are given if enough of them succeed.
    """
    a, w = F.col(encoding.exposure), F.col(design.weight)
    rows = encoding.prepare(df).withColumn("_domain", F.concat_ws("|", *[F.col(c).cast("string") for c in by]))
    held = dict.fromkeys(["_domain", *by, unit, *(design.cluster if reps else ()), *encoding.keys])
    # the rows are read once; all that follows are sums of these
    cells = cut(rows.groupBy(*held, F.col(outcome).cast("double").alias("_y")).agg(F.sum(w).alias("_w"), F.count("*").alias("_n")))
    n = F.col("_n")
    counts = cells.groupBy("_domain", *by, unit).agg(
        F.sum(n).alias("n"), F.sum(F.when(a == 0, n).otherwise(0)).alias("n0"), F.sum(F.when(a == 1, n).otherwise(0)).alias("n1"),
        F.sum(F.col("_y") * n).alias("events"))
    support = cut(counts.withColumn("own", (F.col("n0") >= minimum) & (F.col("n1") >= minimum)))
    own = lambda v: F.coalesce(F.sum(F.when(F.col("own"), v)), F.lit(0))
    tallies = {r["_domain"]: r for r in support.groupBy("_domain", *by).agg(
        F.sum("n").alias("n"), own(F.col("n")).alias("model_n"), F.count_if("own").alias("units"),
        own(F.col("events")).alias("events"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("own"), F.col(unit).cast("string")))), "|").alias("left_out"),
    ).collect()}  # one row per domain
    fitted = sorted(k for k, r in tallies.items() if r["model_n"] >= least_rows and 0 < r["events"] < r["model_n"])
    common = support.where("own").groupBy(unit).count().where(F.col("count") == len(tallies)).select(unit)
    few = sum(r["units"] for r in tallies.values()) * 256 <= BROADCAST_BYTES  # counted; the plan only guesses
    small = F.broadcast if few else broadcast_if_small
    own_units = small(support.where("own").select("_domain", unit))
    kept = cells.where(F.col("_domain").isin(fitted)).join(own_units, ["_domain", unit], "left_semi").select(
        F.col("_domain").alias("domain"), *dict.fromkeys([*(design.cluster if reps else ()), *encoding.keys]), "_y", "_w")
    fits: dict[str, Fits] = {}
    if fitted and reps:
        fits, _ = refit_cells(kept, encoding, design, roster, reps, seed, ridge, fitted)
    elif fitted:
        fits = fit_many(cut(kept.groupBy("domain", *encoding.keys, "_y").agg(F.array(F.sum("_w")).alias("_ws"))), encoding, ridge, dict.fromkeys(fitted, 1))
    shared = cells.join(small(common), unit, "left_semi").groupBy(*encoding.keys).agg(F.sum("_w").alias("_w"))
    target = _target_gaps(shared, encoding, F.col("_w"), {k: f.beta[0] for k, f in fits.items() if f.status[0] == "ok"})
    kinds, out = dict(df.dtypes), []
    for name, r in sorted(tallies.items()):
        line = [*[r[c] for c in by], int(r["n"]), int(r["model_n"]), int(r["units"]), r["left_out"]]
        if name not in fits:
            out.append((*line, None, None, None, None, None, "insufficient_data"))
            continue
        gaps = 100 * fits[name].gap
        good = gaps[1:][np.isfinite(gaps[1:])]
        enough = reps and len(good) >= max(least_success, int(np.ceil(reps * share)))
        limits = np.percentile(good, [2.5, 97.5]).tolist() if enough else [None, None]
        status = "point_estimate" if not reps else ("interval" if enough else "too_few_replicates")
        point = float(gaps[0]) if np.isfinite(gaps[0]) else None
        out.append((*line, point, target.get(name), len(good) if reps else None, *limits, status if point is not None else fits[name].status[0]))
    return df.sparkSession.createDataFrame(
        out, ", ".join(f"{c} {kinds[c]}" for c in by) + ", eligible_n long, model_n long, units_retained long, units_excluded string, "
        "own_target_gap_pp double, common_target_gap_pp double, replicates_ok int, ci_low double, ci_high double, status string")


def _target_gaps(df: DataFrame, encoding: Encoding, weight: Column, betas: Mapping[str, np.ndarray]) -> dict[str, float | None]:
    """Adjusted gap, in percent, of several models on the same prepared rows, in one pass."""
    if not betas:
        return {}
    mean = lambda b, a: F.sum(weight * sigmoid(encoding.linear(b, F.lit(a)))) / F.sum(weight)
    row = df.agg(*[(100 * (mean(b, 1.0) - mean(b, 0.0))).alias(k) for k, b in betas.items()]).first()
    return row.asDict()


def period_influence(df: DataFrame, encoding: Encoding, design: SurveyDesign, outcome: str, roster: DataFrame, period: str,
                     periods: Sequence[str], pairs: Sequence[tuple[str, str]], ridge: float, critical: float | None = None,
                     reference: Column | None = None) -> DataFrame:
    """Period gaps on one shared target with joint covariance, and later-minus-earlier contrasts.

    The target is all rows or those of ``reference``. A level of it that a period's training rows never show is refused
    with any ridge: its coefficient would be the penalty's. Without a penalty, terms that earlier terms
    explain are dropped and named, which is refused if the target is not in the span of the others. A level with a
    single outcome has its best coefficient at infinity: its training rows are set aside if the target
    has no such rows, else it is refused.
    """
    w = design.weight
    tokens = [token_name(c) for c, _ in encoding.categorical]
    levels = F.array(*[F.struct(F.lit(t).alias("c"), F.col(t).alias("l")) for t in tokens])
    target = df if reference is None else df.where(reference)
    wanted = {tuple(r) for r in encoding.prepare(target).select(F.inline(levels)).distinct().collect()} if tokens else set()  # one row per model term
    linear, points, notes = df, {}, {}
    for name in periods:
        train, rows_of = F.col(period) == name, lambda t: covariate_cells(
            df, encoding, outcome, {"_w": F.when(t, F.col(w)), "_n": F.when(t, F.lit(1))}).where("_w > 0")
        cells = cut(rows_of(train))
        shown = cells.select("_y", F.inline(levels)).groupBy("c", "l").agg(
            F.min("_y").alias("lo"), F.max("_y").alias("hi")).collect() if tokens else []
        pure = sorted((r["c"], r["l"]) for r in shown if r["lo"] == r["hi"])
        unseen = sorted(wanted - {(r["c"], r["l"]) for r in shown})
        if unseen:
            raise ValueError(f"{name}: levels of the target without training rows: {unseen[:5]}")
        aside, found, error = 0, identify(cells, encoding), 0.0
        if ridge <= 0:
            if any(x in wanted for x in pure):
                raise ValueError(f"{name}: single-outcome levels of the target: {[x for x in pure if x in wanted][:5]}")
            if pure:
                lonely = [F.col(c) == level for c, level in pure]
                aside = int(cells.where(functools.reduce(operator.or_, lonely)).agg(F.sum("_n")).first()[0])
                known = {token_name(c): category_token(c, v) for c, v in encoding.categorical}
                train = train & ~functools.reduce(operator.or_, [known[c] == level for c, level in pure])
                cells = cut(rows_of(train))
                found = identify(cells, encoding)
            error = span_error(target, encoding, found)
            if error > 1e-7:
                raise ValueError(f"{name}: the target depends on terms that its training rows do not identify")
        model = fit_cells(cells, encoding, ridge)
        linear, more = reference_influence(linear, model, outcome, w, {name: reference}, train, ["adjusted_gap"])
        points[name] = more[f"{name}__adjusted_gap"]
        notes[name] = (len(found.kept), len(encoding.labels), "|".join(encoding.labels[j] for j in found.dropped), len(pure), aside, error)
    linear = linear.withColumnsRenamed({f"{k}__adjusted_gap": k for k in points})
    for later, earlier in pairs:
        linear = linear.withColumn(f"{later}_minus_{earlier}", F.col(later) - F.col(earlier))
        points[f"{later}_minus_{earlier}"] = points[later] - points[earlier]
        notes[f"{later}_minus_{earlier}"] = (None,) * 6
    table = df.sparkSession.createDataFrame(
        [(k, *v) for k, v in notes.items()], "metric string, design_rank int, design_terms int, dropped_terms string, single_outcome_levels int, "
        "rows_set_aside long, span_error double")
    return estimate_rows(linear, points, design, roster, critical).join(table, "metric")


def heterogeneity_change(theta: DataFrame, cov: DataFrame, contrasts: DataFrame, critical: float) -> DataFrame:
    """Contrasts of group-by-wave estimates with joint SE and the SE that ignores covariances."""
    joint = contrast_covariance(cov, contrasts).where("row_contrast = col_contrast").select(
        F.col("row_contrast").alias("contrast"), F.sqrt(F.greatest("cov", F.lit(0.0))).alias("se"))
    diagonal = cov.where("row_key = col_key")
    naive = contrasts.join(diagonal.select(F.col("row_key").alias("key"), F.col("cov").alias("_v")), "key").groupBy(
        "contrast").agg(F.sqrt(F.sum(F.col("coef") * F.col("coef") * F.col("_v"))).alias("se_ignoring_covariance"))
    rows = apply_contrasts(theta, contrasts).join(joint, "contrast").join(naive, "contrast")
    return intervals(rows, "estimate", "se", critical)


def residualize_context(df: DataFrame, columns: Mapping[str, float], unit: str, year: str, month: str) -> tuple[DataFrame, DataFrame]:
    """Residuals of context columns on unit, calendar-year and annual sine/cosine terms (unweighted).

    The projection is solved on summed normal equations; unit effects are removed by unit means, so the
    number of units is not limited and only year and season terms are dense. A term that the nuisance
    terms or earlier context terms explain is dropped. Returns (rows with
    ``<column>_residual``, table of terms).
    """
    years = sorted(r[0] for r in df.select(year).where(F.col(year).isNotNull()).distinct().collect())
    angle = 2 * np.pi * F.col(month) / 12
    nuisance = [(F.col(year) == v).cast("double") for v in years[1:]] + [F.sin(angle), F.cos(angle)]
    values = [F.col(c).cast("double") / float(d) for c, d in columns.items()]
    k, m = len(nuisance), len(values)
    terms = [*nuisance, *values]
    cells = df.groupBy(unit, year, month, *columns).agg(F.count("*").cast("double").alias("_n"))
    units = cut(cells.groupBy(unit).agg(F.sum("_n").alias("_n"), *[F.sum(F.col("_n") * t).alias(f"_s{i}") for i, t in enumerate(terms)]))

    def block(batch: pd.DataFrame) -> np.ndarray:
        z = np.stack(batch["_z"])
        return (z.T @ (batch["_n"].to_numpy()[:, None] * z)).ravel()

    # unit effects are absorbed: squares about unit means are all squares less those of the means
    cross = _summed(cells.select(F.array(*terms).alias("_z"), "_n"), block).reshape(k + m, k + m)
    means = units.select(F.array(*[F.col(f"_s{i}") / F.col("_n") for i in range(k + m)]).alias("_z"), "_n")
    within = cross - _summed(means, block).reshape(k + m, k + m)
    beta = np.linalg.lstsq(within[:k, :k], within[:k, k:], rcond=1e-12)[0]
    left = within[k:, k:] - within[k:, :k] @ beta
    kept, table = [], []
    for j, name in enumerate(columns):
        raw = max(left[j, j], 0.0)
        independent = raw
        if kept:
            s = left[np.ix_(kept, kept)]
            independent = max(raw - float(left[kept, j] @ np.linalg.lstsq(s, left[kept, j], rcond=1e-12)[0]), 0.0)
        keep = bool(np.sqrt(independent) > 1e-6 * max(1.0, np.sqrt(cross[k + j, k + j])))
        kept += [j] if keep else []
        table.append((name, float(columns[name]), float(np.sqrt(raw)), float(np.sqrt(independent)), keep))
    centred = [t - F.col(f"_s{i}") / F.col("_units_n") for i, t in enumerate(terms)]
    out = {f"{name}_residual": centred[k + j] - sum((z * float(b) for z, b in zip(centred[:k], beta[:, j])), F.lit(0.0))
           for j, name in enumerate(columns)}
    terms_table = df.sparkSession.createDataFrame(table, "term string, divisor double, residual_norm double, "
                                                   "independent_norm double, included boolean")
    joined = df.join(broadcast_if_small(units.withColumnRenamed("_n", "_units_n")), unit, "left")
    return joined.withColumns(out).drop("_units_n", *[f"_s{i}" for i in range(k + m)]), terms_table



def residual_variation(df: DataFrame, raw: str, residual: str, unit: str, year: str, exposure: str, weight: str,
                       tolerance: float = 1e-8) -> DataFrame:
    """Share of variance absorbed, unit-year cells with remaining variation, weighted exposure correlation."""
    cells = df.groupBy(unit, year).agg(F.avg(residual).alias("_m"), F.count("*").alias("_n"))
    summary = cells.agg(F.count("*").alias("cells"), F.count_if(F.abs("_m") > tolerance).alias("cells_with_variation"),
                        F.count_distinct(F.when(F.abs("_m") > tolerance, F.col(unit))).alias("units_with_variation"),
                        F.sqrt(F.avg(F.col("_m") * F.col("_m"))).alias("between_cell_rms"))
    w, r, a = F.col(weight), F.col(residual), F.col(exposure)
    mean = lambda v: F.sum(w * v) / F.sum(w)
    one = df.agg(mean(r).alias("_mr"), mean(a).alias("_ma"), mean(r * r).alias("_rr"), mean(a * a).alias("_aa"),
                 mean(r * a).alias("_ra"), F.var_pop(raw).alias("_vt"), F.avg(r * r).alias("_vr"), F.count("*").alias("n"))
    vr, va = F.col("_rr") - F.col("_mr") ** 2, F.col("_aa") - F.col("_ma") ** 2
    stats = one.select("n", (1 - F.try_divide(F.col("_vr"), F.col("_vt"))).alias("share_absorbed"),
                       F.sqrt("_vt").alias("raw_sd"), F.sqrt("_vr").alias("residual_sd"),
                       F.try_divide(F.col("_ra") - F.col("_mr") * F.col("_ma"), F.sqrt(F.greatest(vr * va, F.lit(0.0)))).alias(
                           "weighted_corr_with_exposure"))
    pick = lambda c: summary.select(c).scalar().alias(c)
    return stats.select("*", *[pick(c) for c in ("cells", "cells_with_variation", "units_with_variation", "between_cell_rms")])


def context_models(df: DataFrame, encoding: Encoding, calendar: Encoding, context: Encoding, design: SurveyDesign,
                   outcome: str, roster: DataFrame, ridge: float, linked: Column, critical: float | None = None) -> DataFrame:
    """Six paired points: full, linked reference, calendar model, context model and two differences."""
    w = design.weight
    full = fit_weighted_logit(df, encoding, outcome, w, ridge)
    linear, points = reference_influence(df, full, outcome, w, {"full": None, "linked": linked}, None, ["adjusted_gap"])
    for name, enc in (("calendar", calendar), ("context", context)):
        model = fit_weighted_logit(df, enc, outcome, w, ridge, linked)
        linear, more = reference_influence(linear, model, outcome, w, {name: linked}, linked, ["adjusted_gap"])
        points |= more
    points = {k.split("__")[0]: v for k, v in points.items()}
    linear = linear.withColumnsRenamed({f"{k}__adjusted_gap": k for k in points})
    for name, (a, b) in {"context_minus_calendar": ("context", "calendar"), "linked_minus_full": ("linked", "full")}.items():
        linear = linear.withColumn(name, F.col(a) - F.col(b))
        points[name] = points[a] - points[b]
    return estimate_rows(linear, points, design, roster, critical)


def penalty_selection(df: DataFrame, encoding: Encoding, design: SurveyDesign, outcome: str, site: str,
                      grid: Sequence[float], seeds: Sequence[int], fraction: float = 0.2) -> DataFrame:
    """Pooled hold-out log loss of every penalty over repeated cluster splits; ties go to the larger penalty."""
    w, losses, split = F.col(design.weight), [], df
    units = [c for c in design.cluster if c != site]
    for i, seed in enumerate(seeds):
        split = hash_split(split, units, [site], fraction, seed).withColumnRenamed("holdout", f"_out{i}")
    outside = [F.col(f"_out{i}") for i in range(len(seeds))]
    cells = cut(covariate_cells(split, encoding, outcome, {f"_w{i}": F.when(~o, w) for i, o in enumerate(outside)}
                                | {f"_held{i}": F.when(o, w) for i, o in enumerate(outside)}))
    rows = cut(cells.select(F.lit("all").alias("domain"), *encoding.keys, "_y", F.array(*[f"_w{i}" for i in range(len(seeds))]).alias("_ws")))
    start = None
    for ridge in sorted(grid, reverse=True):
        # the splits are fitted together, from the coefficients of the next larger penalty
        fits = fit_many(rows, encoding, ridge, {"all": len(seeds)}, start=start)["all"]
        if set(fits.status) != {"ok"}:
            raise RuntimeError(f"Fits with penalty {ridge} that did not settle: {fits.status}")
        start, sums = {"all": fits.beta}, []
        for i, beta in enumerate(fits.beta):
            z = encoding.linear(beta)
            loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("_y") * z
            sums += [F.sum(f"_held{i}").alias(f"t{i}"), F.sum(F.col(f"_held{i}") * loss).alias(f"l{i}")]
        found = cells.agg(*sums).first()
        losses += [(int(seed), float(ridge), float(found[f"t{i}"]), float(found[f"l{i}"])) for i, seed in enumerate(seeds)]
    table = df.sparkSession.createDataFrame(losses, "seed int, ridge double, weight double, loss double")
    pooled = table.groupBy("ridge").agg((F.sum("loss") / F.sum("weight")).alias("pooled_log_loss"),
                                        F.avg(F.col("loss") / F.col("weight")).alias("split_mean"),
                                        F.stddev_samp(F.col("loss") / F.col("weight")).alias("split_sd"))
    best = pooled.agg(F.min_by("ridge", F.struct("pooled_log_loss", -F.col("ridge"))).alias("v")).scalar()
    wins = table.groupBy("seed").agg(F.min_by("ridge", F.struct(F.col("loss") / F.col("weight"), -F.col("ridge"))).alias("ridge"))
    won = wins.groupBy("ridge").agg(F.count("*").alias("splits_won"))
    return pooled.join(won, "ridge", "left").select(
        "ridge", "pooled_log_loss", "split_mean", "split_sd", F.coalesce("splits_won", F.lit(0)).alias("splits_won"),
        (F.col("ridge") == best).alias("selected"),
        ((F.col("ridge") == best) & F.col("ridge").isin(float(min(grid)), float(max(grid)))).alias("at_grid_boundary"))


def site_screen(df: DataFrame, design: SurveyDesign, site: str, arm: str, outcome: str, minimum: int) -> DataFrame:
    """Per-site rows, arms, outcomes and clusters, and whether the site passes the support screen."""
    n0, n1 = F.count_if(F.col(arm) == 0), F.count_if(F.col(arm) == 1)
    return df.groupBy(site).agg(
        F.count("*").alias("n"), n0.alias("n_control"), n1.alias("n_treated"), F.sum(outcome).alias("events"),
        F.sum(design.weight).alias("weight"), F.count_distinct(*[c for c in design.cluster if c != site]).alias("psus"),
        ((n0 >= minimum) & (n1 >= minimum) & (F.min(outcome) != F.max(outcome))).alias("passes"))


def screened_training(df: DataFrame, encoding: Encoding, design: SurveyDesign, outcome: str, site: str, ridge: float,
                      minimum: int) -> DataFrame:
    """Evaluation of the full fit and of a fit on screened sites, on the same full reference."""
    w = design.weight
    screen = site_screen(df, design, site, encoding.exposure, outcome, minimum).where("passes").select(
        site, F.lit(True).alias("_passes"))
    marked = df.join(screen, site, "left").withColumn("_passes", F.coalesce("_passes", F.lit(False)))
    out = None
    for name, rows in (("all_sites", None), ("screened_sites", F.col("_passes"))):
        model = fit_weighted_logit(marked, encoding, outcome, w, ridge, rows)
        scores = encoding.prepare(df).select(outcome, w, model.probability().alias("_p"),
                                             model.probability(F.lit(1.0)).alias("_q1"), model.probability(F.lit(0.0)).alias("_q0"))
        row = evaluation_sums(scores, outcome, "_p", "_q1", "_q0", w).withColumn("training", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def treated_counterfactual_delta(df: DataFrame, exposure: str, observed: str, counterfactual: str, weight: str,
                                 supported: str, by: str) -> DataFrame:
    """For treated rows in supported cells: weighted mean and quantiles of observed minus control prediction."""
    treated = df.where((F.col(exposure) == 1) & F.col(supported)).withColumn("delta", F.col(observed) - F.col(counterfactual))
    long = grouped_levels(treated, ["delta", F.col(weight).alias("_w")], [by])
    means = long.groupBy("group", "level").agg(F.count("*").alias("n"),
                                               (F.sum(F.col("_w") * F.col("delta")) / F.sum("_w")).alias("mean_delta"))
    quantiles = weighted_quantile(long, "delta", "_w", {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95},
                                  ["group", "level"])
    return means.join(quantiles, ["group", "level"])


def counterfactual_delta_ci(df: DataFrame, design: SurveyDesign, exposure: str, observed: str, counterfactual: str,
                            supported: str, levels: Mapping[str, Column], reps: int, seed: int) -> DataFrame:
    """Cluster-bootstrap limits of the weighted mean delta of treated supported rows, per named subgroup."""
    w, delta = F.col(design.weight), F.col(observed) - F.col(counterfactual)
    here = (F.col(exposure) == 1) & F.col(supported)
    sums = ratio_sums({name: here & test for name, test in levels.items()}, w * delta, w)
    replicates = psu_bootstrap(cluster_totals(df, design, sums), design, reps, seed)
    return percentile_intervals(replicates, {name: F.try_divide(F.col(f"num_{name}"), F.col(f"den_{name}")) for name in levels})
