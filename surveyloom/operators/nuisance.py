"""Fitted nuisance models: cross-fitting, targeted updates, stacking, forests and calibration."""

from __future__ import annotations

import functools
import hashlib
import inspect
import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.design import SurveyDesign
from surveyloom.functions.hashing import digest
from surveyloom.functions.recode import clip
from surveyloom.operators.bootstrap import cluster_totals, paired_bootstrap_difference, psu_bootstrap
from surveyloom.operators.causal import aipw, aipw_scores
from surveyloom.operators.encoding import Encoding, learn_encoding, token_name
from surveyloom.operators.evaluate import ranking_metrics
from surveyloom.operators.ranking import quantile_bins, stratified_group_folds
from surveyloom.operators.refits import fit_many, multiplier_bytes
from surveyloom.operators.scale import broadcast_if_small, cut, exact_quantiles, growing_side, hash_ranks
from surveyloom.operators.standardize import LogitModel, covariate_cells, fit_cells, sigmoid

TINY = 1e-6


def _features(encoding: Encoding, exposure: Column | None = None) -> Column:
    return array_to_vector(F.array(*encoding.terms(exposure)[1:]))


def fit_trees(cells: DataFrame, encoding: Encoding, weight: str, trees: int, depth: int, seed: int):
    """Boosted trees on covariate cells with summed weights."""
    rows = cells.where(F.col(weight) > 0).select(_features(encoding).alias("features"), F.col("_y").alias("label"),
                                                 F.col(weight).alias("w"))
    return GBTClassifier(weightCol="w", maxIter=trees, maxDepth=depth, seed=seed, maxBins=32).fit(rows)


def tree_probability(model, df: DataFrame, encoding: Encoding, out: str, exposure: Column | None = None) -> DataFrame:
    """Add the tree model's probability to a prepared frame."""
    scored = model.transform(df.withColumn("features", _features(encoding, exposure)))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def check_cross_fit(df: DataFrame, group: Sequence[str], scores: Sequence[str]) -> None:
    """Fail on groups in several folds and on missing or non-finite scores."""
    bad = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in scores]).first().asDict()
    if any(bad.values()):
        raise ValueError(f"Held-out scores are incomplete: {bad}")
    if df.groupBy(*group).agg((F.min("fold") != F.max("fold")).alias("torn")).where("torn").limit(1).count():
        raise ValueError("A group occurs in several folds")


def _model_of(fits: Mapping[str, Sequence], level: Column) -> Column:
    """Coefficients of the row's own level and fold, as one array column."""
    every = F.create_map(*[F.lit(x) for name, models in fits.items() for x in (name, [[float(b) for b in m.beta] for m in models])])
    return F.get(every[level], F.col("fold"))


def cross_fit(df: DataFrame, numeric: Mapping[str, float], categorical: Sequence[str], exposure: str, outcome: str,
              weight: str, group: Sequence[str], k: int, seed: int, outcome_model: str = "trees", ridge: float = 1e-5,
              trees: int = 10, depth: int = 3, within: str | None = None) -> DataFrame:
    """Out-of-fold propensity ``e_fit`` and outcome predictions ``mu1_fit`` and ``mu0_fit``.

    Models are fitted on covariate cells of the other folds; held-out rows are scored
    and stored once so that later estimates do not refit. With ``within``, folds and (logistic) models never see rows of
    other levels of that column, which must not be null; the fits of all levels share the passes.
    """
    folded = cut(stratified_group_folds(df, group, exposure, k, seed, within=[within] if within else []))
    confounders = learn_encoding(folded, None, numeric, categorical)
    full = Encoding(exposure, confounders.numeric, confounders.categorical)
    w, parts = F.col(weight), []
    names = [f"_w{f}" for f in range(k)]
    level = F.col(within).cast("string") if within else F.lit("all")
    sums = {f"_w{f}": F.when(F.col("fold") != f, w) for f in range(k)}
    cells = lambda encoding, label: cut(covariate_cells(folded.withColumn("domain", level), encoding, label, sums, ["domain"]))
    ready = full.prepare(folded)
    propensities = LogitLearner(confounders, ridge).fit_within(cells(confounders, exposure), names)
    for_outcome = cells(full, outcome)
    outcomes = LogitLearner(full, ridge).fit_within(for_outcome, names) if outcome_model == "logistic" else {}
    ready = ready.withColumn("_b", _model_of(propensities, level)).withColumn("e_fit", sigmoid(confounders.linear_of(F.col("_b"))))
    if outcome_model == "logistic":
        # one projection takes each row's scores from the models of its level and fold
        ready = ready.withColumn("_b", _model_of(outcomes, level))
        scored = ready.withColumns({f"mu{a}_fit": sigmoid(full.linear_of(F.col("_b"), F.lit(float(a)))) for a in (1, 0)})
    elif within:
        raise ValueError("Trees are fitted level by level")
    else:
        for f in range(k):
            model, held = fit_trees(for_outcome, full, f"_w{f}", trees, depth, seed), ready.where(F.col("fold") == f)
            held = tree_probability(model, held, full, "mu1_fit", F.lit(1.0))
            parts.append(tree_probability(model, held, full, "mu0_fit", F.lit(0.0)))
        scored = functools.reduce(DataFrame.unionByName, parts)
    stored = cut(scored.drop("_b", *[token_name(c) for c in categorical]))
    check_cross_fit(stored, [*([within] if within else []), *group], ["e_fit", "mu1_fit", "mu0_fit"])
    return stored


def cross_fit_within(df: DataFrame, by: Sequence[str], *args, **more) -> DataFrame:
    """:func:`cross_fit` on the rows of each level of ``by`` alone: folds and models never see other levels.

    ``by`` names a few strata or groups; rows with a null level are left out. Logistic fits of all levels of one column are
    made together if the levels of every categorical begin with the same one, so that the models have the same reference.
    """
    if not by:
        return cross_fit(df, *args, **more)
    given = inspect.signature(cross_fit).bind(df, *args, **more).arguments
    rows = df.where(F.col(by[0]).isNotNull())
    if len(by) == 1 and given.get("outcome_model") == "logistic" and _same_references(rows, by[0], given["categorical"]):
        return cross_fit(rows, *args, **more, within=by[0])
    levels = [r[0] for r in rows.select(by[0]).distinct().collect()]
    parts = [cross_fit_within(df.where(F.col(by[0]) == v), by[1:], *args, **more) for v in sorted(levels)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _same_references(df: DataFrame, by: str, categorical: Sequence[str]) -> bool:
    """Whether the smallest text of every categorical is the same in all levels of ``by`` and no level lacks it altogether."""
    if not categorical:
        return True
    firsts = df.groupBy(by).agg(*[F.min(F.col(c).cast("string")).alias(f"_{i}") for i, c in enumerate(categorical)])
    tests = [(F.count_distinct(f"_{i}") == 1) & (F.count(f"_{i}") == F.count("*")) for i in range(len(categorical))]
    return bool(firsts.agg(functools.reduce(lambda a, b: a & b, tests, F.lit(True)).alias("v")).first()["v"])


def fitted_aipw(scored: DataFrame, design: SurveyDesign, outcome: str, exposure: str, reps: int, seed: int,
                by: Sequence[str] = (), eps: float = 1e-6) -> DataFrame:
    """Doubly robust risks with cluster-bootstrap percentile limits, overall or per level of one column.

    All levels share the same draws of clusters; their number is not limited.
    """
    rows = aipw_scores(scored, outcome, exposure, "e_fit", "mu1_fit", "mu0_fit", eps)
    w, points = F.col(design.weight), aipw(rows, design.weight, by)
    keyed = SurveyDesign(design.weight, (*by, *design.strata), design.psu)
    totals = cluster_totals(rows, design if not by else keyed,
                            {"w": w, "w1": w * F.col("psi1"), "w0": w * F.col("psi0")})
    if not by:
        replicates = psu_bootstrap(totals, design, reps, seed)
        limits = replicates.agg(*_limits())
        return points.select("*", *[limits.select(c).scalar().alias(c) for c in ("rd_low", "rd_high", "rr_low", "rr_high")])
    limits = psu_bootstrap(totals, design, reps, seed, by).groupBy(*by).agg(*_limits())
    return points.join(limits, list(by))


def _limits() -> list[Column]:
    rd = F.try_divide(F.col("w1") - F.col("w0"), F.col("w"))
    rr = F.try_divide(F.col("w1"), F.col("w0"))
    return [F.percentile(v, p).alias(name) for v, p, name in (
        (rd, 0.025, "rd_low"), (rd, 0.975, "rd_high"), (rr, 0.025, "rr_low"), (rr, 0.975, "rr_high"))]


def targeted(df: DataFrame, design: SurveyDesign, outcome: str, exposure: str, e: str, mu1: str, mu0: str, eps: float = 0.01,
             reps: int = 0, seed: int = 0, bound: float = 50.0, tolerance: float = 1e-13, passes: int = 60) -> DataFrame:
    """Doubly robust and targeted risks from the same scores, with percentile limits of both from the same draws of clusters.

    The targeting step fluctuates each arm's prediction until its weighted score is zero. The root of the sample comes
    from bracketed Newton steps (see :func:`_roots`). Score and risks of every replicate are power series about that root, whose
    coefficients are sums over clusters, so replicates touch cluster totals only. Where the remainder of a series is not
    proved negligible (few clusters), the roots of those replicates come from passes over the rows. Returns one row per method.
    """
    score = lambda p: F.ln(clip(p, TINY) / (1 - clip(p, TINY)))
    keys = list(design.cluster)
    rows = df.select(*keys, F.col(design.weight).cast("double").alias("w"), F.col(outcome).cast("double").alias("y"),
                     F.col(exposure).cast("double").alias("a"), clip(e, eps).cast("double").alias("g1"), score(mu1).alias("l1"), score(mu0).alias("l0"))
    if reps:  # the rows of a cluster lie together
        rows = rows.dropna(subset=keys).repartition(*keys).sortWithinPartitions(*keys)
    rows = cut(rows)
    point, s, sums, done = _roots(rows.withColumn("multipliers", F.lit(bytes([1]))), 1, bound, tolerance, passes)
    if not done[0] or not (np.abs(s[:, 0]) < 1e-9).all():
        raise RuntimeError("The targeting step did not converge")
    n, risks = int(sums["rows"]), {m: sums[m] / sums["weight"] for m in ("aipw", "tmle")}
    good = np.ones(1, bool)
    if reps:
        more, proved = _series_risks(rows, design, point[:, 0], reps, seed)
        if not proved.all():
            drawn = rows.join(multiplier_bytes(df.select(*keys).distinct(), design, reps, seed), keys)
            at = [0, *(1 + np.flatnonzero(~proved)).tolist()]
            pick = F.udf(lambda m: bytes(m[i] for i in at), "binary")
            open_rows = cut(drawn.withColumn("multipliers", pick("multipliers")).drop(*keys))
            _, s_open, sums, done = _roots(open_rows, len(at), bound, tolerance, passes)
            settled = done & (np.abs(s_open) < 1e-9).all(axis=0)
            for m in more:
                more[m][:, ~proved] = (sums[m] / sums["weight"])[:, 1:]
            good = np.ones(reps + 1, bool)
            good[at] = settled
        else:
            good = np.ones(reps + 1, bool)
        risks = {m: np.concatenate([risks[m], more[m]], axis=1) for m in risks}
    out = []
    for method in ("aipw", "tmle"):
        r1, r0 = risks[method]
        used = np.isfinite(r1 - r0) if method == "aipw" else good
        draws = {"rd": (r1 - r0)[1:][used[1:]], "rr": (r1 / r0)[1:][used[1:]]}
        limits = [float(x) for v in draws.values() for x in (np.percentile(v, [2.5, 97.5]) if len(v) else (np.nan, np.nan))] if reps else [None] * 4
        extra = [float(x) for x in (*point[:, 0], *s[:, 0])] if method == "tmle" else [None] * 4
        out.append((method, n, float(r1[0]), float(r0[0]), float(r1[0] - r0[0]), float(r1[0] / r0[0]), int(used[1:].sum()), *limits, *extra))
    return df.sparkSession.createDataFrame(
        out, "method string, n long, risk_treated double, risk_control double, risk_difference double, risk_ratio double, replicates int, "
        "rd_low double, rd_high double, rr_low double, rr_high double, epsilon_treated double, epsilon_control double, "
        "score_treated double, score_control double")


def _roots(rows: DataFrame, count: int, bound: float, tolerance: float, passes: int):
    """Fluctuations of both arms for all columns of multipliers: (points, scores there, sums there, which settled).

    Every pass sums score and slope of each column at its own point, the sign narrows its bracket (first ``bound`` to both
    sides), and the next point is Newton's if it lies inside the bracket and the middle otherwise.
    """
    point = np.zeros((2, count))
    low, high, done = np.full((2, count), -bound), np.full((2, count), bound), np.zeros(count, bool)
    for _ in range(passes):
        sums = _targeting_pass(rows, point, count)
        s, slope = sums["score"] / sums["weight"], sums["slope"] / sums["weight"]
        done = (np.abs(s) < tolerance).all(axis=0) | ((high - low) < 1e-15 * bound).all(axis=0) | ~(slope > 0).all(axis=0)
        if done.all():
            break
        low, high = np.where(s > 0, point, low), np.where(s < 0, point, high)
        with np.errstate(divide="ignore", invalid="ignore"):
            new = point + s / slope
        point = np.where(np.abs(s) < tolerance, point, np.where((new > low) & (new < high), new, (low + high) / 2))
    return point, s, sums, done


#: Highest power of the series of the targeting step.
POWERS = 12


def _logistic_series(p: np.ndarray, powers: int) -> list[np.ndarray]:
    """Taylor coefficients 0 to ``powers`` of the logistic function at points where its value is ``p``."""
    a = [p]
    for k in range(powers):
        a.append((a[k] - sum(a[j] * a[k - j] for j in range(k + 1))) / (k + 1))
    return a


def _series_risks(rows: DataFrame, design: SurveyDesign, root: np.ndarray, reps: int, seed: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Risks of both arms and methods per replicate from series about the sample's ``root``, and which replicates are proved.

    ``rows`` lie sorted by cluster, each cluster in one partition. A replicate is proved if the remainders of score and risk
    are below 1e-12 of its weight and the polynomial's root is found.
    """
    keys, k = list(design.cluster), POWERS + 1
    # the coefficient after the last one has its largest size, over all points, on this grid up to 5 percent
    most = 1.05 * float(np.abs(_logistic_series(1 / (1 + np.exp(-np.linspace(-30, 30, 60001))), k)[k]).max())
    width = 1 + 2 * (2 * k + 3)

    def features(part: pd.DataFrame) -> np.ndarray:
        w, y, a, g1 = (part[c].to_numpy() for c in ("w", "y", "a", "g1"))
        out = [w]
        for i, (l, g, arm) in enumerate(((part["l1"].to_numpy(), g1, 1), (part["l0"].to_numpy(), 1 - g1, 0))):
            h, series = (a == arm) / g, _logistic_series(1 / (1 + np.exp(-np.clip(l + root[i] / g, -700, 700))), POWERS)
            q, power = 1 / (1 + np.exp(-l)), [w * g ** -float(j) for j in range(k + 1)]
            out += [w * (q + h * (y - q)), w * h * (y - series[0]), *[-h * power[j] * series[j] for j in range(1, k)],
                    *[power[j] * series[j] for j in range(k)], most * h * power[k], most * power[k]]
        return np.stack(out, axis=1)

    def run(batches):
        held = None  # the last cluster of a batch may go on in the next
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at:at + 4096]
                names, v = part[keys].reset_index(drop=True), features(part)
                starts = np.flatnonzero(np.r_[True, np.any([names[c].to_numpy()[1:] != names[c].to_numpy()[:-1] for c in keys], axis=0)])
                sums, names = np.add.reduceat(v, starts, axis=0), names.iloc[starts].reset_index(drop=True)
                if held is not None:
                    if tuple(held[0].iloc[0]) == tuple(names.iloc[0]):
                        sums[0] += held[1]
                    else:
                        yield held[0].assign(**{f"v{j}": [x] for j, x in enumerate(held[1])})
                held = (names.iloc[-1:].reset_index(drop=True), sums[-1])
                if len(names) > 1:
                    yield pd.concat([names.iloc[:-1], pd.DataFrame(sums[:-1], columns=[f"v{j}" for j in range(width)])], axis=1)
        if held is not None:
            yield held[0].assign(**{f"v{j}": [x] for j, x in enumerate(held[1])})

    kinds, values = dict(rows.dtypes), [f"v{j}" for j in range(width)]
    totals = rows.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + "".join(f", {v} double" for v in values))
    found = psu_bootstrap(totals, design, reps, seed).collect()  # one row per replicate
    table = np.full((reps, width), np.nan)
    for r in found:
        table[r["replicate"] - 1] = [r[v] for v in values]
    weight, proved = table[:, 0], np.isfinite(table).all(axis=1)
    risks = {"aipw": np.empty((2, reps)), "tmle": np.empty((2, reps))}
    horner = lambda c, x: functools.reduce(lambda acc, j: acc * x + c[:, j], range(c.shape[1] - 1, -1, -1), np.zeros(len(c)))
    with np.errstate(all="ignore"):
        for i in range(2):
            at = 1 + i * (2 * k + 3)
            risks["aipw"][i] = table[:, at] / weight
            c, t, left = table[:, at + 1:at + 1 + k], table[:, at + 1 + k:at + 1 + 2 * k], table[:, at + 1 + 2 * k:at + 3 + 2 * k]
            slopes, x = c[:, 1:] * np.arange(1, k), np.zeros(reps)
            for _ in range(60):
                x = x - horner(c, x) / horner(slopes, x)
            risks["tmle"][i] = horner(t, x) / weight
            proved &= (np.abs(horner(c, x)) < 1e-12 * weight) & (left * np.abs(x)[:, None] ** k < 1e-12 * weight[:, None]).all(axis=1)
    return risks, proved


def _targeting_pass(rows: DataFrame, point: np.ndarray, count: int) -> dict[str, np.ndarray]:
    """Sums of both arms (first index: treated) at the given fluctuations, for the sample and every replicate."""
    def run(batches):
        total, seen = np.zeros((9, count)), 0
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at:at + 4096]
                w = part["w"].to_numpy()[:, None] * np.frombuffer(b"".join(part["multipliers"]), np.uint8).reshape(len(part), count)
                y, a, g1 = (part[c].to_numpy() for c in ("y", "a", "g1"))
                total[0] += w.sum(axis=0)
                for i, (l, g, mine) in enumerate(((part["l1"].to_numpy(), g1, a == 1), (part["l0"].to_numpy(), 1 - g1, a == 0))):
                    p = 1 / (1 + np.exp(-np.clip(l[:, None] + point[i] / g[:, None], -700, 700)))
                    q, h = 1 / (1 + np.exp(-l)), mine / g
                    total[1 + i] += (w * h[:, None] * (y[:, None] - p)).sum(axis=0)
                    total[3 + i] += (w * (h / g)[:, None] * p * (1 - p)).sum(axis=0)
                    total[5 + i] += (w * p).sum(axis=0)
                    total[7 + i] += (q + h * (y - q)) @ w
                seen += len(part)
        yield pd.DataFrame([(TaskContext.get().partitionId() % 32, seen, total.tobytes())], columns=["slot", "n", "sums"])

    def add(frame):
        return pd.DataFrame([(int(frame["slot"].iloc[0]), int(frame["n"].sum()), sum(np.frombuffer(x) for x in frame["sums"]).tobytes())],
                            columns=["slot", "n", "sums"])

    schema = "slot int, n long, sums binary"
    found = rows.mapInPandas(run, schema).groupBy("slot").applyInPandas(add, schema).collect()  # at most 32 rows
    cells = sum(np.frombuffer(r["sums"]) for r in found).reshape(9, count)
    return {"rows": sum(r["n"] for r in found), "weight": cells[0], "score": cells[1:3], "slope": cells[3:5], "tmle": cells[5:7], "aipw": cells[7:9]}


@dataclass(frozen=True)
class LogitLearner:
    """Ridge logistic regressions, one per column of weights, all fitted in the same passes."""

    encoding: Encoding
    ridge: float = 1e-5

    def fit(self, cells: DataFrame, weights: Sequence[str]) -> list:
        rows = cells.select(F.lit("all").alias("domain"), *self.encoding.keys, "_y", F.array(*weights).alias("_ws"))
        fits = fit_many(rows, self.encoding, self.ridge, {"all": len(weights)})["all"]
        if set(fits.status) != {"ok"}:
            raise RuntimeError(f"Fits that did not settle: {fits.status}")
        return [LogitModel(self.encoding, beta, self.ridge) for beta in fits.beta]

    def fit_within(self, cells: DataFrame, weights: Sequence[str]) -> dict[str, list]:
        """A model per level of the column ``domain`` and column of weights; no model sees rows of another level."""
        names = sorted(r[0] for r in cells.select("domain").distinct().collect())  # as many as levels
        rows = cells.select("domain", *self.encoding.keys, "_y", F.array(*weights).alias("_ws"))
        fits = fit_many(rows, self.encoding, self.ridge, dict.fromkeys(names, len(weights)))
        bad = {n: f.status for n, f in fits.items() if set(f.status) != {"ok"}}
        if bad:
            raise RuntimeError(f"Fits that did not settle: {bad}")
        return {n: [LogitModel(self.encoding, beta, self.ridge) for beta in f.beta] for n, f in fits.items()}

    def score(self, model, df: DataFrame, out: str, exposure: Column | None = None) -> DataFrame:
        return df.withColumn(out, model.probability(exposure))

    def score_each(self, models: Sequence, df: DataFrame, outs: Sequence[str]) -> DataFrame:
        """A column of scores per model, all in one projection."""
        return df.withColumns({out: model.probability() for out, model in zip(outs, models)})

    def score_held_out(self, models: Sequence, df: DataFrame, out: str, exposure: Column | None = None) -> DataFrame:
        """Scores of all rows in one projection, each from the model of its ``fold``."""
        of_fold = F.get(F.array(*[F.array(*[F.lit(float(b)) for b in m.beta]) for m in models]), F.col("fold"))
        return df.withColumn(out, sigmoid(self.encoding.linear_of(of_fold, exposure)))


@dataclass(frozen=True)
class TreeLearner:
    """Boosted trees, one model per column of weights."""

    encoding: Encoding
    trees: int = 200
    depth: int = 4
    seed: int = 42

    def fit(self, cells: DataFrame, weights: Sequence[str]) -> list:
        return [fit_trees(cells, self.encoding, w, self.trees, self.depth, self.seed) for w in weights]

    def score(self, model, df: DataFrame, out: str, exposure: Column | None = None) -> DataFrame:
        return tree_probability(model, df, self.encoding, out, exposure)

    def score_each(self, models: Sequence, df: DataFrame, outs: Sequence[str]) -> DataFrame:
        for out, model in zip(outs, models):
            df = self.score(model, df, out)
        return df


def _inner_folds(groups: DataFrame, group: Sequence[str], label: str, outer: int, inner: int, seed: int, out: str) -> DataFrame:
    """Per group the inner fold in the training rows of every outer fold, as an array (null at the group's own fold).

    ``groups`` hold the outer fold and the label's mean, one row each.
    """
    classed = groups.select(*group, "fold", F.floor(F.col(label) * 4).cast("int").alias("_class"))
    long = classed.select("*", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))).alias("_outer")).where("_outer <> fold")
    named = long.withColumn("_h", F.sha2(F.concat_ws("|", (F.lit(seed) + F.col("_outer")).cast("string"), *[F.col(g).cast("string") for g in group]), 256))
    ranked = hash_ranks(named, ["_outer", "_class"], "_h")
    fold = F.pmod(F.col("rank") - 1 + F.col("_class"), F.lit(inner)).cast("int")
    return ranked.groupBy(*group).agg(F.array(*[F.max(F.when(F.col("_outer") == f, fold)) for f in range(outer)]).alias(out))


def profile_mix(scored: DataFrame, by: str, grid: int = 100) -> DataFrame:
    """Share of the first of two scores with the least weighted log loss, per level of ``by``; all shares in one aggregate.

    ``scored`` holds ``_h`` (weight), ``_y``, ``_one`` and ``_two``. The smallest share wins ties.
    """
    def loss(i: int) -> Column:
        p = clip(F.col("_one") * (i / grid) + F.col("_two") * (1 - i / grid), TINY)
        return F.sum(F.col("_h") * -(F.col("_y") * F.ln(p) + (1 - F.col("_y")) * F.ln(1 - p))) / F.sum("_h")

    sums = scored.groupBy(by).agg(F.array(*[loss(i) for i in range(grid + 1)]).alias("_losses"))
    best = F.array_min("_losses")
    return sums.select(by, ((F.array_position("_losses", best) - 1) / grid).alias("share"), best.alias("log_loss"),
                       F.element_at("_losses", grid + 1).alias("log_loss_one"), F.element_at("_losses", 1).alias("log_loss_two"))


def _stacked_models(folded: DataFrame, learners: Sequence, label: str, weight: str, inner_of: str, outer: int, inner: int, grid: int,
                    whole: bool = True):
    """Models of both learners per outer fold (none without ``whole``), and the table of shares profiled on inner held-out scores."""
    w, training = F.col(weight), lambda f: F.col("fold") != f
    at = lambda f: F.element_at(inner_of, f + 1)
    tries = [(f, i) for f in range(outer) for i in range(inner)]
    sums = {f"_t{f}_{i}": F.when(training(f) & (at(f) != i), w) for f, i in tries}
    sums |= {f"_h{f}_{i}": F.when(training(f) & (at(f) == i), w) for f, i in tries} | {f"_all{f}": F.when(training(f), w) for f in range(outer)}
    columns = [f"_t{f}_{i}" for f, i in tries] + [f"_all{f}" for f in range(outer) if whole]
    # the first learner's covariates hold those of the second
    cells = cut(covariate_cells(folded, learners[0].encoding, label, sums))
    models = [learner.fit(cells, columns) for learner in learners]
    held = cells
    for name, learner, fitted in zip(("one", "two"), learners, models):
        held = learner.score_each(fitted[:len(tries)], held, [f"_{name}{f}_{i}" for f, i in tries])
    long = held.select("_y", F.inline(F.array(*[
        F.struct(F.lit(f).alias("fold"), F.col(f"_h{f}_{i}").alias("_h"), F.col(f"_one{f}_{i}").alias("_one"), F.col(f"_two{f}_{i}").alias("_two"))
        for f, i in tries]))).where("_h > 0")
    shares = cut(profile_mix(long, "fold", grid))
    return [m[len(tries):] for m in models], shares


def _nested_folds(df: DataFrame, exposure: str, outcome: str, group: Sequence[str], outer: int, inner: int, seed: int) -> DataFrame:
    """Outer folds, and inner ones for the models of both labels, stored.

    Folds are dealt out on a table of groups and meet the rows once, so that ``df`` is read twice. The steps in between are
    stored: ranks read their input twice, and unstored steps would read ``df`` anew for every later one.
    """
    group = list(group)
    mean = lambda label: F.avg(F.col(label).cast("double"))
    groups = cut(df.groupBy(*group).agg(mean(exposure).alias("_mean_e"), mean(outcome).alias("_mean_q")))
    dealt = cut(stratified_group_folds(groups, group, "_mean_e", outer, seed))
    folds = dealt.select(*group, "fold")
    for label, name, shift in (("_mean_e", "_inner_e", 0), ("_mean_q", "_inner_q", 100)):
        folds = folds.join(growing_side(cut(_inner_folds(dealt, group, label, outer, inner, seed + shift, name))), group)
    return cut(df.join(growing_side(folds), group))


def cross_fit_stacked(df: DataFrame, propensity: Sequence, outcomes: Sequence, exposure: str, outcome: str, weight: str, group: Sequence[str],
                      outer: int = 5, inner: int = 3, seed: int = 42, grid: int = 100) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold ``e_fit``, ``mu1_fit`` and ``mu0_fit``, each a mix of two learners.

    The share of each learner is chosen per outer fold on scores held out in grouped inner folds of its training rows
    only; both learners are then fitted to all training rows. Returns (scored rows, shares per fold and model).
    """
    folded = _nested_folds(df, exposure, outcome, group, outer, inner, seed)
    e_models, e_shares = _stacked_models(folded, propensity, exposure, weight, "_inner_e", outer, inner, grid)
    q_models, q_shares = _stacked_models(folded, outcomes, outcome, weight, "_inner_q", outer, inner, grid)
    share = {name: {r["fold"]: r["share"] for r in table.collect()} for name, table in (("e", e_shares), ("q", q_shares))}  # one per fold
    ready = outcomes[0].encoding.prepare(folded.drop("_inner_e", "_inner_q"))
    jobs = (("e_fit", "e", propensity, e_models, None), ("mu1_fit", "q", outcomes, q_models, F.lit(1.0)), ("mu0_fit", "q", outcomes, q_models, F.lit(0.0)))

    def mixed(held: DataFrame, folds: Sequence[int], score) -> DataFrame:
        for out, name, learners, models, arm in jobs:
            for part, learner, fitted in zip(("_one", "_two"), learners, models):
                held = score(learner, fitted, held, part, arm)
            a = F.lit(share[name][folds[0]]) if len(folds) == 1 else F.get(F.array(*[F.lit(share[name][f]) for f in folds]), F.col("fold"))
            held = held.withColumn(out, a * F.col("_one") + (1 - a) * F.col("_two")).drop("_one", "_two")
        return held

    if all(hasattr(learner, "score_held_out") for learner in (*propensity, *outcomes)):
        scored = mixed(ready, range(outer), lambda learner, fitted, held, part, arm: learner.score_held_out(fitted, held, part, arm))
    else:
        parts = [mixed(ready.where(F.col("fold") == f), [f], lambda learner, fitted, held, part, arm: learner.score(fitted[f], held, part, arm))  # noqa: B023
                 for f in range(outer)]
        scored = functools.reduce(DataFrame.unionByName, parts)
    stored = cut(scored.drop(*[token_name(c) for c, _ in outcomes[0].encoding.categorical]))
    check_cross_fit(stored, group, ["e_fit", "mu1_fit", "mu0_fit"])
    return stored, e_shares.withColumn("model", F.lit("propensity")).unionByName(q_shares.withColumn("model", F.lit("outcome")))


def stacked_shares(df: DataFrame, propensity: Sequence, outcomes: Sequence, exposure: str, outcome: str, weight: str, group: Sequence[str],
                   outer: int = 5, inner: int = 3, seed: int = 42, grid: int = 100) -> DataFrame:
    """The shares of :func:`cross_fit_stacked` alone, which take neither models of whole training sets nor scores of rows."""
    folded, tables = _nested_folds(df, exposure, outcome, group, outer, inner, seed), []
    for learners, label, of, model in ((propensity, exposure, "_inner_e", "propensity"), (outcomes, outcome, "_inner_q", "outcome")):
        tables.append(_stacked_models(folded, learners, label, weight, of, outer, inner, grid, whole=False)[1].withColumn("model", F.lit(model)))
    return tables[0].unionByName(tables[1])


def context_split_aipw(scored: DataFrame, design: SurveyDesign, outcome: str, exposure: str, unit: str, measure: str, reps: int = 0,
                       seed: int = 0, trim: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Doubly robust contrast in units above and below the median of a unit-level measure.

    Returns (estimates of both groups with the high-minus-low difference, the
    difference recomputed without each unit). Both come from one table of unit sums. The
    median unit counts as high; a unit without a measure belongs to neither group. Rows with a propensity outside
    ``trim`` to 1 - ``trim`` are left out. With ``reps``, percentile limits of both groups and of their
    difference come from the same draws of clusters.
    """
    inside = scored.where(F.col("e_fit").between(trim, 1 - trim)) if trim else scored
    rows = aipw_scores(inside, outcome, exposure, "e_fit", "mu1_fit", "mu0_fit")
    w = F.col(design.weight)
    units = rows.groupBy(unit).agg(F.max(measure).alias("_m"), F.count("*").alias("n"), F.sum(w).alias("_w"),
                                   F.sum(w * F.col("psi1")).alias("_w1"), F.sum(w * F.col("psi0")).alias("_w0"))
    units = cut(units.where(F.col("_m").isNotNull()))
    middle = exact_quantiles(units, [], "_m", {"v": 0.5}).scalar()
    split = units.withColumn("high", F.col("_m") >= middle)
    both = split.groupBy("high").agg(F.count("*").alias("units"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("_w", "_w1", "_w0")])
    rd = (F.col("_w1") - F.col("_w0")) / F.col("_w")
    value = lambda side: both.where(F.col("high") == side).select(rd.alias("v")).scalar()
    estimates = both.select("high", "units", "n", rd.alias("risk_difference"), (value(True) - value(False)).alias("high_minus_low"))
    if reps:
        marked = rows.join(broadcast_if_small(split.select(unit, "high")), unit)
        draws = cut(paired_bootstrap_difference(marked, design, F.col("high"), ~F.col("high"), F.col("psi1") - F.col("psi0"), reps, seed))
        limit = lambda c, p: draws.agg(F.percentile(c, p).alias("v")).scalar()
        ends = (("low", 0.025), ("high", 0.975))
        estimates = estimates.select("*", *[F.when(F.col("high"), limit("first", p)).otherwise(limit("second", p)).alias(f"rd_{e}") for e, p in ends],
                                     *[limit("difference", p).alias(f"difference_{e}") for e, p in ends])
    totals = both.select("high", *[F.col(c).alias(f"{c}_all") for c in ("_w", "_w1", "_w0")])
    left = lambda c: F.col(f"{c}_all") - F.col(c)
    other = F.when(F.col("high"), value(False)).otherwise(value(True))
    own = F.try_divide(left("_w1") - left("_w0"), left("_w"))
    without = split.join(totals, "high").select(
        unit, "high", F.when(F.col("high"), own - other).otherwise(other - own).alias("high_minus_low"))
    return estimates, without


def effects_by_group(scored: DataFrame, design: SurveyDesign, outcome: str, exposure: str, groups: Mapping[str, Column], predicted: Column,
                     reps: int, seed: int) -> DataFrame:
    """Doubly robust risks, difference and ratio with limits, and the mean prediction, per level of every grouping."""
    levels = F.array(*[F.struct(F.lit(k).alias("group"), v.cast("string").alias("level")) for k, v in groups.items()])
    long = scored.withColumn("_predicted", predicted).select("*", F.inline(levels)).where("level is not null")
    means = long.groupBy("group", "level").agg(
        (F.sum(F.col(design.weight) * F.col("_predicted")) / F.sum(design.weight)).alias("mean_predicted_effect"))
    return fitted_aipw(long, design, outcome, exposure, reps, seed, ["group", "level"]).join(means, ["group", "level"])


def cate_forest(scored: DataFrame, moderators: Encoding, design: SurveyDesign, outcome: str, exposure: str, split: str,
                bins: int, trees: int = 20, depth: int = 4, seed: int = 42):
    """Regress the doubly robust row effect on moderators in development rows, bin and re-estimate on test rows.

    Returns (fitted forest, scored rows, estimate per bin of the test rows).
    """
    rows = moderators.prepare(aipw_scores(scored, outcome, exposure, "e_fit", "mu1_fit", "mu0_fit").withColumn(
        "tau", F.col("psi1") - F.col("psi0")))
    ready = rows.withColumn("features", _features(moderators))
    forest = RandomForestRegressor(labelCol="tau", weightCol=design.weight, numTrees=trees, maxDepth=depth, seed=seed,
                                   predictionCol="tau_hat").fit(ready.where(~F.col(split)))
    predicted = cut(forest.transform(ready).drop("features"))
    binned = quantile_bins(predicted, "tau_hat", ~F.col(split), bins)
    return forest, binned, aipw(binned.where(split), design.weight, ["bin"])


def permutation_importance(forest, rows: DataFrame, moderators: Encoding, variables: Sequence[str], key: Sequence[str],
                           weight: str, repeats: int, seed: int) -> DataFrame:
    """Drop of weighted R2 when one original variable is shuffled across rows.

    Rows are put in hash order once. A repeat hands the values of a variable on by an offset of its own in that order, a
    shuffle in which no row keeps its value's place; all variables and repeats travel together, are scored
    together and are summed in one aggregate.
    """
    tokens = {token_name(c) for c, _ in moderators.categorical}
    inputs = [c for c in dict.fromkeys([*[c for c, _ in (*moderators.numeric, *moderators.plain)], *[c for c, _ in moderators.categorical]])]
    base = rows.select(*key, *[c for c in inputs if c not in key], "tau", weight)
    placed = cut(hash_ranks(base.withColumn("_h", digest(f"{seed}|place", *key)), [], "_h", "_at", "_n").drop("_h"))
    kinds, turns = dict(base.dtypes), []
    for i, variable in enumerate(variables):
        for r in range(repeats):
            share = int(hashlib.sha256(f"{seed}|{variable}|{r}".encode()).hexdigest()[:8], 16) / 2.0**32
            offset = 1 + F.floor(F.lit(share) * F.greatest(F.col("_n") - 1, F.lit(1)))
            turns.append(F.struct(F.lit(i).alias("_variable"), F.lit(r).alias("_repeat"), (F.pmod(F.col("_at") - 1 + offset, "_n") + 1).alias("_at"),
                                  F.col(variable).cast("string").alias("_value")))
    moved = placed.select(F.inline(F.array(*turns)))
    swapped = placed.join(moved, "_at").withColumns({
        v: F.when(F.col("_variable") == i, F.col("_value").cast(kinds[v])).otherwise(F.col(v)) for i, v in enumerate(variables)}).drop("_value")
    both = placed.withColumns({"_variable": F.lit(-1), "_repeat": F.lit(0)}).unionByName(swapped)
    scored = forest.transform(moderators.prepare(both).withColumn("features", _features(moderators))).drop(*tokens)
    w, t, p = F.col(weight), F.col("tau"), F.col("tau_hat")
    r2 = 1 - F.sum(w * (t - p) ** 2) / (F.sum(w * t * t) - F.sum(w * t) * F.sum(w * t) / F.sum(w))
    fits = cut(scored.groupBy("_variable", "_repeat").agg(r2.alias("r2")))
    reference = fits.where("_variable = -1").select("r2").scalar()
    names = F.array(*[F.lit(v) for v in variables])
    return fits.where("_variable >= 0").groupBy(names[F.col("_variable")].alias("variable")).agg(
        F.avg(reference - F.col("r2")).alias("importance_mean"), F.stddev_samp(reference - F.col("r2")).alias("importance_sd"))


def propensity_range(scored: DataFrame, exposure: str) -> DataFrame:
    """Minimum, median and maximum fitted propensity per arm."""
    return exact_quantiles(scored, [exposure], "e_fit", {"minimum": 0.0, "median": 0.5, "maximum": 1.0})


def calibrate(oof: DataFrame, test: DataFrame, y: str, p: str, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sigmoid and isotonic calibration learned out of fold; the one with the lower Brier score is applied to test rows.

    Returns (test rows with ``calibrated``, table of both out-of-fold Brier scores).
    Scores are pooled to distinct values with summed weights before fitting.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    cells = cut(oof.groupBy(F.col(p).cast("double").alias("score"), F.col(y).cast("double").alias("label")).agg(F.sum(w).alias("w")))
    vector = lambda df, c: df.withColumn("features", array_to_vector(F.array(F.col(c).cast("double"))))
    sigmoid_model = LogisticRegression(weightCol="w", standardization=False, tol=1e-10).fit(vector(cells, "score"))
    slope, intercept = float(sigmoid_model.coefficients[0]), float(sigmoid_model.intercept)
    isotonic = IsotonicRegression(weightCol="w", predictionCol="calibrated").fit(vector(cells, "score"))
    logistic = lambda c: sigmoid(F.lit(intercept) + slope * F.col(c))
    error = lambda v: (F.sum(F.col("w") * (v - F.col("label")) ** 2) / F.sum("w"))
    scores = isotonic.transform(vector(cells, "score")).agg(error(logistic("score")).alias("sigmoid"),
                                                            error(F.col("calibrated")).alias("isotonic")).first()
    chosen = "isotonic" if scores["isotonic"] <= scores["sigmoid"] else "sigmoid"
    if chosen == "isotonic":
        out = isotonic.transform(vector(test, p)).drop("features")
    else:
        out = test.withColumn("calibrated", logistic(p))
    table = oof.sparkSession.createDataFrame(
        [(m, float(scores[m]), m == chosen) for m in ("sigmoid", "isotonic")], "method string, oof_brier double, chosen boolean")
    return out, table


def sampled_settings(model: str, choices: Mapping[str, Sequence], count: int, seed: int) -> list[dict]:
    """``count`` different settings out of all combinations of ``choices`` (all, if fewer), in hash order."""
    every = [dict(zip(choices, values)) for values in itertools.product(*choices.values())]
    drawn = sorted(every, key=lambda x: hashlib.sha256(f"{seed}|{model}|{sorted(x.items())}".encode()).hexdigest())[:count]
    return [{"model": model, **x} for x in drawn]


def grouped_search(df: DataFrame, encoding: Encoding, outcome: str, weight: str, group: Sequence[str], k: int, seed: int,
                   settings: Sequence[Mapping]) -> DataFrame:
    """Grid search with group-disjoint folds over logistic, forest and boosted models.

    A setting names its ``model`` (``logistic`` with ``ridge``; ``forest`` with ``trees`` and ``depth``; ``boosted`` with ``trees``,
    ``depth`` and ``step``). Models are fitted to covariate cells; the held-out scores of all settings and folds are one
    long table, from which the exact average precision and ROC-AUC of all follow at once. Best mean average precision is selected,
    the first setting on ties.
    """
    folded, w = cut(stratified_group_folds(df, group, outcome, k, seed)), F.col(weight)
    cells = cut(covariate_cells(folded, encoding, outcome, {f"_w{f}": F.when(F.col("fold") != f, w) for f in range(k)}
                                | {f"_h{f}": F.when(F.col("fold") == f, w) for f in range(k)}))
    ready = cells.select("*", _features(encoding).alias("features"), F.col("_y").alias("label"))
    parts = []
    for i, setting in enumerate(settings):
        if setting["model"] == "logistic":
            learner = LogitLearner(encoding, setting["ridge"])
            scores = [learner.score(m, cells, "_p") for m in learner.fit(cells, [f"_w{f}" for f in range(k)])]
        else:
            scores = []
            for f in range(k):
                if setting["model"] == "forest":
                    model = RandomForestClassifier(weightCol=f"_w{f}", numTrees=setting["trees"], maxDepth=setting["depth"], seed=seed)
                else:
                    model = GBTClassifier(weightCol=f"_w{f}", maxIter=setting["trees"], maxDepth=setting["depth"], stepSize=setting["step"], seed=seed)
                fitted = model.fit(ready.where(F.col(f"_w{f}") > 0).select("features", "label", f"_w{f}"))
                scores.append(fitted.transform(ready).withColumn("_p", vector_to_array("probability")[1]))
        parts += [scores[f].where(F.col(f"_h{f}") > 0).select(F.lit(i).alias("setting"), F.lit(f).alias("fold"), "_y", "_p", F.col(f"_h{f}").alias("_h"))
                  for f in range(k)]
    table = search_table(cut(functools.reduce(DataFrame.unionByName, parts)))
    described = F.array(*[F.lit(", ".join(f"{k}={v}" for k, v in s.items())) for s in settings])
    return table.withColumn("settings", described[F.col("setting")])


def search_table(scores: DataFrame) -> DataFrame:
    """Mean and SD over folds of both ranking metrics per setting of ``(setting, fold, _y, _p, _h)``, and which setting is selected."""
    each = ranking_metrics(scores, "_y", "_p", "_h", ["setting", "fold"])
    table = each.groupBy("setting").agg(
        F.count("*").alias("folds"), *[f(c).alias(f"{n}_{c}") for c in ("average_precision", "roc_auc") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    best = table.agg(F.max_by("setting", F.struct("mean_average_precision", -F.col("setting"))).alias("v")).scalar()
    return table.withColumn("selected", F.col("setting") == best)


def fit_authorized(df: DataFrame, encoding: Encoding, outcome: str, partition: str, weight: str | None = None,
                   ridge: float = 1e-5, balance: bool = False):
    """Fit on rows that must all be training rows with valid labels and weights.

    ``balance`` multiplies the weight of positives by negatives over positives.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    checks = df.agg(F.count_if(~F.coalesce(F.col(partition) == "train", F.lit(False))).alias("outside"),
                    F.count_if(~F.coalesce(F.col(outcome).isin(0, 1), F.lit(False))).alias("labels"),
                    F.count_if(~F.coalesce((w > 0) & ~F.isnan(w), F.lit(False))).alias("weights"),
                    F.count_if(F.col(outcome) == 0).alias("n0"), F.count_if(F.col(outcome) == 1).alias("n1")).first()
    if checks["outside"]:
        raise ValueError("Only training rows are authorised for fitting")
    if checks["labels"] or checks["weights"]:
        raise ValueError(f"Invalid labels or weights: {checks.asDict()}")
    if not checks["n0"] or not checks["n1"]:
        raise ValueError("Training data must have both outcome classes")
    ratio = checks["n0"] / checks["n1"] if balance else 1.0
    sums = {"_w": w * F.when(F.col(outcome) == 1, ratio).otherwise(1.0)}
    return fit_cells(covariate_cells(df, encoding, outcome, sums), encoding, ridge)


def fit_multinomial(df: DataFrame, encoding: Encoding, level: str, weight: str, ridge: float):
    """Ridge multinomial logit on covariate cells. Returns (levels, coefficient rows) for ``multinomial_scores``."""
    cells = covariate_cells(df.where(F.col(level).isNotNull()), encoding, level, {"_w": F.col(weight)}).where("_w > 0")
    levels = sorted(r[0] for r in cells.select("_y").distinct().collect())  # as many as the model has classes
    index = F.create_map(*[F.lit(x) for i, v in enumerate(levels) for x in (v, float(i))])
    rows = cells.select(_features(encoding).alias("features"), index[F.col("_y")].alias("label"), F.col("_w").alias("w"))
    model = LogisticRegression(family="multinomial", weightCol="w", regParam=ridge, elasticNetParam=0.0, standardization=False,
                               tol=1e-8, maxIter=200).fit(rows)
    weights, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    return levels, [[float(b), *map(float, c)] for b, c in zip(intercepts, weights)]


def multinomial_scores(df: DataFrame, encoding: Encoding, coefficients: Sequence[Sequence[float]], prefix: str = "p") -> DataFrame:
    """Add one probability column per level.

    Scores, their maximum and their exponentials are columns of their own so that no
    expression repeats another.
    """
    k = range(len(coefficients))
    out = encoding.prepare(df).withColumns({f"_s{i}": encoding.linear(c) for i, c in enumerate(coefficients)})
    out = out.withColumn("_top", F.greatest(*[F.col(f"_s{i}") for i in k]))
    out = out.withColumns({f"_e{i}": F.exp(F.col(f"_s{i}") - F.col("_top")) for i in k})
    out = out.withColumn("_sum", sum((F.col(f"_e{i}") for i in k), F.lit(0.0)))
    return out.withColumns({f"{prefix}{i}": F.col(f"_e{i}") / F.col("_sum") for i in k}).drop(
        "_top", "_sum", *[f"_s{i}" for i in k], *[f"_e{i}" for i in k])
