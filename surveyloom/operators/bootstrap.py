"""Cluster bootstrap on pre-aggregated cluster totals with hash-derived draws.

Rows are summed to cluster totals once; replicates only touch those. Every draw is a
function of seed, replicate and cluster, so results repeat on any cluster size. Draws are
made in packed blocks and counted where the clusters lie, so no row ever stands for a draw.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.design import SurveyDesign
from surveyloom.functions.hashing import digest, uniform
from surveyloom.operators.scale import cut, growing_side, hash_ranks

PERCENTILES = {"ci_low": 0.025, "ci_high": 0.975}
#: Clusters of a stratum whose draws are counted together.
STRETCH = 2048
OUTSIDE = "A cluster of the rows is not in the roster"


def cluster_totals(df: DataFrame, design: SurveyDesign, sums: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*design.cluster).agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in sums.items()])


def cluster_slots(clusters: DataFrame, design: SurveyDesign) -> DataFrame:
    """Number the clusters of every stratum (hash order) and add the stratum's cluster count."""
    hashed = clusters.withColumn("_h", digest("slot", *design.cluster))
    return hash_ranks(hashed, design.strata, "_h", "slot", "stratum_psus").drop("_h")


def _placed(slots: DataFrame, design: SurveyDesign, homes: int) -> DataFrame:
    """Add ``_stretch`` (the stratum and a stretch of at most ``STRETCH`` of its slots), its first slot and length, and ``_home``, the group that counts it.

    Long strata are spread over many homes; small ones share ``homes`` of them.
    """
    n, part = F.col("stratum_psus"), F.floor((F.col("slot") - 1) / STRETCH)
    name = lambda c: F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))
    home = F.when(n > STRETCH, homes + F.pmod(F.xxhash64(*design.strata, part), F.lit(1 << 40))).otherwise(
        F.pmod(F.xxhash64(*design.strata), F.lit(homes)))
    return slots.select("*", F.concat_ws("|", *[name(c) for c in design.strata], part.cast("string")).alias("_stretch"),
                        (part * STRETCH).cast("long").alias("_first"), F.least(F.lit(STRETCH), n - part * STRETCH).cast("int").alias("_length"),
                        home.cast("long").alias("_home"))


def _packed_draws(slots: DataFrame, design: SurveyDesign, reps: int, seed: int, size: Column, homes: int) -> DataFrame:
    """Each slot up to ``size`` draws one slot of its stratum in every replicate; draws of a stretch travel packed.

    A row holds the draws that some slots of a stratum make of one stretch: their replicates and the places in the stretch,
    two bytes each. Strata of one cluster make no draws, since the result is known.
    """
    if reps >= 1 << 16:
        raise ValueError("At most 65,535 replicates")
    tasks = 4 * slots.sparkSession.sparkContext.defaultParallelism
    text = F.concat(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*design.strata, "slot")]), F.lit("|"))
    some = F.floor((F.col("slot") - 1) / 1024)
    kinds = dict(slots.dtypes)
    drawing = slots.where((F.col("stratum_psus") > 1) & (F.col("slot") <= size)).repartition(tasks, *design.strata, some).select(
        *design.strata, "stratum_psus", text.alias("_text"))
    ends = [str(r).encode() for r in range(1, reps + 1)]

    def digest_after(state, end: bytes) -> bytes:
        state = state.copy()
        state.update(end)
        return state.digest()

    def run(batches):
        for batch in batches:
            for keys, rows in batch.groupby(list(design.strata), sort=False):
                n = int(rows["stratum_psus"].iloc[0])
                for at in range(0, len(rows), 4096):
                    texts = [t.encode() for t in rows["_text"].iloc[at:at + 4096]]
                    heads = np.empty((reps, len(texts)), np.uint32)  # replicate by replicate, so that places sort by replicate
                    for i, t in enumerate(texts):
                        state = hashlib.sha256(t)  # the same for all replicates
                        heads[:, i] = np.frombuffer(b"".join([digest_after(state, e) for e in ends]), ">u4")[::8]
                    slot = np.floor(heads.ravel() / 4294967296.0 * n).astype(np.int64)
                    part, place = slot // STRETCH, (slot % STRETCH).astype(np.uint16)
                    order = np.argsort(part.astype(np.uint16) if n < STRETCH << 16 else part, kind="stable")
                    parts, starts = np.unique(part[order], return_index=True)
                    replicate, place = (order // len(texts)).astype(np.uint16), place[order]
                    ends_at = [*starts[1:].tolist(), len(order)]
                    yield pd.DataFrame([(*keys, n, p * STRETCH + 1, replicate[s:e].tobytes(), place[s:e].tobytes())
                                        for p, s, e in zip(parts.tolist(), starts.tolist(), ends_at)],
                                       columns=[*design.strata, "stratum_psus", "slot", "_replicates", "_places"])

    packed = drawing.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in design.strata)
                                 + ", stratum_psus long, slot long, _replicates binary, _places binary")
    return _placed(packed, design, homes).select("_home", "_stretch", "_replicates", "_places")


def with_times_drawn(clusters: DataFrame, design: SurveyDesign, reps: int, seed: int, run, schema: str, rescaled: bool = False,
                     roster: DataFrame | None = None) -> DataFrame:
    """Rows of ``run(rows, times)``, where ``times`` holds how often each replicate draws the cluster of each row.

    As many clusters as the stratum has (one less, if ``rescaled``) are drawn with replacement in each stratum. ``clusters`` may
    repeat a cluster (a row per level). Draws meet the clusters they fall on in groups of about ``STRETCH`` clusters, whatever the
    size of a stratum. A stratum's only cluster is drawn once in each replicate. ``rows`` also hold ``stratum_psus``.
    With ``roster``, its clusters are drawn, whether they have rows or not; a row of another cluster fails.
    """
    whole = roster is None
    slots = cut(cluster_slots((clusters if whole else roster).select(*design.cluster).distinct(), design))
    n = F.col("stratum_psus")
    homes = 1 + slots.where(n <= STRETCH).count() // STRETCH
    packed = _packed_draws(slots, design, reps, seed, n - 1 if rescaled else n, homes)
    named = slots.withColumnsRenamed({c: f"_of_{c}" for c in design.cluster})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in design.cluster]
    if whole:
        met = clusters.join(growing_side(named), same)
    else:
        met = clusters.join(growing_side(named), same, "left").withColumn(
            "slot", F.coalesce("slot", F.raise_error(F.lit(OUTSIDE)).cast("long")))
    owners = _placed(met.drop(*[f"_of_{c}" for c in design.cluster]), design, homes)

    def count(rows: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            if whole:
                raise ValueError("Draws without clusters")
            return pd.DataFrame()
        stretches = rows.drop_duplicates("_stretch")
        lengths = stretches["_length"].to_numpy(np.int64)
        starts = dict(zip(stretches["_stretch"], (np.cumsum(lengths) - lengths).tolist()))
        times = np.zeros(int(lengths.sum()) * reps, np.int32)
        for stretch, some in draws.groupby("_stretch", sort=False):
            if stretch not in starts:  # none of its clusters has rows
                continue
            code = np.frombuffer(b"".join(some["_places"]), np.uint16) * np.int64(reps) + np.frombuffer(b"".join(some["_replicates"]), np.uint16)
            found = np.bincount(code).astype(np.int32)
            times[starts[stretch] * reps:][:len(found)] += found
        at = rows["_stretch"].map(starts).to_numpy(np.int64) + rows["slot"].to_numpy(np.int64) - 1 - rows["_first"].to_numpy(np.int64)
        own = times.reshape(-1, reps)[at]
        own[rows["stratum_psus"].to_numpy() == 1] = 1
        return run(rows, own)

    return owners.groupBy("_home").cogroup(packed.groupBy("_home")).applyInPandas(count, schema)


def _schema(df: DataFrame, columns: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in columns)


def psu_bootstrap(totals: DataFrame, design: SurveyDesign, reps: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Replicate sums, stored: as many clusters as the stratum has are drawn with replacement in each stratum.

    With ``by``, totals hold a row per cluster and level; the draws of clusters serve all levels.
    """
    values = [c for c in totals.columns if c not in (*design.cluster, *by)]
    stored = cut(totals.select(*by, *design.cluster, *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values]))

    def run(rows: pd.DataFrame, times: np.ndarray) -> pd.DataFrame:
        out = []
        levels = rows.groupby(list(by), sort=False, dropna=False).indices if by else {(): np.arange(len(rows))}
        for at in levels.values():
            v, own = rows[values].to_numpy(float)[at], times[at]
            finite = np.isfinite(v).all(axis=1)
            sums = own[finite].T.astype(float) @ v[finite]
            for i in np.flatnonzero(~finite):  # counts only where it is drawn
                sums[own[i] > 0] += own[i][own[i] > 0][:, None] * v[i]
            part = pd.DataFrame(sums, columns=values)
            part.insert(0, "replicate", np.arange(1, reps + 1, dtype=np.int32))
            for c in reversed(by):
                part.insert(0, c, [rows[c].iloc[at[0]]] * reps)
            # a level counts in the replicates that draw one of its clusters
            out.append(part[(own > 0).any(axis=0)])
        return pd.concat(out)

    sums = with_times_drawn(stored, design, reps, seed, run, _schema(stored, by) + "replicate int" + "".join(f", `{v}` double" for v in values))
    # a sum that is not a number leaves pandas as a null
    return cut(sums.groupBy(*by, "replicate").agg(*[F.sum(F.coalesce(v, F.lit(float("nan")))).alias(v) for v in values]))


def percentile_intervals(replicates: DataFrame, statistics: Mapping[str, Column],
                         limits: Mapping[str, float] = PERCENTILES) -> DataFrame:
    """Percentile limits of statistics of the replicate sums; one row per statistic.

    There are only as many rows as replicates, so the built-in exact percentile is used.
    """
    rows = F.array(*[F.struct(F.lit(k).alias("statistic"), v.alias("value")) for k, v in statistics.items()])
    return replicates.select(F.inline(rows)).groupBy("statistic").agg(
        F.count("value").alias("replicates"), F.avg("value").alias("mean"),
        *[F.percentile("value", p).alias(name) for name, p in limits.items()])


def ratio_sums(group: Mapping[str, Column], numerator: Column, denominator: Column) -> dict[str, Column]:
    """Numerator and denominator sums restricted to named groups."""
    out = {}
    for name, test in group.items():
        out[f"num_{name}"] = F.when(test, numerator)
        out[f"den_{name}"] = F.when(test, denominator)
    return out


def paired_bootstrap_difference(df: DataFrame, design: SurveyDesign, first: Column, second: Column, value: Column,
                                reps: int, seed: int) -> DataFrame:
    """Weighted means of two groups and their difference, both from the same draw of clusters."""
    w = F.col(design.weight)
    sums = ratio_sums({"first": first, "second": second}, w * value, w)
    replicates = psu_bootstrap(cluster_totals(df, design, sums), design, reps, seed)
    mean = lambda g: F.try_divide(F.col(f"num_{g}"), F.col(f"den_{g}"))
    return replicates.select("replicate", mean("first").alias("first"), mean("second").alias("second"),
                             (mean("first") - mean("second")).alias("difference"))


def wave_change_bootstrap(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Change of a risk difference and ratio of risk ratios by replicate; inputs hold ``rd`` and ``rr``."""
    a = later.select("replicate", F.col("rd").alias("_rd1"), F.col("rr").alias("_rr1"))
    b = earlier.select("replicate", F.col("rd").alias("_rd0"), F.col("rr").alias("_rr0"))
    return a.join(b, "replicate").select("replicate", (F.col("_rd1") - F.col("_rd0")).alias("rd_change"),
                                         F.try_divide(F.col("_rr1"), F.col("_rr0")).alias("rr_ratio"))


def _factors(rows: pd.DataFrame, times: np.ndarray, rescaled: bool) -> np.ndarray:
    n = rows["stratum_psus"].to_numpy(float)[:, None]
    return np.where(n == 1, 1.0, times * n / np.maximum(n - 1, 1)) if rescaled else times.astype(float)


def psu_factors(clusters: DataFrame, design: SurveyDesign, reps: int, seed: int, rescaled: bool) -> DataFrame:
    """Weight factor of every cluster in every replicate.

    Plain: number of times drawn among n draws. Rescaled: n-1 draws times n/(n-1), and
    1 in strata with a single cluster.
    """
    own = clusters.select(*design.cluster).distinct()

    def run(rows: pd.DataFrame, times: np.ndarray) -> pd.DataFrame:
        return rows[list(design.cluster)].assign(factors=list(_factors(rows, times, rescaled)))

    drawn = with_times_drawn(own, design, reps, seed, run, _schema(own, design.cluster) + "factors array<double>", rescaled)
    return drawn.select(*design.cluster, F.posexplode("factors").alias("_at", "factor")).select(
        (F.col("_at") + 1).alias("replicate"), *design.cluster, "factor")


def psu_factor_summary(clusters: DataFrame, design: SurveyDesign, reps: int, seed: int, rescaled: bool) -> DataFrame:
    """Sum and largest of each cluster's factors (see :func:`psu_factors`), and the number of replicates that never draw it."""
    own = clusters.select(*design.cluster).distinct()

    def run(rows: pd.DataFrame, times: np.ndarray) -> pd.DataFrame:
        factors = _factors(rows, times, rescaled)
        return rows[list(design.cluster)].assign(total=factors.sum(axis=1), largest=factors.max(axis=1), never=(factors == 0).sum(axis=1))

    return with_times_drawn(own, design, reps, seed, run, _schema(own, design.cluster) + "total double, largest double, never long", rescaled)


def bayesian_psu_weights(clusters: DataFrame, design: SurveyDesign, seed: int) -> DataFrame:
    """Exponential cluster weights with mean one inside every stratum."""
    draws = clusters.select(*design.cluster).distinct().withColumn("_e", -F.log1p(-uniform(seed, *design.cluster)))
    means = draws.groupBy(*design.strata).agg(F.avg("_e").alias("_m"))
    return draws.join(means, list(design.strata)).select(
        *design.cluster, F.when(F.col("_m") > 0, F.col("_e") / F.col("_m")).otherwise(F.lit(1.0)).alias("factor"))


def bootstrap_status(replicates: DataFrame, statistic: str, attempted: int, minimum: int = 200,
                     share: float = 0.95) -> DataFrame:
    """Percentile interval only when enough replicates succeeded (finite value)."""
    value = F.col(statistic)
    good = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)
    needed = max(minimum, -int(-(attempted * share) // 1))
    summary = replicates.agg(F.count(good).alias("successful"), F.percentile(good, 0.025).alias("_lo"),
                             F.percentile(good, 0.975).alias("_hi"))
    enough = F.col("successful") >= needed
    return summary.select("successful", F.lit(attempted).alias("attempted"), F.lit(needed).alias("needed"),
                          F.when(enough, "interval").otherwise("point_only_too_few_replicates").alias("status"),
                          F.when(enough, F.col("_lo")).alias("ci_low"), F.when(enough, F.col("_hi")).alias("ci_high"))


def replicates_reproduce(replicates: DataFrame, statistic: str, stored: DataFrame, tolerance: float) -> DataFrame:
    """Check a stored interval against its replicates: ids 1..n once each, all finite, same limits."""
    value = F.col(statistic)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    summary = replicates.agg(
        F.count("*").alias("n"), F.count_distinct("replicate").alias("_ids"), F.min("replicate").alias("_first"),
        F.max("replicate").alias("_last"), F.count_if(finite).alias("_finite"),
        F.percentile(statistic, 0.025).alias("_lo"), F.percentile(statistic, 0.975).alias("_hi"))
    low, high = stored.select("ci_low").scalar(), stored.select("ci_high").scalar()
    return summary.select(
        "n", ((F.col("_ids") == F.col("n")) & (F.col("_first") == 1) & (F.col("_last") == F.col("n"))).alias("consecutive"),
        (F.col("_finite") == F.col("n")).alias("all_finite"),
        F.coalesce((F.abs(F.col("_lo") - low) <= tolerance) & (F.abs(F.col("_hi") - high) <= tolerance),
                   F.lit(False)).alias("limits_match"))
