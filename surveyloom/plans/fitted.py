"""Queries with fitted nuisance, imputation and prediction models over the survey view."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import recode as R
from surveyloom.operators import encoding as E
from surveyloom.operators import impute as I
from surveyloom.operators import nuisance as N
from surveyloom.operators import profile as P
from surveyloom.operators import standardize as S
from surveyloom.operators.joins import broadcast_group_value
from surveyloom.operators.ranking import holm, latest_per_key
from surveyloom.operators.scale import cut, exact_quantiles
from surveyloom.operators.bootstrap import bayesian_psu_weights
from surveyloom.functions.special import t_p_value
from surveyloom.plans.bootstraps import draws_sql, slots_sql
from surveyloom.plans.models import NUMERIC, RIDGE, encoding_of
from surveyloom.plans.ranking import partitioned
from surveyloom.plans.registry import query
from surveyloom.plans.tables import CATEGORICAL, DESIGN, cohort, roster, with_views

FOLDS, REPS, SEED = 5, 500, 42


def scored(rows, model="logistic", by=(), **more):
    return N.cross_fit_within(rows, by, NUMERIC, CATEGORICAL, "sector", "outcome", "weight", ["mother_id"], FOLDS, SEED, model, **more)


@query("cross_fit")
def i1(spark, sf_dir):
    rows = scored(cohort(spark, sf_dir), "trees")
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.avg("e_fit").alias("mean_propensity"),
                                    F.avg("mu1_fit").alias("mean_treated"), F.avg("mu0_fit").alias("mean_control"))


@query("fitted_aipw")
def i1_aipw(spark, sf_dir):
    return N.fitted_aipw(scored(cohort(spark, sf_dir)), DESIGN, "outcome", "sector", REPS, SEED)


def targeted_sql(before: str = "", source: str = "cohort", e: str = "e_hat", mu1: str = "mu1_hat", mu0: str = "mu0_hat", extra: str = "",
                 steps: int = 12) -> str:
    """Both estimators and their limits; the root of every replicate by Newton steps, one CTE each."""
    p = lambda arm: f"(1 / (1 + exp(-(l{arm} + x{arm} / g{arm}))))"
    step = lambda arm: (f"max(x{arm}) + sum(case when a = {arm} then w / g{arm} * (y - {p(arm)}) else 0 end)"  # noqa: E731
                        f" / sum(case when a = {arm} then w / (g{arm} * g{arm}) * {p(arm)} * (1 - {p(arm)}) else 0 end) as x{arm}")
    newton = "".join(f", n{k} as materialized (select replicate, {step(1)}, {step(0)} from b join n{k - 1} using (replicate) group by replicate)"
                     for k in range(1, steps + 1))
    score = lambda arm: f"sum(case when a = {arm} then w / g{arm} * (y - {p(arm)}) else 0 end) / sum(w)"
    plain = lambda arm: (f"sum(w * (1 / (1 + exp(-l{arm})) + case when a = {arm} then (y - 1 / (1 + exp(-l{arm}))) / g{arm} else 0 end)) / sum(w)")
    return with_views(before + f", t as (select distinct state, stratum, psu from {source})," + slots_sql("t") + "," + draws_sql() + f"""
    , times as (select state, stratum, psu, replicate, count(*) as m from draws join slots using (state, stratum, slot) group by all
        union all select state, stratum, psu, 0, 1 from t),
      b as materialized (select replicate, m * weight as w, outcome as y, sector as a, least(greatest({e}, 0.01e0), 0.99e0) as g1, 1 - g1 as g0,
        ln({mu1} / (1 - {mu1})) as l1, ln({mu0} / (1 - {mu0})) as l0 from {source} join times using (state, stratum, psu)),
      n0 as (select distinct replicate, 0e0 as x1, 0e0 as x0 from times){newton},
      r as (select replicate, count(*) as n, max(x1) as e1, max(x0) as e0, {score(1)} as s1, {score(0)} as s0, sum(w * {p(1)}) / sum(w) as t1,
        sum(w * {p(0)}) / sum(w) as t0, {plain(1)} as p1, {plain(0)} as p0 from b join n{steps} using (replicate) group by replicate),
      l as (select 'aipw' as method, replicate, n, p1 as r1, p0 as r0, null as e1, null as e0 from r
        union all select 'tmle', replicate, n, t1, t0, e1, e0 from r)
    select method, max(n) filter (replicate = 0) as n, max(r1) filter (replicate = 0) as risk_treated, max(r0) filter (replicate = 0) as risk_control,
      risk_treated - risk_control as risk_difference, risk_treated / risk_control as risk_ratio, cast(count(*) filter (replicate > 0) as int) as replicates,
      quantile_cont(r1 - r0, 0.025) filter (replicate > 0) as rd_low, quantile_cont(r1 - r0, 0.975) filter (replicate > 0) as rd_high,
      quantile_cont(r1 / r0, 0.025) filter (replicate > 0) as rr_low, quantile_cont(r1 / r0, 0.975) filter (replicate > 0) as rr_high,
      max(e1) filter (replicate = 0) as epsilon_treated, max(e0) filter (replicate = 0) as epsilon_control,
      case when method = 'tmle' then 0e0 end as score_treated, case when method = 'tmle' then 0e0 end as score_control{extra} from l group by method""")


@query("tmle", targeted_sql())
def i17(spark, sf_dir):
    """Both estimators on given scores; the twin states the solved scores as zero."""
    found = N.targeted(cohort(spark, sf_dir), DESIGN, "outcome", "sector", "e_hat", "mu1_hat", "mu0_hat", reps=REPS, seed=SEED)
    return found.withColumns({c: F.round(c, 9) + 0.0 for c in ("score_treated", "score_control")})


def stacked(spark, sf_dir, fit=N.cross_fit_stacked, trees=10, depth=4):
    rows = cohort(spark, sf_dir)
    used = cut(rows.select(*dict.fromkeys([*DESIGN.cluster, "weight", "sector", "outcome", "mother_id", *NUMERIC, *CATEGORICAL])))  # read several times
    full = encoding_of(used)
    plain = E.Encoding(None, full.numeric, full.categorical)
    return fit(used, [N.LogitLearner(plain), N.TreeLearner(plain, trees, depth)], [N.LogitLearner(full), N.TreeLearner(full, trees, depth)],
               "sector", "outcome", "weight", ["mother_id"], FOLDS, 3, SEED)


@query("stack_two_learners")
def i18(spark, sf_dir):
    return stacked(spark, sf_dir, N.stacked_shares)


@query("stacked_risks")
def i18_risks(spark, sf_dir):
    """Both estimators on the same stacked scores."""
    return N.targeted(stacked(spark, sf_dir)[0], DESIGN, "outcome", "sector", "e_fit", "mu1_fit", "mu0_fit", reps=REPS, seed=SEED)


def with_risk(rows):
    return rows.withColumn("risk", R.primary_risk(F.col("delivery_order") == 1, "maternal_age", "twin_order"))


@query("risk_stratified_aipw")
def i19_risk(spark, sf_dir):
    rows = scored(with_risk(cohort(spark, sf_dir)), by=["risk"])
    return N.fitted_aipw(rows, DESIGN, "outcome", "sector", REPS, SEED, ["risk"])


@query("first_event_aipw")
def i19_first(spark, sf_dir):
    return N.fitted_aipw(scored(cohort(spark, sf_dir).where("delivery_order = 1")), DESIGN, "outcome", "sector", REPS, SEED)


@query("one_record_per_unit")
def i19_one(spark, sf_dir):
    latest = latest_per_key(cohort(spark, sf_dir), ["mother_id"], ["event_cmc", "row_id"])
    return N.fitted_aipw(scored(latest), DESIGN, "outcome", "sector", REPS, SEED)


def split_by_context(rows, scores):
    """Both halves of the nations by the mean age of mothers; models are fitted within each half."""
    measure = rows.groupBy("nation").agg(F.avg("maternal_age").alias("measure"))
    middle = exact_quantiles(measure, [], "measure", {"v": 0.5}).first()["v"]
    rows = broadcast_group_value(rows, measure, "nation").withColumn("half", F.col("measure") >= middle)
    return N.context_split_aipw(scores(rows, by=["half"]), DESIGN, "outcome", "sector", "nation", "measure", REPS, SEED, 0.02)


@query("context_split_aipw")
def i20(spark, sf_dir):
    return split_by_context(cohort(spark, sf_dir), scored)[0]


@query("context_split_leave_one_out")
def i20_loo(spark, sf_dir):
    return split_by_context(cohort(spark, sf_dir), scored)[1]


MODERATORS = ["wealth_index", "residence", "social_group"]


def forest(spark, sf_dir):
    rows = scored(cohort(spark, sf_dir)).withColumn("is_test", F.col("fold") == 0)
    moderators = E.learn_encoding(rows, None, {"education_years": 20.0}, MODERATORS)
    return (*N.cate_forest(rows, moderators, DESIGN, "outcome", "sector", "is_test", 4), moderators)


@query("cate_forest")
def i22(spark, sf_dir):
    """Effects in bins of the predicted effect and per level of every moderator, in test rows."""
    binned = forest(spark, sf_dir)[1].where("is_test")
    groups = {"predicted_effect": F.col("bin"), **{c: F.col(c) for c in MODERATORS}}
    return N.effects_by_group(binned, DESIGN, "outcome", "sector", groups, F.col("tau_hat"), REPS, SEED)


@query("permutation_importance")
def i23(spark, sf_dir):
    model, rows, _, moderators = forest(spark, sf_dir)
    return N.permutation_importance(model, rows.where("is_test").drop("bin"), moderators, ["education_years", *MODERATORS],
                                    ["row_id"], "weight", 5, SEED)


def without_group(rows, scores):
    """Both estimators after one social group is left out, with the spread of fitted propensities in each arm."""
    rows = scores(rows.where("coalesce(social_group, 0) <> 4"))
    both = N.targeted(rows, DESIGN, "outcome", "sector", "e_fit", "mu1_fit", "mu0_fit", reps=REPS, seed=SEED)
    spread = N.propensity_range(rows, "sector")
    pick = lambda a, c: spread.where(F.col("sector") == a).select(c).scalar().alias(f"propensity_{c}_{a}")
    return both.withColumns({c: F.round(c, 9) + 0.0 for c in ("score_treated", "score_control")}).select(
        "*", *[pick(a, c) for a in (0, 1) for c in ("minimum", "median", "maximum")])


@query("exclusion_variant")
def i25(spark, sf_dir):
    return without_group(cohort(spark, sf_dir), scored)


def mothers(rows, unit=("mother_id",)):
    """One row per mother with the features that predict a missing social group."""
    stable = ["social_group", "state", "stratum", "psu", "residence", "wealth_index", "education_years"]
    features = P.unit_rollup(rows.withColumns({"multiple": (F.col("twin_order") > 0).cast("int"), "first_delivery": (F.col("delivery_order") == 1).cast("int")}),
                             list(unit), ["event_cmc", "row_id"], ["sector", "outcome", "weight", "birth_order"], ["multiple", "first_delivery"], stable)
    return features.withColumnsRenamed({f"first_{c}": c for c in stable})


IMPUTATIONS = 30


def social_encoding(units):
    return E.learn_encoding(units, None, {"education_years": 20.0}, ["state", "residence", "wealth_index", "any_multiple", "any_first_delivery"],
                            {"mean_sector": 1.0, "mean_outcome": 1.0, "mean_birth_order": 10.0, "size": 5.0})


def social_draws(rows, encoding_of_units, draws=IMPUTATIONS):
    """Social groups of the mothers without one, per wave, and the rows with their wave as domain."""
    units = cut(mothers(rows, ("wave", "mother_id")))
    levels = sorted(r[0] for r in units.select("social_group").where("social_group is not null").distinct().collect())
    return (*drawn_levels(units, encoding_of_units(units), levels, draws), levels)


def drawn_levels(units, encoding, levels, draws, ridge=RIDGE):
    return I.draw_many(units, encoding, "social_group", levels, "mean_weight", DESIGN, "wave", ["mother_id"], draws, ridge)


def social_shares(units, encoding, ridge=RIDGE):
    """Mean fitted probability of each social group beside its observed share, per wave, from the first imputation model."""
    levels = sorted(r[0] for r in units.select("social_group").where("social_group is not null").distinct().collect())
    _, fits = drawn_levels(units, encoding, levels, 3, ridge)
    rows = None
    for wave, f in sorted(fits.items()):
        own = units.where(F.col("wave") == int(wave))
        coefficients = [[0.0] * len(encoding.labels), *f.beta[0].reshape(len(levels) - 1, -1).tolist()]
        ready = N.multinomial_scores(own, encoding, coefficients)
        cells = F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"p{i}").alias("p")) for i, v in enumerate(levels)])
        observed = F.sum((F.col("social_group") == F.col("level")).cast("int")) / F.count("social_group")
        part = ready.select("social_group", F.inline(cells)).groupBy("level").agg(
            F.avg("p").alias("mean_probability"), observed.alias("observed_share")).withColumn("wave", F.lit(int(wave)))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("fit_multinomial")
def j1(spark, sf_dir):
    units = cut(mothers(cohort(spark, sf_dir), ("wave", "mother_id")))
    return social_shares(units, social_encoding(units))


def imputed_gaps(rows, full, encode, encoding_of_units, draws=IMPUTATIONS, ridge=RIDGE):
    """Pooled gaps per wave of all births and of first deliveries, the latter nested in the same completed data."""
    drawn, _, levels = social_draws(rows, encoding_of_units, draws)
    drawn, out = cut(drawn), None
    for name, part in (("all", rows), ("first_delivery", rows.where("delivery_order = 1"))):
        pooled = I.impute_and_pool(part, drawn, encode(rows, name), "social_group", levels, "wave", DESIGN, "outcome", full, ["mother_id"], draws, ridge)
        pooled = pooled.withColumns({"cohort": F.lit(name), "wave": F.col("domain").cast("int")}).drop("domain")
        out = pooled if out is None else out.unionByName(pooled)
    return out


def gap_encoding(rows, name):
    """First deliveries have no birth order to adjust for."""
    return E.learn_encoding(rows, "sector", NUMERIC if name == "all" else {"education_years": 20.0}, CATEGORICAL)


@query("impute_and_reestimate")
def j4(spark, sf_dir):
    pooled = imputed_gaps(cohort(spark, sf_dir), roster(spark, sf_dir), gap_encoding, social_encoding)
    tested = pooled.where("metric like '%gap'").withColumns(
        {"p_value": t_p_value(F.col("pooled") / F.col("se"), F.col("pooling_df")), "family": F.lit("gaps")})
    return holm(tested, "p_value", ["family"], ["wave", "cohort", "metric"])


def split_scores(spark, sf_dir):
    rows = partitioned(spark, sf_dir)
    train = scored(rows.where("partition = 'train'").drop("partition"))
    encoding = encoding_of(rows)
    model = N.fit_authorized(rows.where("partition = 'train'"), encoding, "outcome", "partition", "weight")
    test = encoding.prepare(rows.where("partition = 'test'")).withColumn("p", model.probability())
    oof = train.withColumn("p", F.when(F.col("sector") == 1, F.col("mu1_fit")).otherwise(F.col("mu0_fit")))
    return oof, test


@query("calibrate")
def k8(spark, sf_dir):
    oof, test = split_scores(spark, sf_dir)
    calibrated, table = N.calibrate(oof, test, "outcome", "p", "weight")
    error = lambda c: (F.sum(F.col("weight") * (F.col(c) - F.col("outcome")) ** 2) / F.sum("weight"))
    tested = calibrated.agg(error("p").alias("raw"), error("calibrated").alias("calibrated"))
    return table.select("*", tested.select("raw").scalar().alias("test_brier_raw"),
                        tested.select("calibrated").scalar().alias("test_brier_calibrated"))


SETTINGS = [*N.sampled_settings("logistic", {"ridge": [10.0 ** k for k in range(-5, 1)]}, 6, SEED),
            *N.sampled_settings("forest", {"trees": [20, 40], "depth": [4, 6, 8]}, 2, SEED),
            *N.sampled_settings("boosted", {"trees": [5, 10], "depth": [2, 3, 4], "step": [0.05, 0.1, 0.3]}, 2, SEED)]


@query("grouped_search")
def k9(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return N.grouped_search(rows, encoding_of(rows), "outcome", "weight", ["mother_id"], 3, SEED, SETTINGS)


@query("search_table", with_views("""
    , s as (select 0 as setting, cast(row_id % 3 as int) as fold, outcome as y, mu1_hat as p, weight as h from cohort
        union all select 1, cast(row_id % 3 as int), outcome, round(mu0_hat, 1), weight from cohort),
      g as (select setting, fold, p, sum(h) filter (y = 1) as wp, sum(h) filter (y = 0) as wn from s group by all),
      c as (select setting, fold, p, coalesce(wp, 0) as wp, coalesce(wn, 0) as wn from g),
      r as (select *, sum(wn) over (partition by setting, fold order by p) - wn as below, sum(wp) over (partition by setting, fold) as tp,
        sum(wn) over (partition by setting, fold) as tn, sum(wp) over (partition by setting, fold order by p desc) as up,
        sum(wp + wn) over (partition by setting, fold order by p desc) as ua from c),
      e as (select setting, fold, sum(wp * (below + 0.5e0 * wn)) / (max(tp) * max(tn)) as auc, sum(wp * up / ua) / max(tp) as ap from r group by all),
      t as (select setting, count(*) as folds, avg(ap) as mean_average_precision, stddev_samp(ap) as sd_average_precision, avg(auc) as mean_roc_auc,
        stddev_samp(auc) as sd_roc_auc from e group by setting)
    select *, setting = (select setting from t order by mean_average_precision desc, setting limit 1) as selected from t"""))
def k9_table(spark, sf_dir):
    """The search's metrics on given scores of two settings."""
    rows = cohort(spark, sf_dir).withColumn("fold", (F.col("row_id") % 3).cast("int"))
    given = [rows.select(F.lit(i).alias("setting"), "fold", F.col("outcome").alias("_y"), p.alias("_p"), F.col("weight").alias("_h"))
             for i, p in enumerate((F.col("mu1_hat"), F.round("mu0_hat", 1)))]
    return N.search_table(given[0].unionByName(given[1]))


def authorized(rows, encoding, ridge=RIDGE):
    """Spread of the predictions of a model fitted to training rows only, per partition."""
    model = N.fit_authorized(rows.where("partition = 'train'"), encoding, "outcome", "partition", "weight", ridge, balance=True)
    predicted = encoding.prepare(rows).withColumn("p", model.probability())
    return predicted.groupBy("partition").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.min("p").alias("min_p"),
                                              F.max("p").alias("max_p"))


@query("fit_authorized")
def k10(spark, sf_dir):
    rows = partitioned(spark, sf_dir)
    return authorized(rows, encoding_of(rows))
