"""Model-standardised gaps over the survey view."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from surveyloom.functions import recode as R
from surveyloom.operators import encoding as E
from surveyloom.operators import joins as J
from surveyloom.operators import standardize as S
from surveyloom.operators import variance as V
from surveyloom.operators.profile import with_support
from surveyloom.plans.bootstraps import REPS, SEED, bootstrap_sql
from surveyloom.plans.cohorts import PERIODS
from surveyloom.plans.profiles import SUPPORT
from surveyloom.plans.ranking import PARTITION_SQL, partitioned
from surveyloom.plans.registry import query
from surveyloom.plans.tables import CATEGORICAL, DESIGN, cohort, design_frame, roster, with_views

RIDGE = 1e-5
NUMERIC = {"birth_order": 10.0, "education_years": 20.0}


def encoding_of(rows, **more):
    return E.learn_encoding(rows, "sector", NUMERIC, CATEGORICAL, **more)


def _levels_sql(c: str) -> str:
    return f"""
      select w.wave, '{c}=' || l as term, coalesce(sum(1e0) filter (coalesce(cast({c} as varchar), '__MISSING__') = l), 0) as total
      from (select distinct wave from cohort) w cross join (select * from (
          select distinct cast({c} as varchar) as l from cohort where {c} is not null order by 1 offset 1)
        union all select '__MISSING__' union all select '__UNKNOWN__') left join cohort on cohort.wave = w.wave group by all"""


@query("encode_design", with_views("""
    select wave, 'intercept' as term, count(*) * 1e0 as total from cohort group by wave
    union all select wave, 'sector', sum(sector) from cohort group by wave
    union all select wave, 'birth_order_scaled', sum(birth_order / 10e0) from cohort group by wave
    union all select wave, 'education_years_scaled', sum(coalesce(education_years, 0) / 20e0) from cohort group by wave
    union all select wave, 'birth_order_missing', count(*) filter (birth_order is null) from cohort group by wave
    union all select wave, 'education_years_missing', count(*) filter (education_years is null) from cohort group by wave
    """ + "".join(" union all " + _levels_sql(c) for c in CATEGORICAL)))
def h1(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    encoding = encoding_of(rows)
    cells = F.array(*[F.struct(F.lit(label).alias("term"), F.col(f"t{i}").alias("total"))
                      for i, label in enumerate(encoding.labels)])
    return encoding.prepare(rows).groupBy("wave").agg(
        *[F.sum(t).alias(f"t{i}") for i, t in enumerate(encoding.terms())]).select("wave", F.inline(cells))


@query("fit_preprocessor", with_views(PARTITION_SQL + """
    , d as (select cohort.*, partition from cohort join part using (mother_id)),
      m as (select median(education_years) as m from d where partition = 'train'),
      s as (select avg(coalesce(education_years, m)) as a, stddev_pop(coalesce(education_years, m)) as s
        from d, m where partition = 'train')
    select row_id, (coalesce(education_years, m.m) - s.a) / s.s as education_years_value,
      cast(education_years is null as int) as education_years_missing, cast(social_group is null as int) as "social_group=__MISSING__",
      cast(social_group is not distinct from 1 as int) as "social_group=1", cast(social_group is not distinct from 2 as int) as "social_group=2",
      cast(social_group is not distinct from 3 as int) as "social_group=3", cast(social_group is not distinct from 4 as int) as "social_group=4"
    from d, m, s"""))
def h2(spark, sf_dir):
    rows = partitioned(spark, sf_dir)
    learned = E.fit_preprocessor(rows.where("partition = 'train'"), ["education_years"], ["social_group"], "partition", scale=True)
    return learned.transform(rows).select(
        "row_id", "education_years_value", "education_years_missing",
        *[F.col(f"`social_group={v}`") for v in ("__MISSING__", "1", "2", "3", "4")])


@query("fit_weighted_logit")
def h3(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return S.coefficients(rows, S.fit_weighted_logit(rows, encoding_of(rows), "outcome", "weight", RIDGE))


FIXED = {"intercept": -1.0, "sector": 0.5, "education_years_scaled": -0.3, "education_years_missing": 0.2, "residence=2": 0.4}


@query("standardize", with_views("""
    , z as (select state, weight, -1e0 + case when education_years is null then 0.2e0 else -0.3e0 * education_years / 20 end
        + case when residence = 2 then 0.4e0 else 0 end as z from cohort)
    select state, sum(weight / (1 + exp(-z))) / sum(weight) as standardized_control,
      sum(weight / (1 + exp(-z - 0.5e0))) / sum(weight) as standardized_treated,
      standardized_treated - standardized_control as standardized_gap from z group by state"""))
def h4(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    encoding = E.learn_encoding(rows, "sector", {"education_years": 20.0}, ["residence"])
    model = S.LogitModel(encoding, np.array([FIXED.get(label, 0.0) for label in encoding.labels]), RIDGE)
    return S.standardize(rows, model, "weight", ["state"])


@query("standardized_gap")
def h5(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return S.standardized_gap(rows, encoding_of(rows), DESIGN, "outcome", roster(spark, sf_dir), RIDGE)


def supported_rows(spark, sf_dir, minimum=60, **more):
    return with_support(cohort(spark, sf_dir), SUPPORT, "sector", minimum, "weight", **more)


@query("reference_targets")
def h6(spark, sf_dir):
    rows = supported_rows(spark, sf_dir)
    model = S.fit_weighted_logit(rows, encoding_of(rows), "outcome", "weight", RIDGE)
    linear, points = S.reference_influence(rows, model, "outcome", "weight", {"supported": F.col("supported")})
    return S.estimate_rows(linear, points, DESIGN, roster(spark, sf_dir))


@query("support_scenarios")
def h7(spark, sf_dir):
    rows = with_support(cohort(spark, sf_dir), ["state"], "sector", 30, "weight", "states_30")
    rows = with_support(rows, SUPPORT, "sector", 1, "weight", "cells_both")
    rows = with_support(rows, SUPPORT, "sector", 60, "weight", "cells_60")
    masks = {"states_30_each": "states_30", "cells_both_arms": "cells_both", "cells_60_each": "cells_60"}
    return S.support_scenarios(rows, encoding_of(rows), DESIGN, "outcome", roster(spark, sf_dir), RIDGE, masks, ["cells_60_each"])


@query("shared_reference_gap")
def h8(spark, sf_dir):
    rows = supported_rows(spark, sf_dir, 15, also={"wave": [4, 5]})
    encoding = encoding_of(rows, interactions=[("residence", "2")])
    groups = {"overall": F.lit(True), "residence_1": F.col("residence") == 1, "residence_2": F.col("residence") == 2}
    linear, points = S.shared_reference_gap(rows, encoding, DESIGN, "outcome", "wave", [4, 5], "supported", groups, RIDGE)
    full = roster(spark, sf_dir)
    cov = S.covariance_by_wave(linear, DESIGN, list(points), {4: full, 5: full}, "wave")
    return S.interval_rows(cov, points, None, 100.0)


CELLS = {"r1_w4": (1, 4), "r2_w4": (2, 4), "r1_w5": (1, 5), "r2_w5": (2, 5)}
NAMES = list(CELLS)


def _cell_sql(template: str, joiner: str = ", ") -> str:
    return joiner.join(template.format(k=k, r=r, w=w) for k, (r, w) in CELLS.items())


@query("heterogeneity_change", with_views("""
    , p as (select residence, wave, sum(weight) as tw, sum(weight * outcome) / sum(weight) as p from cohort group by all),
      u as (select c.state, c.stratum, c.psu, """ + _cell_sql(
    "sum(case when c.residence = {r} and c.wave = {w} then weight * (outcome - p) / tw else 0 end) as {k}") + """
        from cohort c join p on p.residence = c.residence and p.wave = c.wave group by all),
      al as (select state, stratum, psu, """ + _cell_sql("coalesce({k}, 0) as {k}") + """
        from (select * from roster semi join u using (state, stratum)) left join u using (state, stratum, psu)),
      lg as (select * from al unpivot (v for key in (""" + ", ".join(NAMES) + """))),
      gm as (select key, avg(v) as g from lg group by key),
      pr as (select a.state, a.stratum, a.key as i, b.key as j, count(*) as n, sum(a.v) as si, sum(b.v) as sj, sum(a.v * b.v) as pp
        from lg a join lg b using (state, stratum, psu) group by all),
      cov as (select i, j, sum(case when n > 1 then n / (n - 1e0) * (pp - si * sj / n) else (si - x.g) * (sj - y.g) end) as cov
        from pr join gm x on x.key = i join gm y on y.key = j group by i, j),
      th as (""" + _cell_sql("select '{k}' as key, p as estimate from p where residence = {r} and wave = {w}", " union all ") + """),
      l(contrast, key, coef) as (values ('gap_w4', 'r2_w4', 1e0), ('gap_w4', 'r1_w4', -1e0), ('gap_w5', 'r2_w5', 1e0),
        ('gap_w5', 'r1_w5', -1e0), ('gap_change', 'r2_w5', 1e0), ('gap_change', 'r1_w5', -1e0), ('gap_change', 'r2_w4', -1e0),
        ('gap_change', 'r1_w4', 1e0)),
      e as (select contrast, sum(coef * estimate) as estimate from l join th using (key) group by contrast),
      s as (select a.contrast, sqrt(sum(a.coef * b.coef * cov)) as se, sqrt(sum(case when i = j then a.coef ^ 2 * cov else 0 end))
          as se_ignoring_covariance from cov join l a on a.key = i join l b on b.key = j and b.contrast = a.contrast group by all)
    select *, estimate - 1.96 * se as ci_low, estimate + 1.96 * se as ci_high from e join s using (contrast)"""))
def h9(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    domains = {name: (F.col("residence") == r) & (F.col("wave") == w) for name, (r, w) in CELLS.items()}
    linear = rows.withColumns(V.domain_influences(rows, "weight", "outcome", domains))
    cov = V.roster_covariance(linear, DESIGN, NAMES, roster(spark, sf_dir)).where("singleton = 'adjust'")
    key = F.concat(F.lit("r"), F.col("residence").cast("string"), F.lit("_w"), F.col("wave").cast("string"))
    theta = rows.groupBy(key.alias("key")).agg((F.sum(F.col("weight") * F.col("outcome")) / F.sum("weight")).alias("estimate"))
    is_w, is_r = F.substring("key", 5, 1), F.substring("key", 2, 1)
    sign = F.when(is_r == "2", 1.0).otherwise(-1.0)
    gaps = theta.select(F.concat(F.lit("gap_w"), is_w).alias("contrast"), "key", sign.alias("coef"))
    change = theta.select(F.lit("gap_change").alias("contrast"), "key",
                          (sign * F.when(is_w == "5", 1.0).otherwise(-1.0)).alias("coef"))
    return S.heterogeneity_change(theta, cov, gaps.unionByName(change), V.NORMAL_CRITICAL)


@query("training_population_contrast")
def h10(spark, sf_dir):
    rows = supported_rows(spark, sf_dir)
    return S.training_population_contrast(rows, encoding_of(rows), DESIGN, "outcome", roster(spark, sf_dir), RIDGE,
                                          F.col("delivery_order") <= 3, F.col("supported"))


@query("exclusion_sensitivity")
def h11(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return S.exclusion_sensitivity(rows, encoding_of(rows), DESIGN, "outcome", roster(spark, sf_dir), RIDGE, F.col("state") != 3)


def with_periods(spark, sf_dir):
    return cohort(spark, sf_dir).withColumn("period", R.period_bucket("event_cmc", PERIODS, "D"))


@query("period_gaps")
def h12(spark, sf_dir):
    rows = with_periods(spark, sf_dir)
    return S.period_gaps(rows, encoding_of(rows), DESIGN, "outcome", ["wave", "period"], "nation", 12, RIDGE, roster(spark, sf_dir), REPS, SEED)


@query("period_influence")
def h13(spark, sf_dir):
    rows = with_periods(spark, sf_dir)
    return S.period_influence(rows, encoding_of(rows), DESIGN, "outcome", roster(spark, sf_dir), "period", ["A", "B", "C", "D"],
                              [("B", "A"), ("C", "B"), ("D", "C")], RIDGE)


SCALES = {"share": 1.0, "level": 10.0}


def with_context(spark, sf_dir):
    """Cohort rows with the preceding fiscal year's mean weight and customer count of their state."""
    frame = design_frame(spark, sf_dir)
    year, month = R.cmc_year("event_cmc"), R.cmc_month("event_cmc")
    panel = frame.groupBy("state", (year - F.when(month < 4, 1).otherwise(0)).alias("fy")).agg(
        F.avg("weight").alias("share"), (F.count("*") / 1000.0).alias("level"))
    rows = cohort(spark, sf_dir)
    for value in SCALES:
        rows = J.lagged_period_lookup(rows, panel, "state", year, month, "fy", value, out_period="lookup_period").drop("lookup_period")
    return rows.withColumns({"year": year, "month": month})


@query("residualize_context")
def h14(spark, sf_dir):
    linked = with_context(spark, sf_dir).where("share is not null and level is not null")
    residuals, terms = S.residualize_context(linked, SCALES, "state", "year", "month")
    spread = residuals.agg(*[F.stddev_pop(f"{c}_residual").alias(c) for c in SCALES]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).alias("residual_sd")) for c in SCALES])))
    return terms.join(spread, "term")


@query("residual_variation", with_views("""
    , d as (select *, (event_cmc - 1) // 12 + 1900 as year, mu1_hat - 0.5e0 as res from cohort),
      c as (select state, year, avg(res) as m from d group by all),
      m as (select sum(weight * res) / sum(weight) as mr, sum(weight * sector) / sum(weight) as ma from d)
    select (select count(*) from d) as n, 1 - avg(res * res) / var_pop(e_hat) as share_absorbed, stddev_pop(e_hat) as raw_sd,
      sqrt(avg(res * res)) as residual_sd, sum(weight * (res - mr) * (sector - ma))
        / sqrt(sum(weight * (res - mr) ^ 2) * sum(weight * (sector - ma) ^ 2)) as weighted_corr_with_exposure,
      (select count(*) from c) as cells, (select count(*) from c where abs(m) > 0.005) as cells_with_variation,
      (select count(distinct state) from c where abs(m) > 0.005) as units_with_variation,
      (select sqrt(avg(m * m)) from c) as between_cell_rms from d, m"""))
def h15(spark, sf_dir):
    rows = cohort(spark, sf_dir).withColumns({"year": R.cmc_year("event_cmc"), "res": F.col("mu1_hat") - 0.5})
    return S.residual_variation(rows, "e_hat", "res", "state", "year", "sector", "weight", 0.005)


@query("context_models")
def h16(spark, sf_dir):
    rows = with_context(spark, sf_dir).withColumn("has_context", F.col("share").isNotNull() & F.col("level").isNotNull())
    residuals, terms = S.residualize_context(rows.where("has_context"), SCALES, "state", "year", "month")
    kept = {f"{r['term']}_residual": 1.0 for r in terms.where("included").collect()}
    side = residuals.select("row_id", *kept)
    angle = 2 * np.pi * F.col("month") / 12
    ready = rows.join(side, "row_id", "left").withColumns(
        {"season_sin": F.sin(angle), "season_cos": F.cos(angle)} | {c: F.coalesce(c, F.lit(0.0)) for c in kept})
    season = {"season_sin": 1.0, "season_cos": 1.0}
    base = E.learn_encoding(ready, "sector", NUMERIC, CATEGORICAL)
    calendar = E.learn_encoding(ready, "sector", NUMERIC, [*CATEGORICAL, "year"], season)
    context = E.learn_encoding(ready, "sector", NUMERIC, [*CATEGORICAL, "year"], season | kept)
    return S.context_models(ready, base, calendar, context, DESIGN, "outcome", roster(spark, sf_dir), RIDGE, F.col("has_context"))


PENALTIES = [10.0 ** k for k in range(-6, 1)]


@query("penalty_selection")
def h17(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return S.penalty_selection(rows, encoding_of(rows), DESIGN, "outcome", "state", PENALTIES, range(1, 6))


@query("site_screen", with_views("""
    select nation, count(*) as n, count(*) filter (sector = 0) as n_control, count(*) filter (sector = 1) as n_treated,
      cast(sum(outcome) as bigint) as events, sum(weight) as weight, count(distinct (state, stratum, psu)) as psus,
      count(*) filter (sector = 0) >= 160 and count(*) filter (sector = 1) >= 160 and min(outcome) <> max(outcome) as passes
    from cohort group by nation"""))
def h19(spark, sf_dir):
    return S.site_screen(cohort(spark, sf_dir), DESIGN, "nation", "sector", "outcome", 160)


@query("screened_training")
def h19_refit(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return S.screened_training(rows, encoding_of(rows), DESIGN, "outcome", "nation", RIDGE, 160)


@query("treated_counterfactual_delta", with_views("""
    , s as (select state, residence, wealth_index from cohort group by all having count(*) filter (sector = 0) >= 60
        and count(*) filter (sector = 1) >= 60),
      d as (select *, mu1_hat - mu0_hat as delta from cohort semi join s using (state, residence, wealth_index) where sector = 1),
      g as (select 'all' as "group", 'all' as level, delta, weight from d union all select 'risk', case when delivery_order <> 1
        then 'not_applicable_multiparous' when maternal_age < 35 and twin_order = 0 then 'lower_risk' else 'elevated_risk' end,
        delta, weight from d),
      c as (select "group", level, delta as x, sum(weight) as w from g group by all),
      r as (select *, (sum(w) over (partition by "group", level order by x) - 0.5e0 * w) / sum(w) over (partition by "group", level)
        as pos, lead(x) over (partition by "group", level order by x) as nx from c),
      p as (select *, lead(pos) over (partition by "group", level order by x) as npos from r),
      v as (select "group", level, k, case when max(pos) filter (pos <= q) is null then min(x) else max(x + (nx - x) * (q - pos)
        / (npos - pos)) filter (pos <= q and npos > q) end as value from p, (values ('p05', 0.05e0), ('p25', 0.25e0),
        ('median', 0.5e0), ('p75', 0.75e0), ('p95', 0.95e0)) t(k, q) group by all),
      m as (select "group", level, count(*) as n, sum(weight * delta) / sum(weight) as mean_delta from g group by all)
    select "group", level, n, mean_delta, max(value) filter (k = 'p05') as p05, max(value) filter (k = 'p25') as p25,
      max(value) filter (k = 'median') as median, max(value) filter (k = 'p75') as p75, max(value) filter (k = 'p95') as p95
    from m join v using ("group", level) group by all"""))
def h20(spark, sf_dir):
    rows = supported_rows(spark, sf_dir).withColumn(
        "risk", R.primary_risk(F.col("delivery_order") == 1, "maternal_age", "twin_order"))
    return S.treated_counterfactual_delta(rows, "sector", "mu1_hat", "mu0_hat", "weight", "supported", "risk")


@query("counterfactual_delta_ci", with_views("""
    , s as (select state, residence, wealth_index from cohort group by all having count(*) filter (sector = 0) >= 60
        and count(*) filter (sector = 1) >= 60),
      d as (select *, mu1_hat - mu0_hat as delta, sector = 1 and (state, residence, wealth_index) in (select (state, residence,
        wealth_index) from s) as ok from cohort),
      t as (select state, stratum, psu, coalesce(sum(weight * delta) filter (ok), 0) as na, coalesce(sum(weight) filter (ok), 0) as da,
        coalesce(sum(weight * delta) filter (ok and delivery_order = 1), 0) as nb,
        coalesce(sum(weight) filter (ok and delivery_order = 1), 0) as db from d group by all),
    """ + bootstrap_sql("t", "na da nb db") + """
    , l as (select 'overall' as statistic, na / nullif(da, 0) as v from reps union all select 'first_event', nb / nullif(db, 0) from reps)
    select statistic, count(v) as replicates, avg(v) as mean, quantile_cont(v, 0.025) as ci_low,
      quantile_cont(v, 0.975) as ci_high from l group by statistic"""))
def h20_ci(spark, sf_dir):
    levels = {"overall": F.lit(True), "first_event": F.col("delivery_order") == 1}
    return S.counterfactual_delta_ci(supported_rows(spark, sf_dir), DESIGN, "sector", "mu1_hat", "mu0_hat", "supported", levels,
                                     REPS, SEED)
