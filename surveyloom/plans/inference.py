"""Design-based inference over the survey view."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.operators import variance as V
from surveyloom.plans.flagship import INFLUENCE_SQL, ROSTER_SQL
from surveyloom.plans.registry import query
from surveyloom.plans.tables import DESIGN, cohort, design_frame, roster, table, with_views

KEYS = ["u_control", "u_treated", "u_gap"]
SRC = ", src as (select * from cohort)"


@query("domain_proportion", with_views("""
    , d as (select sum(weight) as tw, sum(weight * outcome) / sum(weight) as p from cohort where residence = 1),
      z as (select cohort.*, p, case when residence = 1 then weight * (outcome - p) / tw else 0 end as z from cohort, d)
    select state, stratum, psu, max(p) as estimate, sum(z) as z from z group by state, stratum, psu"""))
def g1(spark, sf_dir):
    linear = V.domain_proportion(cohort(spark, sf_dir), DESIGN, "outcome", F.col("residence") == 1)
    return linear.groupBy(*DESIGN.cluster).agg(F.max("estimate").alias("estimate"), F.sum("z").alias("z"))


VARIANCE_SQL = """
      t as (select state, stratum, psu, sum(z) as t from z group by all),
      s as (select state, stratum, count(*) as n, sum(t) as t1, sum(t * t) as t2 from t group by all)
"""


@query("psu_variance", with_views("""
    , d as (select sum(weight) as tw, sum(weight * outcome) / sum(weight) as p from cohort where residence = 1),
      z as (select cohort.*, case when residence = 1 then weight * (outcome - p) / tw else 0 end as z from cohort, d),
    """ + VARIANCE_SQL + """
    select sum(case when n > 1 then n / (n - 1e0) * (t2 - t1 * t1 / n) else 0 end) as variance,
      count(*) filter (n = 1) as singleton_strata, count(*) filter (n > 1) as strata_used from s"""))
def g2(spark, sf_dir):
    linear = V.domain_proportion(cohort(spark, sf_dir), DESIGN, "outcome", F.col("residence") == 1)
    return V.psu_variance(linear, DESIGN, "z")


@query("design_estimates", with_views("""
    , g as (select state, stratum, psu, weight, outcome, 'overall' as grouping, 'all' as level from cohort
        union all select state, stratum, psu, weight, outcome, 'residence', cast(residence as varchar) from cohort
        union all select state, stratum, psu, weight, outcome, 'wealth', cast(wealth_index as varchar) from cohort
        union all select state, stratum, psu, weight, outcome, 'social', cast(social_group as varchar) from cohort
          where social_group is not null),
      d as (select grouping, level, count(*) as n, sum(weight) as tw, sum(weight * outcome) / sum(weight) as p
        from g group by all),
      c as (select distinct state, stratum, psu from cohort),
      h as (select state, stratum, count(*) as nh from c group by all),
      t as (select grouping, level, state, stratum, psu, sum(weight * (outcome - p) / tw) as t
        from g join d using (grouping, level) group by all),
      s as (select grouping, level, state, stratum, sum(t) as t1, sum(t * t) as t2 from t group by all),
      v as (select grouping, level, sum(case when nh > 1 then nh / (nh - 1e0) * (t2 - t1 * t1 / nh) else 0 end) as v
        from s join h using (state, stratum) group by all)
    select grouping, level, n, 100 * p as estimate_pct, 100 * sqrt(v) as se_pct,
      greatest(100 * (p - 1.96 * sqrt(v)), 0) as ci_low_pct, least(100 * (p + 1.96 * sqrt(v)), 100) as ci_high_pct,
      (select count(*) from h where nh = 1) as singleton_strata, (select count(*) from h where nh > 1) as strata_used
    from d join v using (grouping, level)"""))
def g3(spark, sf_dir):
    groupings = {"overall": F.lit("all"), "residence": F.col("residence"), "wealth": F.col("wealth_index"),
                 "social": F.col("social_group")}
    return V.design_estimates(cohort(spark, sf_dir), DESIGN, "outcome", groupings)


@query("design_difference", with_views(SRC + INFLUENCE_SQL + """
    , z as (select *, u_gap as z from lin),""" + VARIANCE_SQL + """,
      v as (select sqrt(sum(case when n > 1 then n / (n - 1e0) * (t2 - t1 * t1 / n) else 0 end)) as se,
        count(*) filter (n = 1) as k from s)
    select (select count(*) from cohort where sector = 1) as n_a, (select count(*) from cohort where sector = 0) as n_b,
      100 * p1 as a_pct, 100 * p0 as b_pct, 100 * (p1 - p0) as gap_pct, 100 * se as se_pct, k as singleton_strata,
      gap_pct - 1.96 * se_pct as ci_low_pct, gap_pct + 1.96 * se_pct as ci_high_pct from v, arm"""))
def g4(spark, sf_dir):
    return V.design_difference(cohort(spark, sf_dir), DESIGN, "outcome", F.col("sector") == 1, F.col("sector") == 0)


NAMED = "case {} when 'u0' then 'u_control' when 'u1' then 'u_treated' else 'u_gap' end"


def arm_covariance(spark, sf_dir, wave=None):
    rows = cohort(spark, sf_dir)
    if wave is not None:
        rows = rows.where(F.col("wave") == wave)
    linear = V.arm_influences(rows, DESIGN, "outcome", "sector")
    return V.roster_covariance(linear, DESIGN, KEYS, roster(spark, sf_dir))


@query("roster_covariance", with_views(SRC + INFLUENCE_SQL + ROSTER_SQL + f"""
    select singleton, {NAMED.format('i')} as row_key, {NAMED.format('j')} as col_key, cov,
      cast(df as bigint) as design_df from cov"""))
def g5(spark, sf_dir):
    return arm_covariance(spark, sf_dir)


@query("variance_from_sufficient_stats", with_views(SRC + INFLUENCE_SQL + """
    , t as (select r.state, r.stratum, r.psu, coalesce(u, 0) as t from roster r left join
        (select state, stratum, psu, sum(u_gap) as u from lin group by all) using (state, stratum, psu)),
      s as (select state, stratum, count(*) as n, sum(t) as t1, sum(t * t) as t2 from t group by all),
      g as (select avg(t) as g from t)
    select sum(case when n > 1 then n / (n - 1e0) * (t2 - t1 * t1 / n) else 0 end) as remove,
      remove + sum(case when n = 1 then (t1 - g) * (t1 - g) else 0 end) as adjust,
      remove + count(*) filter (n = 1) * remove / count(*) filter (n > 1) as average,
      count(*) filter (n = 1) as singleton_strata, cast(sum(n) - count(*) as bigint) as design_df from s, g"""))
def g6(spark, sf_dir):
    linear = V.arm_influences(cohort(spark, sf_dir), DESIGN, "outcome", "sector")
    return V.full_design_variance(linear, DESIGN, "u_gap", roster(spark, sf_dir))


@query("unit_descriptive", with_views("""
    , src as (select * from cohort where delivery_order = 1),
      un as (select state, sector as a, count(*) as n, sum(weight) as w, sum(weight * outcome) / sum(weight) as p,
          sum(weight) ^ 2 / sum(weight * weight) as ess, min(outcome) = max(outcome) as bd from src group by all),
      row_z as (select c.state, c.stratum, c.psu, c.delivery_order = 1 and c.sector = 0 as i0,
          c.delivery_order = 1 and c.sector = 1 as i1, weight, outcome, a0.p as p0, a1.p as p1, a0.w as w0, a1.w as w1
        from cohort c left join un a0 on a0.state = c.state and a0.a = 0 left join un a1 on a1.state = c.state and a1.a = 1),
      t as (select state, stratum, psu, sum(case when i0 then weight * (outcome - p0) / w0 else 0 end) as t0,
          sum(case when i1 then weight * (outcome - p1) / w1 else 0 end) as t1 from row_z group by all),
      al as (select r.state, r.stratum, r.psu, coalesce(t0, 0) as t0, coalesce(t1, 0) as t1,
          coalesce(t1, 0) - coalesce(t0, 0) as t2
        from (select * from roster semi join t using (state, stratum)) r left join t using (state, stratum, psu)),
      lg as (select * from al unpivot (u for m in (t0, t1, t2))),
      gm as (select state, m, avg(u) as g from lg group by all),
      st as (select state, stratum, m, count(*) as n, sum(u) as s, sum(u * u) as q from lg group by all),
      mo as (select st.state, m, sum(case when n > 1 then n / (n - 1e0) * (q - s * s / n) else 0 end) as b,
          sum(case when n = 1 then (s - g) ^ 2 else 0 end) as l, count(*) filter (n = 1) as k,
          count(*) filter (n > 1) as r, sum(n) - count(*) as df from st join gm using (state, m) group by all),
      rules as (select state, m, df, r, rule, case rule when 'adjust' then b + l when 'average' then b + k * b / r else b end
          as v from mo, (values ('adjust'), ('average'), ('zero')) x(rule)),
      w as (select state, max(n) filter (a = 0) as n0, max(n) filter (a = 1) as n1, max(p) filter (a = 0) as p0,
          max(p) filter (a = 1) as p1, max(ess) filter (a = 0) as e0, max(ess) filter (a = 1) as e1,
          bool_or(bd) filter (a = 0) as b0, bool_or(bd) filter (a = 1) as b1 from un group by state),
      o as (select state, r_name as unit_name, coalesce(n0, 0) as n_control, coalesce(n1, 0) as n_treated, df, m, rule,
          100 * case m when 't0' then p0 when 't1' then p1 else p1 - p0 end as estimate, 100 * sqrt(v) as se,
          case m when 't0' then e0 when 't1' then e1 else least(e0, e1) end as minimum_effective_n,
          case m when 't0' then n0 < 200 when 't1' then n1 < 200 else n0 < 200 or n1 < 200 end as few,
          case m when 't0' then e0 < 200 when 't1' then e1 < 200 else e0 < 200 or e1 < 200 end as light
        from rules join w using (state) join region on r_regionkey = state)
    select state, unit_name, n_control, n_treated, cast(df as bigint) as design_df,
      case m when 't0' then 'control' when 't1' then 'treated' else 'gap' end as metric, rule as singleton, estimate, se,
      minimum_effective_n, estimate - 1.96 * se as ci_low, estimate + 1.96 * se as ci_high,
      case when m <> 't2' and (ci_low < 0 or ci_high > 100) then 'approximate_interval_outside_bounds'
        when few or light then 'approximate_interval_sparse' else 'approximate_interval' end as status,
      concat_ws(';', case when few then 'sparse_n_below_200' end,
        case when light then 'weight_only_effective_n_below_200' end,
        case when m <> 't2' and (ci_low < 0 or ci_high > 100) then 'wald_interval_outside_0_100' end) as flags from o"""))
def g7(spark, sf_dir):
    labels = table(spark, sf_dir, "region", "r_regionkey", "r_name").select(
        F.col("r_regionkey").cast("long").alias("state"), F.col("r_name").alias("unit_name"))
    return V.unit_descriptive(cohort(spark, sf_dir), DESIGN, "outcome", "sector", "state", labels, "unit_name",
                              roster(spark, sf_dir), F.col("delivery_order") == 1, sparse=200,
                              critical=V.NORMAL_CRITICAL)


RATES_SQL = """
    , est as (select wave, state, sum(weight * outcome) / sum(weight) as estimate,
        sqrt(var_pop(outcome) / count(*)) as se, count(*) - 1 as design_df from cohort group by all)
"""


def wave_rates(spark, sf_dir):
    return cohort(spark, sf_dir).groupBy("wave", "state").agg(
        (F.sum(F.col("weight") * F.col("outcome")) / F.sum("weight")).alias("estimate"),
        F.sqrt(F.var_pop("outcome") / F.count("*")).alias("se"), (F.count("*") - 1).alias("design_df"))


@query("intervals", with_views(RATES_SQL + """
    select *, 'linear' as kind, estimate - 1.96 * se as ci_low, estimate + 1.96 * se as ci_high from est
    union all select *, 'log_ratio', estimate * exp(-1.96 * se), estimate * exp(1.96 * se) from est"""))
def g8(spark, sf_dir):
    rates = wave_rates(spark, sf_dir)
    parts = [V.intervals(rates.withColumn("kind", F.lit(kind)), "estimate", "se", V.NORMAL_CRITICAL, kind=kind)
             for kind in ("linear", "log_ratio")]
    return parts[0].unionByName(parts[1])


@query("intervals_t")
def g8_t(spark, sf_dir):
    return V.intervals(wave_rates(spark, sf_dir), "estimate", "se", df_column="design_df", p_value="p_value")


@query("independent_change", with_views(RATES_SQL + """
    select state, b.estimate - a.estimate as change, sqrt(a.se ^ 2 + b.se ^ 2) as se,
      least(a.design_df, b.design_df) as design_df
    from (select * from est where wave = 4) a join (select * from est where wave = 5) b using (state)"""))
def g9(spark, sf_dir):
    rates = wave_rates(spark, sf_dir)
    return V.independent_change(rates.where("wave = 5"), rates.where("wave = 4"), ["state"])


@query("paired_contrast", with_views(SRC + INFLUENCE_SQL + ROSTER_SQL + """
    , c as (select i, j, cov from cov where singleton = 'adjust')
    select 'treated_minus_control' as contrast, p1 - p0 as estimate,
      sqrt((select cov from c where i = 'u1' and j = 'u1') + (select cov from c where i = 'u0' and j = 'u0')
        - 2 * (select cov from c where i = 'u0' and j = 'u1')) as se from arm"""))
def g10(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    theta = rows.groupBy(F.when(F.col("sector") == 1, "u_treated").otherwise("u_control").alias("key")).agg(
        (F.sum(F.col("weight") * F.col("outcome")) / F.sum("weight")).alias("estimate"))
    pairs = theta.where("key = 'u_treated'").select(
        F.lit("treated_minus_control").alias("contrast"), F.col("key").alias("first"), F.lit("u_control").alias("second"))
    return V.paired_contrast(theta, arm_covariance(spark, sf_dir).where("singleton = 'adjust'"), pairs)


@query("roster_audit", with_views("""
    , c as (select distinct state, stratum, psu from cohort), f as (select distinct state, stratum, psu from design_frame),
      a as (select * from roster semi join c using (state, stratum)),
      h as (select state, stratum, count(*) as n from a group by all)
    select (select count(*) from roster) as roster_psus, (select count(*) from c) as cohort_psus,
      (select count(*) from a) as active_roster_psus,
      (select count(*) from a anti join c using (state, stratum, psu)) as zero_domain_psus,
      (select count(*) from f anti join roster using (state, stratum, psu)) as file_psus_outside_roster,
      (select count(*) from h where n = 1) as singleton_strata,
      (select count(*) from (select stratum from roster group by stratum having count(distinct state) > 1))
        as strata_shared_by_regions,
      (select count(*) from roster) - (select count(*) from (select distinct stratum, psu from roster))
        as keys_lost_without_region"""))
def g11(spark, sf_dir):
    return V.roster_audit(cohort(spark, sf_dir), design_frame(spark, sf_dir), roster(spark, sf_dir), DESIGN, "state")


@query("cohort_scope", with_views("""
    select count(*) as n, count(*) filter (sector = 0) as n_control, count(*) filter (sector = 1) as n_treated,
      count(*) filter (outcome not in (0, 1)) as invalid_outcomes, count(*) filter (not weight > 0) as invalid_weights,
      100 * (sum(weight * outcome) filter (sector = 1) / sum(weight) filter (sector = 1)
        - sum(weight * outcome) filter (sector = 0) / sum(weight) filter (sector = 0)) as observed_gap_pp,
      (select count(*) from (select distinct state, stratum, psu from cohort)) as design_psus,
      (select count(*) from (select distinct state, stratum from cohort)) as design_strata from cohort"""))
def g12(spark, sf_dir):
    return V.cohort_scope(cohort(spark, sf_dir), DESIGN, "outcome", "sector")
