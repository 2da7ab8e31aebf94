"""Weighted outcome gap between two arms under three single-cluster rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.operators import variance as V
from surveyloom.plans.registry import query
from surveyloom.plans.tables import DESIGN, cohort, roster, with_views

# Roster-aware covariance of the row columns u_control, u_treated and u_gap of a view "lin".
ROSTER_SQL = """
    , tot as (select state, stratum, psu, sum(u_control) as u0, sum(u_treated) as u1, sum(u_gap) as u2
        from lin group by state, stratum, psu),
      al as (select state, stratum, psu, coalesce(u0, 0) as u0, coalesce(u1, 0) as u1, coalesce(u2, 0) as u2,
          u0 is not null as in_domain
        from (select * from roster semi join tot using (state, stratum)) left join tot using (state, stratum, psu)),
      lg as (select state, stratum, psu, in_domain, key, u from al unpivot (u for key in (u0, u1, u2))),
      gm as (select key, avg(u) as g from lg group by key),
      pr as (select a.state, a.stratum, a.key as i, b.key as j, count(*) as n, sum(a.u) as si, sum(b.u) as sj,
          sum(a.u * b.u) as p, sum(a.u) as li, sum(b.u) as lj
        from lg a join lg b using (state, stratum, psu) group by all),
      cv as (select i, j, sum(case when n > 1 then n / (n - 1e0) * (p - si * sj / n) else 0 end) as base,
          sum(case when n = 1 then (li - gi.g) * (lj - gj.g) else 0 end) as lonely,
          count(*) filter (n = 1) as k, count(*) filter (n > 1) as r, sum(n) - count(*) as df
        from pr join gm gi on gi.key = i join gm gj on gj.key = j group by i, j),
      cov as (
        select 'adjust' as singleton, i, j, base + lonely as cov, df from cv union all
        select 'average', i, j, base + k * base / r, df from cv union all
        select 'zero', i, j, base, df from cv)
"""

# Row-level influence columns of the two arm means over the view "src".
INFLUENCE_SQL = """
    , arm as (select sum(weight) filter (sector = 0) as w0, sum(weight) filter (sector = 1) as w1,
        sum(weight * outcome) filter (sector = 0) / sum(weight) filter (sector = 0) as p0,
        sum(weight * outcome) filter (sector = 1) / sum(weight) filter (sector = 1) as p1 from src),
      lin as (select src.*, case when sector = 0 then weight * (outcome - p0) / w0 else 0 end as u_control,
        case when sector = 1 then weight * (outcome - p1) / w1 else 0 end as u_treated,
        u_treated - u_control as u_gap from src, arm)
"""


@query("gap_with_roster_variance", with_views(", src as (select * from cohort)" + INFLUENCE_SQL + ROSTER_SQL + """
    select singleton, p1 - p0 as gap, sqrt(cov) as se, cast(df as bigint) as design_df,
      gap - 1.96 * se as ci_low, gap + 1.96 * se as ci_high from cov, arm where i = 'u2' and j = 'u2'"""))
def gap_with_roster_variance(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    mean = lambda a: V.domain_share(rows, "weight", "outcome", F.col("sector") == a)[0]
    linear = V.arm_influences(rows, DESIGN, "outcome", "sector")
    cov = V.roster_covariance(linear, DESIGN, ["u_gap"], roster(spark, sf_dir))
    estimates = cov.select("singleton", (mean(1) - mean(0)).alias("gap"),
                           F.sqrt(F.greatest("cov", F.lit(0.0))).alias("se"), "design_df")
    return V.intervals(estimates, "gap", "se", V.NORMAL_CRITICAL)
