"""Stochastic level draws and pooling over the survey view."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.operators import impute as I
from surveyloom.plans.registry import query
from surveyloom.plans.tables import cohort, design_frame, with_views


@query("draw_category", with_views("""
    , u as (select *, ('0x' || substr(sha256(concat_ws('|', '5', row_id)), 1, 8))::bigint / 4294967296e0 as u from design_frame)
    select row_id, coalesce(social_group, case when u < 0.5e0 * e_hat then 1 when u < 0.5e0 * e_hat + 0.3e0 * e_hat then 2
      when u < 0.5e0 * e_hat + 0.3e0 * e_hat + 0.2e0 * (1 - e_hat) then 3 else 4 end) as completed from u"""))
def j2(spark, sf_dir):
    e = F.col("e_hat")
    p = [0.5 * e, 0.3 * e, 0.2 * (1 - e), 1 - 0.8 * e - 0.2 * (1 - e)]
    drawn = I.draw_category(design_frame(spark, sf_dir), [1, 2, 3, 4], p, ["row_id"], 5, "social_group", "completed")
    return drawn.select("row_id", "completed")


@query("rubin_pool", with_views("""
    , e as (select wave, nation, sum(weight * outcome) / sum(weight) as est, var_pop(outcome) / count(*) as v,
        count(*) - 1 as d from cohort group by all),
      p as (select wave, count(*) as imputations, avg(est) as pooled, avg(v) as within, var_samp(est) as between,
        min(d) * 1e0 as d from e group by wave),
      t as (select *, within + (1 + 1e0 / imputations) * between as total, (1 + 1e0 / imputations) * between / total as f from p)
    select wave, imputations, pooled, within, between, total, sqrt(total) as se,
      1 / (f * f / (imputations - 1) + 1 / ((d + 1) / (d + 3) * d * (1 - f))) as pooling_df, f as between_fraction,
      sqrt(between / imputations) as monte_carlo_se from t"""))
def j3(spark, sf_dir):
    estimates = cohort(spark, sf_dir).groupBy("wave", "nation").agg(
        (F.sum(F.col("weight") * F.col("outcome")) / F.sum("weight")).alias("est"),
        (F.var_pop("outcome") / F.count("*")).alias("v"), (F.count("*") - 1).alias("d"))
    return I.rubin_pool(estimates, ["wave"], "est", "v", "d")
