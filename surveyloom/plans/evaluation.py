"""Prediction metrics over the given tables."""

from __future__ import annotations

from surveyloom.operators import evaluate as E
from surveyloom.plans.profiles import labelled_documents
from surveyloom.plans.ranking import PARTITION_SQL, partitioned
from surveyloom.plans.registry import query
from surveyloom.plans.tables import cohort, with_views

GRID = [round(i / 100, 2) for i in range(5, 96)]


@query("confusion_metrics", with_views("""
    , c as (select state, coalesce(sum(weight) filter (mu1_hat >= 0.5 and outcome = 1), 0) as tp,
        coalesce(sum(weight) filter (mu1_hat >= 0.5 and outcome = 0), 0) as fp,
        coalesce(sum(weight) filter (mu1_hat < 0.5 and outcome = 1), 0) as fn,
        coalesce(sum(weight) filter (mu1_hat < 0.5 and outcome = 0), 0) as tn from cohort group by state)
    select state, tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) as accuracy, tp / (tp + fp) as precision,
      tp / (tp + fn) as recall, tn / (tn + fp) as specificity, 2 * tp / (2 * tp + fp + fn) as f1 from c"""))
def k1(spark, sf_dir):
    return E.confusion_metrics(cohort(spark, sf_dir), "outcome", "mu1_hat", 0.5, "weight", ["state"])


SCORES_SQL = """
    , c as (select wave, mu1_hat as p, coalesce(sum(weight) filter (outcome = 1), 0) as pos,
        coalesce(sum(weight) filter (outcome = 0), 0) as neg from cohort group by all),
      r as (select *, sum(neg) over (partition by wave order by p) - neg as neg_below,
        sum(pos) over (partition by wave order by p desc) as pos_up,
        sum(pos + neg) over (partition by wave order by p desc) as all_up from c)
"""


@query("roc_auc", with_views(SCORES_SQL + """
    select wave, sum(pos * (neg_below + neg / 2)) / (sum(pos) * sum(neg)) as roc_auc from r group by wave"""))
def k2(spark, sf_dir):
    return E.roc_auc(cohort(spark, sf_dir), "outcome", "mu1_hat", "weight", ["wave"])


@query("average_precision", with_views(SCORES_SQL + """
    select wave, sum(pos * pos_up / all_up) / sum(pos) as average_precision from r group by wave"""))
def k3(spark, sf_dir):
    return E.average_precision(cohort(spark, sf_dir), "outcome", "mu1_hat", "weight", ["wave"])


@query("document_ranking_metrics", """
    with c as (select n_chars as p, count(*) filter (quality = 1) * 1e0 as pos, count(*) filter (quality = 0) * 1e0 as neg
        from documents join labels using (doc_id) group by all),
      r as (select *, sum(neg) over (order by p) - neg as neg_below, sum(pos) over (order by p desc) as pos_up,
        sum(pos + neg) over (order by p desc) as all_up from c)
    select sum(pos * (neg_below + neg / 2)) / (sum(pos) * sum(neg)) as roc_auc,
      sum(pos * pos_up / all_up) / sum(pos) as average_precision from r""")
def k2_documents(spark, sf_dir):
    return E.ranking_metrics(labelled_documents(spark, sf_dir), "quality", "n_chars")


@query("brier", with_views("""
    select state, count(*) as n, sum(weight * (mu1_hat - outcome) ^ 2) / sum(weight) as brier from cohort group by state"""))
def k4(spark, sf_dir):
    return E.brier(cohort(spark, sf_dir), "outcome", "mu1_hat", "weight", ["state"])


@query("calibration_curve", with_views("""
    , e as (select unnest(quantile_cont(mu1_hat, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as e from cohort)
    select cast((select count(*) from e where e < mu1_hat) as int) as bin, count(*) as n, avg(mu1_hat) as mean_predicted,
      avg(outcome) as fraction_positive from cohort group by bin"""))
def k5(spark, sf_dir):
    return E.calibration_curve(cohort(spark, sf_dir), "outcome", "mu1_hat", 10)


SWEEP_SQL = """
    , g as (select i / 100e0 as threshold from range(5, 96) t(i)),
      c as (select threshold, count(*) filter (mu1_hat >= threshold and outcome = 1) * 1e0 as tp,
        count(*) filter (mu1_hat >= threshold and outcome = 0) * 1e0 as fp,
        count(*) filter (mu1_hat < threshold and outcome = 1) * 1e0 as fn,
        count(*) filter (mu1_hat < threshold and outcome = 0) * 1e0 as tn from cohort, g group by threshold),
      sweep as (select threshold, (tp + tn) / (tp + fp + fn + tn) as accuracy,
        case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, tp / (tp + fn) as recall,
        tn / (tn + fp) as specificity, case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1,
        tp / (tp + fn) + tn / (tn + fp) - 1 as youden_j, (tp + fp) / (tp + fp + fn + tn) as positive_rate from c)
"""


@query("threshold_sweep", with_views(SWEEP_SQL + "select * from sweep"))
def k6(spark, sf_dir):
    return E.threshold_sweep(cohort(spark, sf_dir), "outcome", "mu1_hat", GRID)


@query("choose_thresholds", with_views(SWEEP_SQL + """
    , p as (select 'default' as strategy, (select threshold from sweep order by abs(threshold - 0.5), threshold limit 1) as threshold
      union all select 'max_f1', (select threshold from sweep order by f1 desc, threshold limit 1)
      union all select 'max_youden', (select threshold from sweep order by youden_j desc, threshold limit 1)
      union all select 'target_recall', (select max(threshold) from sweep where recall >= 0.8))
    select * from p join sweep using (threshold)"""))
def k7(spark, sf_dir):
    return E.choose_thresholds(E.threshold_sweep(cohort(spark, sf_dir), "outcome", "mu1_hat", GRID), 0.8)


COEFFICIENTS = {"maternal_age": 0.02, "education_years": -0.05, "wealth_index": 0.3}


@query("linear_attribution", with_views("""
    , l as (select weight, feature, value from (select weight, cast(maternal_age as double) as maternal_age,
        cast(education_years as double) as education_years, cast(wealth_index as double) as wealth_index from cohort)
        unpivot (value for feature in (maternal_age, education_years, wealth_index))),
      m as (select feature, sum(weight * value) / sum(weight) as m from l group by feature)
    select feature, sum(weight * abs(case feature when 'maternal_age' then 0.02e0 when 'education_years' then -0.05e0
      else 0.3e0 end * (value - m))) / sum(weight) as mean_abs_contribution from l join m using (feature) group by feature"""))
def k11(spark, sf_dir):
    return E.linear_attribution(cohort(spark, sf_dir), COEFFICIENTS, "weight")


@query("split_missingness", with_views(PARTITION_SQL + """
    , d as (select cohort.*, partition from cohort join part using (mother_id))
    """ + " union all ".join(f"""
    select '{c}' as variable, 100e0 * avg(case when {c} is null then 1 else 0 end) filter (partition = 'train') as train_missing_pct,
      100e0 * avg(case when {c} is null then 1 else 0 end) filter (partition = 'test') as test_missing_pct,
      test_missing_pct - train_missing_pct as difference from d""" for c in ("education_years", "social_group"))))
def k12(spark, sf_dir):
    return E.split_missingness(partitioned(spark, sf_dir), ["education_years", "social_group"], "partition", "train", "test")


@query("evaluation_sums", with_views("""
    select state, sum(weight) as weight_sum, sum(weight * -(outcome * ln(e_hat) + (1 - outcome) * ln(1 - e_hat))) / sum(weight) as log_loss,
      sum(weight * (e_hat - outcome) ^ 2) / sum(weight) as brier, 100 * sum(weight * mu0_hat) / sum(weight) as standardized_control_pct,
      100 * sum(weight * mu1_hat) / sum(weight) as standardized_treated_pct,
      100 * (sum(weight * mu1_hat) - sum(weight * mu0_hat)) / sum(weight) as standardized_gap_pp,
      100 * sum(weight * outcome) / sum(weight) as observed_pct, 100 * sum(weight * e_hat) / sum(weight) as predicted_pct
    from cohort group by rollup (state)"""))
def h18(spark, sf_dir):
    return E.evaluation_sums(cohort(spark, sf_dir), "outcome", "e_hat", "mu1_hat", "mu0_hat", "weight", ["state"])
