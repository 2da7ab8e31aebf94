"""Fitted operators on saturated models, whose results have closed forms that SQL can state.

With the exposure, one categorical and their interaction, and next to no penalty, fitted
probabilities are the weighted means of the cells. Without confounders, cross-fitted scores
are the means of the other folds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.operators import encoding as E
from surveyloom.operators import nuisance as N
from surveyloom.operators import standardize as S
from surveyloom.operators import variance as V
from surveyloom.operators.profile import with_support
from surveyloom.operators.scale import cut
from surveyloom.plans.bootstraps import REPS, SEED, draws_sql, slots_sql
from surveyloom.plans.fitted import authorized, imputed_gaps, mothers, social_shares, split_by_context, targeted_sql, without_group
from surveyloom.plans.models import with_periods
from surveyloom.plans.ranking import PARTITION_SQL, partitioned
from surveyloom.plans.registry import query
from surveyloom.plans.tables import DESIGN, cohort, roster, with_views

TINY, FOLDS = 1e-12, 5
METRICS = [f"{kind}_{arm}" for kind in ("observed", "adjusted") for arm in ("control", "treated", "gap")]

CELLS = """
    , cells as (select sector, residence, sum(weight) as cw, sum(weight * outcome) / sum(weight) as p from cohort group by all)"""


def saturated_encoding(rows):
    return E.learn_encoding(rows, "sector", {}, ["residence"], interactions=[("residence", "2")])


@query("fit_weighted_logit_saturated", with_views(CELLS + """
    , l as (select max(ln(p / (1 - p))) filter (sector = 0 and residence = 1) as l01, max(ln(p / (1 - p))) filter (sector = 1 and residence = 1) as l11,
        max(ln(p / (1 - p))) filter (sector = 0 and residence = 2) as l02, max(ln(p / (1 - p))) filter (sector = 1 and residence = 2) as l12 from cells)
    select 'intercept' as term, l01 as coefficient from l union all select 'sector', l11 - l01 from l
    union all select 'residence=2', l02 - l01 from l union all select 'sector:residence=2', l12 - l02 - l11 + l01 from l
    union all select 'residence=__MISSING__', 0 union all select 'residence=__UNKNOWN__', 0"""))
def h3_saturated(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return S.coefficients(rows, S.fit_weighted_logit(rows, saturated_encoding(rows), "outcome", "weight", TINY))


def intervals_sql(keys: list[str], points: list[str], names: dict[str, str] | None = None) -> str:
    """Design intervals, in percent, of influences whose cluster totals stand in ``u``; ``points`` give the estimates."""
    named = "key" if names is None else f"case key {' '.join(f"when '{k}' then '{n}'" for k, n in names.items())} end"
    return f"""al as (select state, stratum, psu, {", ".join(f"coalesce({k}, 0) as {k}" for k in keys)}
        from (select * from roster semi join u using (state, stratum)) left join u using (state, stratum, psu)),
      lg as (select * from al unpivot (v for key in ({", ".join(keys)}))),
      st as (select key, state, stratum, count(*) as n, sum(v) as sv, sum(v * v) as qv from lg group by all),
      g as (select key, avg(v) as g from lg group by key),
      c as (select key, sum(case when n > 1 then n / (n - 1e0) * (qv - sv * sv / n) else 0 end) as base,
        sum(case when n = 1 then (sv - g) * (sv - g) else 0 end) as lonely, count(*) filter (n = 1) as singles,
        count(*) filter (n > 1) as regular, cast(sum(n) - count(*) as bigint) as design_df from st join g using (key) group by key),
      w as (select key, 'adjust' as singleton, base + lonely as cov, design_df from c
        union all select key, 'average', base + singles * base / regular, design_df from c union all select key, 'zero', base, design_df from c),
      pt as ({" union all ".join(points)}),
      z as (select {named} as metric, singleton, 100 * value as estimate,
        100 * sqrt(greatest(cov, 0)) as se, design_df from w join pt using (key))
    select *, estimate - 1.96 * se as ci_low, estimate + 1.96 * se as ci_high from z"""


def models_sql(models: dict[str, tuple[str, str]], differences: dict[str, tuple[str, str]], before: str = "") -> str:
    """Adjusted gaps of saturated models (training rows, reference rows) and differences of them, with design intervals."""
    parts, joins = [], ""
    for i, (train, ref) in enumerate(models.values()):
        parts.append(f"""
      c{i} as (select sector, residence, sum(weight) as cw, sum(weight * outcome) / sum(weight) as p from b where {train} group by all),
      r{i} as (select residence, max(p) filter (sector = 0) as p0, max(p) filter (sector = 1) as p1, max(cw) filter (sector = 0) as cw0,
        max(cw) filter (sector = 1) as cw1 from c{i} group by residence),
      s{i} as (select residence, sum(weight) / max((select sum(weight) from b where {ref})) as pi from b where {ref} group by residence),
      q{i} as (select sum(pi * (p1 - p0)) as v, max((select sum(weight) from b where {ref})) as rw from s{i} join r{i} using (residence)),
      x{i} as (select residence, p0, p1, cw0, cw1, coalesce(pi, 0) as pi, v, rw from r{i} left join s{i} using (residence), q{i})""")
        joins += f" left join x{i} on x{i}.residence = b.residence"
    value = lambda i, train, ref: (
        f"(case when {train} and sector = 1 then weight * (outcome - x{i}.p1) / x{i}.cw1 * x{i}.pi when {train} and sector = 0 then"
        f" -weight * (outcome - x{i}.p0) / x{i}.cw0 * x{i}.pi else 0 end + case when {ref} then weight / x{i}.rw * (x{i}.p1 - x{i}.p0 - x{i}.v) else 0 end)")
    own = {name: value(i, *rows) for i, (name, rows) in enumerate(models.items())}
    place = {name: i for i, name in enumerate(models)}
    sums = {**own, **{name: f"{own[one]} - {own[other]}" for name, (one, other) in differences.items()}}
    points = [f"select 'm_{n}' as key, v as value from q{i}" for n, i in place.items()]
    points += [f"select 'm_{n}', q{place[one]}.v - q{place[other]}.v from q{place[one]}, q{place[other]}" for n, (one, other) in differences.items()]
    return with_views(f"""{before}
    , b as (select * from {"cohort" if not before else "marked"}), {",".join(parts)},
      u as (select b.state, b.stratum, b.psu, {", ".join(f"sum({v}) as m_{k}" for k, v in sums.items())} from b{joins} group by all),
      {intervals_sql([f"m_{k}" for k in sums], points, {f"m_{k}": k for k in sums})}""")


def influence_sql(names: list[str], mask: str = "true") -> str:
    """Points, cluster totals of the influences and intervals of saturated arm means over the rows of ``mask``."""
    row = {}
    for a, arm in ((0, "control"), (1, "treated")):
        row[f"observed_{arm}"] = f"case when inside and sector = {a} then weight * (outcome - o{a}) / ow{a} else 0 end"
        row[f"adjusted_{arm}"] = (f"case when inside then weight / rw * (p{a} - q{a}) else 0 end"
                                  f" + case when sector = {a} then weight * (outcome - p{a}) / cw{a} * coalesce(pi, 0) else 0 end")
    for kind in ("observed", "adjusted"):
        row[f"{kind}_gap"] = f"({row[f'{kind}_treated']}) - ({row[f'{kind}_control']})"
    value = {"observed_control": "o0", "observed_treated": "o1", "observed_gap": "o1 - o0",
             "adjusted_control": "q0", "adjusted_treated": "q1", "adjusted_gap": "q1 - q0"}
    keys = METRICS
    return with_views(CELLS + f"""
    , b as (select *, {mask} as inside from cohort),
      t as (select sum(weight) as rw, sum(weight) filter (sector = 0) as ow0, sum(weight) filter (sector = 1) as ow1,
        sum(weight * outcome) filter (sector = 0) / ow0 as o0, sum(weight * outcome) filter (sector = 1) / ow1 as o1 from b where inside),
      r as (select residence, max(p) filter (sector = 0) as p0, max(p) filter (sector = 1) as p1, max(cw) filter (sector = 0) as cw0,
        max(cw) filter (sector = 1) as cw1 from cells group by residence),
      s as (select residence, sum(weight) / max(rw) as pi from b, t where inside group by residence),
      q as (select sum(pi * p0) as q0, sum(pi * p1) as q1 from s join r using (residence)),
      u as (select state, stratum, psu, {", ".join(f"sum({row[k]}) as {k}" for k in keys)}
        from b join r using (residence) left join s using (residence), t, q group by state, stratum, psu),
      {intervals_sql(keys, [f"select '{k}' as key, {value[k]} as value from t, q" for k in keys], dict(zip(keys, names)))}""")


@query("standardized_gap_saturated", influence_sql(METRICS))
def h5_saturated(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return S.standardized_gap(rows, saturated_encoding(rows), DESIGN, "outcome", roster(spark, sf_dir), TINY, V.NORMAL_CRITICAL)


@query("reference_targets_saturated", influence_sql([f"kept__{m}" for m in METRICS], "state <> 3"))
def h6_saturated(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    model = S.fit_weighted_logit(rows, saturated_encoding(rows), "outcome", "weight", TINY)
    linear, points = S.reference_influence(rows, model, "outcome", "weight", {"kept": F.col("state") != 3})
    return S.estimate_rows(linear, points, DESIGN, roster(spark, sf_dir), V.NORMAL_CRITICAL)


def folds_sql(within: str = "1", where: str = "true") -> str:
    """Rows with their fold and the means of the other folds, apart for each value of ``within``."""
    other = lambda v, test: f"(sum({v}) filter ({test}) over (partition by lv) - sum({v}) filter ({test}) over (partition by lv, fold))"
    ratio = lambda v, test: f"{other(f'weight * {v}', test)} / {other('weight', test)}"
    return f"""
    , lv as (select *, {within} as lv from cohort where {where}),
      gr as (select lv, mother_id, cast(floor(avg(sector) * 4) as int) as c from lv group by all),
      fo as (select *, row_number() over (partition by lv, c order by sha256(concat_ws('|', '{SEED}', mother_id))) as k from gr),
      f as (select lv.*, cast((k - 1 + c) % {FOLDS} as int) as fold from lv join fo using (lv, mother_id)),
      sc as (select *, {ratio('sector', 'true')} as e_fit, {ratio('outcome', 'sector = 1')} as mu1_fit,
        {ratio('outcome', 'sector = 0')} as mu0_fit from f),
      s as (select *, mu1_fit + sector / e_fit * (outcome - mu1_fit) as psi1,
        mu0_fit + (1 - sector) / (1 - e_fit) * (outcome - mu0_fit) as psi0 from sc)"""


def plain_scores(rows, by=()):
    return N.cross_fit_within(rows, by, {}, [], "sector", "outcome", "weight", ["mother_id"], FOLDS, SEED, "logistic", TINY)


@query("cross_fit_saturated", with_views(folds_sql() + " select row_id, fold, e_fit, mu1_fit, mu0_fit from sc"))
def i1_saturated(spark, sf_dir):
    return plain_scores(cohort(spark, sf_dir)).select("row_id", "fold", "e_fit", "mu1_fit", "mu0_fit")


def aipw_sql(by: str, within: str) -> str:
    """Doubly robust risks per level with limits from draws of clusters that all levels share."""
    return with_views(folds_sql(within) + ", t as (select distinct state, stratum, psu from s)," + slots_sql("t") + "," + draws_sql() + f"""
    , tot as (select {by} as level, state, stratum, psu, sum(weight) as w, sum(weight * psi1) as w1, sum(weight * psi0) as w0 from s group by all),
      reps as (select level, replicate, sum(w) as w, sum(w1) as w1, sum(w0) as w0
        from draws join slots using (state, stratum, slot) join tot using (state, stratum, psu) group by all),
      lim as (select level, quantile_cont((w1 - w0) / w, 0.025) as rd_low, quantile_cont((w1 - w0) / w, 0.975) as rd_high,
        quantile_cont(w1 / nullif(w0, 0), 0.025) as rr_low, quantile_cont(w1 / nullif(w0, 0), 0.975) as rr_high from reps group by level),
      pt as (select {by} as level, count(*) as n, sum(weight * psi1) / sum(weight) as risk_treated, sum(weight * psi0) / sum(weight) as risk_control
        from s group by level)
    select level, n, risk_treated, risk_control, risk_treated - risk_control as risk_difference, risk_treated / risk_control as risk_ratio,
      rd_low, rd_high, rr_low, rr_high from pt join lim using (level)""")


@query("fitted_aipw_saturated", aipw_sql("residence", "1"))
def i1_aipw_saturated(spark, sf_dir):
    return N.fitted_aipw(plain_scores(cohort(spark, sf_dir)), DESIGN, "outcome", "sector", REPS, SEED, ["residence"]).withColumnRenamed(
        "residence", "level")


@query("stratified_aipw_saturated", aipw_sql("residence", "residence"))
def i19_saturated(spark, sf_dir):
    """Nuisance models fitted within each level."""
    rows = plain_scores(cohort(spark, sf_dir), ["residence"])
    return N.fitted_aipw(rows, DESIGN, "outcome", "sector", REPS, SEED, ["residence"]).withColumnRenamed("residence", "level")


PERIOD_SQL = "case when event_cmc < 1177 then 'A' when event_cmc < 1195 then 'B' when event_cmc < 1210 then 'C' else 'D' end"


@query("period_gaps_saturated", with_views(f"""
    , d as (select *, {PERIOD_SQL} as period, wave || '|' || {PERIOD_SQL} as dom from cohort),
      sup as (select dom, wave, period, state, count(*) as n, count(*) filter (sector = 0) >= 12 and count(*) filter (sector = 1) >= 12 as own,
        sum(outcome) as events from d group by all),
      ty as (select dom, wave, period, cast(sum(n) as bigint) as eligible_n, cast(coalesce(sum(n) filter (own), 0) as bigint) as model_n,
        count(*) filter (own) as units_retained, coalesce(string_agg(cast(state as varchar), '|' order by state) filter (not own), '') as units_excluded,
        coalesce(sum(events) filter (own), 0) as events from sup group by all),
      ok as (select dom from ty where model_n >= 100 and events between 1 and model_n - 1),
      common as (select state from sup where own group by state having count(*) = (select count(*) from ty)),
      """ + slots_sql("roster") + "," + draws_sql() + """
    , times as (select state, stratum, psu, replicate, count(*) as m from draws join slots using (state, stratum, slot) group by all
        union all select state, stratum, psu, 0, 1 from roster),
      kept as (select d.* from d join ok using (dom) join sup using (dom, state) where own),
      c as (select dom, replicate, residence, sector, sum(weight * m) as w, sum(weight * m * outcome) / sum(weight * m) as p
        from kept join times using (state, stratum, psu) group by all),
      r as (select dom, replicate, residence, sum(w) as w, max(p) filter (sector = 1) - max(p) filter (sector = 0) as diff from c group by all),
      g as (select dom, replicate, 100 * sum(w * diff) / sum(w) as gap from r group by all),
      tg as (select residence, sum(weight) as w from d semi join common using (state) group by residence),
      cg as (select dom, 100 * sum(tg.w * diff) / sum(tg.w) as common_target_gap_pp from r join tg using (residence) where replicate = 0 group by dom),
      b as (select dom, max(gap) filter (replicate = 0) as own_target_gap_pp, cast(count(gap) filter (replicate > 0) as int) as replicates_ok,
        quantile_cont(gap, 0.025) filter (replicate > 0) as ci_low, quantile_cont(gap, 0.975) filter (replicate > 0) as ci_high from g group by dom)
    select wave, period, eligible_n, model_n, units_retained, units_excluded, own_target_gap_pp, common_target_gap_pp, replicates_ok,
      case when replicates_ok >= 475 then ci_low end as ci_low, case when replicates_ok >= 475 then ci_high end as ci_high,
      case when own_target_gap_pp is null then 'insufficient_data' when replicates_ok >= 475 then 'interval' else 'too_few_replicates' end as status
    from ty left join b using (dom) left join cg using (dom)"""))
def h12_saturated(spark, sf_dir):
    """Refits in every replicate: with a saturated model these are the replicate's own cell means."""
    rows = with_periods(spark, sf_dir)
    return S.period_gaps(rows, saturated_encoding(rows), DESIGN, "outcome", ["wave", "period"], "state", 12, TINY, roster(spark, sf_dir), REPS, SEED)


SPREAD = "".join(f", (select quantile_cont(e_fit, {q}) from s where sector = {a}) as propensity_{c}_{a}"
                 for a in (0, 1) for c, q in (("minimum", 0), ("median", 0.5), ("maximum", 1)))


@query("exclusion_variant_saturated", targeted_sql(folds_sql(where="coalesce(social_group, 0) <> 4"), "s", "e_fit", "mu1_fit", "mu0_fit", SPREAD))
def i25_saturated(spark, sf_dir):
    return without_group(cohort(spark, sf_dir), plain_scores)


def imputed_sql(draws: int = 30) -> str:
    """Pooled gaps after imputing a two-level group by its weighted shares; models with arm, group and their product."""
    uniform = lambda text: f"('0x' || substr(sha256({text}), 1, 8))::bigint / 4294967296e0"
    row = {}
    for a, arm in ((0, "control"), (1, "treated")):
        row[f"observed_{arm}"] = f"case when sector = {a} then weight * (outcome - o{a}) / ow{a} else 0 end"
        row[f"adjusted_{arm}"] = f"weight / rw * (p{a} - q{a}) + case when sector = {a} then weight * (outcome - p{a}) / cw{a} * pi else 0 end"
    for kind in ("observed", "adjusted"):
        row[f"{kind}_gap"] = f"({row[f'{kind}_treated']}) - ({row[f'{kind}_control']})"
    value = {"observed_control": "o0", "observed_treated": "o1", "observed_gap": "o1 - o0", "adjusted_control": "q0", "adjusted_treated": "q1", "adjusted_gap": "q1 - q0"}
    dom = "wave, cohort, m"
    return with_views(f"""
    , k as (select *, case when social_group <= 2 then 1 when social_group <= 4 then 2 end as half from cohort),
      un as (select wave, mother_id, state, stratum, psu, max(half) as half, avg(weight) as mw from k group by all),
      im as (select m from range(1, {draws + 1}) t(m)),
      e as (select un.*, m, -ln(1 - {uniform("concat_ws('|', m, state, stratum, psu)")}) as e from un, im),
      f as (select *, e / avg(e) over (partition by wave, m, state, stratum) as f from e),
      sh as (select wave, m, sum(mw * f) filter (half = 1) / sum(mw * f) as p1 from f where half is not null group by all),
      dr as (select wave, m, mother_id, coalesce(half, case when {uniform("concat_ws('|', 'impute' || m, mother_id)")} < p1 then 1 else 2 end) as level
        from un join sh using (wave)),
      d as (select k.*, c.cohort, m, level from k join dr using (wave, mother_id), (values ('all'), ('first_delivery')) c(cohort)
        where c.cohort = 'all' or delivery_order = 1),
      ce as (select {dom}, level, sector, sum(weight) as cw, sum(weight * outcome) / sum(weight) as p from d group by all),
      t as (select {dom}, sum(weight) as rw, sum(weight) filter (sector = 0) as ow0, sum(weight) filter (sector = 1) as ow1,
        sum(weight * outcome) filter (sector = 0) / ow0 as o0, sum(weight * outcome) filter (sector = 1) / ow1 as o1 from d group by all),
      r as (select {dom}, level, max(p) filter (sector = 0) as p0, max(p) filter (sector = 1) as p1, max(cw) filter (sector = 0) as cw0,
        max(cw) filter (sector = 1) as cw1, sum(cw) as lw from ce group by all),
      q as (select {dom}, sum(lw * p0) / sum(lw) as q0, sum(lw * p1) / sum(lw) as q1 from r group by all),
      a as (select *, lw / rw as pi from d join r using ({dom}, level) join t using ({dom}) join q using ({dom})),
      u as (select {dom}, state, stratum, psu, {", ".join(f"sum({row[x]}) as {x}" for x in METRICS)} from a group by all),
      lg as (select * from u unpivot (v for metric in ({", ".join(METRICS)}))),
      rs as (select state, stratum, count(*) as n from roster group by all),
      st as (select {dom}, metric, state, stratum, max(n) as n, sum(v) as s, sum(v * v) as qq from lg join rs using (state, stratum) group by all),
      g as (select {dom}, metric, sum(s) / sum(n) as g, cast(sum(n) - count(*) as double) as design_df from st group by all),
      va as (select {dom}, metric, max(design_df) as design_df, 1e4 * sum(case when n > 1 then n / (n - 1e0) * (qq - s * s / n) else (s - g) * (s - g) end) as v
        from st join g using ({dom}, metric) group by all),
      pt as (select {dom}, metric, 100 * value as est from (select {dom}, {", ".join(f"{v} as {x}" for x, v in value.items())} from t join q using ({dom}))
        unpivot (value for metric in ({", ".join(METRICS)}))),
      po as (select wave, cohort, metric, count(*) as imputations, avg(est) as pooled, avg(v) as within, var_samp(est) as between, min(design_df) as d
        from pt join va using ({dom}, metric) group by all),
      z as (select *, within + (1 + 1e0 / imputations) * between as total, (1 + 1e0 / imputations) * between / total as f from po)
    select wave, cohort, metric, imputations, pooled, within, between, total, sqrt(total) as se,
      1 / (f * f / (imputations - 1) + 1 / ((d + 1) / (d + 3) * d * (1 - f))) as pooling_df, f as between_fraction,
      sqrt(between / imputations) as monte_carlo_se from z where metric like 'adjusted%'""")


@query("impute_and_reestimate_saturated", imputed_sql())
def j4_saturated(spark, sf_dir):
    rows = cohort(spark, sf_dir).withColumn("social_group", F.when(F.col("social_group") <= 2, 1).when(F.col("social_group") <= 4, 2))
    plain = lambda data, name: E.learn_encoding(data, "sector", {}, ["social_group"], interactions=[("social_group", "2")])
    pooled = imputed_gaps(rows, roster(spark, sf_dir), plain, lambda units: E.learn_encoding(units, None, {}, []), ridge=TINY)
    # observed means do not depend on the group: their variance between imputations is rounding
    return pooled.where("metric like 'adjusted%'").drop("baseline", "baseline_se", "change_from_baseline")


def _mix_sql(name: str, label: str, inner: str, fine: str, coarse: str) -> str:
    """Shares of two learners per outer fold; both are weighted means, of the cells ``fine`` and of the cells ``coarse``."""
    of = lambda keys: f", {keys}" if keys else ""
    using = lambda keys: f"f, i{of(keys)}"
    means = lambda cte, keys: f"""
      {cte}s as (select f, {inner} as i{of(keys)}, sum(weight) as w, sum(weight * {label}) as v from tr group by all),
      {cte}a as (select f{of(keys)}, sum(w) as w, sum(v) as v from {cte}s group by all),
      {cte} as (select k.f, t.i{of(', '.join("a." + x.strip() for x in keys.split(",")) if keys else "")}, (a.v - coalesce(o.v, 0)) / (a.w - coalesce(o.w, 0)) as p
        from (select distinct f from tr) k join {cte}a a on a.f = k.f cross join range(0, 3) t(i) left join {cte}s o on o.f = k.f and o.i = t.i
        {"".join(f" and o.{x.strip()} = a.{x.strip()}" for x in keys.split(",")) if keys else ""})"""  # noqa: E731
    return f"""{means(name + "1", fine)}, {means(name + "2", coarse)},
      {name}h as (select f, {inner} as i{of(fine)}, {label} as y, sum(weight) as h from tr group by all),
      {name}l as (select h.f, g, sum(h * -(y * ln(p) + (1 - y) * ln(1 - p))) / sum(h) as loss from (
        select h.f, h.h, h.y, g, greatest(1e-6, least(1 - 1e-6, a.p * (g / 1e2) + b.p * (1 - g / 1e2))) as p from {name}h h
        join {name}1 a using ({using(fine)}) join {name}2 b using ({using(coarse)}), range(0, 101) t(g)) h group by all),
      {name}w as (select f, min(loss) as log_loss, max(loss) filter (g = 100) as log_loss_one, max(loss) filter (g = 0) as log_loss_two,
        (select min(g) from {name}l x where x.f = {name}l.f and x.loss = (select min(loss) from {name}l z where z.f = {name}l.f)) / 1e2 as share
        from {name}l group by f)"""


STACKED = folds_sql().split(",\n      sc as (")[0] + f""",
      ig as (select t.f, mother_id, cast(floor(avg(sector) * 4) as int) as ca, cast(floor(avg(outcome) * 4) as int) as cy
        from f as rows join range(0, {FOLDS}) t(f) on fold <> t.f group by all),
      ir as (select f, mother_id, cast((row_number() over (partition by f, ca order by sha256(concat_ws('|', {SEED} + f, mother_id))) - 1 + ca) % 3 as int) as ie,
        cast((row_number() over (partition by f, cy order by sha256(concat_ws('|', {SEED + 100} + f, mother_id))) - 1 + cy) % 3 as int) as iq from ig),
      tr as (select rows.*, ir.f, ie, iq from f as rows join ir using (mother_id)),
      {_mix_sql("e", "sector", "ie", "residence", "")}, {_mix_sql("q", "outcome", "iq", "sector, residence", "sector")}"""


def stacked_plainly(rows, fit=N.cross_fit_stacked):
    """Two learners whose fits are means: with and without the residence."""
    used = cut(rows.select(*dict.fromkeys([*DESIGN.cluster, "weight", "sector", "outcome", "mother_id", "residence"])))  # read several times
    fine = E.learn_encoding(used, "sector", {}, ["residence"], interactions=[("residence", "2")])
    e = [N.LogitLearner(E.Encoding(None, (), fine.categorical), TINY), N.LogitLearner(E.Encoding(None, (), ()), TINY)]
    q = [N.LogitLearner(fine, TINY), N.LogitLearner(E.Encoding("sector", (), ()), TINY)]
    return fit(used, e, q, "sector", "outcome", "weight", ["mother_id"], FOLDS, 3, SEED)


@query("stack_two_learners_saturated", with_views(STACKED + """
    select 'propensity' as model, cast(f as int) as fold, share, log_loss, log_loss_one, log_loss_two from ew
    union all select 'outcome', cast(f as int), share, log_loss, log_loss_one, log_loss_two from qw"""))
def i18_saturated(spark, sf_dir):
    return stacked_plainly(cohort(spark, sf_dir), N.stacked_shares)


STACKED_SCORES = STACKED + """,
      sc as (select rows.*, ew.share * e1a.v / e1a.w + (1 - ew.share) * e2a.v / e2a.w as e_fit,
          qw.share * a1.v / a1.w + (1 - qw.share) * b1.v / b1.w as mu1_fit, qw.share * a0.v / a0.w + (1 - qw.share) * b0.v / b0.w as mu0_fit
        from f as rows join ew on ew.f = fold join qw on qw.f = fold join e1a on e1a.f = fold and e1a.residence = rows.residence join e2a on e2a.f = fold
        join q1a a1 on a1.f = fold and a1.residence = rows.residence and a1.sector = 1 join q1a a0 on a0.f = fold and a0.residence = rows.residence and a0.sector = 0
        join q2a b1 on b1.f = fold and b1.sector = 1 join q2a b0 on b0.f = fold and b0.sector = 0)"""


@query("stacked_risks_saturated", targeted_sql(STACKED_SCORES, "sc", "e_fit", "mu1_fit", "mu0_fit"))
def i18_risks_saturated(spark, sf_dir):
    found = N.targeted(stacked_plainly(cohort(spark, sf_dir))[0], DESIGN, "outcome", "sector", "e_fit", "mu1_fit", "mu0_fit", reps=REPS, seed=SEED)
    return found.withColumns({c: F.round(c, 9) + 0.0 for c in ("score_treated", "score_control")})


@query("training_population_saturated", models_sql({"all_rows": ("true", "state <> 3"), "subset": ("delivery_order <= 3", "state <> 3")},
                                                   {"difference": ("subset", "all_rows")}))
def h10_saturated(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return S.training_population_contrast(rows, saturated_encoding(rows), DESIGN, "outcome", roster(spark, sf_dir), TINY,
                                          F.col("delivery_order") <= 3, F.col("state") != 3, V.NORMAL_CRITICAL)


@query("exclusion_sensitivity_saturated", models_sql(
    {"full": ("true", "true"), "reference_only": ("true", "state <> 3"), "refit": ("state <> 3", "state <> 3")},
    {"reference_only_minus_full": ("reference_only", "full"), "refit_minus_reference_only": ("refit", "reference_only"), "refit_minus_full": ("refit", "full")}))
def h11_saturated(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return S.exclusion_sensitivity(rows, saturated_encoding(rows), DESIGN, "outcome", roster(spark, sf_dir), TINY, F.col("state") != 3, V.NORMAL_CRITICAL)


PERIOD_MODELS = {p: (f"({PERIOD_SQL}) = '{p}'", "true") for p in "ABCD"}


@query("period_influence_saturated", models_sql(PERIOD_MODELS, {"B_minus_A": ("B", "A"), "C_minus_B": ("C", "B"), "D_minus_C": ("D", "C")}))
def h13_saturated(spark, sf_dir):
    rows = with_periods(spark, sf_dir)
    found = S.period_influence(rows, saturated_encoding(rows), DESIGN, "outcome", roster(spark, sf_dir), "period", ["A", "B", "C", "D"],
                               [("B", "A"), ("C", "B"), ("D", "C")], 0.0, V.NORMAL_CRITICAL)
    return found.select("metric", "singleton", "estimate", "se", "design_df", "ci_low", "ci_high")


MASKS_SQL = """
    , m1 as (select nation from cohort group by nation having least(count(*) filter (sector = 0), count(*) filter (sector = 1)) >= (select count(*) // 60 from cohort)),
      m2 as (select state, residence from cohort group by all
        having least(count(*) filter (sector = 0), count(*) filter (sector = 1)) >= (select count(*) // 22 from cohort)),
      marked as (select *, nation in (select nation from m1) as own_nation, (state, residence) in (select (state, residence) from m2) as own_cell from cohort)"""


@query("support_scenarios_saturated", models_sql(
    {"full_reference": ("true", "true"), "nations": ("true", "own_nation"), "cells": ("true", "own_cell"), "cells_refit": ("own_cell", "own_cell")}, {}, MASKS_SQL).replace("select *, estimate - 1.96 * se as ci_low, estimate + 1.96 * se as ci_high from z", """, y as (select metric as scenario,
        z.* exclude (metric), case metric when 'full_reference' then (select count(*) from b) when 'nations' then (select count(*) from b where own_nation)
          else (select count(*) from b where own_cell) end as reference_n,
        case metric when 'full_reference' then 0e0 when 'nations' then (select 100 * coalesce(sum(weight) filter (not own_nation), 0) / sum(weight) from b)
          else (select 100 * coalesce(sum(weight) filter (not own_cell), 0) / sum(weight) from b) end as excluded_weight_pct,
        estimate - (select max(estimate) from z where metric = 'full_reference') as change_from_full_pp from z)
    select *, case when scenario <> 'cells_refit' then 2 * excluded_weight_pct end as change_bound_pp,
      estimate - 1.96 * se as ci_low, estimate + 1.96 * se as ci_high from y"""))
def h7_saturated(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    n = rows.count()
    rows = with_support(rows, ["nation"], "sector", n // 60, "weight", "own_nation")
    rows = with_support(rows, ["state", "residence"], "sector", n // 22, "weight", "own_cell")
    return S.support_scenarios(rows, saturated_encoding(rows), DESIGN, "outcome", roster(spark, sf_dir), TINY,
                               {"nations": "own_nation", "cells": "own_cell"}, ["cells"], V.NORMAL_CRITICAL)



HALF = """(select avg(maternal_age) from cohort c where c.nation = cohort.nation) >= (select quantile_cont(m, 0.5) from (select avg(maternal_age) as m
    from cohort group by nation))"""


@query("context_split_saturated", with_views(folds_sql(HALF) + ", t as (select distinct state, stratum, psu from s)," + slots_sql("t") + "," + draws_sql() + """
    , tot as (select lv, state, stratum, psu, sum(weight) as w, sum(weight * (psi1 - psi0)) as v from s group by all),
      reps as (select replicate, sum(v) filter (lv) / sum(w) filter (lv) as h, sum(v) filter (not lv) / sum(w) filter (not lv) as l
        from draws join slots using (state, stratum, slot) join tot using (state, stratum, psu) group by replicate),
      q as (select quantile_cont(h, 0.025) as hl, quantile_cont(h, 0.975) as hh, quantile_cont(l, 0.025) as ll, quantile_cont(l, 0.975) as lh,
        quantile_cont(h - l, 0.025) as difference_low, quantile_cont(h - l, 0.975) as difference_high from reps),
      g as (select lv as high, count(distinct nation) as units, count(*) as n, sum(weight * (psi1 - psi0)) / sum(weight) as risk_difference from s group by lv)
    select high, units, n, risk_difference, (select max(risk_difference) filter (high) - max(risk_difference) filter (not high) from g) as high_minus_low,
      case when high then hl else ll end as rd_low, case when high then hh else lh end as rd_high, difference_low, difference_high from g, q"""))
def i20_saturated(spark, sf_dir):
    return split_by_context(cohort(spark, sf_dir), plain_scores)[0]


@query("fit_multinomial_saturated", with_views("""
    , un as (select wave, mother_id, state, stratum, psu, max(social_group) as g, max(residence) as residence, avg(weight) as mw from cohort group by all),
      e as (select *, -ln(1 - ('0x' || substr(sha256(concat_ws('|', 1, state, stratum, psu)), 1, 8))::bigint / 4294967296e0) as e from un),
      f as (select *, mw * e / avg(e) over (partition by wave, state, stratum) as v from e),
      p as (select wave, residence, level, sum(v) filter (g = level) / sum(v) as p from f, range(1, 5) t(level) where g is not null group by all)
    select wave, level, avg(p) as mean_probability, avg(case when g = level then 1e0 else 0 end) filter (g is not null) as observed_share
    from un join p using (wave, residence) group by all"""))
def j1_saturated(spark, sf_dir):
    units = cut(mothers(cohort(spark, sf_dir), ("wave", "mother_id")))
    return social_shares(units, E.learn_encoding(units, None, {}, ["residence"]), TINY)


@query("fit_authorized_saturated", with_views(PARTITION_SQL + """
    , dd as (select cohort.*, partition from cohort join part using (mother_id)),
      ra as (select count(*) filter (outcome = 0) / (count(*) filter (outcome = 1) * 1e0) as ratio from dd where partition = 'train'),
      cl as (select sector, residence, sum(weight * ratio) filter (outcome = 1) as w1, sum(weight) filter (outcome = 0) as w0 from dd, ra
        where partition = 'train' group by all),
      qq as (select partition, w1 / (w1 + w0) as p from dd join cl using (sector, residence))
    select partition, count(*) as n, avg(p) as mean_p, min(p) as min_p, max(p) as max_p from qq group by partition"""))
def k10_saturated(spark, sf_dir):
    rows = partitioned(spark, sf_dir)
    return authorized(rows, saturated_encoding(rows), TINY)
