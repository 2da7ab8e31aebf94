"""Tests and correlations over the given tables."""

from __future__ import annotations

from surveyloom.operators import association as T
from surveyloom.plans.profiles import labelled_documents
from surveyloom.plans.registry import query
from surveyloom.plans.tables import cohort, design_frame, table, with_views

LABEL = """case when {0} is null then 'Not available' when abs({0}) < 0.1 then 'Negligible' when abs({0}) < 0.3
    then 'Small' when abs({0}) < 0.5 then 'Moderate' else 'Large' end"""


@query("mann_whitney", with_views("""
    , l as (select outcome as g, variable, value from (select outcome, cast(maternal_age as double) as maternal_age,
        cast(education_years as double) as education_years, weight from cohort)
        unpivot (value for variable in (maternal_age, education_years, weight))),
      c as (select variable, value, count(*) filter (g = 0) * 1e0 as c0, count(*) filter (g = 1) * 1e0 as c1 from l group by all),
      r as (select *, sum(c1) over (partition by variable order by value) - c1 as before1 from c),
      s as (select variable, sum(c0) as n0, sum(c1) as n1, sum(c0 * (before1 + c1 / 2)) as u,
        sum((c0 + c1) ^ 3 - (c0 + c1)) as t from r group by variable),
      m as (select variable, median(value) filter (g = 0) as median_0, median(value) filter (g = 1) as median_1
        from l group by variable)
    select variable, cast(n0 as bigint) as n_0, cast(n1 as bigint) as n_1, median_0, median_1,
      median_1 - median_0 as median_difference, u as u_statistic,
      (greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5e0)
        / sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - t / ((n0 + n1) * (n0 + n1 - 1)))) as z,
      1 - 2 * u / (n0 * n1) as rank_biserial, """ + LABEL.format("(1 - 2 * u / (n0 * n1))") + """ as magnitude
    from s join m using (variable)"""))
def t1(spark, sf_dir):
    return T.mann_whitney(cohort(spark, sf_dir), ["maternal_age", "education_years", "weight"], "outcome", p_value=False)


@query("mann_whitney_p")
def t1_p(spark, sf_dir):
    return T.mann_whitney(cohort(spark, sf_dir), ["maternal_age", "education_years", "weight"], "outcome")


CHI_SQL = """
    with l as (select quality as t, variable, level from (select quality, lang, source, cast(toxic as varchar) as toxic
        from documents join labels using (doc_id)) unpivot (level for variable in (lang, source, toxic))),
      o as (select variable, level, t, count(*) as o from l group by all),
      r as (select variable, level, count(*) as r from l group by all),
      c as (select variable, t, count(*) as c from l group by all),
      n as (select variable, count(*) * 1e0 as n, count(distinct level) as nr, count(distinct t) as nc from l group by all),
      e as (select variable, n, nr, nc, r * c / n as e, abs(coalesce(o, 0) - r * c / n) as d
        from r join c using (variable) left join o using (variable, level, t) join n using (variable)),
      x as (select variable, n, nr, nc, sum((d - case when nr = 2 and nc = 2 then least(0.5e0, d) else 0 end) ^ 2 / e)
        as chi from e group by all)
"""


@query("chi_square", CHI_SQL + """
    select variable, n, chi as chi_square, (nr - 1) * (nc - 1) as df from x""")
def t2(spark, sf_dir):
    return T.chi_square(labelled_documents(spark, sf_dir), ["lang", "source", "toxic"], "quality", p_value=False)


@query("chi_square_p")
def t2_p(spark, sf_dir):
    return T.chi_square(labelled_documents(spark, sf_dir), ["lang", "source", "toxic"], "quality")


@query("cramers_v", CHI_SQL + """
    , v as (select *, greatest(0, chi / n - (nc - 1) * (nr - 1) / (n - 1)) as phi,
        least(nr - (nr - 1) ^ 2 / (n - 1) - 1, nc - (nc - 1) ^ 2 / (n - 1) - 1) as depth from x)
    select variable, n, chi as chi_square, case when depth > 0 then sqrt(phi / depth) end as cramers_v,
      """ + LABEL.format("(case when depth > 0 then sqrt(phi / depth) end)") + """ as magnitude from v""")
def t3(spark, sf_dir):
    return T.cramers_v(labelled_documents(spark, sf_dir), ["lang", "source", "toxic"], "quality")


@query("spearman_pairs", """
    with r as (
      """ + " union all ".join(f"""select '{a}' as first, '{b}' as second,
        avg(i) over (partition by x) as rx, avg(j) over (partition by y) as ry from (select {a} as x, {b} as y,
        row_number() over (order by {a}) as i, row_number() over (order by {b}) as j from lineitem)"""
                               for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"),
                                            ("l_extendedprice", "l_discount"))) + """)
    select first, second, count(*) as n, corr(rx, ry) as spearman, abs(corr(rx, ry)) >= 0.7 as flagged from r group by all""")
def t4(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice", "l_discount")
    return T.spearman_pairs(lines, ["l_quantity", "l_extendedprice", "l_discount"], 0.7)


@query("two_wave_profile", with_views(" union all ".join(f"""
    select cast(wave as varchar) as wave, '{c}' as variable, count(*) as n, 100e0 * count(*) filter ({c} is null) / count(*)
        as missing_pct, 100 * coalesce(sum(weight) filter ({c} is null), 0) / sum(weight) as weighted_missing_pct,
      count(distinct {c}) as distinct_codes, max(k) as largest_code_n
    from (select *, case when {c} is not null then count(*) over (partition by wave, {c}) end as k from design_frame)
    group by wave""" for c in ("education_years", "social_group", "residence"))))
def t5(spark, sf_dir):
    return T.two_wave_profile(design_frame(spark, sf_dir), "wave", ["education_years", "social_group", "residence"], "weight")


@query("two_wave_weights", with_views("""
    select wave, min(weight) as min, quantile_cont(weight, 0.05) as p05, median(weight) as median,
      quantile_cont(weight, 0.95) as p95, max(weight) as max from cohort group by wave"""))
def t5_weights(spark, sf_dir):
    return T.two_wave_weights(cohort(spark, sf_dir), "wave", "weight")
