"""Profiles, support and key audits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.operators import profile as P
from surveyloom.plans.registry import query
from surveyloom.plans.tables import cohort, design_frame, table, with_views


@query("weighted_mean", """
    select l_returnflag, l_linestatus, sum(l_quantity * l_discount) / sum(l_quantity) as weighted_mean
    from lineitem group by all""")
def d1(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return P.weighted_mean(lines, "l_discount", "l_quantity", ["l_returnflag", "l_linestatus"])


@query("prevalence_table", with_views("""
    select state, sector, cast(grouping(state, sector) as bigint) as grouping_id, count(*) as n,
      cast(sum(outcome) as bigint) as events, sum(weight) as weight, avg(outcome) as raw_prevalence,
      sum(weight * outcome) / sum(weight) as weighted_prevalence from cohort group by cube (state, sector)"""))
def d2(spark, sf_dir):
    return P.prevalence_table(cohort(spark, sf_dir), "outcome", "weight", ["state", "sector"])


@query("weight_share", with_views("""
    select state, wealth_index, sum(weight) as weight, sum(weight) / sum(sum(weight)) over (partition by state) as share
    from cohort group by state, wealth_index"""))
def d3(spark, sf_dir):
    return P.weight_share(cohort(spark, sf_dir), "weight", ["state", "wealth_index"], ["state"])


@query("kish_ess", with_views("""
    select state, count(*) as n, sum(weight) ^ 2 / sum(weight ^ 2) as ess_survey,
      sum(weight / e_hat) ^ 2 / sum((weight / e_hat) ^ 2) as ess_combined from cohort group by state"""))
def d4(spark, sf_dir):
    weights = {"survey": F.col("weight"), "combined": F.col("weight") / F.col("e_hat")}
    return P.kish_ess(cohort(spark, sf_dir), weights, ["state"])


PROBS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@query("weighted_quantile", """
    with c as (select l_returnflag as g, l_extendedprice as x, sum(l_quantity) as w from lineitem group by all),
      r as (select *, (sum(w) over (partition by g order by x) - 0.5e0 * w) / sum(w) over (partition by g) as pos,
        lead(x) over (partition by g order by x) as nx from c),
      p as (select *, lead(pos) over (partition by g order by x) as npos from r),
      q as (select g, k, v from (select distinct g from c), (values ('p05', 0.05e0), ('p25', 0.25e0), ('p50', 0.5e0),
        ('p75', 0.75e0), ('p95', 0.95e0)) t(k, v)),
      s as (select q.g, k, x + (nx - x) * (v - pos) / (npos - pos) as value from q join p on q.g = p.g and pos <= v and npos > v)
    select g as l_returnflag, max(value) filter (k = 'p05') as p05, max(value) filter (k = 'p25') as p25,
      max(value) filter (k = 'p50') as p50, max(value) filter (k = 'p75') as p75, max(value) filter (k = 'p95') as p95
    from s group by g""")
def d5(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice", "l_quantity")
    return P.weighted_quantile(lines, "l_extendedprice", "l_quantity", PROBS, ["l_returnflag"])


@query("percentile", """
    select l_returnflag, quantile_cont(l_extendedprice, 0.025) as lower, quantile_cont(l_extendedprice, 0.5) as median,
      quantile_cont(l_extendedprice, 0.975) as upper from lineitem group by l_returnflag""")
def d6(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice")
    return P.exact_quantiles(lines, ["l_returnflag"], "l_extendedprice", {"lower": 0.025, "median": 0.5, "upper": 0.975})


@query("weighted_sd_corr", with_views("""
    , m as (select state, sum(weight * e_hat) / sum(weight) as a, sum(weight * maternal_age) / sum(weight) as b
        from cohort group by state),
      v as (select state, sum(weight * (e_hat - a) ^ 2) / sum(weight) as va,
          sum(weight * (maternal_age - b) ^ 2) / sum(weight) as vb,
          sum(weight * (e_hat - a) * (maternal_age - b)) / sum(weight) as ab from cohort join m using (state) group by state)
    select state, sqrt(va) as sd_e_hat, sqrt(vb) as sd_maternal_age, ab / sqrt(va * vb) as correlation from v"""))
def d7(spark, sf_dir):
    return P.weighted_sd_corr(cohort(spark, sf_dir), "e_hat", "maternal_age", "weight", ["state"])


@query("smd", with_views("""
    , l as (select sector, weight, variable, value from (select sector, weight, cast(maternal_age as double) as maternal_age,
        cast(education_years as double) as education_years, cast(wealth_index as double) as wealth_index from cohort)
        unpivot (value for variable in (maternal_age, education_years, wealth_index))),
      m as (select variable, sector, sum(weight * value) / sum(weight) as m from l group by all),
      v as (select variable, sector, max(m) as m, sum(weight * (value - m) ^ 2) / sum(weight) as v
        from l join m using (variable, sector) group by all)
    select variable, (max(m) filter (sector = 1) - max(m) filter (sector = 0)) / sqrt(sum(v) / 2) as smd
    from v group by variable"""))
def d8(spark, sf_dir):
    return P.smd(cohort(spark, sf_dir), ["maternal_age", "education_years", "wealth_index"], "sector", F.col("weight"))


MISSABLE = ["education_years", "social_group", "convulsions", "swelling"]


@query("missing_profile", with_views("""
    , g as (select 'all' as "group", 'all' as level, * from cohort
        union all select 'sector', cast(sector as varchar), * from cohort
        union all select 'wave', cast(wave as varchar), * from cohort)
    """ + " union all ".join(f"""
    select "group", level, count(*) as n, '{c}' as variable, count(*) filter ({c} is null) as missing_n,
      100e0 * count(*) filter ({c} is null) / count(*) as missing_pct,
      100 * coalesce(sum(weight) filter ({c} is null), 0) / sum(weight) as weighted_missing_pct from g group by all"""
                             for c in MISSABLE)))
def d9(spark, sf_dir):
    return P.missing_profile(cohort(spark, sf_dir), MISSABLE, "weight", ["sector", "wave"])


@query("code_frequencies", with_views(" union all ".join(f"""
    select wave, '{c}' as variable, coalesce(cast({c} as varchar), '__MISSING__') as code, count(*) as n
    from design_frame group by all""" for c in ("social_group", "residence", "education_years"))))
def d10(spark, sf_dir):
    return P.code_frequencies(design_frame(spark, sf_dir), ["social_group", "residence", "education_years"], ["wave"])


@query("missing_patterns", with_views("""
    select coalesce(nullif(concat_ws('|', """ + ", ".join(f"case when {c} is null then '{c}' end" for c in MISSABLE) + """
      ), ''), 'COMPLETE') as pattern, count(*) as n, 100 * sum(weight) / (select sum(weight) from cohort) as weight_pct
    from cohort group by pattern"""))
def d11(spark, sf_dir):
    return P.missing_patterns(cohort(spark, sf_dir), MISSABLE, "weight")


@query("numeric_profile", """
    with l as (select event_type, 'value' as variable, value from events
      union all select event_type, 'user_id', user_id from events)
    select event_type, variable, count(*) as n, avg(value) as mean, stddev_samp(value) as sd, min(value) as min,
      max(value) as max, quantile_cont(value, 0.25) as p25, quantile_cont(value, 0.5) as median,
      quantile_cont(value, 0.75) as p75 from l group by all""")
def d12(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_type", "value", "user_id")
    return P.numeric_profile(events, ["value", "user_id"], ["event_type"])


@query("categorical_profile", with_views(" union all ".join(f"""
    select '{c}' as variable, coalesce(cast({c} as varchar), '__MISSING__') as level, count(*) as n,
      100e0 * count(*) / (select count(*) from cohort) as pct, avg(outcome) as rate, count(*) < 400 as small_group
    from cohort group by {c}""" for c in ("social_group", "education_years", "wealth_index"))))
def d13(spark, sf_dir):
    return P.categorical_profile(cohort(spark, sf_dir), ["social_group", "education_years", "wealth_index"], "outcome", 400)


@query("binary_profile", with_views(" union all ".join(f"""
    select '{c}' as variable, count(*) filter ({c} = 1) as n_yes, count(*) filter ({c} = 0) as n_no,
      count(*) filter ({c} is null) as n_missing, avg(outcome) filter ({c} = 1) as rate_yes,
      avg(outcome) filter ({c} = 0) as rate_no from cohort""" for c in ("convulsions", "swelling", "sector"))))
def d14(spark, sf_dir):
    return P.binary_profile(cohort(spark, sf_dir), ["convulsions", "swelling", "sector"], "outcome")


@query("crosstab", """
    select lang, count(*) filter (quality = 0) as quality_0, count(*) filter (quality = 1) as quality_1
    from documents join labels using (doc_id) group by lang""")
def d15(spark, sf_dir):
    return P.crosstab(labelled_documents(spark, sf_dir), "lang", "quality", [0, 1])


@query("crosstab_percent", """
    select lang, 100e0 * count(*) filter (quality = 0) / count(*) as quality_0,
      100e0 * count(*) filter (quality = 1) / count(*) as quality_1
    from documents join labels using (doc_id) group by lang""")
def d15_percent(spark, sf_dir):
    return P.crosstab(labelled_documents(spark, sf_dir), "lang", "quality", [0, 1], normalize=True)


def labelled_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), "doc_id")


@query("distinct_key_counts", with_views("""
    select 'full' as key_name, count(*) as distinct_keys, count(*) - 1500 as difference
      from (select distinct state, stratum, psu from design_frame)
    union all select 'no_state', count(*), count(*) - 1500 from (select distinct stratum, psu from design_frame)
    union all select 'stratum', count(*), count(*) - 55 from (select distinct state, stratum from design_frame)"""))
def d16(spark, sf_dir):
    keys = {"full": ["state", "stratum", "psu"], "no_state": ["stratum", "psu"], "stratum": ["state", "stratum"]}
    return P.distinct_key_counts(design_frame(spark, sf_dir), keys, {"full": 1500, "no_state": 1500, "stratum": 55})


@query("id_gaps", with_views("""
    select state, count(distinct psu) as distinct_ids, min(psu) as min_id, max(psu) as max_id,
      max(psu) - min(psu) + 1 - count(distinct psu) as unused_ids from cohort group by state"""))
def d17(spark, sf_dir):
    return P.id_gaps(cohort(spark, sf_dir), "psu", ["state"])


@query("key_consistency", with_views(" union all ".join(f"""
    select (select count(distinct psu) from design_frame) as keys, '{c}' as column,
      (select count(*) from (select psu from design_frame group by psu
        having count(distinct coalesce({c}, -1)) > 1)) as inconsistent_keys"""
                                            for c in ("stratum", "wealth_index", "sector", "education_years"))))
def d18(spark, sf_dir):
    return P.key_consistency(design_frame(spark, sf_dir), ["psu"], ["stratum", "wealth_index", "sector", "education_years"])


@query("unit_rollup", with_views("""
    select mother_id, count(*) as size, avg(weight) as mean_weight, max(outcome) as any_outcome,
      arg_min(place_code, event_cmc * 1000000000000 + row_id) as first_place_code from design_frame group by mother_id"""))
def d19(spark, sf_dir):
    return P.unit_rollup(design_frame(spark, sf_dir), ["mother_id"], ["event_cmc", "row_id"], ["weight"], ["outcome"],
                         ["place_code"])


SUPPORT = ["state", "residence", "wealth_index"]


@query("support_cells", with_views("""
    select cast(state as varchar) as state, cast(residence as varchar) as residence,
      cast(wealth_index as varchar) as wealth_index, count(*) filter (sector = 0) as n_0,
      count(*) filter (sector = 1) as n_1, 100 * sum(weight) / (select sum(weight) from cohort) as weight_pct,
      count(*) filter (sector = 0) >= 100 and count(*) filter (sector = 1) >= 100 as adequate from cohort group by all"""))
def d20(spark, sf_dir):
    return P.support_cells(cohort(spark, sf_dir), SUPPORT, "sector", 100, "weight")


@query("support_mask", with_views("""
    , c as (select state, residence, wealth_index, count(*) filter (sector = 0) >= 100 and
        count(*) filter (sector = 1) >= 100 as ok from cohort group by all)
    select ok as supported, count(*) as n, sum(weight) as weight from cohort join c using (state, residence, wealth_index)
    group by ok"""))
def d20_mask(spark, sf_dir):
    return P.with_support(cohort(spark, sf_dir), SUPPORT, "sector", 100, "weight").groupBy("supported").agg(
        F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("marginal_support", with_views("""
    , tr as (select * from cohort where wave = 4), ta as (select * from cohort where wave = 5),
      tot as (select sum(weight) as t from ta)
    """ + " union all ".join(
    [f"""select '{c}' as variable, {a} as arm, 100 * coalesce(sum(weight) filter (coalesce({c}, -1) not in
        (select coalesce({c}, -1) from tr where sector = {a})), 0) / max(t) as target_weight_pct, 'absent_level' as "check"
        from ta, tot""" for c in ("education_years", "stratum") for a in (0, 1)]
    + [f"""select '{c}', {a}, 100 * coalesce(sum(weight) filter ({c} not between
        (select min({c}) from tr where sector = {a}) and (select max({c}) from tr where sector = {a})), 0) / max(t),
        'outside_range' from ta, tot""" for c in ("psu", "maternal_age") for a in (0, 1)])))
def d21(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return P.marginal_support(rows.where("wave = 4"), rows.where("wave = 5"), ["education_years", "stratum"],
                              ["psu", "maternal_age"], "sector", "weight")


@query("pure_cells", with_views("""
    , l as (select 'psu' as variable, cast(psu as varchar) as level, outcome, weight from cohort
      union all select 'social_group', coalesce(cast(social_group as varchar), '__MISSING__'), outcome, weight from cohort)
    select variable, level, count(*) as n, cast(sum(outcome) as bigint) as events,
      100 * sum(weight) / (select sum(weight) from cohort) as reference_weight_pct
    from l group by all having min(outcome) = max(outcome)"""))
def d22(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return P.pure_cells(rows, rows, ["psu", "social_group"], "outcome", "weight")


@query("duplicate_keys", """
    select l_orderkey, l_linenumber, count(*) as copies from lineitem group by all having count(*) > 1""")
def d23(spark, sf_dir):
    return P.duplicate_keys(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("rollup_importance", """
    with f as (select p_brand as feature, avg(abs(p_retailprice)) as score from part group by 1),
      m as (select distinct p_brand as feature, substr(p_brand, 1, 7) as original, 'brand' || length(p_brand) as domain
        from part),
      o as (select domain, original, sum(score) as importance from f join m using (feature) group by all)
    select domain, original, importance, 100 * importance / sum(importance) over () as share_pct,
      sum(importance) over (partition by domain) as domain_importance,
      100 * sum(importance) over (partition by domain) / sum(importance) over () as domain_share_pct from o""")
def d24(spark, sf_dir):
    part = table(spark, sf_dir, "part", "p_brand", "p_retailprice").withColumnRenamed("p_brand", "feature")
    scores = part.groupBy("feature").agg(F.avg(F.abs("p_retailprice")).alias("score"))
    mapping = part.select("feature", F.substring("feature", 1, 7).alias("original"),
                          F.concat(F.lit("brand"), F.length("feature").cast("string")).alias("domain")).distinct()
    return P.rollup_importance(scores, mapping, "feature", "score", "original", "domain")


@query("coverage_audit", with_views("""
    select state, wave, count(*) as n, count(education_years) as matched_n,
      coalesce(sum(weight) filter (education_years is not null), 0) as matched_weight,
      100 * matched_weight / sum(weight) as matched_pct_of_cell,
      100 * matched_weight / (select sum(weight) from cohort) as matched_pct_of_cohort from cohort group by state, wave"""))
def d25(spark, sf_dir):
    return P.coverage_audit(cohort(spark, sf_dir), F.col("education_years").isNotNull(), ["state", "wave"], "weight")
