"""Data contracts, split audits, code books and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.recode import canonical_name
from surveyloom.operators.association import chi_square, mann_whitney
from surveyloom.operators.joins import compare_to_baseline


def contract_report(df: DataFrame, key: Sequence[str], counts: Mapping[str, Column], errors: Mapping[str, Column],
                    warnings: Mapping[str, Column], allowed: Mapping[str, Sequence]) -> DataFrame:
    """One row per check with its row count, severity and whether it fired, plus a final status row.

    ``counts`` are plain tallies; a positive tally of an error or warning condition
    fires it. Codes outside ``allowed`` and repeated keys are errors.
    """
    checks = [("count", name, condition) for name, condition in counts.items()]
    checks += [("error", name, condition) for name, condition in errors.items()]
    checks += [("error", f"unexpected_codes_{c}", F.col(c).isNotNull() & ~F.col(c).isin(list(codes)))
               for c, codes in allowed.items()]
    checks += [("warning", name, condition) for name, condition in warnings.items()]
    copies = df.groupBy(*key).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("v")).scalar()
    tallies = df.agg(*[F.count_if(condition).alias(f"_{i}") for i, (_, _, condition) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("check"), F.col(f"_{i}").alias("n"))
                     for i, (severity, name, _) in enumerate(checks)],
                   F.struct(F.lit("error").alias("severity"), F.lit("duplicate_keys").alias("check"), copies.alias("n")))
    report = tallies.select(F.inline(rows)).withColumn(
        "fired", (F.col("n") > 0) & (F.col("severity") != "count"))
    status = report.agg(F.count_if(F.col("fired") & (F.col("severity") == "error")).alias("n")).select(
        F.lit("status").alias("severity"),
        F.when(F.col("n") > 0, "INVALID").otherwise("DATA_CONTRACT_VALID").alias("check"), "n",
        (F.col("n") > 0).alias("fired"))
    return report.unionByName(status)


def audit_partition(df: DataFrame, group: str, partition: str, label: str, parts: Sequence[str]) -> DataFrame:
    """Rows, groups and classes per part with the split problems that would invalidate it."""
    spread = df.groupBy(group).agg((F.min(partition) != F.max(partition)).alias("_torn"))
    torn = spread.agg(F.count_if("_torn").alias("v")).scalar()
    rows = df.groupBy(partition).agg(
        F.count("*").alias("rows"), F.count_distinct(group).alias("groups"),
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))
    return rows.select("*", F.col(partition).isin(list(parts)).alias("known_label"),
                       ((F.col("positives") > 0) & (F.col("negatives") > 0)).alias("both_classes"),
                       torn.alias("groups_in_several_parts"))


def guard_wave_transfer(train: DataFrame, evaluation: DataFrame, wave: str, train_wave, evaluation_wave,
                        unit: str) -> DataFrame:
    """Direction of a wave transfer and units shared by both sides."""
    one = lambda df, value: df.agg(value.alias("v")).scalar()
    off = lambda expected: F.count_if(F.col(wave).isNull() | (F.col(wave) != expected))
    shared = train.select(unit).distinct().join(evaluation.select(unit).distinct(), unit, "left_semi")
    return train.agg(F.count("*").alias("train_rows"), off(train_wave).alias("train_rows_off_wave")).select(
        "train_rows", "train_rows_off_wave", one(evaluation, F.count("*")).alias("evaluation_rows"),
        one(evaluation, off(evaluation_wave)).alias("evaluation_rows_off_wave"),
        one(shared, F.count("*")).alias("shared_units")).withColumn(
        "valid", (F.col("train_rows_off_wave") == 0) & (F.col("evaluation_rows_off_wave") == 0)
        & (F.col("shared_units") == 0))


MOST_CODES = 1000


def code_profile(df: DataFrame, variables: Mapping[str, Column], special: Mapping[str, Sequence] | None = None) -> tuple[DataFrame, DataFrame]:
    """What the data hold of each coded variable: ``(variable, code, n)``, and ``(variable, missing, special)`` from one pass.

    ``special`` lists codes that stand for no answer; they are counted, null where a variable has none.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("variable"), v.cast("string").alias("code")) for k, v in variables.items()])
    codes = df.select(F.inline(cells)).where("code is not null").groupBy("variable", "code").agg(F.count("*").alias("n"))
    counts = F.array(*[F.struct(
        F.lit(k).alias("variable"), F.count_if(v.isNull()).alias("missing"),
        (F.count_if(v.cast("string").isin([str(x) for x in special[k]])) if special and k in special else F.lit(None).cast("long")).alias("special"))
        for k, v in variables.items()])
    return codes, df.agg(counts.alias("_c")).select(F.inline("_c"))


def compare_codebooks(a: DataFrame, b: DataFrame, codes_a: DataFrame, codes_b: DataFrame, profile_a: DataFrame | None = None,
                      profile_b: DataFrame | None = None, most: int = MOST_CODES) -> DataFrame:
    """Per variable: codes whose labels differ, codes used on one side only, missing and special-code counts, and a review status.

    Label tables are ``(variable, code, label)``, used codes ``(variable, code)``, profiles those of :func:`code_profile`. Codes
    used on one side are always counted and listed up to ``most``, so a continuous column taken for a coded one makes no large row.
    """
    listed = lambda v: F.array_join(F.array_sort(F.collect_set(v)), ";")
    left = a.select("variable", "code", canonical_name("label").alias("_a"))
    right = b.select("variable", "code", canonical_name("label").alias("_b"))
    labels = left.join(right, ["variable", "code"], "full_outer").groupBy("variable").agg(
        # the label tables are the code book itself
        listed(F.when(F.col("_a") != F.col("_b"), F.col("code"))).alias("label_conflicts"),
        F.count_if(F.col("_a").isNotNull()).alias("labels_first"), F.count_if(F.col("_b").isNotNull()).alias("labels_second"))
    mark = lambda df, name: df.select("variable", "code").distinct().withColumn(name, F.lit(True))
    used = mark(codes_a, "_x").join(mark(codes_b, "_y"), ["variable", "code"], "full_outer")
    sizes = used.groupBy("variable").agg(F.count_if(F.col("_y").isNull()).alias("only_first_n"), F.count_if(F.col("_x").isNull()).alias("only_second_n"))
    alone = used.where("_x is null or _y is null").join(
        F.broadcast(sizes.where(f"only_first_n + only_second_n <= {int(most)}")), "variable").groupBy("variable").agg(
        listed(F.when(F.col("_y").isNull(), F.col("code"))).alias("only_first"), listed(F.when(F.col("_x").isNull(), F.col("code"))).alias("only_second"))
    out = labels.join(sizes, "variable", "left").join(alone, "variable", "left")
    few = F.coalesce(F.col("only_first_n") + F.col("only_second_n") <= most, F.lit(False))
    out = out.withColumns({c: F.when(few, F.coalesce(c, F.lit(""))) for c in ("only_first", "only_second")})
    for side, profile in (("first", profile_a), ("second", profile_b)):
        if profile is not None:
            out = out.join(profile.withColumnsRenamed({"missing": f"missing_{side}", "special": f"special_{side}"}), "variable", "left")
    return out.withColumn("status", F.when(F.col("label_conflicts") != "", "LABEL_DIFFERENCE_REVIEW").otherwise("METADATA_LABELS_MATCH"))


def missingness_association(df: DataFrame, column: str, categorical: Sequence[str], numeric: Sequence[str],
                            p_value: bool = True) -> DataFrame:
    """Is a column's missingness related to others? Contingency test for categories, rank test for numbers."""
    flagged = df.withColumn("_missing", F.col(column).isNull().cast("int"))
    tests = chi_square(flagged, categorical, "_missing", p_value)
    ranks = mann_whitney(flagged, numeric, "_missing", p_value)
    p = ["p_value"] if p_value else []
    return tests.select("variable", F.lit("chi_square").alias("test"), F.col("chi_square").alias("statistic"), *p).unionByName(
        ranks.select("variable", F.lit("rank_test").alias("test"), F.col("u_statistic").alias("statistic"), *p))


def result_consistency(first: DataFrame, second: DataFrame, keys: Sequence[str], tolerances: Mapping[str, float]) -> DataFrame:
    """The same quantities from two paths agree within their tolerances."""
    out = None
    for value, tolerance in tolerances.items():
        row = compare_to_baseline(first, second, keys, [value], tolerance).select(
            "value", "matched", "only_new", "only_old", F.col("reproduced").alias("consistent"))
        out = row if out is None else out.unionByName(row)
    return out


def master_results(tables: Mapping[str, DataFrame], null_value: float = 0.0) -> DataFrame:
    """Headline rows ``(metric, value, ci_low, ci_high)`` of several result tables as one long table."""
    out = None
    for layer, df in tables.items():
        row = df.select(F.lit(layer).alias("layer"), "metric", *[F.col(c).cast("double").alias(c)
                                                                for c in ("value", "ci_low", "ci_high")])
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ci_includes_null", F.col("ci_low").isNotNull() & (F.col("ci_low") <= null_value)
                          & (F.col("ci_high") >= null_value))
