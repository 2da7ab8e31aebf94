"""Feature encoding with a stored schema, and the preprocessor learned on training rows only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.recode import MISSING, UNKNOWN, category_token
from surveyloom.operators.scale import exact_quantiles



def token_name(column: str) -> str:
    return f"_token_{column}"


@dataclass(frozen=True)
class Encoding:
    """Fixed-scale numerics with missing indicators and level indicators without the reference level.

    ``plain`` numerics have no indicator and must not be null; ``interactions`` are
    exposure times "column equals level".
    """

    exposure: str | None
    numeric: tuple[tuple[str, float], ...]
    categorical: tuple[tuple[str, tuple[str, ...]], ...]
    plain: tuple[tuple[str, float], ...] = ()
    interactions: tuple[tuple[str, str], ...] = ()

    @property
    def labels(self) -> list[str]:
        names = ["intercept"] + ([self.exposure] if self.exposure else [])
        names += [f"{c}_scaled" for c, _ in self.numeric] + [f"{c}_missing" for c, _ in self.numeric]
        names += [c for c, _ in self.plain]
        names += [f"{c}={level}" for c, levels in self.categorical for level in levels[1:]]
        return names + [f"{self.exposure}:{c}={level}" for c, level in self.interactions]

    @property
    def keys(self) -> list[str]:
        """Columns of a prepared frame that determine all terms."""
        return ([self.exposure] if self.exposure else []) + [c for c, _ in (*self.numeric, *self.plain)] + [
            token_name(c) for c, _ in self.categorical]

    def prepare(self, df: DataFrame) -> DataFrame:
        """Add one text level per categorical; unseen levels become the reserved unknown level."""
        return df.withColumns({token_name(c): category_token(c, levels) for c, levels in self.categorical})

    def terms(self, exposure: Column | None = None) -> list[Column]:
        """Dense columns in label order; ``exposure`` overrides the exposure column."""
        a = None if self.exposure is None else (F.col(self.exposure) if exposure is None else exposure).cast("double")
        out = [F.lit(1.0)] + ([a] if a is not None else [])
        out += [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / F.lit(float(d)) for c, d in self.numeric]
        out += [F.col(c).isNull().cast("double") for c, _ in self.numeric]
        out += [F.col(c).cast("double") / F.lit(float(d)) for c, d in self.plain]
        out += [(F.col(token_name(c)) == level).cast("double") for c, levels in self.categorical for level in levels[1:]]
        return out + [a * (F.col(token_name(c)) == level).cast("double") for c, level in self.interactions]

    def matrix(self, rows: pd.DataFrame, exposure: float | None = None) -> np.ndarray:
        """The terms of the ``keys`` columns of a prepared frame as a dense block, inside a task."""
        out = np.zeros((len(rows), len(self.labels)))
        out[:, 0], at = 1.0, 1
        if self.exposure:
            a = rows[self.exposure].to_numpy(float) if exposure is None else np.full(len(rows), float(exposure))
            out[:, 1], at = a, 2
        k = len(self.numeric)
        for i, (c, divisor) in enumerate(self.numeric):
            value = rows[c].to_numpy(float)
            missing = np.isnan(value)
            out[:, at + i], out[:, at + k + i] = np.where(missing, 0.0, value) / float(divisor), missing
        at += 2 * k
        for i, (c, divisor) in enumerate(self.plain):
            out[:, at + i] = rows[c].to_numpy(float) / float(divisor)
        at += len(self.plain)
        for c, levels in self.categorical:
            codes = pd.Categorical(rows[token_name(c)], categories=list(levels[1:])).codes
            known = np.flatnonzero(codes >= 0)
            out[known, at + codes[known]] = 1.0
            at += len(levels) - 1
        for i, (c, level) in enumerate(self.interactions):
            out[:, at + i] = a * (rows[token_name(c)] == level).to_numpy()
        return out

    def linear(self, coefficients: Sequence[float], exposure: Column | None = None) -> Column:
        """Dot product of the terms with coefficients as one built-in expression."""
        values = dict(zip(self.labels, map(float, coefficients)))
        a = None if self.exposure is None else (F.col(self.exposure) if exposure is None else exposure).cast("double")
        out = F.lit(values["intercept"])
        if a is not None:
            out = out + a * values[self.exposure]
        for c, divisor in self.numeric:
            out = out + F.when(F.col(c).isNull(), F.lit(values[f"{c}_missing"])).otherwise(
                F.col(c).cast("double") * (values[f"{c}_scaled"] / float(divisor)))
        for c, divisor in self.plain:
            out = out + F.col(c).cast("double") * (values[c] / float(divisor))
        for c, levels in self.categorical:
            chain = None
            for level in levels[1:]:
                test, value = F.col(token_name(c)) == level, F.lit(values[f"{c}={level}"])
                chain = F.when(test, value) if chain is None else chain.when(test, value)
            if chain is not None:
                out = out + chain.otherwise(F.lit(0.0))
        for c, level in self.interactions:
            out = out + F.when(F.col(token_name(c)) == level, a * values[f"{self.exposure}:{c}={level}"]).otherwise(F.lit(0.0))
        return out

    def linear_of(self, coefficients: Column, exposure: Column | None = None) -> Column:
        """Dot product of the terms with an array column of coefficients: one expression, whatever the number of models."""
        at = {label: i for i, label in enumerate(self.labels)}
        b = lambda label: coefficients[at[label]]
        a = None if self.exposure is None else (F.col(self.exposure) if exposure is None else exposure).cast("double")
        out = b("intercept")
        if a is not None:
            out = out + a * b(self.exposure)
        for c, divisor in self.numeric:
            out = out + F.when(F.col(c).isNull(), b(f"{c}_missing")).otherwise(F.col(c).cast("double") * b(f"{c}_scaled") / F.lit(float(divisor)))
        for c, divisor in self.plain:
            out = out + F.col(c).cast("double") * b(c) / F.lit(float(divisor))
        for c, levels in self.categorical:
            places = [F.lit(x) for level in levels[1:] for x in (level, at[f"{c}={level}"])]
            if places:
                place = F.coalesce(F.try_element_at(F.create_map(*places), F.col(token_name(c))), F.lit(-1))
                out = out + F.coalesce(F.get(coefficients, place), F.lit(0.0))  # nothing at -1
        for c, level in self.interactions:
            out = out + F.when(F.col(token_name(c)) == level, a * b(f"{self.exposure}:{c}={level}")).otherwise(F.lit(0.0))
        return out


def learn_encoding(df: DataFrame, exposure: str | None, numeric: Mapping[str, float], categorical: Sequence[str],
                   plain: Mapping[str, float] | None = None, interactions: Sequence[tuple[str, str]] = ()) -> Encoding:
    """Collect the level vocabularies: as many levels as the model has terms, which the driver holds anyway."""
    found: dict[str, set[str]] = {c: set() for c in categorical}
    if categorical:
        cells = F.array(*[F.struct(F.lit(c).alias("c"), category_token(c).alias("t")) for c in categorical])
        rows = df.select(F.inline(cells)).distinct().collect()  # one row per model term
        for row in rows:
            found[row["c"]].add(row["t"])
    vocabulary = tuple((c, (*sorted(found[c] - {MISSING, UNKNOWN}), MISSING, UNKNOWN)) for c in categorical)
    return Encoding(exposure, tuple(numeric.items()), vocabulary, tuple((plain or {}).items()), tuple(interactions))


@dataclass(frozen=True)
class Preprocessor:
    """Medians, scales and vocabularies learned on training rows."""

    numeric: dict[str, tuple[float, float, float]]
    categorical: dict[str, tuple[str, ...]]
    scale: bool

    def transform(self, df: DataFrame) -> DataFrame:
        """Impute the median, flag missing values, optionally scale, and add level indicators."""
        out = {}
        for c, (median, mean, sd) in self.numeric.items():
            value = F.coalesce(F.col(c).cast("double"), F.lit(median))
            out[f"{c}_value"] = (value - mean) / (sd if sd > 0 else 1.0) if self.scale else value
            out[f"{c}_missing"] = F.col(c).isNull().cast("int")
        for c, levels in self.categorical.items():
            for level in levels:
                out[f"{c}={level}"] = (category_token(c) == level).cast("int")
        return df.withColumns(out)


def fit_preprocessor(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], partition: str,
                     train: str = "train", scale: bool = False) -> Preprocessor:
    """Learn from rows that must all belong to the training partition.

    The scale is the population SD of the imputed values.
    """
    if df.where(~F.coalesce(F.col(partition) == train, F.lit(False))).limit(1).count():
        raise ValueError("Preprocessing may only be fitted on training rows")
    learned = {}
    for c in numeric:
        median = exact_quantiles(df, [], c, {"m": 0.5}).first()["m"]
        value = F.coalesce(F.col(c).cast("double"), F.lit(float(median)))
        mean, sd = df.agg(F.avg(value), F.stddev_pop(value)).first()
        learned[c] = (float(median), float(mean), float(sd))
    encoding = learn_encoding(df, None, {}, categorical)
    levels = {c: tuple(v for v in found if v != UNKNOWN) for c, found in encoding.categorical}
    return Preprocessor(learned, levels, scale)
