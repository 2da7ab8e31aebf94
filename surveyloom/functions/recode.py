"""Scalar recodes of coded microdata. Every function returns one Column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "__MISSING__"
UNKNOWN = "__UNKNOWN__"
# Accented Latin letters and the plain letters they become.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_numeric(c) -> Column:
    """Parse to double; unparsable text and NaN become null."""
    number = _col(c).try_cast("double")
    return F.when(~F.isnan(number), number)


def special_codes_to_null(c, codes: Iterable) -> Column:
    """Null for the listed survey codes ("do not know", "not asked", ...)."""
    c = _col(c)
    return F.when(~c.isin(list(codes)), c)


def implied_decimal(c, places: int) -> Column:
    """Undo an implied decimal point: 1234 with two places is 12.34."""
    return _col(c) / F.lit(float(10**places))


def recode_ranges(c, ranges: Sequence[tuple], default=None) -> Column:
    """First closed range ``(low, high, label)`` that holds the code."""
    c = _col(c)
    out = None
    for low, high, label in ranges:
        test = c.between(low, high)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))


def cmc(year, month) -> Column:
    """Century-month code of a calendar month (January 1900 is 1)."""
    return ((_col(year) - 1900) * 12 + _col(month)).cast("int")


def cmc_of_date(date) -> Column:
    return cmc(F.year(_col(date)), F.month(_col(date)))


def cmc_year(c) -> Column:
    return (F.floor((_col(c) - 1) / 12) + 1900).cast("int")


def cmc_month(c) -> Column:
    return (F.pmod(_col(c) - 1, F.lit(12)) + 1).cast("int")


def valid_cmc(c) -> Column:
    """True for integral codes in 1..2400; false, never null, otherwise."""
    number = to_numeric(c)
    return F.coalesce(number.between(1, 2400) & (number == F.floor(number)), F.lit(False))


def recall_lag(interview, event) -> Column:
    """Months between event and interview; null unless both codes are valid."""
    return F.when(valid_cmc(interview) & valid_cmc(event), (_col(interview) - _col(event)).cast("int"))


def in_recall_window(interview, event, months: int) -> Column:
    lag = recall_lag(interview, event)
    return F.coalesce((lag >= 0) & (lag < months), F.lit(False))


def period_bucket(c, cutpoints: Sequence[tuple], last: str, single: Mapping | None = None) -> Column:
    """Half-open periods: label of the first ``(upper, label)`` with ``c < upper``.

    ``single`` maps one month code to a transition label of its own.
    """
    c = _col(c)
    tests = [(c == month, label) for month, label in (single or {}).items()]
    tests += [(c < upper, label) for upper, label in cutpoints]
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for test, label in tests:
        out = out.when(test, F.lit(label))
    return out.otherwise(F.lit(last))


def bin_numeric(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(e0, e1], (e1, e2] ...``; null outside."""
    c = _col(c)
    out = None
    for low, high, label in zip(edges, edges[1:], labels):
        test = (c > low) & (c <= high)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


def delivery_order(order, multiple) -> Column:
    """Order of the delivery: later members of a multiple birth share the first one's order."""
    order, multiple = _col(order), _col(multiple)
    return F.when(multiple == 0, order).otherwise(order - multiple + 1)


def primary_risk(first_event, age, multiple, age_limit: int = 35) -> Column:
    """Two-level risk class of first events from fully observed columns."""
    lower = (_col(age) < age_limit) & (_col(multiple) == 0)
    return (F.when(~_col(first_event), F.lit("not_applicable_multiparous"))
            .when(lower, F.lit("lower_risk")).otherwise(F.lit("elevated_risk")))


def refined_risk(first_event, age, multiple, complications: Sequence, age_limit: int = 35) -> Column:
    """Risk class that also needs complication flags; a missing flag is its own excluded class."""
    flags = [_col(c) for c in complications]
    any_missing = flags[0].isNull()
    any_present = flags[0] == 1
    for flag in flags[1:]:
        any_missing = any_missing | flag.isNull()
        any_present = any_present | (flag == 1)
    lower = (_col(age) < age_limit) & (_col(multiple) == 0) & ~any_present
    return (F.when(~_col(first_event), F.lit("not_applicable_multiparous"))
            .when(any_missing, F.lit("excluded_missing_complication_data"))
            .when(lower, F.lit("refined_lower_risk")).otherwise(F.lit("refined_elevated_risk")))


def category_token(c, vocabulary: Iterable[str] | None = None) -> Column:
    """Text level of a code: null and unseen values get reserved levels, 3.0 prints as ``3``."""
    c = _col(c)
    number = c.try_cast("double")
    text = F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("long").cast("string")).otherwise(
        c.cast("string"))
    token = F.coalesce(text, F.lit(MISSING))
    if vocabulary is None:
        return token
    return F.when((token == MISSING) | token.isin(list(vocabulary)), token).otherwise(F.lit(UNKNOWN))


def canonical_name(c, aliases: Mapping[str, str] | None = None) -> Column:
    """Lower-case name with ``&`` spelled out, accents and marks stripped, blanks squeezed."""
    text = F.translate(F.lower(_col(c)), ACCENTED, PLAIN)
    text = F.regexp_replace(text, "&", " and ")
    text = F.regexp_replace(text, "[^a-z0-9 ]", " ")
    text = F.trim(F.regexp_replace(text, " +", " "))
    if not aliases:
        return text
    pairs = [F.lit(x) for item in aliases.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), text)


def post_event(unit, date, launches: Mapping) -> tuple[Column, Column]:
    """(strictly after the unit's launch month, exactly in the launch month)."""
    pairs = [F.lit(x) for item in launches.items() for x in item]
    launch = F.try_element_at(F.create_map(*pairs), _col(unit))
    return (F.coalesce(_col(date) > launch, F.lit(False)).cast("int"),
            F.coalesce(_col(date) == launch, F.lit(False)))


def clip(p, eps: float) -> Column:
    """Keep a probability inside ``[eps, 1 - eps]``."""
    return F.least(F.greatest(_col(p), F.lit(float(eps))), F.lit(1.0 - eps))


def e_value(rr, low=None, high=None) -> tuple[Column, Column]:
    """(point, interval) strength an unmeasured confounder would need to explain a risk ratio.

    Ratios below 1 are inverted. The interval value uses the bound nearest to 1 and
    is 1 when that bound lies on the other side of 1.
    """
    def strength(ratio: Column) -> Column:
        ratio = F.when(ratio < 1, 1.0 / ratio).otherwise(ratio)
        return ratio + F.sqrt(ratio * (ratio - 1.0))

    point = strength(_col(rr))
    if low is None:
        return point, F.lit(None).cast("double")
    near = F.when(F.abs(_col(low) - 1) < F.abs(_col(high) - 1), _col(low)).otherwise(_col(high))
    other_side = (near - 1) * (_col(rr) - 1) < 0
    return point, F.when(other_side, F.lit(1.0)).otherwise(strength(near))
