"""Secret scans with DataFrame functions only: fixed patterns and a battery of randomness tests.

Runs of key characters that no pattern covers are tested for randomness in the smallest alphabet
that holds them (hex, base32, letters and digits, base64 and so on): chi-squared uniformity of the
alphabet, a runs test and lag-one serial correlation, combined by Fisher's method. A run is added
as ``random`` if these do not reject randomness and, against the letter frequencies of the corpus,
ordinary wording is rejected by a false-discovery procedure within its class of length.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import cut

#: The base patterns. The key words match in either case.
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}"
FREQUENCY_RUN, TESTED_RUN = 12, 20
LENGTH_CLASSES = (24, 32, 48, 64)
P_STEPS = 4

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Alphabets by size; the first one that holds a run is its inferred encoding.
ALPHABETS = (("decimal", _DIGITS), ("hex", _DIGITS + _LOWER[:6]), ("hex upper", _DIGITS + _UPPER[:6]), ("lower", _LOWER), ("upper", _UPPER),
             ("base32", _UPPER + _DIGITS[2:8]), ("base36", _DIGITS + _LOWER), ("base36 upper", _DIGITS + _UPPER),
             ("letters", _UPPER + _LOWER), ("base62", _UPPER + _LOWER + _DIGITS), ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
             ("base64 url", _UPPER + _LOWER + _DIGITS + "-_"), ("mixed", _UPPER + _LOWER + _DIGITS + "+/-_"))
_EVERY = ALPHABETS[-1][1]


def spans_of(text: Column, pattern: str, kind: str, least: int, group: int = 0, screen: str | None = None) -> Column:
    """Leftmost matches as ``(kind, start, stop, body)`` in code points, without those whose group is too short.

    The parts between matches and the matches themselves give the places by their lengths.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("body"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    start = lambda acc, x: acc["at"] + F.char_length(x["gap"])
    none = F.expr("cast(array() as array<struct<kind:string,start:int,stop:int,body:string>>)")

    def step(acc: Column, x: Column) -> Column:
        begin = start(acc, x)
        stop = begin + F.coalesce(F.char_length(x["body"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), stop.alias("stop"), x["body"].alias("body"))
        fits = F.char_length(x["value"]) >= least
        return F.struct(stop.alias("at"), F.when(fits, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(screen or pattern), found).otherwise(none)  # most texts have no match


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, one array of ``(kind, start, stop, body)``."""
    return F.concat(spans_of(text, ASSIGN, "assign", LEAST["assign"], 2), spans_of(text, ACCESS, "access", LEAST["access"]),
                    spans_of(text, HEX, "hex", LEAST["hex"], screen=r"[0-9a-f]{24}"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal_tail(z: Column) -> Column:
    """P(Z > z) by the rational approximation 26.2.17 of Abramowitz and Stegun, error below 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = let(t, lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
    return let(F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly, lambda tail: F.when(z >= 0, tail).otherwise(1 - tail))


def encoding_of(run: Column) -> Column:
    """Index of the smallest alphabet that holds every character of the run."""
    return reduce(lambda rest, i: F.when(F.char_length(F.translate(run, ALPHABETS[i][1], "")) == 0, i).otherwise(rest),
                  reversed(range(len(ALPHABETS) - 1)), F.lit(len(ALPHABETS) - 1))


def _of_encoding(code: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), code + 1)


@dataclass
class SecretModel:
    """Excess of each alphabet's chi-squared per character in ordinary wording, and the accepted p by length class."""

    excess: list[float] = field(default_factory=lambda: [float(len(a)) for _, a in ALPHABETS])
    accept: list[float] = field(default_factory=lambda: [0.0] * (len(LENGTH_CLASSES) + 1))
    least_random: float = 0.001


def length_class(run: Column) -> Column:
    return reduce(lambda rest, i: F.when(F.char_length(run) < LENGTH_CLASSES[i], i).otherwise(rest),
                  reversed(range(len(LENGTH_CLASSES))), F.lit(len(LENGTH_CLASSES)))


def battery(run: Column, excess: list[float]) -> Column:
    """``(p_random, p_ordinary)`` of a run: chance of such a run if it is random, and if it is ordinary wording."""
    pairs = lambda a: F.arrays_zip(F.slice(a, 1, F.size(a) - 1).alias("a"), F.slice(a, 2, F.size(a) - 1).alias("b"))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + f(v))
    safe = lambda p: F.log(F.greatest(p, F.lit(1e-300)))

    def places(x: Column) -> Column:
        place = F.transform(x["chars"], lambda c: F.instr(x["alphabet"], c).cast("double"))
        squares = total(F.array_distinct(x["chars"]), lambda c: F.pow(x["n"] - F.char_length(F.replace(run, c, F.lit(""))), F.lit(2)))
        return F.struct(x["code"].alias("code"), x["n"].alias("n"), x["size"].alias("size"), place.alias("place"), squares.alias("squares"))

    def sums(x: Column) -> Column:
        high = F.transform(x["place"], lambda v: (2 * v > x["size"]).cast("int"))
        centred = let(total(x["place"], lambda v: v) / x["n"], lambda mean: F.transform(x["place"], lambda v: v - mean))
        return F.struct(
            x["n"].alias("n"), (x["size"] - 1).alias("free"), (x["size"] * x["squares"] / x["n"] - x["n"]).alias("chi"),
            (_of_encoding(x["code"], excess) * x["n"]).alias("more"),
            let(high, lambda h: F.struct(total(h, lambda v: v).alias("ones"),
                                         (1 + total(pairs(h), lambda p: (p["a"] != p["b"]).cast("double"))).alias("runs"))).alias("bits"),
            let(centred, lambda c: F.struct(total(c, lambda v: v * v).alias("power"), total(pairs(c), lambda p: p["a"] * p["b"]).alias("lag"))).alias("line"))

    def scores(x: Column) -> Column:
        n, free, more, ones = x["n"], x["free"], x["more"], x["bits"]["ones"]
        z_chi = (F.cbrt(x["chi"] / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        # all characters alike, or on one side of the middle: as far from random as the length allows
        z_runs = let(2 * ones * (n - ones) / n + 1, lambda usual: let((usual - 1) * (usual - 2) / (n - 1), lambda spread: F.when(
            spread > 0, F.abs(x["bits"]["runs"] - usual) / F.sqrt(spread)).otherwise(F.sqrt(n))))
        z_lag = F.when(x["line"]["power"] > 0, F.abs(x["line"]["lag"] / x["line"]["power"]) * F.sqrt(n)).otherwise(F.sqrt(n))
        z_ordinary = (x["chi"] - free - more) / F.sqrt(2 * (free + 2 * more))
        return F.struct(z_chi.alias("chi"), z_runs.alias("runs"), z_lag.alias("lag"), z_ordinary.alias("ordinary"))

    def chances(z: Column) -> Column:
        fisher = -(safe(normal_tail(z["chi"])) + safe(2 * normal_tail(z["runs"])) + safe(2 * normal_tail(z["lag"])))
        return F.struct(let(fisher, lambda f: F.exp(-f) * (1 + f + f * f / 2)).alias("p_random"), normal_tail(-z["ordinary"]).alias("p_ordinary"))

    facts = let(encoding_of(run), lambda code: F.struct(
        code.alias("code"), F.split(run, "").alias("chars"), F.char_length(run).cast("double").alias("n"),
        _of_encoding(code, [a for _, a in ALPHABETS]).alias("alphabet"), _of_encoding(code, [float(len(a)) for _, a in ALPHABETS]).alias("size")))
    return let(let(let(let(facts, places), sums), scores), chances)


def fit_model(documents: DataFrame, rate: float = 0.01, text: str = "text") -> SecretModel:
    """Letter frequencies and accepted p-values from the long runs of all documents.

    What reaches the driver is one row of character counts and one row per length class and step of p.
    """
    runs = cut(documents.select(F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN % FREQUENCY_RUN), F.lit(0))).alias("run"))
               .groupBy("run").agg(F.count("*").alias("n")))
    counts = runs.agg(*[F.sum(F.col("n") * (F.char_length("run") - F.char_length(F.replace("run", F.lit(c), F.lit(""))))).alias(f"c{i}")
                        for i, c in enumerate(_EVERY)]).first()
    seen = {c: (counts[i] or 0) + 0.5 for i, c in enumerate(_EVERY)}
    model = SecretModel()
    for i, (_, alphabet) in enumerate(ALPHABETS):
        total = sum(seen[c] for c in alphabet)
        model.excess[i] = max(0.05, len(alphabet) * sum((seen[c] / total) ** 2 for c in alphabet) - 1)
    step = F.least(F.floor(-F.log10(F.greatest(battery(F.col("run"), model.excess)["p_ordinary"], F.lit(1e-60))) * P_STEPS), F.lit(60 * P_STEPS))
    table = (runs.where(F.char_length("run") >= TESTED_RUN).groupBy(length_class(F.col("run")).alias("class"), step.alias("step"))
             .agg(F.count("*").alias("n")).collect())
    for i in range(len(model.accept)):
        own = sorted(((r["step"], r["n"]) for r in table if r["class"] == i), reverse=True)
        tests, below = sum(n for _, n in own), 0
        for at, n in own:
            below += n
            # all runs of this step have a p of at most 10 ** (-at / P_STEPS)
            p = 10 ** (-at / P_STEPS)
            if p <= rate * below / tests:
                model.accept[i] = max(model.accept[i], p)
    return model


def added_spans(text: Column, base: Column, model: SecretModel) -> Column:
    """Random-looking runs outside the base spans."""
    runs = spans_of(text, RUN % TESTED_RUN, "random", TESTED_RUN)

    def wanted(s: Column) -> Column:
        apart = ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
        likely = let(battery(s["body"], model.excess), lambda p: (p["p_random"] >= model.least_random)
                     & (p["p_ordinary"] <= _of_encoding(length_class(s["body"]), model.accept)))
        return F.when(apart, likely).otherwise(False)

    return F.filter(runs, wanted)


def secret_spans(documents: DataFrame, model: SecretModel, text: str = "text", base: str = "base", added: str = "added") -> DataFrame:
    """Adds the arrays ``base`` and ``added`` of ``(kind, start, stop, body)`` to every row of ``documents``.

    Places are code points from 0, ends exclusive. A null text is empty and has no spans. Rows keep
    all their columns (``base`` and ``added`` must not be among them); repeated rows keep a row
    each; texts of any length are searched whole.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    both = let(base_spans(value), lambda b: F.struct(b.alias("base"), added_spans(value, b, model).alias("added")))
    found = documents.withColumn(base, both)
    return found.withColumn(added, F.col(base)["added"]).withColumn(base, F.col(base)["base"])


def ordered(spans: Column) -> Column:
    """Spans by start, then by kind in the listed order."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["body"].alias("body")))
    return F.array_sort(keyed)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the ordered spans, comma-joined."""
    return F.array_join(F.transform(ordered(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by one mark."""
    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(ordered(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
