"""Weak supervision over quality rules: rules vote or abstain, their accuracies are estimated, and a
posterior probability replaces the demand that every rule passes.

The votes of all documents are counted by pattern (at most ``3 ** rules`` patterns, whatever the
number of documents). Expectation-maximisation on these counts gives, for each rule, how often it
votes right for good and for bad documents, and with that the posterior of each pattern.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import cut
from surveyloom.llm.text_statistics import STATISTICS_SCHEMA, add_statistics

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    """1 good, 0 bad, 2 abstains."""
    return F.when(bad, 0).when(good, 1).otherwise(2)


def rules() -> dict[str, Column]:
    """The voting rules over the text statistics; a document without words gets abstentions."""
    word_length = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    symbols, shout = _share("n_symbols", "n_words"), _share("n_upper", "n_letters")
    lines, repeats = _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words")
    adjacent, exclaim = _share("n_adjacent", "n_words"), _share("n_exclaim", "n_words")
    distinct, stops, clean = _share("n_distinct", "n_words"), _share("n_stops", "n_words"), _share("n_clean_words", "n_words")
    some = F.col("n_words") > 0
    vote = lambda good, bad: _vote(some & good, some & bad)
    return {
        "word_length": vote(word_length.between(3, 9), (word_length < 2) | (word_length > 14)),
        "clean_words": vote(clean >= 0.85, clean < 0.6),
        "symbols": vote(symbols <= 0.05, symbols > 0.2),
        "capitals": vote(shout <= 0.2, shout > 0.5),
        "equal_lines": vote(lines <= 0.1, lines > 0.3),
        "repeats": vote(repeats <= 0.05, repeats > 0.2),
        "stutter": vote(adjacent <= 0.05, adjacent > 0.2),
        "exclamations": vote(exclaim <= 0.05, exclaim > 0.3),
        "vocabulary": vote(distinct >= 0.3, (distinct < 0.15) & (F.col("n_words") < 2000)),
        "sentences": vote(stops.between(0.01, 0.5), (stops < 0.002) & (F.col("n_words") >= 50)),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, steps: int = 500, prior_good: float = 0.8, prior_up: tuple[float, float] = (0.6, 0.97),
             strength: float = 20.0) -> tuple[float, np.ndarray]:
    """Share of good documents and P(vote = 1 | class, not abstaining) of each rule, by expectation-maximisation.

    ``patterns`` holds votes 0, 1 or 2 (abstains). Abstaining says nothing about the class. The start
    is that a document is good if no rule votes against it. A beta prior worth ``strength``
    documents says that rules rarely vote against good documents and that bad ones pass most rules;
    it also names the classes. A rule may turn out useless, but not reversed.
    """
    n_rules = patterns.shape[1] if patterns.ndim == 2 else 0
    one, zero = (patterns == 1).astype(float), (patterns == 0).astype(float)
    prior = np.tile(np.array(prior_up)[:, None], (1, n_rules))
    good, up, share = np.where(zero.sum(axis=1) > 0, 0.1, 0.95), prior, prior_good
    for _ in range(steps):
        before = up
        weight = np.stack([counts * (1 - good), counts * good])
        share = (weight[1].sum() + prior_good * strength) / (counts.sum() + strength)
        up = (weight @ one + strength * prior) / (weight @ (one + zero) + strength)
        up[0] = np.minimum(up[0], up[1])
        good = posterior(patterns, share, up)
        if np.abs(up - before).max(initial=0) < 1e-9:
            break
    return share, up


def posterior(patterns: np.ndarray, share: float, up: np.ndarray) -> np.ndarray:
    """P(good | votes) of each pattern."""
    up = np.clip(up, 1e-5, 1 - 1e-5)
    ratio = np.log(up[1] / up[0]), np.log((1 - up[1]) / (1 - up[0]))
    score = (patterns == 1) @ ratio[0] + (patterns == 0) @ ratio[1] + np.log(share / (1 - share))
    return 1 / (1 + np.exp(-score))


def quality_verdicts(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.5,
                     min_words: int = 20, repeat_percent: int = 30, store: bool = True) -> DataFrame:
    """``keep`` columns, base counts, ``base_failed``, ``kept``, ``votes`` and ``posterior`` for every row.

    Null and empty texts have no words: they fail the base rules and are not kept. Repeated rows
    keep a row each; other columns are ignored; an empty table gives no rows. A text is read whole.
    ``store`` keeps the votes and ``keep`` columns in the checkpoint folder; without it, for wide
    ``keep`` columns, the texts are read a second time instead.
    """
    fields = {f.name: f.dataType.simpleString() for f in documents.schema}
    own = text in keep  # a kept text is sent to Python once, as the last column
    order, keep = keep, (*[c for c in keep if c != text], *([text] if own else []))
    kept_names = [f"_keep_{i}" for i in range(len(keep))]
    schema = ", ".join([*[f"{k} {fields[c]}" for k, c in zip(kept_names, keep)], STATISTICS_SCHEMA])
    sent = [F.col(c).alias(k) for k, c in zip(kept_names, keep)] + ([] if own else [F.col(text)])
    stats = documents.select(*sent).mapInArrow(add_statistics(kept_names, own), schema)
    named = rules()
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    voted = stats.select(*kept_names, *BASE, failed.alias("base_failed"),
                         F.concat(*[v.cast("string") for v in named.values()]).alias("votes"))
    voted = cut(voted) if store else voted
    spark = documents.sparkSession
    rows = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    patterns = np.array([[int(v) for v in r["votes"]] for r in rows]).reshape(len(rows), len(named))
    share, up = estimate(patterns, np.array([r["n"] for r in rows], float))
    found = posterior(patterns, share, up)
    table = spark.createDataFrame([(r["votes"], float(p)) for r, p in zip(rows, found)], "votes string, posterior double")
    return (voted.join(F.broadcast(table), "votes")  # at most 3 ** rules rows
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
            .select(*[F.col(kept_names[keep.index(c)]).alias(c) for c in order], *BASE, "base_failed", "kept", "votes", "posterior"))
