import random
import re
import textwrap

import pytest

from surveyloom.llm import licenses
from surveyloom.llm.license_texts import FULL_TEXTS
from tests.llm.brute import ASCII

ALL = {**licenses.TEMPLATES, **FULL_TEXTS}


def pairs(text):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(ASCII))
    return list(zip(words, words[1:]))


def passages(text, template, percent=80):
    """All windows, best first, by plain sets."""
    own, body = pairs(text), pairs(template)
    wanted, longest = set(body), len(body) * (200 - percent) // percent
    fit = []
    for i in range(len(own)):
        seen = set()
        for j in range(i, min(i + longest, len(own))):
            seen.add(own[j])
            shared, sizes = len(seen & wanted), len(seen) + len(wanted)
            if own[i] in wanted and 200 * shared >= percent * sizes:
                fit.append((-2 * shared / sizes, i, j + 1, shared, sizes))
    out = []
    for _, i, j, shared, sizes in sorted(fit):
        if all(j <= a or b <= i for a, b, *_ in out):
            out.append((i, j, shared, sizes))
    return [(i, j - i + 1, shared, sizes) for i, j, shared, sizes in out]


def found(df, templates=ALL):
    return sorted((tuple(r)[:6] for r in licenses.license_passages(df, templates).collect()), key=str)


def test_wrapped_and_embedded_wording_equals_all_windows(spark):
    rng = random.Random(8)
    short = {n: t for n, t in ALL.items() if len(t) < 1700}
    vocabulary = " ".join(short.values()).split()
    noise = lambda n: " ".join(rng.choice(vocabulary) if rng.random() < 0.3 else f"x{rng.randrange(99)}" for _ in range(n))
    rows = [(None, None), (1, ""), (2, "Released under the MIT License. " * 3), (2, "under the MIT License MIT License " * 5), (3, "one"), (4, noise(150))]
    for i, (name, body) in enumerate(sorted(short.items()), 10):
        words = [w for w in body.split() if rng.random() > 0.07]
        wrapped = textwrap.fill(" ".join(words), 60, initial_indent="# ", subsequent_indent="# ")
        rows.append((i, f"{noise(20)}\n{wrapped}\n{noise(20)} {textwrap.fill(body, 40)} {noise(5)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    expected = [(d, n, *p) for d, t in rows for n, body in short.items() for p in passages(t, body)]
    assert found(df, short) == sorted(expected, key=str)
    assert licenses.license_passages(df.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(FULL_TEXTS))
def test_whole_licenses_are_found_in_longer_texts(spark, name):
    body = " ".join(FULL_TEXTS[name].replace("<year>", "2021").replace("<copyright holders>", "A. N. Author").split())
    texts = [body, textwrap.fill(body, 72, initial_indent=" * ", subsequent_indent=" * "), "int main() { return 0; }\n" * 40 + textwrap.fill(body, 50) + "\nint x;" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {d for d, n, *_ in found(df) if n == name} == {0, 1, 2}


def test_wrapped_sentence_is_found(spark):
    df = spark.createDataFrame([(1, "Redistribution and use in source and binary forms, with or without modification,\n"
                                    "are permitted provided that the following conditions are met:")], "doc_id long, text string")
    assert licenses.license_matches(df).where("unit = 'line'").count() == 0
    assert ("bsd/text", 0) in [(n, at) for _, n, at, *_ in found(df)]
