"""License scans: normalised text against templates by the Dice coefficient of word bigrams.

``license_matches`` compares each whole text and each of its lines; ``license_passages`` finds the wording
wherever it stands, wrapped over lines or inside a longer text. Words are runs of letters, digits and
characters beyond ASCII, with A-Z in lower case. Two bigram sets of sizes a and b reach a
coefficient c only if a lies between ``b * c / (2 - c)`` and ``b * (2 - c) / c``, so most units meet no
template at all; hashes find the units that share enough bigrams with the templates.
"""

from __future__ import annotations

import heapq
from bisect import bisect, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.license_texts import FULL_TEXTS
from surveyloom.llm.textarrays import chunks, sequence_hashes, split_words

#: Wording of public licenses and of the usual notices that name them.
TEMPLATES = {
    "mit/notice": "Released under the MIT License.",
    "mit/licensed": "Licensed under the MIT License.",
    "mit/text": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
                 "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
                 "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
                 "this permission notice shall be included in all copies or substantial portions of the Software."),
    "apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/header": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                          "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "gpl-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0/header": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                       "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
                       "later version."),
    "isc/text": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                 "provided that the above copyright notice and this permission notice appear in all copies."),
    "bsd/text": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                 "following conditions are met:"),
    "mpl-2.0/header": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                       "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "cc-by-nc-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0/notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0/notice": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "unlicense/text": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD_PERCENT = 80

_PLAIN = np.full(256, 0x20, np.uint8)
for _code in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _PLAIN[_code] = _code
_PLAIN[65:91] = np.arange(97, 123)


def _bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words, and where each unit's words begin."""
    words = split_words(_PLAIN[data], offsets)
    return sequence_hashes(words.hashes, 2), words.first


def template_sets(templates: Mapping[str, str]) -> dict[str, np.ndarray]:
    out = {}
    for name, text in templates.items():
        data = np.frombuffer(text.encode(), np.uint8)
        out[name] = np.unique(_bigrams(data, np.array([0, len(data)]))[0])
    return {n: s for n, s in out.items() if len(s)}


def _matches(grams: np.ndarray, first: np.ndarray, sets: dict[str, np.ndarray], percent: int) -> Iterator[tuple]:
    """``(unit, name, shared, sizes)`` of the best template of each unit that reaches the threshold; ties to the earlier name."""
    marked = np.zeros(len(grams) + 1, np.int64)
    np.cumsum(np.isin(grams, np.concatenate(list(sets.values()))), out=marked[1:])
    ends = np.maximum(first[1:] - 1, first[:-1])
    hits = marked[np.minimum(ends, len(grams))] - marked[np.minimum(first[:-1], len(grams))]
    least = min(len(s) * percent / (200 - percent) for s in sets.values())
    most = max(len(s) * (200 - percent) / percent for s in sets.values())
    for unit in np.flatnonzero(hits * (200 - percent) >= least * percent):
        own = np.unique(grams[first[unit]:ends[unit]])
        if not least <= len(own) <= most:
            continue
        found = []
        for name, other in sets.items():
            if len(own) * (200 - percent) >= len(other) * percent and len(own) * percent <= len(other) * (200 - percent):
                shared, sizes = len(np.intersect1d(own, other, assume_unique=True)), len(own) + len(other)
                if 200 * shared >= percent * sizes:
                    found.append((-shared / sizes, name, shared, sizes))
        if found:
            _, name, shared, sizes = min(found)
            yield int(unit), name, shared, sizes


def _scan(templates: Mapping[str, str], percent: int):
    names = ["doc_id", "unit", "line", "template", "shared", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = template_sets(templates)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for begin, _, data, offsets in chunks(batch.column(1)):
                for unit, name, shared, sizes in _matches(*_bigrams(data, offsets), sets, percent):
                    rows.append((ids[begin + unit], "document", None, name, shared, sizes))
                breaks = np.flatnonzero(data == 10) + 1
                cuts = np.union1d(breaks, offsets)
                cuts = cuts if len(cuts) > 1 else np.array([0, len(data)])
                text_of = np.searchsorted(offsets, cuts[:-1], side="right") - 1
                opening = np.searchsorted(cuts, offsets[text_of])
                for unit, name, shared, sizes in _matches(*_bigrams(data, cuts), sets, percent):
                    rows.append((ids[begin + int(text_of[unit])], "line", unit - int(opening[unit]), name, shared, sizes))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
    return run


def license_matches(documents: DataFrame, templates: Mapping[str, str] = TEMPLATES, percent: int = THRESHOLD_PERCENT,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, unit, line, template, shared, sizes, dice)``: the best template of each matching text and line.

    ``line`` counts from 0 and is null for whole texts. ``dice`` is ``2 * shared / sizes``. Texts that
    are null, empty or match nothing give no row; repeated rows give their matches each; a null id
    stays null. Equal coefficients go to the alphabetically first template. An empty table gives no rows.
    """
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = texts.mapInArrow(_scan(dict(templates), percent),
                             "doc_id long, unit string, line long, template string, shared long, sizes long")
    return found.withColumn("dice", 2 * F.col("shared") / F.col("sizes"))


def _previous(values: np.ndarray) -> np.ndarray:
    """Place of the last earlier equal value, or -1."""
    order = np.argsort(values, kind="stable")
    same = np.flatnonzero(values[order[1:]] == values[order[:-1]])
    out = np.full(len(values), -1, np.int64)
    out[order[same + 1]] = order[same]
    return out


def best_windows(marked: np.ndarray, before: np.ndarray, size: int, longest: int, percent: int) -> list[tuple[int, int, int, int]]:
    """``(start, end, shared, sizes)`` of the windows of bigrams that reach the threshold, the highest coefficient first.

    ``marked`` tells which bigrams of the text are in the template of ``size`` distinct ones, ``before`` where each was
    last. Taken is again and again the best window beside those taken. Starts are tried in the order of
    what they can reach at most, and only as long as that beats what is found.
    """
    places = np.flatnonzero(marked)
    # a bigram is new in the windows that start after its last place
    opened = np.bincount(np.maximum(before[places] + 1, np.maximum(places - longest + 1, 0)), minlength=len(marked) + 1)
    closed = np.bincount(places + 1, minlength=len(marked) + 1)
    most = np.cumsum(opened - closed)[places]
    likely = 200 * most >= percent * (most + size)
    heap = [(-2 * m / (m + size), 0, i) for i, m in zip(places[likely].tolist(), most[likely].tolist())]
    heapq.heapify(heap)
    taken: list[tuple[int, int]] = []
    out = []
    while heap:
        _, known, start, *window = heapq.heappop(heap)
        at = bisect(taken, (start, len(marked) + 1))
        if at and taken[at - 1][1] > start:
            continue
        room = taken[at][0] if at < len(taken) else len(marked)
        if known and window[0] <= room:
            insort(taken, (start, window[0]))
            out.append((start, *window))
            continue
        end = min(start + longest, room)
        new = before[start:end] < start
        sizes = np.cumsum(new) + size
        shared = np.cumsum(new & marked[start:end])
        best = int(np.argmax(shared / sizes))
        if 200 * shared[best] >= percent * sizes[best]:
            heapq.heappush(heap, (-2 * int(shared[best]) / int(sizes[best]), 1, start, start + best + 1, int(shared[best]), int(sizes[best])))
    return out


def _find_passages(templates: Mapping[str, str], percent: int):
    names = ["doc_id", "template", "first_word", "words", "shared", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = template_sets(templates)
        longest = {}
        for name in sets:
            data = np.frombuffer(templates[name].encode(), np.uint8)
            longest[name] = len(_bigrams(data, np.array([0, len(data)]))[0]) * (200 - percent) // percent
        vocabulary = np.unique(np.concatenate([np.zeros(1, np.uint64), *sets.values()]))
        member = {name: np.isin(vocabulary, own) for name, own in sets.items()}
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for begin, end, data, offsets in chunks(batch.column(1)):
                grams, first = _bigrams(data, offsets)
                at = np.minimum(np.searchsorted(vocabulary, grams), len(vocabulary) - 1)
                places = np.flatnonzero(vocabulary[at] == grams)
                unit = np.searchsorted(first, places, side="right") - 1
                inside = places < first[unit + 1] - 1
                unit, entry = np.divmod(np.unique(unit[inside] * len(vocabulary) + at[places[inside]]), len(vocabulary))
                before: dict[int, np.ndarray] = {}
                for name, own in sets.items():
                    count = np.bincount(unit[member[name][entry]], minlength=end - begin)
                    for u in np.flatnonzero(count * (200 - percent) >= len(own) * percent).tolist():
                        a, b = int(first[u]), int(first[u + 1]) - 1
                        if u not in before:
                            before[u] = _previous(grams[a:b])
                        marked = member[name][at[a:b]] & (vocabulary[at[a:b]] == grams[a:b])
                        for start, stop, shared, sizes in best_windows(marked, before[u], len(own), longest[name], percent):
                            rows.append((ids[begin + u], name, start, stop - start + 1, shared, sizes))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
    return run


def license_passages(documents: DataFrame, templates: Mapping[str, str] = {**TEMPLATES, **FULL_TEXTS}, percent: int = THRESHOLD_PERCENT,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, template, first_word, words, shared, sizes, dice)``: the passages of each text that match a template.

    Windows of the whole text's words are compared, line breaks or not, that begin with a bigram of the template and
    have at most ``(200 - percent) / percent`` times its bigrams; fewer than the inverse cannot match. For
    each template the best window that reaches the threshold is taken (then the earliest, then the shortest), then the best one
    that shares no bigram with those taken, and so on. ``first_word`` counts from 0. Null and empty texts give no row; repeated
    rows give their passages each; a null id stays null. An empty table gives no rows.
    """
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = texts.mapInArrow(_find_passages(dict(templates), percent),
                             "doc_id long, template string, first_word long, words long, shared long, sizes long")
    return found.withColumn("dice", 2 * F.col("shared") / F.col("sizes"))


def oracle(templates: Mapping[str, str] = TEMPLATES, percent: int = THRESHOLD_PERCENT) -> str:
    """The same result in DuckDB SQL."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates.items())
    words = ("regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')")
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
with templates(template, body) as (values {rows}),
t as (select template, {grams} as g from (select template, {words.format('body')} as w from templates)),
units as (select doc_id, 'document' as unit, cast(null as bigint) as line, text as body from documents where text is not null
  union all select doc_id, 'line', i - 1, parts[i] from (select doc_id, string_split(text, chr(10)) as parts from documents), unnest(range(1, len(parts) + 1)) as u(i)),
sets as (select doc_id, unit, line, {grams} as g from (select doc_id, unit, line, {words.format('body')} as w from units)),
pairs as (select doc_id, unit, line, template, len(list_intersect(sets.g, t.g)) as shared, len(sets.g) + len(t.g) as sizes
  from sets join t on len(sets.g) * {200 - percent} >= len(t.g) * {percent} and len(sets.g) * {percent} <= len(t.g) * {200 - percent}),
ranked as (select *, row_number() over (partition by doc_id, unit, line order by shared / sizes desc, template) as place
  from pairs where 200 * shared >= {percent} * sizes)
select doc_id, unit, line, template, shared, sizes, 2.0::double * shared / sizes as dice from ranked where place = 1"""
