"""Counts of whole texts that rules and classifiers start from, computed on Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from surveyloom.llm.textarrays import chunks, sequence_hashes, split_words

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_lines", "n_upper", "n_letters",
         "n_digits", "n_exclaim", "n_pipes", "n_distinct", "n_adjacent", "n_closed_lines", "n_non_ascii", "n_stops", "n_clean_words")


def _flags(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_UPPER, _LETTER = _flags(bytes(range(65, 91))), _flags(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_MASKS = {"n_symbols": _flags(SYMBOLS), "n_upper": _UPPER, "n_letters": _LETTER, "n_digits": _flags(b"0123456789"),
          "n_exclaim": _flags(b"!"), "n_pipes": _flags(b"|"), "n_non_ascii": _flags(bytes(range(192, 256))), "n_stops": _flags(b".?")}
_INNER = _flags(bytes([*range(65, 91), *range(97, 123), *range(128, 256), *b"'-"]))
_CONTINUATION = _flags(bytes(range(128, 192)))


def _between(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside runs of ``window`` words that occur twice or more in the text."""
    runs = sequence_hashes(hashes, window)
    ordered = np.sort(runs)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = np.flatnonzero(np.isin(runs, again))
    marks = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(marks, hit, 1)
    np.add.at(marks, hit + window, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def _lines(text: bytes) -> tuple[int, int, int]:
    """Lines with a word, those equal to an earlier one, and those that end like a sentence."""
    seen, repeated, closed, total = set(), 0, 0, 0
    for line in text.split(b"\n"):
        body = line.strip(b" \t\r\v\f")
        if not body:
            continue
        total += 1
        closed += body.endswith((b".", b"!", b"?", b":", b'"'))
        if line in seen:
            repeated += 1
        seen.add(line)
    return total, repeated, closed


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """One int64 array for each of ``NAMES``; null texts count as empty."""
    parts: dict[str, list] = {name: [] for name in NAMES}
    for _, _, data, offsets in chunks(texts):
        words = split_words(data, offsets)
        put = lambda name, values: parts[name].append(np.asarray(values, np.int64))
        put("n_words", np.diff(words.first))
        put("n_bytes", np.diff(offsets))
        for name, flags in _MASKS.items():
            put(name, _between(flags[data], offsets))
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, words.starts, 1)
        np.add.at(inside, words.ends, -1)
        put("word_chars", _between((np.cumsum(inside)[:-1] > 0) & ~_CONTINUATION[data], offsets))
        # words of letters, but for one other character at their end
        odd = np.r_[0, np.cumsum(~_INNER[data])]
        inner = odd[words.ends] - odd[words.starts]
        put("n_clean_words", _between((inner == 0) | ((inner == 1) & ~_INNER[data[words.ends - 1]] & (words.ends - words.starts > 1)), words.first))
        same = np.zeros(len(words.hashes), bool)
        same[1:] = words.hashes[1:] == words.hashes[:-1]
        firsts = words.first[:-1][words.first[:-1] < len(same)]
        same[firsts] = False
        put("n_adjacent", _between(same, words.first))
        spans = list(zip(words.first[:-1].tolist(), words.first[1:].tolist()))
        put("n_distinct", [len(np.unique(words.hashes[a:b])) for a, b in spans])
        put("n_repeat_words", [repeated_words(words.hashes[a:b]) for a, b in spans])
        raw = data.tobytes()
        lines = np.array([_lines(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64)
        for i, name in enumerate(("n_lines", "n_dup_lines", "n_closed_lines")):
            put(name, lines[:, i])
    return {name: np.concatenate(x) if x else np.zeros(0, np.int64) for name, x in parts.items()}


def add_statistics(schema_names: list[str], keep_text: bool = False):
    """Arrow function: the last column is the text; it is followed (with ``keep_text``) or replaced by its statistics."""
    def run(batches):
        for batch in batches:
            found = statistics(batch.column(batch.num_columns - 1))
            kept = batch.columns if keep_text else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(found[n]) for n in NAMES]], [*schema_names, *NAMES])
    return run


STATISTICS_SCHEMA = ", ".join(f"{n} long" for n in NAMES)
