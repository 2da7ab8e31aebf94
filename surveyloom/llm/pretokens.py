"""Pre-tokens of a byte-level BPE vocabulary and their ids.

A text is first cut at the vocabulary's special string, each part is cut into pre-tokens by the
vocabulary's pattern, and merges never cross a pre-token. So counts and ids of a text follow
from those of its pre-tokens.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import numpy as np

SPECIAL = "<|endoftext|>"
#: Unicode white space, as the vocabulary's pattern means it.
_SPACES = "\t-\r \x85\xa0  -     　"


def _pattern(numbers: str) -> re.Pattern:
    return re.compile(
        rf"'(?:[stmd]|re|ve|ll)| ?[^\W\d_{numbers}]+| ?[\d{numbers}]+| ?(?:[^{_SPACES}\w]+|_+)+"
        rf"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


@functools.cache
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Numbers that are no decimal digits; the pattern for texts with such and the faster one for others."""
    numbers = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")]
    edges = [i for i in range(len(numbers)) if i == 0 or numbers[i] != numbers[i - 1] + 1]
    listed = "".join(f"{chr(numbers[a])}-{chr(numbers[b - 1])}" for a, b in zip(edges, [*edges[1:], len(numbers)]))
    return re.compile(f"[{listed}]"), _pattern(listed), _pattern("")


def split(text: str) -> list[str]:
    """Pre-tokens of a text by the vocabulary's pattern, in Python's re."""
    numbers, exact, fast = _patterns()
    return (exact if numbers.search(text) else fast).findall(text)


def pretokens(text: str) -> tuple[list[str], int]:
    """Pre-tokens of a text in order (without the special strings) and the number of special strings."""
    if SPECIAL not in text:
        return split(text), 0
    parts = text.split(SPECIAL)
    return [t for part in parts for t in split(part)], len(parts) - 1


@functools.cache
def encoding(rank_file: str):
    """The same vocabulary for whole texts, with its special string as the first free id.

    The pattern is the vocabulary's, with possessive repeats, which match the same and never go back.
    """
    import base64

    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def text_ids(rank_file: str, text: str) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit integers; the special string is one id."""
    return encoding(rank_file).encode_to_numpy(text, allowed_special="all")


@functools.cache
def tokenizer(json_file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_file)


@functools.cache
def entry_counts(json_file: str) -> dict[str, int]:
    """Piece counts of the vocabulary's own entries that are one pre-token: at most as many as it has entries."""
    tok = tokenizer(json_file)
    entries = [e for e in tok.decode_batch([[i] for i in range(tok.get_vocab_size())], skip_special_tokens=False)
               if e != SPECIAL and split(e) == [e]]
    found = tok.encode_batch_fast(entries, add_special_tokens=False)
    return {e: len(x) for e, x in zip(entries, found)}
