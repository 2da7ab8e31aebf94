"""Reproducible draws: a uniform number is a function of seed and keys, not of row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed, *keys) -> Column:
    """Hex SHA-256 of ``seed|key|key...``."""
    parts = [F.lit(str(seed))]
    for key in keys:
        parts.append((F.col(key) if isinstance(key, str) else key).cast("string"))
    return F.sha2(F.concat_ws("|", *parts), 256)


def uniform_of(hex_digest: Column) -> Column:
    """First 32 bits of a hex digest as a double in [0, 1)."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(seed, *keys) -> Column:
    return uniform_of(digest(seed, *keys))
