"""Random numbers as column expressions: a stream is a function of its key, so every run, plan and retry draws the same."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: hex digits of an MD5 that make one uniform: 52 bits, exact in a double
DIGITS = 13


def _digest(seed: int, *keys: str | Column) -> Column:
    """MD5 of the seed and the keys as text, joined by bars; a null key is the text null."""
    text = lambda k: F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("null"))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *map(text, keys)))


def _unit(digest: Column, k: int) -> Column:
    return (F.conv(F.substring(digest, DIGITS * k + 1, DIGITS), 16, 10).cast("double") + 0.5) / float(1 << 4 * DIGITS)


def uniform(seed: int, *keys: str | Column) -> Column:
    """In (0, 1), ends excluded."""
    return _unit(_digest(seed, *keys), 0)


def normal(seed: int, *keys: str | Column) -> Column:
    """Standard normal, by Box and Muller from two uniforms of one digest."""
    d = _digest(seed, *keys)
    return F.sqrt(-2 * F.log(_unit(d, 0))) * F.cos(2 * math.pi * _unit(d, 1))
