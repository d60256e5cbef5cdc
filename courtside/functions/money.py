"""Exact dollars: LongType outside, decimals inside, never doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_dollars(c) -> Column:
    """``"$1,234"`` as long; blank as null."""
    return F.nullif(F.trim(F.regexp_replace(_col(c), r"[$,\s]", "")), F.lit("")).try_cast("long")


def parse_dollars(c) -> Column:
    """As ``strip_dollars``, also ``"$1.35M"``; an empty string is an error."""
    bare = F.upper(F.trim(F.regexp_replace(_col(c), r"[$,\s]", "")))
    million = F.round(F.regexp_replace(bare, "M$", "").try_cast("decimal(20,6)") * F.lit(1_000_000).cast("decimal(10,0)"), 0).cast("long")
    return F.when(bare == "", F.raise_error(F.lit("empty amount")).cast("long")).when(bare.endswith("M"), million).otherwise(bare.try_cast("long"))


def pct_of(amount, pct) -> Column:
    """``pct`` per cent of ``amount``, halves up, exact."""
    p = F.lit(pct).cast("decimal(9,4)") if not isinstance(pct, Column) else pct.cast("decimal(9,4)")
    return F.round(_col(amount).cast("decimal(20,0)") * p / F.lit(100).cast("decimal(3,0)"), 0).cast("long")


def grouped(c) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(_col(c), 0)


def dollars(c) -> Column:
    """``$1,234``; negative amounts as ``$-5``."""
    return F.concat(F.lit("$"), grouped(c))


def cents(c) -> Column:
    """A double amount as whole cents, by way of an exact decimal."""
    return (_col(c).cast("decimal(18,2)") * 100).cast("long")
