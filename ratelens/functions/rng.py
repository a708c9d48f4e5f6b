"""Keyed pseudo-random numbers: the same for a key whatever the order or partitioning of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex(key: tuple[Column | str | int, ...], digits: int) -> Column:
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, digits), 16, 10).cast("long")


def draw(*key: Column | str | int) -> Column:
    """An integer from 0 to 2**32 - 1 from the md5 of the key's parts, joined by bars.

    A string is a literal part; columns and numbers are cast to strings.
    """
    return _hex(key, 8)


def uniform(*key: Column | str | int) -> Column:
    """A number from 0 up to 1, of 52 bits, from the same md5."""
    return _hex(key, 13) / F.lit(2.0**52)
