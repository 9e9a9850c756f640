"""Randomness by keyed hashing: the same draw for the same key in any engine, order and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def uniform(seed: int, *keys: Column) -> Column:
    """A number from 0 up to, not including, 1."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
