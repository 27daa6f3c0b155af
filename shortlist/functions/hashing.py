"""Seeded, engine-independent pseudo-randomness.

Every draw is a function of a seed and of keys in the row, so that a recomputed
partition makes the same draw and any SQL engine with md5 can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int, *keys: Column) -> Column:
    """32 hexadecimal digits, uniform over rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_int(hex_digest: Column, digits: int = 15) -> Column:
    """The leading hexadecimal digits as a number (15 digits give 0 .. 2**60 - 1)."""
    return F.conv(F.substring(hex_digest, 1, digits), 16, 10).cast("bigint")


def draw(seed: int, size: Column, *keys: Column) -> Column:
    """A number in ``0 .. size - 1``."""
    return F.pmod(hash_int(seeded_hash(seed, *keys)), size.cast("bigint"))
