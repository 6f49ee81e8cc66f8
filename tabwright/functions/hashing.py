"""Reproducible pseudo-random numbers derived from row keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 13 hexadecimal digits are 52 bits, which a double holds exactly.
HASH_DIGITS = 13
HASH_RANGE = 16**HASH_DIGITS


def row_key(*columns: str) -> Column:
    """One text key from one or several identifying columns."""
    return F.concat_ws("-", *[F.col(c).cast("string") for c in columns])


def key_hash(key: Column, seed: int) -> Column:
    """Uniform integer in ``[0, HASH_RANGE)``; the same key and seed always give the same value.

    A missing key is a key like any other.
    """
    text = F.concat(F.coalesce(key.cast("string"), F.lit("missing key")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("bigint")


def key_uniform(key: Column, seed: int) -> Column:
    """``key_hash`` scaled to ``[0, 1)``."""
    return key_hash(key, seed) / F.lit(float(HASH_RANGE))
