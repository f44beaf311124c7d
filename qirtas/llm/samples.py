"""Bounded samples for training, by hash order: the same rows whatever the partitions, at any size of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes are taken as fractions of this.
WHOLE = 1 << 63


def bound(rows: int, want: int) -> int:
    """The hash below which about ``want`` of ``rows`` rows lie; never 0, so that no table is too large to be sampled."""
    return WHOLE - 1 if rows <= want else max(1, WHOLE * want // rows)


def place(key: Column, salt: str) -> Column:
    """The place of a row in the hash order, from 0 to ``WHOLE``."""
    return F.xxhash64(key, F.lit(salt)).bitwiseAND(F.lit(WHOLE - 1))


def first(df: DataFrame, key: str, order: list[str], below: Column, most: int, salt: str) -> DataFrame:
    """The rows whose hash lies below a bound, at most ``most`` of them in the order of hash, key and ``order``."""
    d = df.withColumn("_place", place(F.col(key), salt))
    return d.where(F.col("_place") < below).orderBy("_place", key, *order).limit(most).drop("_place")
