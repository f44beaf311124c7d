"""Deterministic order: the single home of everything that would otherwise be a random draw.

A seeded draw is an order by ``md5(seed | purpose | key)``, ties by key, so a result doesn't depend on partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEED = 1234


def draw(purpose: str, *keys: Column | str, seed: int = SEED) -> Column:
    """The hash that orders a draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *keys))


def uniform(purpose: str, *keys: Column | str, seed: int = SEED) -> Column:
    """A number in [0, 1) by hash."""
    return F.conv(F.substring(draw(purpose, *keys, seed=seed), 1, 8), 16, 10).cast("long") / 4294967296


def first_n(df: DataFrame, n: int, by: list[str], order: list) -> DataFrame:
    """The first ``n`` rows of each group; a group's rows stream through a limited window."""
    r = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in ``order`` (never an arbitrary one)."""
    return first_n(df, 1, keys, order)


def keep_least(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``keep_first`` for one ordering column: combines before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_s"))
    return g.select(*keys, *(F.col("_s")[c].alias(c) for c in rest)).select(*df.columns)


def round_robin(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """``n`` rows, one from each group in turn."""
    r = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return first_n(df, n, [group], order).withColumn("turn", r).orderBy("turn", group).limit(n)


def global_sum(df: DataFrame, order: list, value: Column, name: str, buckets: int = 256) -> DataFrame:
    """The sum of ``value`` over all rows before each one in a total order, without one task that sorts all rows: the
    rows are range partitioned, summed per partition, and run on inside it from the sum of the partitions before."""
    from qirtas.lineage import written

    d = df.withColumn("_v", value).repartitionByRange(buckets, *order).withColumn("_p", F.spark_partition_id())
    d = written(d, "ranked")
    sums = d.groupBy("_p").agg(F.sum("_v").alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.coalesce(F.sum("_v").over(W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + own).drop("_p", "_before", "_v")  # at most one row per bucket


def global_rank(df: DataFrame, order: list, name: str, buckets: int = 256) -> DataFrame:
    """Dense row numbers (from 0) in a total order."""
    return global_sum(df, order, F.lit(1).cast("long"), name, buckets)


def group_sum(df: DataFrame, by: list[str], order: list, value: Column, name: str, buckets: int = 256) -> DataFrame:
    """The sum of ``value`` over the rows before each one of its group, and ``{name}_all``, the sum of the whole group,
    without a task that sorts a group: one running sum over all groups, less what it was where the group began. Meant
    for few columns; rows of null groups are a group."""
    d = written_sum(df, [*by, *order], value, "_run", buckets)
    g = d.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.min("_run").alias("_start"), F.sum("_value").alias(f"{name}_all"))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return d.join(g, on).withColumn(name, F.col("_run") - F.col("_start")).drop("_run", "_start", "_value", *(f"_{c}" for c in by))


def written_sum(df: DataFrame, order: list, value: Column, name: str, buckets: int) -> DataFrame:
    from qirtas.lineage import written

    return written(global_sum(df.withColumn("_value", value), order, F.col("_value"), name, buckets), "group-sum")


def group_rank(df: DataFrame, by: list[str], order: list, name: str, buckets: int = 256) -> DataFrame:
    """Row numbers (from 0) inside each group, and ``{name}_all``, the group's size, as ``group_sum`` finds them."""
    return group_sum(df, by, order, F.lit(1).cast("long"), name, buckets)
