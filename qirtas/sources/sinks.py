"""Sinks: Parquet (whole or partitioned), JSON, and small reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str) -> None:
    """zstd Parquet; the committer makes it visible as a whole."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def split_by_source(df: DataFrame, path: str) -> None:
    """``path/split=.../source=...``; rows of a partition come from few tasks, salted so that a large source has many."""
    d = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    d.repartition("split", "source", "_salt").drop("_salt").write.mode("overwrite").option("compression", "zstd").partitionBy("split", "source").parquet(path)


def shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder for each shard number, rows in order of ``pair_id``."""
    df.repartition(shard).sortWithinPartitions(shard, "pair_id").write.mode("overwrite").option("compression", "zstd").partitionBy(shard).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_small(path: str, content: object) -> None:
    """A manifest or report on the driver, replaced as a whole."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False, indent=1, sort_keys=True))
    os.replace(f"{path}.new", path)
