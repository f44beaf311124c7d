"""Cutting lineage through the checkpoint folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the setting is absent, a temporary folder in local mode (tests); on
    a cluster that is an error, as executors share no machine's own folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="qirtas-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


_tables: list[tuple[SparkSession, str]] = []


def remove_written() -> None:
    """Delete the tables that ``written`` made in this application; runs at its end, as lazy results may need them."""
    while _tables:
        spark, path = _tables.pop()
        with contextlib.suppress(Exception):  # the session may be gone already
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(remove_written)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cheaper than a checkpoint where only some
    columns are read later, as Parquet is columnar and compressed."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
