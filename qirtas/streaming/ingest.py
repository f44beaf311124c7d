"""Incremental ingestion with deduplication state: an addition of this engine to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qirtas.functions import text as X


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string, source string, loaded_at timestamp", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch)).parquet(folder)


def deduplicated(stream: DataFrame, late: str = "30 days", time: str = "loaded_at") -> DataFrame:
    """First arrival of each text; the state of a text is dropped once the watermark has passed it, so that it stays
    bounded. A copy that arrives later than that is taken as new."""
    d = stream.withColumn(time, F.col(time).cast("timestamp")).withColumn("dedup_key", X.md5_hex(F.coalesce("text", F.lit("")), 32))
    return d.withWatermark(time, late).dropDuplicatesWithinWatermark(["dedup_key"])


def hourly_counts(stream: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "2 hours") -> DataFrame:
    """Events by hour and kind; an hour is final when the watermark has passed it."""
    d = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = d.groupBy(F.window(time, "1 hour"), kind).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("hour"), kind, "n")
