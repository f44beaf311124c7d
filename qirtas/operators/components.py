"""Connected components of an edge table, by label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.lineage import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """``id, component`` for every vertex of ``edges``: the component is its least vertex.

    Each round takes the least label among a vertex and its neighbours, then jumps to that label's own label, so that
    the rounds grow with the logarithm of the diameter. The least label per vertex is combined before the shuffle, so a
    hub costs no more than its links.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v and u is not null and v is not null")
    both = written(both.union(both.select("v", "u")).distinct(), "links")
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label"))
    labels = written(labels, "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, "u").select("u", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("u").alias("next"), F.col("label").alias("far"))
        new = written(step.join(jump, "next", "left").select("u", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "labels")
        labels = new.select("u", "label")
        if new.where("moved").isEmpty():
            return labels.select(F.col("u").alias("id"), F.col("label").alias("component"))
    raise RuntimeError("the components did not settle")
