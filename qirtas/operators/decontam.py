"""Exact and n-gram decontamination against evaluation texts, by one hash join on exploded n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qirtas.functions import text as X


def key_words(c: Column) -> Column:
    return X.words(X.query_key(X.normalize(c)))


def tables(evals: DataFrame, n: int = 13, least: int = 6) -> DataFrame:
    """``kind, gram, label``: exact keys of all items, ``n``-grams of long ones, the whole of items of ``least`` to
    ``n - 1`` words; the first item (by ``item_id``) labels a gram that several share."""
    d = evals.select("item_id", key_words(F.col("text")).alias("w")).where("size(w) > 0")
    whole = F.array_join("w", " ")
    exact = d.select(F.lit(0).alias("kind"), whole.alias("gram"), "item_id")
    long_ = d.where(F.size("w") >= n).select(F.lit(n).alias("kind"), F.explode(X.ngrams(F.col("w"), n)).alias("gram"), "item_id")
    mid = d.where(F.size("w").between(least, n - 1)).select(F.size("w").alias("kind"), whole.alias("gram"), "item_id")
    return exact.union(long_).union(mid).groupBy("kind", "gram").agg(F.min("item_id").alias("label"))


def decide(texts: DataFrame, key: str, text: str, evals: DataFrame, n: int = 13, least: int = 6) -> DataFrame:
    """``key, reason, label``: exact query, ``n``-gram, or whole short query; exact wins, then longer grams."""
    t = tables(evals, n, least)
    d = texts.select(key, key_words(F.col(text)).alias("w")).where("size(w) > 0")
    sizes = range(least, n + 1)

    def sized(k: int) -> Column:
        return F.transform(X.ngrams(F.col("w"), k), lambda g: F.struct(F.lit(k).alias("kind"), g.alias("gram")))

    grams = F.flatten(F.array(*map(sized, sizes)))
    whole = F.array(F.struct(F.lit(0).alias("kind"), F.array_join("w", " ").alias("gram")))
    e = d.select(key, F.explode(F.concat(whole, grams)).alias("g")).select(key, "g.kind", "g.gram").distinct()
    rank = F.when(F.col("kind") == 0, -1).otherwise(n - F.col("kind"))
    hit = e.join(t, ["kind", "gram"]).groupBy(key).agg(F.min(F.struct(rank.alias("rank"), "label", "kind")).alias("h"))
    reason = F.when(F.col("h.kind") == 0, "exact query").when(F.col("h.kind") == n, f"{n}-gram").otherwise("whole short query")
    return hit.select(key, reason.alias("reason"), F.col("h.label").alias("label"))


def check_canaries(texts: DataFrame, key: str, text: str, evals: DataFrame, canaries: dict[str, str]) -> list[str]:
    """Ids of planted rows that the decision misses (none, or the tables are broken). ``canaries``: id -> text."""
    spark = texts.sparkSession
    c = spark.createDataFrame(list(canaries.items()), f"{key} string, {text} string")
    return sorted(set(canaries) - {r[key] for r in decide(c, key, text, evals).select(key).collect()})
