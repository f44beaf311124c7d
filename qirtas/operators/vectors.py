"""Vector search, ranks, false negatives, hard negatives, retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qirtas.functions import ordering as O
from qirtas.lineage import written


class Scorer(Protocol):
    """Scores (query, passage) pairs; a cross-encoder in production."""

    def __call__(self, queries: list[str], passages: list[str]) -> np.ndarray: ...


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Query vectors of one block; each block is one broadcast and one pass over the pool.
QUERY_BLOCK = 4096


#: Blocks whose partial lists are merged and written together, so that the plan stays small however many blocks there are.
MERGED_BLOCKS = 16


def top_k(queries: DataFrame, pool: DataFrame, k: int, query_id: str = "vec_id", pool_id: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK, same: str | None = None, other: str | None = None) -> DataFrame:
    """``qid, pid, score, rank``: the ``k`` nearest pool rows of each query by dot product, ties by pool id. With ``same``
    only pool rows with the query's value in that column count (its domain), with ``other`` only those with another one
    (what is a positive). Null values in either are equal to no value.

    The queries are a stated set that is searched in blocks: a block's matrix is broadcast (``block`` vectors at most),
    every task multiplies it with its part of the pool and keeps the best ``k`` per query, and only these partial lists
    are shuffled and merged. A pool row is read once for each block and never shuffled."""
    spark = queries.sparkSession
    kind_q, kind_p = queries.schema[query_id].dataType.simpleString(), pool.schema[pool_id].dataType.simpleString()
    tests = [c for c in (same, other) if c is not None]
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "pid"))

    def search(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows])
        sent = spark.sparkContext.broadcast((ids, np.array([r[1] for r in rows], np.float64), [np.array([r[2 + i] for r in rows], object) for i in range(len(tests))]))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, own = sent.value
            best_s, best_p = np.full((len(ids), 0), 0.0), None
            for batch in batches:
                if not batch.num_rows:
                    continue
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                p = np.asarray(batch.column(0).to_pylist())
                s = q @ flat.reshape(batch.num_rows, -1).T
                for i, c in enumerate(tests):
                    theirs = np.array(batch.column(2 + i).to_pylist(), object)
                    equal = (own[i][:, None] == theirs[None]) & (theirs != None)[None]  # noqa: E711
                    s = np.where(equal == (c == same), s, -np.inf)
                best_s = np.concatenate([best_s, s], axis=1)
                best_p = np.tile(p, (len(ids), 1)) if best_p is None else np.concatenate([best_p, np.tile(p, (len(ids), 1))], axis=1)
                if best_s.shape[1] > k:
                    order = np.lexsort((best_p, -best_s), axis=1)[:, :k]
                    best_s, best_p = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_p, order, 1)
            if best_p is not None:
                n = best_s.shape[1]
                out = pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_p.reshape(-1)), pa.array(best_s.reshape(-1))], names=["qid", "pid", "score"])
                yield out.filter(pa.array(np.isfinite(best_s.reshape(-1))))

        return pool.select(pool_id, vector, *tests).where(F.col(vector).isNotNull()).mapInArrow(run, f"qid {kind_q}, pid {kind_p}, score double")

    def merged(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionAll, parts).withColumn("rank", rank).where(F.col("rank") <= k)

    rows: list = []
    parts: list[DataFrame] = []
    done: list[DataFrame] = []
    for r in queries.select(query_id, vector, *tests).where(F.col(vector).isNotNull()).toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            parts.append(search(rows))
            rows = []
        if len(parts) == MERGED_BLOCKS:
            done.append(written(merged(parts), "nearest"))
            parts = []
    if rows:
        parts.append(search(rows))
    if parts:
        done.append(merged(parts))
    if not done:
        return spark.createDataFrame([], f"qid {kind_q}, pid {kind_p}, score double, rank int")
    return reduce(DataFrame.unionAll, done)


def count_above(queries: DataFrame, pool: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """``qid, n`` for ``queries(qid, q, own, al)``: pool rows ``(vec_id, embedding, label)`` other than the query and of
    another label than its answer that score above ``own``. The stated queries go out in blocks, as in ``top_k``."""
    parts: list[DataFrame] = []

    def count(rows: list) -> DataFrame:
        sent = queries.sparkSession.sparkContext.broadcast((np.array([r.qid for r in rows]), np.array([r.q for r in rows], np.float64), np.array([r.own for r in rows]), np.array([r.al for r in rows])))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, own, al = sent.value
            n = np.zeros(len(ids), np.int64)
            for batch in batches:
                if batch.num_rows:
                    p = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                    other = (ids[:, None] != batch.column(0).to_numpy()[None]) & (al[:, None] != batch.column(2).to_numpy()[None])
                    n += ((q @ p.T > own[:, None] + 1e-9) & other).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["qid", "n"])

        return pool.select("vec_id", "embedding", "label").where("embedding is not null").mapInArrow(run, "qid long, n long")

    rows: list = []
    for r in queries.select("qid", "q", "own", "al").toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            parts.append(count(rows))
            rows = []
    if rows or not parts:
        parts.append(count(rows) if rows else queries.sparkSession.createDataFrame([], "qid long, n long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("qid").agg(F.sum("n").alias("n"))


def rerank(candidates: DataFrame, scorer: Scorer, query: str = "query", passage: str = "passage") -> DataFrame:
    """``candidates`` with a ``score`` from an injected model, in batches where the rows lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(score=np.asarray(scorer(pdf[query].tolist(), pdf[passage].tolist()), np.float64))

    return candidates.mapInPandas(run, T.StructType([*candidates.schema.fields, T.StructField("score", T.DoubleType())]))


def false_negatives(cands: DataFrame, ratio: float = 0.95) -> DataFrame:
    """``cands(qid, pid, score, best_pos)`` with ``false_neg``: sigmoid(score) >= ratio * sigmoid(best positive); without
    a scored positive nothing is flagged."""
    sig = lambda c: 1.0 / (1.0 + F.exp(-F.col(c)))
    return cands.withColumn("false_neg", F.coalesce(sig("score") >= ratio * sig("best_pos"), F.lit(False)))


def consistency_ranks(cands: DataFrame) -> DataFrame:
    """``qid, rank``: one more than the candidates that score above the best positive."""
    return cands.groupBy("qid").agg((F.count_if(F.col("score") > F.col("best_pos")) + 1).alias("rank"))


def random_negatives(items: DataFrame, key: str, group: str, k: int, purpose: str = "negatives") -> DataFrame:
    """``key, other``: for each row ``k`` drawn others of its group (fewer in small groups).

    A group is put on a drawn ring, and a row's others are the ones after it, so that no pairs of a group are formed and
    each row takes part in ``k`` links. Places on the ring come from one running number over all groups."""
    d = items.select(key, group).withColumn("_h", O.draw(purpose, F.col(key).cast("string")))
    ring = written(O.group_rank(d, [group], ["_h", key], "at", 32).withColumnRenamed("at_all", "n"), "ring")
    step = ring.select(key, group, "n", "at", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step")).where(F.col("step") < F.col("n"))
    want = step.select(key, group, ((F.col("at") + F.col("step")) % F.col("n")).alias("at"))
    return want.join(ring.select(group, "at", F.col(key).alias("other")), [group, "at"]).select(key, "other")


def true_ranks(items: DataFrame, key: str, group: str, query: str, passage: str, k: int = 99) -> DataFrame:
    """``key, rank, score, best_negative``: the rank of each row's passage among ``k`` drawn ones of its group; alone in
    its group a row has rank 1 and best negative -1."""
    links = random_negatives(items, key, group, k)
    q, p = items.select(key, F.col(query).alias("_q")), items.select(F.col(key).alias("other"), F.col(passage).alias("_p"))
    s = links.join(q, key).join(p, "other").select(key, dot(F.col("_q"), F.col("_p")).alias("s"))
    own = items.select(key, dot(F.col(query), F.col(passage)).alias("score"))
    g = own.join(s, key, "left").groupBy(key, "score").agg(F.count_if(F.col("s") > F.col("score")).alias("above"), F.max("s").alias("m"))
    return g.select(key, (F.col("above") + 1).alias("rank"), "score", F.coalesce("m", F.lit(-1.0)).alias("best_negative"))


def negative_cascade(cands: DataFrame, positives: DataFrame, n: int = 7) -> DataFrame:
    """``qid, place, pid, origin`` from ``cands(qid, tier, origin, pid, text_key)``: judged negatives, then the top
    candidates, the rest, random ones; drawn inside a tier, no text of a positive, no text twice, ``n`` in all."""
    d = cands.join(positives.select("qid", "text_key"), ["qid", "text_key"], "left_anti")
    d = d.withColumn("h", O.draw("negative", F.col("qid").cast("string"), F.col("tier").cast("string"), F.col("pid").cast("string")))
    d = O.keep_first(d, ["qid", "text_key"], ["tier", "h", "pid"])
    place = F.row_number().over(W.partitionBy("qid").orderBy("tier", "h", "pid"))
    return d.withColumn("place", place).where(F.col("place") <= n).select("qid", "place", "pid", "origin")


def training_rows(queries: DataFrame, repeats: int = 2) -> DataFrame:
    """``qid, repeat, positives``: human queries ``repeats`` times, each time another positive in front."""
    n = F.when(F.col("is_human"), F.lit(repeats)).otherwise(1)
    d = queries.where("size(pos_pids) > 0").select("qid", "pos_pids", F.explode(F.sequence(F.lit(0), n - 1)).alias("repeat"))
    at = F.col("repeat") % F.size("pos_pids")
    front = F.slice("pos_pids", at + 1, F.lit(1))
    others = F.filter("pos_pids", lambda x, i: i != at)
    return d.select("qid", "repeat", F.concat(front, others).alias("positives"))


def retrieval_metrics(top: DataFrame, relevant: DataFrame) -> DataFrame:
    """``qid, ndcg10, recall10, recall100`` from ``top(qid, pid, rank)`` and ``relevant(qid, pid)``; queries without an
    answer in ``top`` score 0."""
    n = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    hit = top.join(relevant, ["qid", "pid"]).groupBy("qid").agg(F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1))).alias("dcg"), F.count_if(F.col("rank") <= 10).alias("h10"), F.count_if(F.col("rank") <= 100).alias("h100"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    d = n.join(hit, "qid", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return d.select("qid", (z("dcg") / ideal).alias("ndcg10"), (z("h10") / F.col("n")).alias("recall10"), (z("h100") / F.col("n")).alias("recall100"))


def ranking_metrics(ranks: DataFrame, rank: str = "rank") -> list[Column]:
    """nDCG@10, recall@10 and @100, MRR@10 of single relevant items, as aggregates over their ranks."""
    r = F.col(rank)
    in10 = r <= 10
    return [F.avg(F.when(in10, 1 / F.log2(r + 1)).otherwise(0.0)).alias("ndcg10"), F.avg(in10.cast("double")).alias("recall10"), F.avg((r <= 100).cast("double")).alias("recall100"), F.avg(F.when(in10, 1 / r).otherwise(0.0)).alias("mrr10")]


def rank_bucket(r: Column) -> Column:
    return F.when(r <= 3, r.cast("string")).when(r <= 10, F.lit("4-10")).otherwise(F.lit("11-100"))


def invariant(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """``n_queries, n_negatives, n_violations`` of ``queries(qid, pos_pids, neg_pids)``: a negative with the text of one
    of its query's positives is a violation. Only ids and hashes of ``passages(pid, text)`` are joined."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    k = passages.select("pid", F.md5(words).alias("k"))
    side = lambda c: queries.select("qid", F.explode(c).alias("pid")).join(k, "pid").select("qid", "k")
    pos = side("pos_pids").distinct().withColumn("same", F.lit(1))
    n = side("neg_pids").join(pos, ["qid", "k"], "left").agg(F.count(F.lit(1)).alias("n_negatives"), F.count("same").alias("n_violations"))
    return queries.agg(F.count(F.lit(1)).alias("n_queries")).join(n)
