"""Queries over vectors and ranks, and over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qirtas.functions import ordering as O
from qirtas.operators import vectors as V
from qirtas.registry import query
from qirtas.tables import table

SQL_EQ = "EQ AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0)"
SQL_SIM = f"{SQL_EQ}, SIM AS (SELECT q.vec_id AS qid, p.vec_id AS pid, q.label AS ql, p.label AS pl, list_inner_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score FROM EQ q, embeddings p WHERE q.vec_id <> p.vec_id)"
SQL_TOP = f"{SQL_SIM}, TOP AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pid) AS rank FROM SIM) WHERE rank <= 50)"


def _top(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 100, against all."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    t = V.top_k(e.where("vec_id % 100 = 0"), e, k + 1).where("qid <> pid")
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "pid"))
    return t.withColumn("rank", rank).where(F.col("rank") <= k)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "embeddings", "vec_id", "label")
    return _top(spark, d).join(l.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql")), "qid").join(l.select(F.col("vec_id").alias("pid"), F.col("label").alias("pl")), "pid")


@query("topk_cosine", f"WITH {SQL_TOP} SELECT qid, pid, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM TOP WHERE rank <= 10")
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).where("rank <= 10").select("qid", "pid", "rank", F.round("score", 4).alias("score"))


@query(
    "mined_in_domain",
    """WITH E AS (SELECT vec_id, label, label % 3 AS domain, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL), S AS (SELECT q.vec_id AS qid, p.vec_id AS pid, list_inner_product(q.v, p.v) AS score FROM E q JOIN E p ON q.domain = p.domain AND q.label <> p.label WHERE q.vec_id % 100 = 0)
    SELECT qid, pid, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pid) AS rank FROM S) WHERE rank <= 20""",
)
def mined_in_domain(spark: SparkSession, d: str) -> DataFrame:
    """The twenty nearest that are no positives (another label), in the query's own domain (here classes of labels)."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label").where("label is not null").withColumn("domain", F.col("label") % 3)
    t = V.top_k(e.where("vec_id % 100 = 0"), e, 21, same="domain", other="label")
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "pid"))
    return t.withColumn("rank", rank).where("rank <= 20").select("qid", "pid", F.round("score", 4).alias("score"))


@query("recall_of_positives", f"WITH {SQL_TOP}, N AS (SELECT qid, count(*) AS n FROM SIM WHERE ql = pl GROUP BY 1) SELECT round(CAST(sum(h) AS DOUBLE) / greatest(sum(n), 1), 6) AS recall50 FROM (SELECT qid, count(*) FILTER (ql = pl) AS h FROM TOP GROUP BY 1) JOIN N USING (qid)")
def recall_of_positives(spark: SparkSession, d: str) -> DataFrame:
    """How many vectors of the query's label the fifty nearest hold."""
    hits = _labelled(spark, d).agg(F.count_if(F.col("ql") == F.col("pl")).alias("h"))
    e = table(spark, d, "embeddings", "vec_id", "label")
    sizes = e.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n"))
    total = e.where("vec_id % 100 = 0").join(sizes, "label").agg(F.sum("n").alias("n"))
    return hits.join(total, how="inner").select(F.round(F.col("h") / F.greatest("n", F.lit(1)), 6).alias("recall50"))


_SQL_POS = "BP AS (SELECT qid, max(score) FILTER (ql = pl) AS best FROM TOP GROUP BY qid)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    t = _labelled(spark, d)
    best = t.groupBy("qid").agg(F.max(F.when(F.col("ql") == F.col("pl"), F.col("score"))).alias("best_pos"))
    return t.join(best, "qid")


@query("false_negative_flags", f"WITH {SQL_TOP}, {_SQL_POS} SELECT qid, pid FROM TOP JOIN BP USING (qid) WHERE ql <> pl AND 1 / (1 + exp(-score)) >= 0.95 / (1 + exp(-best))")
def false_negative_flags(spark: SparkSession, d: str) -> DataFrame:
    return V.false_negatives(_scored(spark, d).where("ql <> pl")).where("false_neg").select("qid", "pid")


@query("consistency_rank", f"WITH {SQL_TOP}, {_SQL_POS} SELECT qid, count(*) FILTER (ql <> pl AND score > best) + 1 AS rank FROM TOP JOIN BP USING (qid) GROUP BY qid")
def consistency_rank(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("qid").agg((F.count_if((F.col("ql") != F.col("pl")) & (F.col("score") > F.col("best_pos"))) + 1).alias("rank"))


@query("rank_histogram", f"WITH {SQL_TOP}, {_SQL_POS}, R AS (SELECT qid, count(*) FILTER (ql <> pl AND score > best) + 1 AS rank FROM TOP JOIN BP USING (qid) GROUP BY qid) SELECT CASE WHEN rank <= 3 THEN CAST(rank AS VARCHAR) WHEN rank <= 10 THEN '4-10' ELSE '11-100' END AS bucket, count(*) AS n, median(rank) AS median FROM R GROUP BY 1")
def rank_histogram(spark: SparkSession, d: str) -> DataFrame:
    r = consistency_rank(spark, d)
    return r.groupBy(V.rank_bucket(F.col("rank")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.median("rank").alias("median"))


@query("capped_rank_counts", f"WITH {SQL_TOP}, {_SQL_POS}, R AS (SELECT qid, count(*) FILTER (ql <> pl AND score > best) + 1 AS rank FROM TOP JOIN BP USING (qid) GROUP BY qid) SELECT CAST(least(rank, 5) AS BIGINT) AS rank, count(*) AS n FROM R GROUP BY 1")
def capped_rank_counts(spark: SparkSession, d: str) -> DataFrame:
    return consistency_rank(spark, d).groupBy(F.least("rank", F.lit(5)).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "ndcg_recall",
    f"""WITH {SQL_TOP}, N AS (SELECT qid, count(*) AS n FROM SIM WHERE ql = pl GROUP BY 1), H AS (SELECT qid, sum(CASE WHEN rank <= 10 AND ql = pl THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (rank <= 10 AND ql = pl) AS h10, count(*) FILTER (ql = pl) AS h100 FROM TOP GROUP BY 1)
    SELECT qid, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg10, round(h10 / n, 6) AS recall10, round(h100 / n, 6) AS recall100 FROM N JOIN H USING (qid)""",
)
def ndcg_recall(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "label")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    rel = q.join(e, "label").where("qid <> vec_id").select("qid", F.col("vec_id").alias("pid"))
    m = V.retrieval_metrics(_top(spark, d), rel)
    return m.select("qid", *(F.round(c, 6).alias(c) for c in ("ndcg10", "recall10", "recall100")))


@query("ndcg_recall_whole")
def ndcg_recall_whole(spark: SparkSession, d: str) -> DataFrame:
    """``ndcg_recall`` with recall100 from the hundred nearest; that one's SQL stops at rank 50."""
    e = table(spark, d, "embeddings", "vec_id", "label")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    rel = q.join(e, "label").where("qid <> vec_id").select("qid", F.col("vec_id").alias("pid"))
    m = V.retrieval_metrics(_top(spark, d, 100), rel)
    return m.select("qid", *(F.round(c, 6).alias(c) for c in ("ndcg10", "recall10", "recall100")))


@query("consistency_rank_whole")
def consistency_rank_whole(spark: SparkSession, d: str) -> DataFrame:
    """Rank of a query's best positive among all vectors, whatever its place; null for a query without a positive. The
    SQL of ``consistency_rank`` looks among the fifty nearest, and gives rank 1 where they hold no positive."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), F.col("label").alias("al"))
    p = e.select(F.col("vec_id").alias("pid"), F.col("embedding").alias("p"), F.col("label").alias("al"))
    own = q.join(p, "al").where("qid <> pid").groupBy("qid").agg(F.max(V.dot(F.col("q"), F.col("p"))).alias("own"))
    own = q.join(own, "qid")
    return q.select("qid").join(own.select("qid", "own"), "qid", "left").join(V.count_above(own, e), "qid", "left").select("qid", F.when(F.col("own").isNotNull(), F.coalesce("n", F.lit(0)) + 1).alias("rank"))


@query("rank_histogram_whole")
def rank_histogram_whole(spark: SparkSession, d: str) -> DataFrame:
    r = consistency_rank_whole(spark, d).where("rank is not null")
    bucket = F.when(F.col("rank") > 100, "over 100").otherwise(V.rank_bucket(F.col("rank")))
    return r.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.median("rank").alias("median"))


@query("capped_rank_counts_whole")
def capped_rank_counts_whole(spark: SparkSession, d: str) -> DataFrame:
    r = consistency_rank_whole(spark, d).where("rank is not null")
    return r.groupBy(F.least("rank", F.lit(5)).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "pair_rank_dup_masked",
    f"""WITH {SQL_EQ}, P AS (SELECT q.vec_id AS qid, list_inner_product(q.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS own, a.label AS al FROM EQ q JOIN embeddings a ON a.vec_id = q.vec_id + 1),
    R AS (SELECT qid, 1 + count(*) FILTER (list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) > own + 1e-9 AND e.label <> al) AS rank FROM P JOIN EQ q ON q.vec_id = qid, embeddings e WHERE e.vec_id <> qid GROUP BY qid)
    SELECT round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg10, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall10, round(avg(CASE WHEN rank <= 100 THEN 1.0 ELSE 0 END), 6) AS recall100, round(avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END), 6) AS mrr10 FROM R""",
)
def pair_rank_dup_masked(spark: SparkSession, d: str) -> DataFrame:
    """Rank of a query's own answer (here the next vector) among all; answers of the same label don't count against it."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    own = q.join(e, F.col("vec_id") == F.col("qid") + 1).select("qid", "q", V.dot(F.col("q"), F.col("embedding")).alias("own"), F.col("label").alias("al"))
    above = V.count_above(own, e)
    r = own.select("qid").join(above, "qid", "left").select((F.coalesce("n", F.lit(0)) + 1).alias("rank"))
    return r.agg(*V.ranking_metrics(r)).select(*(F.round(c, 6).alias(c) for c in ("ndcg10", "recall10", "recall100", "mrr10")))


@query(
    "negative_cascade",
    f"""WITH {SQL_TOP}, C AS (SELECT qid, pid, CASE WHEN rank <= 15 THEN 1 ELSE 2 END AS tier, CASE WHEN rank <= 15 THEN 'top15' ELSE 'rest' END AS origin FROM TOP WHERE ql <> pl),
    R AS (SELECT qid, pid, origin, row_number() OVER (PARTITION BY qid ORDER BY tier, md5('1234|negative|' || qid || '|' || tier || '|' || pid), pid) AS place FROM C) SELECT qid, CAST(place AS INTEGER) AS place, pid, origin FROM R WHERE place <= 7""",
)
def negative_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Seven negatives of each query by tiers; texts of positives (here: the query's label) excluded."""
    t = _labelled(spark, d)
    first = F.col("rank") <= 15
    c = t.select("qid", F.when(first, 1).otherwise(2).alias("tier"), F.when(first, "top15").otherwise("rest").alias("origin"), "pid", F.col("pid").alias("text_key"))
    return V.negative_cascade(c, t.where("ql = pl").select("qid", F.col("pid").alias("text_key")))


@query(
    "rank_among_random",
    """WITH O AS (SELECT vec_id, label, embedding, row_number() OVER w - 1 AS at, count(*) OVER (PARTITION BY label) AS n FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY md5('1234|negatives|' || vec_id), vec_id)),
    OWN AS (SELECT a.vec_id, a.label, a.at, a.n, a.embedding AS q, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS own FROM O a JOIN embeddings b ON b.vec_id = a.vec_id // 2 * 2),
    L AS (SELECT x.vec_id, x.own, list_inner_product(x.q::DOUBLE[], (SELECT e.embedding FROM embeddings e WHERE e.vec_id = y.vec_id // 2 * 2)::DOUBLE[]) AS s FROM OWN x, range(1, 10) r(k), O y WHERE y.label = x.label AND y.at = (x.at + k) % x.n AND k < x.n)
    SELECT vec_id, count(*) FILTER (s > own + 1e-9) + 1 AS rank FROM L GROUP BY vec_id""",
)
def rank_among_random(spark: SparkSession, d: str) -> DataFrame:
    """Rank of each row's answer (here the vector at the even id) among those of nine drawn rows of its label."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    a = e.select(F.col("vec_id").alias("even"), F.col("embedding").alias("p"))
    items = e.join(a, F.col("even") == F.floor(F.col("vec_id") / 2) * 2).select("vec_id", "label", F.col("embedding").alias("q"), "p")
    links = V.random_negatives(items, "vec_id", "label", 9)
    own = items.select("vec_id", "q", V.dot(F.col("q"), F.col("p")).alias("own"))
    s = links.join(own, "vec_id").join(items.select(F.col("vec_id").alias("other"), "p"), "other")
    return s.groupBy("vec_id").agg((F.count_if(V.dot(F.col("q"), F.col("p")) > F.col("own") + 1e-9) + 1).alias("rank"))


@query("rank_among_random_whole")
def rank_among_random_whole(spark: SparkSession, d: str) -> DataFrame:
    """Rank, score and best negative of each row's answer among those of 99 drawn rows of its label; the SQL of
    ``rank_among_random`` draws nine."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    a = e.select(F.col("vec_id").alias("even"), F.col("embedding").alias("p"))
    items = e.join(a, F.col("even") == F.floor(F.col("vec_id") / 2) * 2).select("vec_id", "label", F.col("embedding").alias("q"), "p")
    return V.true_ranks(items, "vec_id", "label", "q", "p")


_SQL_RES = "RES AS (SELECT 'm' || (label % 3) AS model, 't' || (vec_id % 4) AS task, CAST(vec_id % 7 AS DOUBLE) / 7 AS score, vec_id % 5 = 0 AS flagged, vec_id FROM embeddings WHERE NOT (label % 3 = 1 AND vec_id % 4 = 2))"


def _results(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "label").where("not (label % 3 = 1 and vec_id % 4 = 2)")
    return e.select(F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model"), F.concat(F.lit("t"), (F.col("vec_id") % 4).cast("string")).alias("task"), ((F.col("vec_id") % 7).cast("double") / 7).alias("score"), (F.col("vec_id") % 5 == 0).alias("flagged"), "vec_id")


@query("published_results", f"WITH {_SQL_RES} SELECT model, task, round(score, 6) AS score, flagged FROM (SELECT *, row_number() OVER (PARTITION BY model, task ORDER BY flagged, vec_id) AS r FROM RES) WHERE r = 1")
def published_results(spark: SparkSession, d: str) -> DataFrame:
    """One result of each model and task, unflagged before flagged."""
    return O.keep_first(_results(spark, d), ["model", "task"], ["flagged", "vec_id"]).select("model", "task", F.round("score", 6).alias("score"), "flagged")


@query("model_task_pivot", f"WITH {_SQL_RES}, M AS (SELECT model, {', '.join(f'round(avg(score) FILTER (task = {chr(39)}t{i}{chr(39)}), 6) AS t{i}' for i in range(4))}, round(avg(score), 6) AS mean FROM RES GROUP BY model) SELECT model, {', '.join(f'''coalesce(CAST(t{i} AS VARCHAR), '-') <> '-' AS has_t{i}''' for i in range(4))}, t0, t1, t2, t3, mean FROM M")
def model_task_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Models by tasks, with what is missing marked."""
    r = _results(spark, d)
    p = r.groupBy("model").pivot("task", ["t0", "t1", "t2", "t3"]).agg(F.round(F.avg("score"), 6)).join(r.groupBy("model").agg(F.round(F.avg("score"), 6).alias("mean")), "model")
    return p.select("model", *(F.col(f"t{i}").isNotNull().alias(f"has_t{i}") for i in range(4)), "t0", "t1", "t2", "t3", "mean")


@query("best_model", f"WITH {_SQL_RES}, M AS (SELECT model, avg(score) AS mean FROM RES WHERE task IN ('t0', 't1') GROUP BY model) SELECT arg_max(model, mean) AS model, round(max(mean), 6) AS mean FROM M")
def best_model(spark: SparkSession, d: str) -> DataFrame:
    m = _results(spark, d).where(F.col("task").isin("t0", "t1")).groupBy("model").agg(F.avg("score").alias("mean"))
    return m.agg(F.max_by("model", "mean").alias("model"), F.round(F.max("mean"), 6).alias("mean"))


@query("bernoulli_distractors", "SELECT vec_id FROM embeddings WHERE CAST('0x' || substr(md5('1234|keep|' || vec_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.25")
def bernoulli_distractors(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of all rows, each by its own hash."""
    return table(spark, d, "embeddings", "vec_id").where(O.uniform("keep", F.col("vec_id").cast("string")) < 0.25)


@query("label_shares", "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM embeddings GROUP BY label")
def label_shares(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "embeddings", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


# -- joins and windows on the relational tables ---------------------------------------------------------------------------


@query("order_shard_lookup", "SELECT o_orderkey, o_orderkey // 8192 AS shard, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def order_shard_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Ids to their shard by arithmetic, with a left join of pre-aggregated lines."""
    n = table(spark, d, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return table(spark, d, "orders", "o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.floor(F.col("o_orderkey") / 8192).alias("shard"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query("three_way_join", "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def three_way_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey", "o_totalprice").join(table(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    return o.join(F.broadcast(table(spark, d, "nation", "n_nationkey", "n_name")), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))  # nation: 25 rows at every size


@query("customers_without_orders", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1")
def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer", "c_custkey", "c_mktsegment").join(table(spark, d, "orders", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("position_lookup", "WITH S AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), C AS (SELECT l_suppkey, coalesce(sum(n) OVER (ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, n FROM S), P AS (SELECT event_id AS pos FROM events) SELECT CAST(pos AS BIGINT) AS pos, l_suppkey, CAST(pos - lo AS BIGINT) AS row FROM P JOIN C ON pos >= lo AND pos < lo + n")
def position_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Positions (here event ids) to (window, row): an interval join on cumulative sizes, turned into an equi join by
    cutting both sides into cells of 1024 positions."""
    s = table(spark, d, "lineitem", "l_suppkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    c = O.global_sum(s, ["l_suppkey"], F.col("n"), "lo", 16)
    p = table(spark, d, "events", "event_id").withColumnRenamed("event_id", "pos")
    cell = lambda x: F.floor(x / 1024)
    c = c.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("lo") + F.col("n") - 1))))
    return p.withColumn("cell", cell(F.col("pos"))).join(c, "cell").where((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("lo") + F.col("n"))).select("pos", "l_suppkey", (F.col("pos") - F.col("lo")).alias("row"))


@query("flag_pivot", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY l_returnflag")
def flag_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_quantity"), 2))


@query("events_per_type", "SELECT coalesce(event_type, '(all)') AS event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((event_type), ())")
def events_per_type(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events", "event_type", "user_id", "value").rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"), F.round(F.avg("value"), 6).alias("mean"))
    return g.withColumn("event_type", F.coalesce("event_type", F.lit("(all)")))
