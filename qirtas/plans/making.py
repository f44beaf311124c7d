"""Queries of pair makers, length fitting, batches and model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qirtas.functions import ordering as O
from qirtas.functions import text as X
from qirtas.operators import makers
from qirtas.plans.corpus import sql_strip
from qirtas.registry import query
from qirtas.tables import table

B = X.BLANK


@query("summary_pairs", f"WITH D AS (SELECT doc_id, title, {sql_strip('string_split(text, chr(10))[1]')} AS s, text FROM documents WHERE text IS NOT NULL), F AS (SELECT * FROM D WHERE coalesce({sql_strip('s')}, '') <> '') SELECT doc_id, 'xlsum_title' AS kind, md5(title) AS query, md5(s) AS passage FROM F WHERE coalesce({sql_strip('title')}, '') <> '' UNION ALL SELECT doc_id, 'xlsum_summary', md5(s), md5(text) FROM F WHERE {sql_strip('text')} <> ''")
def summary_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Title with the first line, and the first line with the text."""
    t = table(spark, d, "documents", "doc_id", "title", "text").where("text is not null").withColumn("s", X.strip(F.split("text", "\n")[0]))
    p = makers.summary_pairs(t, "doc_id", F.col("title"), F.col("s"), F.col("text"))
    return p.select("doc_id", "kind", F.md5("query").alias("query"), F.md5("passage").alias("passage"))


@query("prompt_pairs_by_language", "SELECT lang, count(*) AS n FROM pairs WHERE contains(lang, 'ar') AND kind = 'aya' GROUP BY lang")
def prompt_pairs_by_language(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs", "kind", "lang", "query", "passage").where("kind = 'aya'")
    return makers.prompt_pairs(p, "lang", "query", "passage", "ar").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "headline_pairs",
    f"""WITH D AS (SELECT doc_id, {sql_strip("coalesce(title, '')")} AS head, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS p FROM documents WHERE source = 'news' AND text IS NOT NULL),
    C AS (SELECT *, list_transform(range(1, len(p) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: len(regexp_extract_all(x, '[^{B}]+'))))) AS cum FROM D WHERE head <> '' AND len(p) > 0)
    SELECT doc_id, md5(head) AS query, md5(substr(array_to_string(p[1:len(list_filter(cum, lambda x: x < 80)) + 1], chr(10)), 1, 3000)) AS passage FROM C""",
)
def headline_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A news article's headline with its first paragraphs, up to eighty words."""
    t = table(spark, d, "documents", "doc_id", "source", "title", "text").where("source = 'news' and text is not null")
    p = makers.headline_pairs(t, "doc_id", F.col("title"), F.col("text"), 80)
    return p.select("doc_id", F.md5("query").alias("query"), F.md5("passage").alias("passage"))


@query("span_pairs")
def span_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two drawn spans of each document."""
    return makers.span_pairs(table(spark, d, "documents", "doc_id", "text").where("text is not null"), "doc_id", F.col("text"))


@query("fitted_passages")
def fitted_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages cut to 64 tokens at a word's start."""
    return makers.fit_to_length(table(spark, d, "passages", "pid", "text"), "pid", "text", 64).select("pid", "n_tokens", "cut", F.md5("fitted").alias("fitted"))


@query("answer_windows")
def answer_windows(spark: SparkSession, d: str) -> DataFrame:
    """A window of 300 characters around the last word of each question's passage."""
    p = table(spark, d, "pairs", "pair_id", "kind", "passage").where("kind in ('arabicaqa', 'aya') and passage is not null")
    last = F.element_at(F.when(F.size(X.words(F.col("passage"))) > 0, X.words(F.col("passage"))), -1)
    p = p.withColumn("answer", last).withColumn("start", F.length("passage") - F.length("answer"))
    return makers.windowed(p, "passage", "answer", "start", 300).select("pair_id", "answer", "window")


@query(
    "source_batches",
    """WITH R AS (SELECT pair_id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5('1234|batch 0|' || pair_id), pair_id) - 1 AS r, count(*) OVER (PARTITION BY kind) AS n FROM pairs)
    SELECT kind, CAST(r // 32 AS BIGINT) AS batch, pair_id FROM R WHERE r // 32 < n // 32""",
)
def source_batches(spark: SparkSession, d: str) -> DataFrame:
    """Full batches of 32 rows of one kind; what is left over in an epoch drops."""
    p = table(spark, d, "pairs", "pair_id", "kind").withColumn("h", O.draw("batch 0", F.col("pair_id").cast("string")))
    p = O.group_rank(p, ["kind"], ["h", "pair_id"], "r", 32).withColumn("batch", F.floor(F.col("r") / 32))
    return p.where(F.col("batch") < F.floor(F.col("r_all") / 32)).select("kind", "batch", "pair_id")


@query(
    "budgeted_source",
    """WITH U AS (SELECT source, lang AS unit, count(*) AS made FROM documents WHERE lang IS NOT NULL GROUP BY ALL), C AS (SELECT *, coalesce(sum(made) OVER (PARTITION BY source ORDER BY md5('1234|units|' || source || '|' || unit), unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM U),
    K AS (SELECT doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY md5('1234|keep|' || doc_id), doc_id) AS r FROM documents d JOIN C ON C.source = d.source AND C.unit = d.lang WHERE before < 60) SELECT doc_id, source FROM K WHERE r <= 60""",
)
def budgeted_source(spark: SparkSession, d: str) -> DataFrame:
    """Units of each source in drawn order until they have made 60 rows, then exactly 60 drawn ones of these."""
    t = table(spark, d, "documents", "doc_id", "source", "lang").where("lang is not null")
    u = t.groupBy("source", F.col("lang").alias("unit")).agg(F.count(F.lit(1)).alias("made"))
    w = W.partitionBy("source").orderBy(O.draw("units", "source", "unit"), "unit").rowsBetween(W.unboundedPreceding, -1)
    u = u.withColumn("before", F.coalesce(F.sum("made").over(w), F.lit(0))).where("before < 60")
    k = t.join(u.select("source", F.col("unit").alias("lang")), ["source", "lang"])
    return O.first_n(k, 60, ["source"], [O.draw("keep", F.col("doc_id").cast("string")), "doc_id"]).select("doc_id", "source")


@query(
    "first_changes",
    f"""WITH C AS (SELECT doc_id, text AS a, regexp_replace(text, '[0-9]', '#', 'g') AS b FROM documents WHERE text IS NOT NULL), P AS (SELECT doc_id, a, b, list_position(list_transform(list_zip(string_split(a, ''), string_split(b, '')), lambda z: z[1] = z[2]), false) AS i FROM C WHERE a <> b)
    SELECT doc_id, md5(substr(a, greatest(i - 45, 1), 90)) AS before, md5(substr(b, greatest(i - 45, 1), 90)) AS after FROM P""",
)
def first_changes(spark: SparkSession, d: str) -> DataFrame:
    """Both texts around their first difference."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null").withColumn("b", F.regexp_replace("text", "[0-9]", "#"))
    w = t.where("text <> b").select("doc_id", X.change_window(F.col("text"), F.col("b")).alias("w"))
    return w.select("doc_id", F.md5("w.before").alias("before"), F.md5("w.after").alias("after"))


@query(
    "validation_corpus",
    """WITH SQ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY loaded_at, query) AS rn FROM supervised_queries) WHERE rn = 1 AND is_human), P AS (SELECT DISTINCT unnest(pos_pids) AS pid, 0 AS tier FROM SQ), N AS (SELECT DISTINCT unnest(neg_pids) AS pid, 1 AS tier FROM SQ),
    R AS (SELECT pid, 2 AS tier FROM (SELECT DISTINCT pid FROM passages) ORDER BY md5('1234|corpus|' || pid), pid LIMIT 300), A AS (SELECT pid, min(tier) AS tier FROM (SELECT * FROM P UNION ALL SELECT * FROM N UNION ALL SELECT * FROM R) GROUP BY pid)
    SELECT pid, tier, row_number() OVER (ORDER BY tier, pid) - 1 AS cid FROM A""",
)
def validation_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Positives, judged negatives and drawn passages with dense ids in this order."""
    q = O.keep_first(table(spark, d, "supervised_queries", "qid", "query", "is_human", "pos_pids", "neg_pids", "loaded_at"), ["qid"], ["loaded_at", "query"]).where("is_human")
    pos, neg = (q.select(F.explode(c).alias("pid"), F.lit(t).alias("tier")) for c, t in (("pos_pids", 0), ("neg_pids", 1)))
    rnd = table(spark, d, "passages", "pid").distinct().orderBy(O.draw("corpus", "pid"), "pid").limit(300).withColumn("tier", F.lit(2))
    a = pos.union(neg).union(rnd).groupBy("pid").agg(F.min("tier").alias("tier"))
    return O.global_rank(a, ["tier", "pid"], "cid", 16)


@query(
    "batch_schedule",
    """WITH R AS (SELECT pair_id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5('1234|batch 0|' || pair_id), pair_id) - 1 AS r, count(*) OVER (PARTITION BY kind) AS n FROM pairs),
    B AS (SELECT DISTINCT kind, CAST(r // 32 AS BIGINT) AS batch FROM R WHERE r // 32 < n // 32)
    SELECT kind, batch, row_number() OVER (ORDER BY md5('1234|schedule 0|' || kind || '|' || batch), kind, batch) - 1 AS step FROM B""",
)
def batch_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The order in which an epoch's full batches of one kind follow each other: drawn over all kinds."""
    n = table(spark, d, "pairs", "kind").groupBy("kind").agg(F.floor(F.count(F.lit(1)) / 32).alias("n")).where("n > 0")
    b = n.select("kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("batch"))
    b = b.withColumn("at", O.draw("schedule 0", "kind", F.col("batch").cast("string")))
    return O.global_rank(b, ["at", "kind", "batch"], "step", 16).select("kind", "batch", "step")


@query("generated_queries")
def generated_queries(spark: SparkSession, d: str) -> DataFrame:
    """Model outputs (here made of pairs) parsed, unpivoted and filtered by the first reason that holds."""
    p = table(spark, d, "pairs", "pair_id", "kind", "query", "passage").where("kind = 'wiki_lead'")
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("query").alias("question"), F.col("query").alias("paraphrase"), F.col("passage").alias("search_query"))), F.lit("\n```"))
    o = p.select("pair_id", "passage", X.parsed_output(raw, F.lit(None).cast("string"), ["question", "paraphrase", "search_query"]).alias("o"))
    u = o.select("pair_id", "passage", F.col("o.reason").alias("bad"), "o.question", "o.paraphrase", "o.search_query").unpivot(["pair_id", "passage", "bad"], ["question", "paraphrase", "search_query"], "qtype", "query")
    n = X.word_count(F.col("query"))
    lo, hi = F.when(F.col("qtype") == "search_query", 2).otherwise(3), F.when(F.col("qtype") == "search_query", 6).otherwise(40)
    banned = X.banned_pattern(X.BANNED)
    reason = F.when(F.col("bad").isNotNull(), F.concat(F.lit("parse failed: "), F.col("bad"))).when(X.arabic_share(F.col("query")) < 0.7, "not Arabic").when(~n.between(lo, hi), "length").when(X.copied_run(F.col("query"), F.col("passage"), 5).isNotNull(), "copying").when(X.normalize(F.col("query")).rlike(banned), "mentions the passage")
    return u.select("pair_id", "qtype", reason.alias("reason"))
