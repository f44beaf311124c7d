"""Queries over supervised data: judgements, merging, drops, splits, caps, passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qirtas.functions import ordering as O
from qirtas.functions import text as X
from qirtas.operators import dedupe, quotas, vectors
from qirtas.operators.vectors import training_rows as rows_for_training
from qirtas.plans.corpus import _TOK, sql_arabic_share, sql_key
from qirtas.plans.pairs import sql_normalize
from qirtas.registry import query
from qirtas.tables import table

B = X.BLANK
SQL_SQ = "SQ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY loaded_at, query) AS rn FROM supervised_queries) WHERE rn = 1)"
SQL_PS = "PS AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY loaded_at) AS rn FROM passages) WHERE rn = 1)"


def _sq(spark: SparkSession, d: str) -> DataFrame:
    """Queries, the first arrival of each qid."""
    return O.keep_first(table(spark, d, "supervised_queries"), ["qid"], ["loaded_at", "query"])


def _ps(spark: SparkSession, d: str) -> DataFrame:
    return O.keep_first(table(spark, d, "passages"), ["pid"], ["loaded_at"])


@query("passage_dictionary", f"WITH {SQL_PS} SELECT pid, domain, orig_id, md5(coalesce(text, '')) AS text FROM PS")
def passage_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """One passage of each id, the first arrival."""
    return _ps(spark, d).select("pid", "domain", "orig_id", F.md5(F.coalesce("text", F.lit(""))).alias("text"))


@query(
    "content_addressed_passages",
    f"WITH K AS (SELECT domain || ':' || substr(md5(trim(regexp_replace({sql_normalize('text')}, '[{B}]+', ' ', 'g'))), 1, 16) AS key, min(pid) AS first_pid, count(DISTINCT pid) AS n_pids FROM passages WHERE text IS NOT NULL GROUP BY 1) SELECT key, first_pid, n_pids FROM K",
)
def content_addressed_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages by a hash of their normalized text: equal texts share a key."""
    p = table(spark, d, "passages", "pid", "domain", "text").where("text is not null")
    key = F.concat(F.col("domain"), F.lit(":"), X.md5_hex(X.squeeze(X.normalize(F.col("text")))))
    return p.groupBy(key.alias("key")).agg(F.min("pid").alias("first_pid"), F.count_distinct("pid").alias("n_pids"))


_SQL_QRELS = "QR AS (SELECT qid, docid AS pid, max(rel) AS rel FROM qrels WHERE qid IS NOT NULL AND docid IS NOT NULL GROUP BY ALL)"


@query(
    "judged_queries",
    f"WITH {_SQL_QRELS} SELECT qid, count(*) FILTER (rel > 0) AS n_pos, count(*) FILTER (rel <= 0) AS n_neg, md5(string_agg(pid, ',' ORDER BY pid) FILTER (rel > 0)) AS pos FROM QR GROUP BY qid HAVING count(*) FILTER (rel > 0) > 0",
)
def judged_queries(spark: SparkSession, d: str) -> DataFrame:
    """Judgements to positives and negatives; contradictions count as the highest, queries without positive drop."""
    q = table(spark, d, "qrels", "qid", "docid", "rel").where("qid is not null and docid is not null").groupBy("qid", F.col("docid").alias("pid")).agg(F.max("rel").alias("rel"))
    g = q.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("rel") > 0, F.col("pid")))).alias("pos"), F.count_if(F.col("rel") <= 0).alias("n_neg"))
    return g.where("size(pos) > 0").select("qid", F.size("pos").cast("long").alias("n_pos"), "n_neg", F.md5(F.array_join("pos", ",")).alias("pos"))


@query("judged_with_topics", f"WITH {SQL_SQ}, {SQL_PS}, {_SQL_QRELS} SELECT SQ.domain, count(*) AS n, count(DISTINCT qid) AS n_queries, count(*) FILTER (rel > 0) AS n_pos FROM QR JOIN SQ USING (qid) JOIN PS USING (pid) GROUP BY SQ.domain")
def judged_with_topics(spark: SparkSession, d: str) -> DataFrame:
    """Judgements that have a topic and a passage, by domain: two equi joins."""
    q = table(spark, d, "qrels", "qid", "docid", "rel").where("qid is not null and docid is not null").groupBy("qid", F.col("docid").alias("pid")).agg(F.max("rel").alias("rel"))
    j = q.join(table(spark, d, "supervised_queries", "qid", "domain").groupBy("qid").agg(F.min("domain").alias("domain")), "qid").join(table(spark, d, "passages", "pid").distinct(), "pid", "left_semi")
    return j.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("qid").alias("n_queries"), F.count_if(F.col("rel") > 0).alias("n_pos"))


@query("unjudged_queries", "SELECT DISTINCT qid FROM supervised_queries WHERE is_human AND qid NOT IN (SELECT qid FROM qrels WHERE qid IS NOT NULL)")
def unjudged_queries(spark: SparkSession, d: str) -> DataFrame:
    """Human queries without a judgement: an anti join."""
    return table(spark, d, "supervised_queries", "qid", "is_human").where("is_human").select("qid").distinct().join(table(spark, d, "qrels", "qid"), "qid", "left_anti")


@query("qid_set_difference", "SELECT qid FROM qrels WHERE qid IS NOT NULL INTERSECT SELECT qid FROM supervised_queries WHERE is_human")
def qid_set_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qrels", "qid").where("qid is not null").intersect(table(spark, d, "supervised_queries", "qid", "is_human").where("is_human").select("qid"))


_SQL_KEYED = f"{SQL_SQ}, KQ AS (SELECT *, {sql_key(sql_normalize('query'))} AS key FROM SQ WHERE query IS NOT NULL)"


@query(
    "merge_duplicate_queries",
    f"""WITH {_SQL_KEYED}, G AS (SELECT key, list(struct_pack(qid := qid, pos := pos_pids, neg := neg_pids) ORDER BY qid) AS c FROM KQ GROUP BY key),
    F AS (SELECT c[1].qid AS qid, len(c) AS n_copies, flatten(list_transform(c, lambda x: x.pos)) AS p, flatten(list_transform(c, lambda x: x.neg)) AS n FROM G),
    U AS (SELECT qid, n_copies, list_filter(p, lambda x, i: list_position(p, x) = i) AS pos, list_filter(n, lambda x, i: list_position(n, x) = i AND NOT list_contains(p, x)) AS neg FROM F)
    SELECT qid, n_copies, md5(array_to_string(pos, ',')) AS pos, md5(array_to_string(neg, ',')) AS neg FROM U""",
)
def merge_duplicate_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries with one key merged into the first, positives in order, negatives without positives."""
    q = _sq(spark, d).where("query is not null").withColumn("key", X.query_key(X.normalize(F.col("query"))))
    m = dedupe.merge_queries(q, [])
    return m.select("qid", "n_copies", F.md5(F.array_join("pos_pids", ",")).alias("pos"), F.md5(F.array_join("neg_pids", ",")).alias("neg"))


_SQL_BAD = f"BAD AS (SELECT pid FROM PS WHERE text IS NULL OR {sql_arabic_share('text')} < 0.7)"


def _bad(spark: SparkSession, d: str) -> DataFrame:
    return _ps(spark, d).where(F.coalesce(X.arabic_share(F.col("text")), F.lit(0.0)) < 0.7).select("pid")


@query(
    "drop_passages_propagate",
    f"""WITH {SQL_SQ}, {SQL_PS}, {_SQL_BAD}, E AS (SELECT qid, unnest(pos_pids) AS pid, generate_subscripts(pos_pids, 1) AS i FROM SQ), K AS (SELECT * FROM E WHERE pid NOT IN (SELECT pid FROM BAD)),
    N AS (SELECT qid, count(*) AS n_neg FROM (SELECT qid, unnest(neg_pids) AS pid FROM SQ) WHERE pid NOT IN (SELECT pid FROM BAD) GROUP BY 1)
    SELECT qid, count(*) AS n_pos, md5(string_agg(pid, ',' ORDER BY i)) AS pos, coalesce(any_value(n_neg), 0) AS n_neg FROM K LEFT JOIN N USING (qid) GROUP BY qid""",
)
def drop_passages_propagate(spark: SparkSession, d: str) -> DataFrame:
    """Bad passages leave both arrays; queries without a positive go."""
    kept, _ = dedupe.drop_passages(_sq(spark, d), _bad(spark, d))
    return kept.select("qid", F.size("pos_pids").cast("long").alias("n_pos"), F.md5(F.array_join("pos_pids", ",")).alias("pos"), F.size("neg_pids").cast("long").alias("n_neg"))


@query(
    "drop_passages_report",
    f"WITH {SQL_SQ}, {SQL_PS}, {_SQL_BAD}, E AS (SELECT qid, unnest(pos_pids) AS pid FROM SQ) SELECT qid, 'no positive with >= 70% Arabic letters' AS reason FROM SQ WHERE qid NOT IN (SELECT qid FROM E WHERE pid NOT IN (SELECT pid FROM BAD))",
)
def drop_passages_report(spark: SparkSession, d: str) -> DataFrame:
    _, gone = dedupe.drop_passages(_sq(spark, d), _bad(spark, d))
    return gone.select("qid", F.lit("no positive with >= 70% Arabic letters").alias("reason"))


@query("used_passages", f"WITH {SQL_SQ}, {SQL_PS}, U AS (SELECT unnest(pos_pids) AS pid FROM SQ UNION SELECT unnest(neg_pids) FROM SQ) SELECT domain, count(*) AS n FROM PS WHERE pid IN (SELECT pid FROM U) GROUP BY domain")
def used_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages that some query refers to."""
    u = _sq(spark, d).select(F.explode(F.array_union("pos_pids", "neg_pids")).alias("pid")).distinct()
    return _ps(spark, d).select("pid", "domain").join(u, "pid", "left_semi").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query(
    "group_holdout",
    f"""WITH {SQL_SQ}, G AS (SELECT grp, count(*) AS n FROM SQ WHERE grp IS NOT NULL GROUP BY grp), O AS (SELECT *, coalesce(sum(n) OVER (ORDER BY md5('1234|holdout|' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM G),
    H AS (SELECT grp FROM O WHERE before < (SELECT least(120, sum(n) // 5) FROM G)) SELECT qid, grp IN (SELECT grp FROM H) AS held FROM SQ WHERE grp IS NOT NULL""",
)
def group_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Whole groups held out."""
    return quotas.group_holdout(_sq(spark, d).where("grp is not null"), "grp", 120).select("qid", "held")


_SQL_SYN = f"{SQL_SQ}, SY AS (SELECT * FROM SQ WHERE qtype <> '' AND grp IS NOT NULL)"


@query(
    "cap_synthetic_groups",
    f"""WITH {_SQL_SYN}, R AS (SELECT qid, grp, row_number() OVER (PARTITION BY grp ORDER BY CASE qtype WHEN 'search_query' THEN 0 WHEN 'full_question' THEN 1 ELSE 2 END, md5('1234|cap|' || qid), qid) AS r FROM SY), K AS (SELECT qid, grp FROM R WHERE r <= 2),
    G AS (SELECT grp, count(*) AS n FROM K GROUP BY grp), O AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n, md5('1234|drop|' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM G)
    SELECT qid, grp FROM K WHERE grp NOT IN (SELECT grp FROM O WHERE before < (SELECT sum(n) - 100 FROM G))""",
)
def cap_synthetic_groups(spark: SparkSession, d: str) -> DataFrame:
    """At most two queries of a passage, search queries first; then whole groups go, the smallest first, down to 100."""
    s = _sq(spark, d).where("qtype <> '' and grp is not null")
    prefer = F.when(F.col("qtype") == "search_query", 0).when(F.col("qtype") == "full_question", 1).otherwise(2)
    return quotas.cap_groups(s.select("qid", "grp", "qtype"), "grp", "qid", 2, 100, prefer).select("qid", "grp")


@query("source_sample", f"WITH {SQL_SQ}, R AS (SELECT qid, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('1234|domain|' || domain || '|' || qid), qid) AS r FROM SQ), C AS (SELECT * FROM (VALUES ('wiki', 200), ('mmarco', 80)) v(domain, n)) SELECT qid, domain FROM R JOIN C USING (domain) WHERE r <= n")
def source_sample(spark: SparkSession, d: str) -> DataFrame:
    """Exactly so many queries of each domain."""
    return quotas.sample_counts(_sq(spark, d).select("qid", "domain"), "domain", "qid", {"wiki": 200, "mmarco": 80}, "domain").select("qid", "domain")


@query("drawn_pick", f"WITH {SQL_SQ} SELECT qid FROM SQ ORDER BY md5('1234|pick|' || qid), qid LIMIT 50")
def drawn_pick(spark: SparkSession, d: str) -> DataFrame:
    return quotas.pick(_sq(spark, d).select("qid"), "qid", 50, "pick")


@query(
    "training_rows",
    f"""WITH {SQL_SQ}, R AS (SELECT qid, pos_pids, unnest(range(0, CASE WHEN is_human THEN 2 ELSE 1 END)) AS rep FROM SQ WHERE len(pos_pids) > 0)
    SELECT qid, CAST(rep AS INTEGER) AS repeat, md5(array_to_string(list_concat([pos_pids[rep % len(pos_pids) + 1]], list_filter(pos_pids, lambda x, i: i <> rep % len(pos_pids) + 1)), ',')) AS positives FROM R""",
)
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Human queries twice, each time another positive in front."""
    return rows_for_training(_sq(spark, d)).select("qid", "repeat", F.md5(F.array_join("positives", ",")).alias("positives"))


@query("lockstep_filter", f"WITH {SQL_SQ}, F AS (SELECT qid, list_filter(pos_pids, lambda x, i: CAST('0x' || substr(md5(x), 1, 1) AS BIGINT) % 2 = 0) AS kept FROM SQ) SELECT qid, md5(array_to_string(kept, ',')) AS kept, CAST(len(kept) AS BIGINT) AS n FROM F")
def lockstep_filter(spark: SparkSession, d: str) -> DataFrame:
    """An array filtered by a mask that runs beside it."""
    mask = F.transform("pos_pids", lambda x: F.conv(F.substring(F.md5(x), 1, 1), 16, 10).cast("int") % 2 == 0)
    q = _sq(spark, d).select("qid", F.transform(F.filter(F.arrays_zip(F.col("pos_pids").alias("p"), mask.alias("m")), lambda z: z["m"]), lambda z: z["p"]).alias("k"))
    return q.select("qid", F.md5(F.array_join("k", ",")).alias("kept"), F.size("k").cast("long").alias("n"))


@query("unpivot_queries", "SELECT doc_id, unnest(['title', 'site', 'source']) AS kind, unnest([title, site, source]) AS query FROM documents")
def unpivot_queries(spark: SparkSession, d: str) -> DataFrame:
    """One row for each of three fields."""
    return table(spark, d, "documents", "doc_id", "title", "site", "source").unpivot("doc_id", ["title", "site", "source"], "kind", "query")


@query(
    "select_passages",
    f"""WITH {SQL_PS}, C AS (SELECT pid, text, regexp_extract(orig_id, '^[^#]*') AS article FROM PS WHERE domain = 'wiki' AND text IS NOT NULL AND orig_id IS NOT NULL AND len(regexp_extract_all(text, '[^{B}]+')) BETWEEN 20 AND 200),
    R AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY md5('1234|passages|' || pid), pid) AS r FROM C) SELECT pid, article FROM R WHERE r <= 2 ORDER BY md5('1234|passages|' || pid), pid LIMIT 200""",
)
def select_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages for generation: of good length, at most two of an article, 200 in drawn order."""
    c = _ps(spark, d).where("domain = 'wiki' and text is not null and orig_id is not null").where(X.word_count(F.col("text")).between(20, 200)).select("pid", F.substring_index("orig_id", "#", 1).alias("article"))
    draw = O.draw("passages", "pid")
    return O.first_n(c, 2, ["article"], [draw, "pid"]).orderBy(draw, "pid").limit(200)


@query("without_eval_articles", f"WITH {SQL_PS}, {_SQL_QRELS}, A AS (SELECT DISTINCT regexp_extract(orig_id, '^[^#]*') AS article FROM PS JOIN QR USING (pid) WHERE rel > 0 AND orig_id IS NOT NULL) SELECT domain, count(*) AS n FROM PS WHERE orig_id IS NOT NULL AND regexp_extract(orig_id, '^[^#]*') NOT IN (SELECT article FROM A) GROUP BY domain")
def without_eval_articles(spark: SparkSession, d: str) -> DataFrame:
    """Passages of articles that hold no judged positive."""
    p = _ps(spark, d).where("orig_id is not null").select("pid", "domain", F.substring_index("orig_id", "#", 1).alias("article"))
    pos = table(spark, d, "qrels", "docid", "rel").where("rel > 0").select(F.col("docid").alias("pid")).distinct()
    return p.join(p.join(pos, "pid", "left_semi").select("article").distinct(), "article", "left_anti").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("pool_union", f"WITH {SQL_PS}, OWN AS (SELECT pid, domain, 'own' AS origin FROM PS), COR AS (SELECT DISTINCT 'wiki:' || substr(md5(text), 1, 16) AS pid, 'wiki' AS domain, 'corpus' AS origin FROM documents WHERE source = 'wiki' AND text IS NOT NULL) SELECT domain, origin, count(*) AS n FROM (SELECT * FROM OWN UNION ALL SELECT * FROM COR WHERE pid NOT IN (SELECT pid FROM OWN)) GROUP BY ALL")
def pool_union(spark: SparkSession, d: str) -> DataFrame:
    """A pool of own passages and corpus texts; an own passage overrides the corpus."""
    own = _ps(spark, d).select("pid", "domain", F.lit(0).alias("ord"), F.lit("own").alias("origin"))
    cor = table(spark, d, "documents", "text", "source").where("source = 'wiki' and text is not null").select(F.concat(F.lit("wiki:"), X.md5_hex(F.col("text"))).alias("pid"), F.lit("wiki").alias("domain"), F.lit(1).alias("ord"), F.lit("corpus").alias("origin"))
    return O.keep_least(own.unionByName(cor), ["pid"], "ord").groupBy("domain", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("human_share_by_domain", f"WITH {SQL_SQ} SELECT coalesce(domain, '(all)') AS domain, count(*) AS n, round(avg(CASE WHEN is_human THEN 1.0 ELSE 0.0 END), 6) AS human FROM SQ GROUP BY ROLLUP (domain)")
def human_share_by_domain(spark: SparkSession, d: str) -> DataFrame:
    g = _sq(spark, d).rollup("domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("is_human"), 1.0).otherwise(0.0)), 6).alias("human"))
    return g.withColumn("domain", F.coalesce("domain", F.lit("(all)")))


@query("positives_per_source", f"WITH {SQL_SQ} SELECT domain, qtype, CAST(sum(len(pos_pids)) AS BIGINT) AS n_pos, CAST(sum(len(neg_pids)) AS BIGINT) AS n_neg, median(len(pos_pids)) AS median_pos FROM SQ GROUP BY ALL")
def positives_per_source(spark: SparkSession, d: str) -> DataFrame:
    """Sums of array lengths and an exact median."""
    g = _sq(spark, d).groupBy("domain", "qtype")
    return g.agg(F.sum(F.size("pos_pids")).alias("n_pos"), F.sum(F.size("neg_pids")).alias("n_neg"), F.median(F.size("pos_pids")).alias("median_pos"))


_SQL_TEXT_KEY = "md5(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')))"


@query(
    "positives_among_negatives",
    f"""WITH {SQL_SQ}, {SQL_PS}, K AS (SELECT pid, {_SQL_TEXT_KEY} AS k FROM PS), P AS (SELECT DISTINCT qid, k FROM (SELECT qid, unnest(pos_pids) AS pid FROM SQ) JOIN K USING (pid)),
    N AS (SELECT qid, pid, k FROM (SELECT qid, unnest(neg_pids) AS pid FROM SQ) JOIN K USING (pid))
    SELECT (SELECT count(*) FROM SQ) AS n_queries, (SELECT count(*) FROM N) AS n_negatives, (SELECT count(*) FROM N JOIN P USING (qid, k)) AS n_violations""",
)
def positives_among_negatives(spark: SparkSession, d: str) -> DataFrame:
    """The invariant of training rows: how many negatives have the text of one of their query's positives."""
    return vectors.invariant(_sq(spark, d), _ps(spark, d))


_SQL_BROKEN = f"WITH {SQL_SQ}, {SQL_PS}, W AS (SELECT pid, regexp_extract_all(text, '[^{B}]+') AS w FROM PS), BAD AS (SELECT pid FROM W WHERE w IS NULL OR len(w) < 20 OR (len(w) >= 10 AND len(list_distinct(w)) / len(w) < 0.3)), E AS (SELECT qid, unnest(pos_pids) AS pid, generate_subscripts(pos_pids, 1) AS i FROM SQ WHERE domain = 'mmarco')"


@query("translations_checked", f"{_SQL_BROKEN} SELECT qid, count(*) AS n_pos, md5(string_agg(pid, ',' ORDER BY i)) AS pos FROM E WHERE pid NOT IN (SELECT pid FROM BAD) GROUP BY qid")
def translations_checked(spark: SparkSession, d: str) -> DataFrame:
    """Translated queries after their broken positives (too short, or few distinct words) are gone; a query without a
    positive goes too. Runs of Latin or repeated words are ``broken_translations``' own."""
    p = _ps(spark, d)
    w = X.words(F.col("text"))
    bad = p.where(F.col("text").isNull() | (F.size(w) < 20) | ((F.size(w) >= 10) & (F.size(F.array_distinct(w)) / F.size(w) < 0.3))).select("pid")
    kept, _ = dedupe.drop_passages(_sq(spark, d).where("domain = 'mmarco'"), bad)
    return kept.select("qid", F.size("pos_pids").cast("long").alias("n_pos"), F.md5(F.array_join("pos_pids", ",")).alias("pos"))


_SQL_LONG = f"""WITH {SQL_SQ}, {SQL_PS}, H AS (SELECT DISTINCT unnest(pos_pids) AS pid FROM SQ WHERE is_human), TK AS (SELECT pid, len(regexp_extract_all(coalesce(text, ''), '{_TOK}')) AS n FROM PS),
    SHORT AS (SELECT pid FROM TK WHERE n < CASE WHEN pid IN (SELECT pid FROM H) THEN 20 ELSE 60 END),
    Q AS (SELECT * FROM SQ WHERE len(regexp_extract_all(coalesce(query, ''), '{_TOK}')) <= 64 AND len(regexp_extract_all(coalesce(query, ''), '[^{B}]+')) >= 3),
    E AS (SELECT qid, unnest(pos_pids) AS pid FROM Q)"""


@query("length_checked", f"{_SQL_LONG} SELECT qid, count(*) AS n_pos FROM E WHERE pid NOT IN (SELECT pid FROM SHORT) GROUP BY qid")
def length_checked(spark: SparkSession, d: str) -> DataFrame:
    """Queries of fitting length that keep a positive of enough tokens: twenty where a human query judged it, else sixty."""
    q = _sq(spark, d)
    human = q.where("is_human").select(F.explode("pos_pids").alias("pid")).distinct().withColumn("human", F.lit(True))
    tokens = _ps(spark, d).select("pid", X.token_count(F.coalesce("text", F.lit(""))).alias("n")).join(human, "pid", "left")
    short = tokens.where(F.col("n") < F.when(F.col("human"), 20).otherwise(60)).select("pid")
    text = F.coalesce("query", F.lit(""))
    kept, _ = dedupe.drop_passages(q.where((X.token_count(text) <= 64) & (X.word_count(text) >= 3)), short)
    return kept.select("qid", F.size("pos_pids").cast("long").alias("n_pos"))


@query(
    "validation_distractors",
    f"""WITH {SQL_SQ}, {SQL_PS}, S AS (SELECT domain, count(*) / sum(count(*)) OVER () AS share FROM SQ WHERE is_human GROUP BY domain),
    R AS (SELECT pid, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('1234|validation corpus|' || domain || '|' || pid), pid) AS r FROM PS)
    SELECT domain, pid FROM R JOIN S USING (domain) WHERE r <= CAST(round(400 * share) AS INTEGER)""",
)
def validation_distractors(spark: SparkSession, d: str) -> DataFrame:
    """Four hundred drawn passages for a validation corpus, dealt to the domains as the human queries are."""
    n = _sq(spark, d).where("is_human").groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a domain
    total = sum(r.n for r in n)
    counts = {r.domain: int(400 * r.n / total + 0.5) for r in n if r.domain is not None}
    return quotas.sample_counts(_ps(spark, d).select("domain", "pid"), "domain", "pid", counts, "validation corpus").select("domain", "pid")
