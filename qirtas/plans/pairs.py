"""Queries over weak pairs: cleanup, filter chain, deduplication, decontamination, mix, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qirtas.functions import ordering as O
from qirtas.functions import text as X
from qirtas.lineage import written
from qirtas.operators import decontam, dedupe, quotas, steps
from qirtas.plans.corpus import _TOK, _q, sql_arabic_share, sql_clean, sql_key, sql_strip
from qirtas.registry import query
from qirtas.tables import table, wide_table

B = X.BLANK


def sql_normalize(c: str) -> str:
    t = f"translate({c}, '▁', ' ')"
    t = f"regexp_replace({t}, '{X.INVISIBLE}', '', 'g')"
    t = f"regexp_replace({t}, '\\x{{640}}|{X.TASHKEEL}', '', 'g')"
    t = f"translate({t}, '{X.ALEFS[0]}{X.DIGITS[0]}', '{X.ALEFS[1]}{X.DIGITS[1]}')"
    t = f"regexp_replace({t}, '\\r\\n|[\\r\\x{{0b}}\\x{{0c}}\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"
    t = f"regexp_replace({t}, '[{B.replace(chr(92) + 't-' + chr(92) + 'r', chr(92) + 't')}]+', ' ', 'g')"
    return sql_strip(f"regexp_replace({t}, ' ?\\n[\\n ]*', chr(10) || ' ', 'g')")


_S = sql_clean("t")
SQL_CP = f"""L AS (SELECT pair_id, 'q' AS side, coalesce(query, '') AS t FROM pairs UNION ALL SELECT pair_id, 'p', coalesce(passage, '') FROM pairs),
    L4 AS (SELECT *, {_S[3]} AS w FROM (SELECT *, {_S[2]} AS e FROM (SELECT *, {_S[1]} AS u FROM (SELECT *, {_S[0]} AS h FROM L)))),
    L5 AS (SELECT pair_id, side, w, len(regexp_extract_all(w, '{_TOK}')) AS toks, {sql_normalize('w')} AS norm FROM L4),
    CP AS (SELECT x.pair_id, source, kind, q.w AS query, p.w AS passage, q.toks AS q_tokens, p.toks AS p_tokens, q.norm AS q_norm, p.norm AS p_norm
           FROM pairs x JOIN L5 q ON q.pair_id = x.pair_id AND q.side = 'q' JOIN L5 p ON p.pair_id = x.pair_id AND p.side = 'p')"""
SQL_JACCARD = f"(SELECT CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(a || b)) ELSE 1.0 END FROM (SELECT regexp_extract_all(q_norm, '{X.WORD}') AS a, regexp_extract_all(p_norm, '{X.WORD}') AS b))"
SQL_TITLES = ", ".join(f"'{t}'" for t in steps.BOILERPLATE)
SQL_STEPS = f"""{SQL_CP},
    E1 AS (SELECT *, CASE WHEN q_tokens <= 0 OR p_tokens <= 0 THEN 'empty after cleanup' END AS r FROM CP), K1 AS (SELECT * EXCLUDE (r) FROM E1 WHERE r IS NULL),
    E2 AS (SELECT *, CASE WHEN q_tokens < 3 THEN 'query < 3 tokens' WHEN p_tokens < 20 THEN 'passage < 20 tokens' END AS r FROM K1), K2 AS (SELECT * EXCLUDE (r) FROM E2 WHERE r IS NULL),
    E3 AS (SELECT *, CASE WHEN {sql_arabic_share('q_norm')} < 0.7 THEN 'query not Arabic' WHEN {sql_arabic_share('p_norm')} < 0.7 THEN 'passage not Arabic' END AS r FROM K2), K3 AS (SELECT * EXCLUDE (r) FROM E3 WHERE r IS NULL),
    E4 AS (SELECT *, CASE WHEN k IN ({SQL_TITLES}) THEN 'boilerplate title' WHEN source IS NOT NULL AND count(*) OVER (PARTITION BY source, k) > 5 THEN 'query text > 5 times in the source' END AS r FROM (SELECT *, {sql_key('q_norm')} AS k FROM K3)), K4 AS (SELECT * EXCLUDE (r, k) FROM E4 WHERE r IS NULL),
    E5 AS (SELECT *, CASE WHEN {SQL_JACCARD} > 0.8 THEN 'query and passage alike (word Jaccard > 0.8)' END AS r FROM K4), K5 AS (SELECT * EXCLUDE (r) FROM E5 WHERE r IS NULL),
    E6 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY md5(q_norm || chr(31) || p_norm) ORDER BY pair_id) > 1 THEN 'duplicate pair' END AS r FROM K5), K6 AS (SELECT * EXCLUDE (r) FROM E6 WHERE r IS NULL),
    LOG AS (SELECT pair_id, source, 'cleanup' AS step, r AS reason FROM E1 WHERE r IS NOT NULL UNION ALL SELECT pair_id, source, 'length', r FROM E2 WHERE r IS NOT NULL
            UNION ALL SELECT pair_id, source, 'language', r FROM E3 WHERE r IS NOT NULL UNION ALL SELECT pair_id, source, 'junk', r FROM E4 WHERE r IS NOT NULL
            UNION ALL SELECT pair_id, source, 'near_identical', r FROM E5 WHERE r IS NOT NULL UNION ALL SELECT pair_id, source, 'dedupe', r FROM E6 WHERE r IS NOT NULL)"""
NAMES = ["cleanup", "length", "language", "junk", "near_identical", "dedupe"]


def _clean(spark: SparkSession, d: str) -> DataFrame:
    # the cleanup rewrites the texts once; every later step reads them from there
    return written(steps.clean_pairs(wide_table(spark, d, "pairs", "pair_id", "source", "kind", "query", "passage")), "clean")


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return steps.decided_pairs(wide_table(spark, d, "pairs", "pair_id", "source", "kind", "query", "passage"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).where("step is not null")


@query("pair_cleanup", f"WITH {SQL_CP} SELECT pair_id, md5(query) AS query, md5(passage) AS passage, CAST(q_tokens AS BIGINT) AS q_tokens, CAST(p_tokens AS BIGINT) AS p_tokens, md5(q_norm) AS q_norm, md5(p_norm) AS p_norm FROM CP")
def pair_cleanup(spark: SparkSession, d: str) -> DataFrame:
    c = _clean(spark, d)
    return c.select("pair_id", *(F.md5(x).alias(x) for x in ("query", "passage")), F.col("q_tokens").cast("long").alias("q_tokens"), F.col("p_tokens").cast("long").alias("p_tokens"), *(F.md5(x).alias(x) for x in ("q_norm", "p_norm")))


@query("pair_removal_log", f"WITH {SQL_STEPS} SELECT pair_id, step, reason FROM LOG")
def pair_removal_log(spark: SparkSession, d: str) -> DataFrame:
    """The whole filter chain: why each removed pair went."""
    return _log(spark, d).select("pair_id", "step", "reason")


@query("pair_kept", f"WITH {SQL_STEPS} SELECT pair_id, source, kind FROM K6")
def pair_kept(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).where("step is null").select("pair_id", "source", "kind")


@query("removed_by_reason", f"WITH {SQL_STEPS} SELECT step, reason, count(*) AS n FROM LOG GROUP BY ALL")
def removed_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).groupBy("step", "reason").agg(F.count(F.lit(1)).alias("n"))


_SQL_IN = "(SELECT count(*) FROM pairs)"


@query(
    "step_stats",
    f"""WITH {SQL_STEPS}, S AS (SELECT * FROM (VALUES (0, 'cleanup'), (1, 'length'), (2, 'language'), (3, 'junk'), (4, 'near_identical'), (5, 'dedupe')) v(ord, step)),
    N AS (SELECT ord, S.step, count(LOG.step) AS n_removed FROM S LEFT JOIN LOG USING (step) GROUP BY ALL),
    A AS (SELECT *, {_SQL_IN} - coalesce(sum(n_removed) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM N)
    SELECT step, CAST(i AS BIGINT) AS n_in, CAST(i - n_removed AS BIGINT) AS n_out, n_removed FROM A""",
)
def step_stats(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "pairs", "pair_id")
    return steps.step_stats(pairs, _log(spark, d), NAMES)


@query(
    "pair_funnel",
    f"""WITH {SQL_STEPS}, R AS (SELECT coalesce(source, '(null)') AS source, count(*) AS n_raw FROM pairs GROUP BY 1 UNION ALL SELECT '(all)', count(*) FROM pairs),
    G AS (SELECT coalesce(source, '(null)') AS source, step FROM LOG UNION ALL SELECT '(all)', step FROM LOG)
    SELECT R.source, any_value(n_raw) AS n_raw, {", ".join(f"count(*) FILTER (step = '{n}') AS {n}" for n in NAMES)}, any_value(n_raw) - count(step) AS n_left FROM R LEFT JOIN G USING (source) GROUP BY R.source""",
)
def pair_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Source by step, with a total row."""
    named = F.coalesce("source", F.lit("(null)"))
    pairs = table(spark, d, "pairs", "pair_id", "source").withColumn("source", named)
    return steps.funnel(pairs, _log(spark, d).withColumn("source", named), NAMES)


@query(
    "removal_sample",
    f"""WITH {SQL_STEPS}, R AS (SELECT *, row_number() OVER (PARTITION BY step, reason ORDER BY md5('1234|removed|' || step || '|' || reason || '|' || pair_id), pair_id) AS rn FROM LOG)
    SELECT R.pair_id, step, reason, md5(coalesce(p.query, '')) AS query FROM R LEFT JOIN pairs p USING (pair_id) WHERE rn <= 30""",
)
def removal_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most thirty removals of each reason, with their texts joined late."""
    s = steps.removal_sample(_log(spark, d), "pair_id").select("pair_id", "step", "reason")
    return s.join(table(spark, d, "pairs", "pair_id", "query"), "pair_id", "left").select("pair_id", "step", "reason", F.md5(F.coalesce("query", F.lit(""))).alias("query"))


@query(
    "review_round_robin",
    "WITH R AS (SELECT kind, pair_id, row_number() OVER (PARTITION BY kind ORDER BY md5('1234|review|' || pair_id), pair_id) AS turn FROM pairs) SELECT kind, pair_id, CAST(turn AS INTEGER) AS turn FROM R ORDER BY turn, kind LIMIT 40",
)
def review_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Forty pairs for review, one of each kind in turn."""
    return O.round_robin(table(spark, d, "pairs", "kind", "pair_id"), "kind", [O.draw("review", F.col("pair_id").cast("string")), "pair_id"], 40)


@query("near_identical_jaccard", f"WITH {SQL_CP} SELECT pair_id, round({SQL_JACCARD}, 6) AS jaccard FROM CP")
def near_identical_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).select("pair_id", F.round(X.word_jaccard(F.col("q_norm"), F.col("p_norm")), 6).alias("jaccard"))


@query("template_queries", f"WITH {SQL_CP} SELECT source, {sql_key('q_norm')} AS key, count(*) AS n FROM CP WHERE source IS NOT NULL GROUP BY ALL HAVING count(*) > 5")
def template_queries(spark: SparkSession, d: str) -> DataFrame:
    c = _clean(spark, d).where("source is not null")
    return c.groupBy("source", X.query_key(F.col("q_norm")).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@query(
    "cross_source_dedup",
    f"""WITH {SQL_CP}, O AS (SELECT *, CASE kind WHEN 'arabicaqa' THEN 0 WHEN 'aya' THEN 0 WHEN 'xlsum_title' THEN 1 WHEN 'xlsum_summary' THEN 1 WHEN 'wiki_lead' THEN 2 WHEN 'wiki_section' THEN 2 WHEN 'news' THEN 3 ELSE 4 END AS ord FROM CP),
    R AS (SELECT *, first_value(pair_id) OVER w AS orig, first_value(kind) OVER w AS orig_kind, row_number() OVER w AS rn FROM O WINDOW w AS (PARTITION BY md5(q_norm || chr(31) || p_norm) ORDER BY ord, pair_id))
    SELECT pair_id, orig AS original, orig_kind AS original_kind FROM R WHERE rn > 1""",
)
def cross_source_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Copies across kinds with the original that is kept: by order of kinds, then pair id; combined before the shuffle."""
    rank = F.coalesce(*(F.when(F.col("kind").isin(*ks), i) for i, ks in enumerate((("arabicaqa", "aya"), ("xlsum_title", "xlsum_summary"), ("wiki_lead", "wiki_section"), ("news",)))), F.lit(4))
    c = _clean(spark, d).select("pair_id", "kind", rank.alias("ord"), F.md5(F.concat("q_norm", F.lit("\x1f"), "p_norm")).alias("k"))
    first = c.groupBy("k").agg(F.min(F.struct("ord", "pair_id", "kind")).alias("f"))
    return c.join(first, "k").where(F.col("pair_id") != F.col("f.pair_id")).select("pair_id", F.col("f.pair_id").alias("original"), F.col("f.kind").alias("original_kind"))


_PERMS = dedupe.permutations()
_SQL_GRAMS = f"""W AS (SELECT doc_id, regexp_extract_all(lower(text), '{X.WORD}') AS w FROM documents WHERE text IS NOT NULL),
    G AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [coalesce(array_to_string(w, ' '), '')] END) AS g FROM W),
    H AS (SELECT doc_id, CASE WHEN g = '' THEN 0 ELSE CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % {dedupe.PRIME} END AS h FROM G),
    SIG AS (SELECT doc_id, [{", ".join(f"min((h * {a} + {b}) % {dedupe.PRIME})" for a, b in _PERMS)}] AS sig FROM H GROUP BY doc_id)"""
_SQL_BANDS = f"""BK AS (SELECT doc_id, band, md5(array_to_string(sig[band*4+1:band*4+4], ',')) AS bucket FROM SIG, range(16) r(band)),
    P AS (SELECT doc_id AS b, lag(doc_id) OVER w AS prev, first_value(doc_id) OVER w AS first FROM BK WINDOW w AS (PARTITION BY band, bucket ORDER BY doc_id)),
    CAND AS (SELECT DISTINCT a, b FROM (SELECT first AS a, b FROM P WHERE prev IS NOT NULL UNION ALL SELECT prev, b FROM P WHERE prev IS NOT NULL) WHERE a < b),
    LINK AS (SELECT a, b, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / 64 AS est FROM CAND JOIN SIG x ON x.doc_id = a JOIN SIG y ON y.doc_id = b)"""


def _sigs(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.signatures(wide_table(spark, d, "documents", "doc_id", "text").where("text is not null"), "doc_id", F.col("text"))


@query("minhash_signatures", f"WITH {_SQL_GRAMS} SELECT doc_id, md5(array_to_string(sig, ',')) AS sig FROM SIG")
def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _sigs(spark, d).select("doc_id", F.md5(F.array_join("sig", ",")).alias("sig"))


@query("lsh_candidate_pairs", f"WITH {_SQL_GRAMS}, {_SQL_BANDS} SELECT a, b, round(est, 6) AS est FROM LINK")
def lsh_candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Band buckets, each member with the first and the one before it (the reference's linear rule, which loses links;
    ``lsh_all_links`` is whole); agreement of the signatures."""
    s = written(_sigs(spark, d), "signatures")
    return dedupe.estimated(dedupe.candidate_pairs(s, "doc_id"), s, "doc_id", 0.0).select("a", "b", F.round("est", 6).alias("est"))


_SQL_KEEPERS = f"""WITH RECURSIVE {_SQL_GRAMS}, {_SQL_BANDS}, E AS (SELECT a, b FROM LINK WHERE est >= 0.8 UNION SELECT b, a FROM LINK WHERE est >= 0.8),
    R(x, y) AS (SELECT a, a FROM E UNION SELECT R.x, E.b FROM R JOIN E ON E.a = R.y), K AS (SELECT x, min(y) AS keeper FROM R GROUP BY x),
    KEPT AS (SELECT doc_id, coalesce(keeper, doc_id) AS keeper FROM SIG LEFT JOIN K ON x = doc_id)"""


@query("near_dup_keepers", f"{_SQL_KEEPERS} SELECT * FROM KEPT")
def near_dup_keepers(spark: SparkSession, d: str) -> DataFrame:
    """Keepers by the linear rule; ``near_dup_keepers_all`` is whole."""
    s = written(_sigs(spark, d), "signatures")
    return dedupe.keepers(s, dedupe.estimated(dedupe.candidate_pairs(s, "doc_id"), s, "doc_id"), "doc_id")


@query("near_dup_groups", f"{_SQL_KEEPERS}, N AS (SELECT keeper, count(*) AS n FROM KEPT GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_members, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_removed, coalesce(max(n), 0) AS largest FROM N")
def near_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    """How many groups of near duplicates there are, their members, and what goes."""
    return dedupe.groups_of(near_dup_keepers(spark, d), "doc_id")


@query(
    "keeper_estimates",
    f"{_SQL_KEEPERS} SELECT k.doc_id, k.keeper, round(len(list_filter(range(1, 65), lambda i: x.sig[i] = y.sig[i])) / 64, 6) AS est FROM KEPT k JOIN SIG x ON x.doc_id = k.doc_id JOIN SIG y ON y.doc_id = k.keeper WHERE k.doc_id <> k.keeper",
)
def keeper_estimates(spark: SparkSession, d: str) -> DataFrame:
    """How alike each document that goes is to the one that stays, by their signatures."""
    s = written(_sigs(spark, d), "signatures")
    k = dedupe.keepers(s, dedupe.estimated(dedupe.candidate_pairs(s, "doc_id"), s, "doc_id"), "doc_id").where("doc_id <> keeper")
    e = dedupe.estimated(k.select(F.col("keeper").alias("a"), F.col("doc_id").alias("b")), s, "doc_id", 0.0)
    return e.select(F.col("b").alias("doc_id"), F.col("a").alias("keeper"), F.round("est", 6).alias("est"))


@query("lsh_all_links")
def lsh_all_links(spark: SparkSession, d: str) -> DataFrame:
    """All documents whose signatures agree at 0.8 or more; those of equal signature by their least document."""
    s = written(_sigs(spark, d), "signatures")
    return dedupe.all_links(s, "doc_id").select("a", "b", F.round("est", 6).alias("est"))


@query("near_dup_keepers_all")
def near_dup_keepers_all(spark: SparkSession, d: str) -> DataFrame:
    """The least document of each group that all links connect."""
    s = written(_sigs(spark, d), "signatures")
    return dedupe.keepers(s, dedupe.all_links(s, "doc_id"), "doc_id")


_SQL_KW = lambda c: f"regexp_extract_all({sql_key(sql_normalize(c))}, '[^{B}]+')"
_SQL_DECON = f"""EV AS (SELECT item_id, {_SQL_KW('text')} AS w FROM eval_items),
    T0 AS (SELECT 0 AS kind, array_to_string(w, ' ') AS gram, item_id FROM EV WHERE len(w) > 0 UNION ALL SELECT 13, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))), item_id FROM EV WHERE len(w) >= 13
           UNION ALL SELECT len(w), array_to_string(w, ' '), item_id FROM EV WHERE len(w) BETWEEN 6 AND 12),
    T AS (SELECT kind, gram, min(item_id) AS label FROM T0 GROUP BY ALL),
    Q AS (SELECT pair_id, {_SQL_KW('query')} AS w FROM pairs WHERE query IS NOT NULL),
    QG AS (SELECT DISTINCT pair_id, 0 AS kind, array_to_string(w, ' ') AS gram FROM Q WHERE len(w) > 0 UNION SELECT DISTINCT pair_id, CAST(n AS INTEGER), unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) FROM Q, range(6, 14) r(n) WHERE len(w) >= n),
    HIT AS (SELECT pair_id, min(struct_pack(rank := CASE WHEN QG.kind = 0 THEN -1 ELSE 13 - QG.kind END, label := label)) AS h FROM QG JOIN T ON T.kind = QG.kind AND T.gram = QG.gram GROUP BY pair_id)"""


@query("decontam_queries", f"WITH {_SQL_DECON} SELECT pair_id, CASE h.rank WHEN -1 THEN 'exact query' WHEN 0 THEN '13-gram' ELSE 'whole short query' END AS reason, h.label AS label FROM HIT")
def decontam_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries that hold an evaluation text: exact, by 13-gram or by a whole short query."""
    q = wide_table(spark, d, "pairs", "pair_id", "query").where("query is not null")
    return decontam.decide(q, "pair_id", "query", table(spark, d, "eval_items", "item_id", "text"))


_COUNTS = {"news": 400, "wiki": 300, "xlsum": 60, "qa": 200, "qa_mined": 150, "spans": 150}
_SQL_SRC = "CASE kind WHEN 'news' THEN 'news' WHEN 'wiki_lead' THEN 'wiki' WHEN 'wiki_section' THEN 'wiki' WHEN 'xlsum_title' THEN 'xlsum' WHEN 'xlsum_summary' THEN 'xlsum' WHEN 'arabicaqa' THEN 'qa' WHEN 'aya' THEN 'qa' ELSE kind END"
_SQL_MIX = f"""S AS (SELECT pair_id, {_SQL_SRC} AS source FROM pairs), C AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in _COUNTS.items())}) v(source, n)),
    D AS (SELECT S.*, n, row_number() OVER (PARTITION BY S.source ORDER BY md5('1234|mix|' || S.source || '|' || pair_id), pair_id) AS r FROM S JOIN C USING (source)), M AS (SELECT * FROM D WHERE r <= n),
    V AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('1234|validation|' || source || '|' || pair_id), pair_id) <= least(25, count(*) OVER (PARTITION BY source) // 5) AS v FROM M)"""


def _source() -> F.Column:
    return F.coalesce(*(F.when(F.col("kind").isin(*k), F.lit(s)) for s, k in (("wiki", ("wiki_lead", "wiki_section")), ("xlsum", ("xlsum_title", "xlsum_summary")), ("qa", ("arabicaqa", "aya")))), F.col("kind"))


@query("final_pair_mix", f"WITH {_SQL_MIX} SELECT pair_id, source, CASE WHEN v THEN 'validation' ELSE 'train' END AS split FROM V")
def final_pair_mix(spark: SparkSession, d: str) -> DataFrame:
    """Drawn counts of each source, split into training and validation."""
    p = table(spark, d, "pairs", "pair_id", "kind").select("pair_id", _source().alias("source"))
    m = quotas.sample_counts(p, "source", "pair_id", _COUNTS, "mix")
    return quotas.with_validation(m, "source", "pair_id", 25).select("pair_id", "source", "split")


@query("share_cap_counts")
def share_cap_counts(spark: SparkSession, d: str) -> DataFrame:
    """What each source has and what a cap of a fifth leaves of it: a loop over one tiny aggregate on the driver."""
    n = {r.source: r.n for r in table(spark, d, "pairs", "kind").groupBy(_source().alias("source")).agg(F.count(F.lit(1)).alias("n")).collect()}
    capped = quotas.capped(n, 0.2)
    return spark.createDataFrame([(s, n[s], capped[s]) for s in sorted(n)], "source string, available long, capped long")


@query(
    "site_cap",
    "WITH R AS (SELECT pair_id, site, row_number() OVER (PARTITION BY site ORDER BY md5('1234|site|' || pair_id), pair_id) AS r FROM pairs WHERE site IS NOT NULL) SELECT pair_id, site FROM R WHERE r <= 3",
)
def site_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most three drawn pairs of each site."""
    return O.first_n(table(spark, d, "pairs", "pair_id", "site").where("site is not null"), 3, ["site"], [O.draw("site", F.col("pair_id").cast("string")), "pair_id"])


@query(
    "pairs_not_prose",
    rf"""WITH P AS (SELECT pair_id, passage AS t, list_filter(string_split(passage, chr(10)), lambda x: regexp_matches(x, '[^{B}]')) AS l, length(passage) - len(regexp_extract_all(passage, ' ')) AS chars,
        len(regexp_extract_all(passage, '[،,؛;•]')) + len(regexp_extract_all(passage, ' - ')) AS seps, len(regexp_extract_all(passage, '[^{B}]+')) AS words FROM pairs WHERE passage IS NOT NULL)
    SELECT pair_id, CASE WHEN regexp_matches(substr(t, 1, 300), '{X.DISAMBIGUATION}') THEN 'disambiguation page' WHEN len(regexp_extract_all(t, '\|')) >= 3 OR len(regexp_extract_all(t, '\t')) >= 3 THEN 'table' WHEN chars > 0 AND len(regexp_extract_all(t, '\p{{Nd}}')) / chars > 0.25 THEN 'table or figures'
        WHEN len(l) >= 3 AND len(list_filter(l, lambda x: len(regexp_extract_all(x, '[^{B}]+')) <= 5)) / len(l) > 0.5 THEN 'list (short lines)' WHEN seps >= 8 AND words / (seps + 1) < 3.0 THEN 'list (short items)' END AS reason FROM P""",
)
def pairs_not_prose(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs", "pair_id", "passage").where("passage is not null").select("pair_id", X.not_prose(F.lit(None).cast("string"), F.col("passage")).alias("reason"))


@query(
    "copied_ngrams",
    f"""WITH P AS (SELECT pair_id, regexp_extract_all(query, '{X.WORD}') AS q, regexp_extract_all(passage, '{X.WORD}') AS p FROM pairs WHERE query IS NOT NULL AND passage IS NOT NULL),
    G AS (SELECT pair_id, list_transform(range(1, greatest(len(q) - 3, 1)), lambda i: array_to_string(q[i:i+4], ' ')) AS qg, list_transform(range(1, greatest(len(p) - 3, 1)), lambda i: array_to_string(p[i:i+4], ' ')) AS pg FROM P)
    SELECT pair_id, list_filter(qg, lambda g: list_contains(pg, g))[1] AS copied FROM G WHERE len(list_filter(qg, lambda g: list_contains(pg, g))) > 0""",
)
def copied_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """The first five words in a row that a query copies from its passage."""
    p = table(spark, d, "pairs", "pair_id", "query", "passage").where("query is not null and passage is not null")
    return p.select("pair_id", X.copied_run(F.col("query"), F.col("passage"), 5).alias("copied")).where("copied is not null")


@query(
    "broken_translations",
    rf"""WITH Q AS (SELECT pair_id, regexp_extract_all(passage, '[^{B}]+') AS w FROM pairs WHERE passage IS NOT NULL),
    E AS (SELECT pair_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM Q), F AS (SELECT *, regexp_matches(x, '\p{{Latin}}') AND NOT regexp_matches(regexp_replace(x, '\p{{Latin}}+', '', 'g'), '[\p{{L}}_]') AS lat, coalesce(x = lag(x) OVER (PARTITION BY pair_id ORDER BY i), false) AS rep FROM E),
    G AS (SELECT *, i - sum(lat::INT) OVER w AS gl, i - sum(rep::INT) OVER w AS gr FROM F WINDOW w AS (PARTITION BY pair_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
    LR AS (SELECT pair_id, max(n) AS n FROM (SELECT pair_id, gl, count(*) AS n FROM G WHERE lat GROUP BY ALL) GROUP BY 1), RR AS (SELECT pair_id, max(n) + 1 AS n FROM (SELECT pair_id, gr, count(*) AS n FROM G WHERE rep GROUP BY ALL) GROUP BY 1)
    SELECT Q.pair_id, CASE WHEN len(w) < 5 THEN 'too short' WHEN coalesce(LR.n, 0) >= 4 THEN 'untranslated: ' || LR.n || ' Latin words in a row' WHEN coalesce(RR.n, 1) >= 4 THEN 'broken: a word repeated ' || RR.n || ' times in a row'
        WHEN len(w) >= 10 AND len(list_distinct(w)) / len(w) < 0.3 THEN 'broken: few distinct words' END AS reason FROM Q LEFT JOIN LR USING (pair_id) LEFT JOIN RR USING (pair_id)""",
)
def broken_translations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs", "pair_id", "passage").where("passage is not null").select("pair_id", X.broken_translation(F.col("passage"), least_words=5).alias("reason"))


@query("banned_mentions")
def banned_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Queries that mention the passage or the text itself (a pattern with lookarounds, which the SQL engine lacks)."""
    q = table(spark, d, "pairs", "pair_id", "query").where("query is not null").withColumn("n", X.normalize(F.col("query")))
    p = X.banned_pattern(X.BANNED)
    return q.where(F.col("n").rlike(p)).select("pair_id", F.regexp_extract("n", p, 0).alias("form"))


@query("titled_passages", "SELECT doc_id, md5(concat_ws(' ', nullif(" + sql_strip('title') + ", ''), " + sql_strip('text') + ")) AS passage FROM documents WHERE text IS NOT NULL")
def titled_passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "title", "text").where("text is not null").select("doc_id", F.md5(X.titled(F.col("title"), F.col("text"))).alias("passage"))


@query("short_titles", f"WITH S AS (SELECT pair_id, trim(regexp_replace(query, '[{B}]+', ' ', 'g')) AS q FROM pairs WHERE query IS NOT NULL) SELECT pair_id, CASE WHEN length(q) > 40 THEN substr(q, 1, 39) || '…' ELSE q END AS short FROM S")
def short_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs", "pair_id", "query").where("query is not null").select("pair_id", X.shortened(F.col("query"), 40).alias("short"))


@query("prompt_words", "SELECT pid, ['هل', 'كيف', 'لماذا', 'متى'][CAST('0x' || substr(md5(pid), 1, 8) AS BIGINT) % 4 + 1] AS word FROM (SELECT DISTINCT pid FROM passages)")
def prompt_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages", "pid").distinct().select("pid", X.hex_choice(F.col("pid"), ["هل", "كيف", "لماذا", "متى"]).alias("word"))
