"""Queries over documents: text functions, filters, exact deduplication, planning, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qirtas.functions import ordering as O
from qirtas.functions import text as X
from qirtas.operators import corpus as C
from qirtas.operators.steps import once
from qirtas.registry import query
from qirtas.tables import table, wide_table

# SQL twins of the shared expressions
B = X.BLANK
_TOK = rf"{X.WORD}|[^\p{{L}}\p{{N}}_{B}]"
SQL_WC = f"len(regexp_extract_all(text, '[^{B}]+'))"
_LINE = B.replace(r"\t-\r", r"\t\x{0b}-\r")


def _q(s: str) -> str:
    return s.replace("'", "''")


def sql_clean(c: str) -> tuple[str, str, str, str]:
    """The cleanup's four stages as SQL: after html, url, email, whitespace."""
    t = f"regexp_replace({c}, '{_q(X.TAG)}', ' ', 'g')"
    for a, b in X.ENTITIES:
        t = f"replace({t}, '{a}', '{_q(b)}')"
    html = f"(CASE WHEN contains({c}, '<') OR contains({c}, '&') THEN {t} ELSE {c} END)"
    return html, "regexp_replace(h, '%s', ' ', 'g')" % _q(X.URL), "(CASE WHEN contains(u, '@') THEN regexp_replace(u, '%s', ' ', 'g') ELSE u END)" % _q(X.EMAIL), sql_strip(f"regexp_replace(regexp_replace(e, '[{_LINE}]+', ' ', 'g'), '[{B}]*\\n[{B}]*', chr(10), 'g')")


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{B}]+|[{B}]+$', '', 'g')"


def sql_arabic_share(c: str) -> str:
    n = f"len(regexp_extract_all({c}, '\\p{{L}}'))"
    return f"(CASE WHEN {n} > 0 THEN len(regexp_extract_all({c}, '{X.ARABIC_LETTER}')) / {n} ELSE 0.0 END)"


def sql_key(c: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace({c}, '[\\p{{P}}\\p{{S}}]+', ' ', 'g')), '[{B}]+', ' ', 'g'))"


SQL_CLEANED = "SELECT *, {3} AS w FROM (SELECT *, {2} AS e FROM (SELECT *, {1} AS u FROM (SELECT *, {0} AS h FROM (SELECT *, coalesce(text, '') AS t FROM documents))))".format(*sql_clean("t"))


@query(
    "corpus_funnel",
    f"""
    WITH c AS (SELECT doc_id, source, w AS text FROM ({SQL_CLEANED})),
    r AS (SELECT *, row_number() OVER (PARTITION BY substr(md5(text), 1, 16) ORDER BY doc_id) AS rn,
                 length({sql_strip('text')}) AS chars, len(regexp_extract_all(text, '{_TOK}')) AS toks, {sql_arabic_share('text')} AS share FROM c),
    d AS (SELECT source, CASE WHEN rn > 1 THEN 'duplicate' WHEN chars < 100 THEN 'short' WHEN toks < 32 THEN 'few tokens' WHEN share < 0.5 THEN 'not Arabic' END AS reason FROM r)
    SELECT coalesce(source, '(all)') AS source, count(*) AS n_in, count(*) FILTER (reason = 'duplicate') AS n_duplicate, count(*) FILTER (reason = 'short') AS n_short,
           count(*) FILTER (reason = 'few tokens') AS n_few_tokens, count(*) FILTER (reason = 'not Arabic') AS n_not_arabic, count(*) FILTER (reason IS NULL) AS n_kept
    FROM d GROUP BY ROLLUP (source)""",
)
def corpus_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Slice zero: clean, drop exact copies (first kept), filter, count by source with a total row."""
    t = wide_table(spark, d, "documents", "doc_id", "source", "text")
    return C.corpus_counts(once(t.withColumnRenamed("text", "raw"), text=X.clean(F.col("raw"))))


@query(
    "clean_text_rules",
    f"""SELECT doc_id, md5(w) AS cleaned, list_aggregate(list_filter([CASE WHEN h <> t THEN 'html' END, CASE WHEN u <> h THEN 'url' END, CASE WHEN e <> u THEN 'email' END,
        CASE WHEN w <> {sql_strip('e')} THEN 'whitespace' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS rules
        FROM ({SQL_CLEANED})""",
)
def clean_text_rules(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned text (by hash) and which rules changed it."""
    t = wide_table(spark, d, "documents", "doc_id", "text")
    return t.select("doc_id", F.md5(X.clean(F.col("text"))).alias("cleaned"), F.nullif(F.array_join(X.fired(F.col("text")), ","), F.lit("")).alias("rules"))


@query("arabic_normalized")
def arabic_normalized(spark: SparkSession, d: str) -> DataFrame:
    """The whole normalizer with compatibility composition."""
    t = wide_table(spark, d, "documents", "doc_id", "text").where("text is not null")
    n = X.full_normalize(F.col("text"))
    return t.select("doc_id", F.md5(n).alias("normalized"), (n != F.col("text")).alias("changed"))


@query("pre_tokens", rf"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '\n|\p{{Nd}}|[\p{{P}}\p{{S}}]+|[^\p{{Nd}}\p{{P}}\p{{S}}{B}]+')) AS BIGINT) AS n_pre_tokens FROM documents")
def pre_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Pre-tokens: words, newlines, single digits, runs of punctuation."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", C.pre_tokens(F.coalesce("text", F.lit(""))).alias("p")).select("doc_id", F.size("p").cast("long").alias("n_pre_tokens"))


_MOD = "(({0}) * 4294967296 + CAST('0x' || substr(md5(text), {1}, 8) AS BIGINT)) % 50"
_SQL_MOD = "CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) % 50"
for _p in (9, 17, 25):
    _SQL_MOD = _MOD.format(_SQL_MOD, _p)


@query("heldout_md5_split", f"SELECT doc_id, {_SQL_MOD} = 0 AS heldout FROM documents WHERE text IS NOT NULL")
def heldout_md5_split(spark: SparkSession, d: str) -> DataFrame:
    """One of fifty documents by the full md5 number."""
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", (X.md5_mod(F.col("text"), 50) == 0).alias("heldout"))


@query(
    "shard_quota_scan",
    f"""WITH h AS (SELECT doc_id, source, {_SQL_MOD} = 0 AS heldout FROM documents WHERE length({sql_strip('text')}) >= 20),
    r AS (SELECT *, sum(CASE WHEN heldout THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS seen FROM h)
    SELECT doc_id, source, CASE WHEN heldout THEN 'heldout' ELSE 'train' END AS split FROM r WHERE seen - CASE WHEN heldout THEN 0 ELSE 1 END < 100""",
)
def shard_quota_scan(spark: SparkSession, d: str) -> DataFrame:
    """Read each source in order until 100 training rows; held-out rows don't use the quota."""
    t = table(spark, d, "documents", "doc_id", "source", "text").where(F.length(X.strip(F.col("text"))) >= 20)
    return C.quota_scan(t.withColumn("heldout", X.md5_mod(F.col("text"), 50) == 0), "source", "doc_id", 100).select("doc_id", "source", F.when(F.col("heldout"), "heldout").otherwise("train").alias("split"))


@query("script_shares", f"SELECT doc_id, round({sql_arabic_share('text')}, 6) AS arabic_share, CAST(len(regexp_extract_all(text, '{X.LATIN_LETTER}')) AS BIGINT) AS n_latin FROM documents WHERE text IS NOT NULL")
def script_shares(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return t.select("doc_id", F.round(X.arabic_share(F.col("text")), 6).alias("arabic_share"), X.letters(F.col("text"), X.LATIN_LETTER).cast("long").alias("n_latin"))


@query(
    "word_categories",
    rf"""WITH w AS (SELECT source, regexp_replace(unnest(regexp_extract_all(text, '[^{B}]+')), '^[\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]+$', '', 'g') AS w FROM documents)
    SELECT source, CASE WHEN regexp_matches(w, '^{X.ARABIC_LETTER}+$') THEN 'arabic' WHEN regexp_matches(w, '^{X.LATIN_LETTER}+$') THEN 'latin' WHEN regexp_matches(w, '^\p{{Nd}}+([.,]\p{{Nd}}+)*$') THEN 'number' ELSE 'other' END AS category, count(*) AS n FROM w GROUP BY ALL""",
)
def word_categories(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents", "source", "text").select("source", F.explode(X.words(F.col("text"))).alias("w"))
    return w.groupBy("source", F.coalesce(X.word_category(F.col("w")), F.lit("other")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


_WORD_START = f"SELECT doc_id, len(regexp_extract_all(text, '(^|[{B}])[^\\p{{L}}\\p{{N}}{B}]*{X.ARABIC_LETTER}')) AS arabic, len(regexp_extract_all(text, '(^|[{B}])[^\\p{{L}}\\p{{N}}{B}]*{X.LATIN_LETTER}')) AS latin FROM documents WHERE text IS NOT NULL"


@query("word_start_filter", f"WITH S AS ({_WORD_START}) SELECT doc_id, arabic, latin, NOT (arabic + latin > 0 AND arabic < 0.8 * (arabic + latin)) AS kept FROM S")
def word_start_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the script in which their words begin: kept if four fifths of them are Arabic, or none begins with a
    letter of either script."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return C.word_starts(t, "doc_id", F.col("text"), 0.8)


@query(
    "token_scripts",
    rf"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_TOK}')) AS tok FROM documents)
    SELECT CASE WHEN regexp_matches(tok, '^[{B}▁]*$') THEN 'space' WHEN regexp_matches(tok, '{X.ARABIC_LETTER}') THEN 'arabic' WHEN regexp_matches(tok, '{X.LATIN_LETTER}') THEN 'latin' WHEN regexp_matches(tok, '\p{{Nd}}') THEN 'digit' ELSE 'other' END AS script, count(*) AS n FROM t GROUP BY 1""",
)
def token_scripts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents", "text").select(F.explode(X.tokens(F.col("text"))).alias("tok")).distinct()
    return t.groupBy(X.token_script(F.col("tok")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fertility_by_source",
    rf"""SELECT source, CAST(sum(len(regexp_extract_all(text, '{_TOK}'))) AS BIGINT) AS n_tokens, CAST(sum({SQL_WC}) AS BIGINT) AS n_words, round(sum(len(regexp_extract_all(text, '{_TOK}'))) / sum({SQL_WC}), 6) AS tokens_per_word,
    round(sum(strlen(text)) / sum(len(regexp_extract_all(text, '{_TOK}'))), 6) AS bytes_per_token FROM documents WHERE text IS NOT NULL GROUP BY source""",
)
def fertility_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per word and bytes per token, with the default token counter."""
    t = table(spark, d, "documents", "source", "text").where("text is not null")
    s = t.groupBy("source").agg(F.sum(X.token_count(F.col("text"))).alias("n_tokens"), F.sum(X.word_count(F.col("text"))).alias("n_words"), F.sum(F.octet_length("text")).alias("b"))
    return s.select("source", "n_tokens", "n_words", F.round(F.col("n_tokens") / F.col("n_words"), 6).alias("tokens_per_word"), F.round(F.col("b") / F.col("n_tokens"), 6).alias("bytes_per_token"))


@query("alphabet_fingerprint", "WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) SELECT count(*) AS n_chars, substr(sha256(string_agg(c, chr(10) ORDER BY unicode(c))), 1, 16) AS fingerprint FROM c WHERE c <> ''")
def alphabet_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Hash of a sorted vocabulary; here the alphabet of the corpus, which Unicode bounds."""
    c = table(spark, d, "documents", "text").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").distinct()
    return C.vocabulary_fingerprint(c, "c")


@query("exact_dedup_keep_first", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY substr(md5(coalesce(text, '')), 1, 16) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def exact_dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents", "doc_id", "source", "text").withColumn("k", X.md5_hex(F.coalesce("text", F.lit(""))))
    return O.keep_least(t.select("doc_id", "source", "k"), ["k"], "doc_id").select("doc_id", "source")


@query(
    "dedup_report",
    "WITH r AS (SELECT source, row_number() OVER (PARTITION BY substr(md5(coalesce(text, '')), 1, 16) ORDER BY doc_id) AS rn FROM documents) SELECT source, count(*) AS n_docs, count(*) FILTER (rn > 1) AS n_duplicates, round(count(*) FILTER (rn > 1) / greatest(count(*), 1), 6) AS share FROM r GROUP BY source",
)
def dedup_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents and copies of each source; the first copy is searched by a combined minimum, not by a sorted window."""
    t = table(spark, d, "documents", "doc_id", "source", "text").select("doc_id", "source", X.md5_hex(F.coalesce("text", F.lit(""))).alias("k"))
    kept = O.keep_least(t, ["k"], "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    g = t.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs")).alias("g").join(kept.alias("k"), F.col("g.source").eqNullSafe(F.col("k.source")), "left").select("g.source", "n_docs", (F.col("n_docs") - F.coalesce("kept", F.lit(0))).alias("n_duplicates"))
    return g.withColumn("share", F.round(F.col("n_duplicates") / F.greatest("n_docs", F.lit(1)), 6))


@query("unit_duplicates", "SELECT source, count(*) AS n_skipped FROM (SELECT source, row_number() OVER (PARTITION BY source, md5(substr(text, 1, 8000)) ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn > 1 GROUP BY source")
def unit_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Rows skipped in a source because an earlier one begins alike (8,000 characters, as defined)."""
    t = table(spark, d, "documents", "doc_id", "source", "text").where("text is not null")
    g = t.groupBy("source", F.md5(F.substring("text", 1, 8000)).alias("k")).agg((F.count(F.lit(1)) - 1).alias("again"))
    return g.groupBy("source").agg(F.sum("again").alias("n_skipped")).where("n_skipped > 0")


@query(
    "keyword_soup",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^{B}]+') AS w FROM documents WHERE text IS NOT NULL),
    g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS g FROM w WHERE len(w) >= 3),
    c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL)
    SELECT doc_id, round(CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS repeated FROM c GROUP BY doc_id HAVING CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS DOUBLE) / sum(n) > 0.2""",
)
def keyword_soup(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose repeated trigrams are over a fifth of all."""
    t = wide_table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return C.keyword_soup(t, "doc_id", F.col("text"), 0.2).select("doc_id", F.round("repeated", 6).alias("repeated"))


@query("single_letters", f"WITH w AS (SELECT source, unnest(regexp_extract_all(text, '[^{B}]+')) AS w FROM documents) SELECT source, round(1000.0 * count(*) FILTER (length(w) = 1 AND w <> 'و' AND unicode(w) BETWEEN 1536 AND 1791) / count(*), 6) AS per_1000 FROM w GROUP BY source")
def single_letters(spark: SparkSession, d: str) -> DataFrame:
    """Single Arabic letters per thousand words, a sign of broken extraction."""
    t = table(spark, d, "documents", "source", "text").select("source", X.words(F.col("text")).alias("w")).where("size(w) > 0")
    one = F.size(F.filter("w", lambda x: (F.length(x) == 1) & (x != "و") & x.rlike(r"^[\x{600}-\x{6ff}]$")))
    return t.groupBy("source").agg(F.round(F.lit(1000.0) * F.sum(one) / F.sum(F.size("w")), 6).alias("per_1000"))


@query(
    "heading_probe",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
    n AS (SELECT *, {sql_strip('raw')} AS line, coalesce({sql_strip("lag(raw) OVER w")} = '', true) AS pb, coalesce({sql_strip("lead(raw) OVER w")} = '', true) AS nb FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    h AS (SELECT doc_id, line FROM n WHERE i > 1 AND line <> '' AND len(regexp_extract_all(line, '[^{B}]+')) <= 10 AND length(line) <= 80 AND NOT regexp_matches(line, '[.!?؟،,;؛:]$') AND (suffix(raw, ' ') OR (pb AND nb)))
    SELECT line AS heading, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, heading LIMIT 15""",
)
def heading_probe(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen most frequent headings."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    h = C.headings(t, "doc_id", "text").where("i > 0")
    return h.groupBy(F.col("line").alias("heading")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "heading").limit(15)


@query(
    "paragraph_pairs",
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, p[1] AS head, p[2:] AS rest FROM p WHERE len(p) >= 2),
    c AS (SELECT *, list_transform(range(1, len(rest) + 1), lambda i: list_sum(list_transform(rest[1:i], lambda x: len(regexp_extract_all(x, '[^{B}]+'))))) AS cum FROM b)
    SELECT doc_id, md5(head) AS head, md5(substr(array_to_string(rest[1:len(list_filter(cum, lambda x: x < 25)) + 1], chr(10)), 1, 3000)) AS body FROM c""",
)
def paragraph_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A document's first paragraph with the next ones up to 25 words."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", X.paragraphs(F.col("text")).alias("p")).where("size(p) >= 2")
    return t.select("doc_id", F.md5(F.col("p")[0]).alias("head"), F.md5(X.join_until(F.slice("p", 2, F.size("p")), 25)).alias("body"))


@query("mined_questions")
def mined_questions(spark: SparkSession, d: str) -> DataFrame:
    """Question paragraphs with their answers, at most two of a document."""
    t = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(X.mined_questions(F.col("text"))).alias("i", "q"))
    return t.select("doc_id", F.col("i").cast("long").alias("i"), "q.question", "q.answer")


@query("wiki_sections")
def wiki_sections(spark: SparkSession, d: str) -> DataFrame:
    """Title with lead, and title and heading with each section, from wiki documents."""
    t = table(spark, d, "documents", "doc_id", "title", "text", "source").where("source = 'wiki' and text is not null")
    return C.wiki_pairs(t, "doc_id", "title", "text")


_PACK_L = 128


@query(
    "pack_sequences",
    f"""WITH t AS (SELECT source, doc_id, list_append(list_transform(regexp_extract_all(text, '[^{B}]+'), lambda w: CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) + 10), 3) AS ids FROM documents WHERE text IS NOT NULL),
    f AS (SELECT source, unnest(ids) AS id, doc_id, generate_subscripts(ids, 1) AS i FROM t),
    p AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS pos FROM f),
    s AS (SELECT source, pos // {_PACK_L - 2} AS seq, list(id ORDER BY pos) AS body FROM p GROUP BY ALL)
    SELECT source, seq, md5(array_to_string(list_concat([1], body, [2]), ',')) AS ids FROM s WHERE len(body) = {_PACK_L - 2}""",
)
def pack_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Documents' tokens one after the other, each closed by a separator, cut into rows of fixed length; tails drop."""
    t = wide_table(spark, d, "documents", "doc_id", "source", "text").where("text is not null")
    ids = F.transform(X.words(F.col("text")), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") + 10)
    rows = C.pack(t.select("source", "doc_id", ids.alias("ids")), "source", "doc_id", "ids", _PACK_L, cls=1, sep=3, end=2)
    return rows.select("source", "seq", F.md5(F.array_join("ids", ",")).alias("ids"))


@query(
    "pack_manifest",
    f"""WITH t AS (SELECT source, {SQL_WC} + 1 AS n FROM documents WHERE text IS NOT NULL)
    SELECT source, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(n) // {_PACK_L - 2} AS BIGINT) AS n_sequences, round(sum(n) / sum(sum(n)) OVER (), 6) AS token_share FROM t GROUP BY source""",
)
def pack_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each source as a packing manifest has them."""
    t = table(spark, d, "documents", "source", "text").where("text is not null").select("source", (X.word_count(F.col("text")) + 1).alias("n"))
    g = t.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"))
    return g.select("source", "n_docs", "n_tokens", F.floor(F.col("n_tokens") / (_PACK_L - 2)).alias("n_sequences"), F.round(F.col("n_tokens") / F.sum("n_tokens").over(W.partitionBy()), 6).alias("token_share"))


@query(
    "masked_tokens",
    f"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^{B}]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^{B}]+'), 1) - 1 AS i FROM documents),
    u AS (SELECT CAST('0x' || substr(md5('1234|mask|' || doc_id || '|' || i), 1, 8) AS BIGINT) / 4294967296.0 AS a, CAST('0x' || substr(md5('1234|kind|' || doc_id || '|' || i), 1, 8) AS BIGINT) / 4294967296.0 AS b FROM f)
    SELECT CASE WHEN a >= 0.3 THEN 'kept' WHEN b < 0.8 THEN 'mask' WHEN b < 0.9 THEN 'random' ELSE 'same' END AS kind, count(*) AS n FROM u GROUP BY 1""",
)
def masked_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Masking of 30 % of all tokens (80 / 10 / 10), decided by hash of row and place."""
    f = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(X.words(F.col("text"))).alias("i", "w"))
    return f.groupBy(C.mask_kind("doc_id", "i").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "budget_prefix_files",
    """WITH f AS (SELECT source, lang, count(*) AS n_docs, CAST(sum(strlen(coalesce(text, ''))) // 4 AS BIGINT) AS est FROM documents WHERE lang IS NOT NULL GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(est) OVER (PARTITION BY source ORDER BY md5('1234|plan|' || source || '|' || lang), lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
    SELECT source, lang, est, CAST(before AS BIGINT) AS planned_before FROM b WHERE before < 60000""",
)
def budget_prefix_files(spark: SparkSession, d: str) -> DataFrame:
    """Files (here: languages of a source) in drawn order while less than the token budget is planned."""
    f = table(spark, d, "documents", "source", "lang", "text").where("lang is not null").groupBy("source", "lang").agg(F.floor(F.sum(F.octet_length(F.coalesce("text", F.lit("")))) / 4).alias("est"))
    return C.budget_prefix(f, "source", "est", O.draw("plan", "source", "lang"), "lang", 60000).select("source", "lang", "est", F.col("before").alias("planned_before"))


@query(
    "row_group_units",
    "WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, CAST(s AS BIGINT) AS first_row, CAST(least(s + 250, n) AS BIGINT) AS end_row FROM (SELECT source, n, unnest(range(0, n, 250)) AS s FROM n)",
)
def row_group_units(spark: SparkSession, d: str) -> DataFrame:
    """Each source's rows in ranges of 250."""
    n = table(spark, d, "documents", "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return C.row_ranges(n, "source", "n", 250)


@query(
    "shard_sample_quota",
    "WITH s AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY md5('1234|shards|' || source || '|' || lang), lang) AS r FROM (SELECT DISTINCT source, lang FROM documents WHERE lang IS NOT NULL)), k AS (SELECT * FROM s WHERE r <= 3) SELECT source, lang, CAST(ceil(500.0 / count(*) OVER (PARTITION BY source)) AS BIGINT) AS quota FROM k",
)
def shard_sample_quota(spark: SparkSession, d: str) -> DataFrame:
    """Three drawn shards (languages) of each source and the documents each must give."""
    s = table(spark, d, "documents", "source", "lang").where("lang is not null").distinct()
    k = O.first_n(s, 3, ["source"], [O.draw("shards", "source", "lang"), "lang"])
    return k.select("source", "lang", F.ceil(F.lit(500.0) / F.count(F.lit(1)).over(W.partitionBy("source"))).alias("quota"))


@query(
    "ordered_source_caps",
    f"""WITH r AS (SELECT source, {SQL_WC} AS n, {_SQL_MOD} = 0 AS heldout, row_number() OVER (PARTITION BY source, {_SQL_MOD} = 0 ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL)
    SELECT source, heldout, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM r WHERE rn <= CASE WHEN heldout THEN 20 ELSE 300 END GROUP BY ALL""",
)
def ordered_source_caps(spark: SparkSession, d: str) -> DataFrame:
    """At most 300 training and 20 held-out documents of each source, in order, with their words."""
    t = table(spark, d, "documents", "doc_id", "source", "text").where("text is not null").select("doc_id", "source", X.word_count(F.col("text")).alias("n"), (X.md5_mod(F.col("text"), 50) == 0).alias("heldout"))
    r = F.row_number().over(W.partitionBy("source", "heldout").orderBy("doc_id"))
    k = t.withColumn("r", r).where(F.col("r") <= F.when(F.col("heldout"), 20).otherwise(300))
    return k.groupBy("source", "heldout").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_words"))


@query(
    "shuffled_shards",
    "SELECT doc_id, row_number() OVER (ORDER BY md5('1234|shuffle|' || doc_id), doc_id) - 1 AS pair_id, CAST((row_number() OVER (ORDER BY md5('1234|shuffle|' || doc_id), doc_id) - 1) // 256 AS BIGINT) AS shard FROM documents",
)
def shuffled_shards(spark: SparkSession, d: str) -> DataFrame:
    """A full shuffle with dense ids and shards of 256 rows, ranked by range partitions instead of one task."""
    t = table(spark, d, "documents", "doc_id").withColumn("h", O.draw("shuffle", "doc_id"))
    return O.global_rank(t, ["h", "doc_id"], "pair_id", 32).select("doc_id", "pair_id", F.floor(F.col("pair_id") / 256).alias("shard"))


@query(
    "epoch_windows",
    """WITH s AS (SELECT doc_id, doc_id // 100 AS shard FROM documents), o AS (SELECT DISTINCT shard FROM s),
    k AS (SELECT shard, (row_number() OVER (ORDER BY md5('1234|epoch 1|' || shard), shard) - 1) // 4 AS win FROM o)
    SELECT win, doc_id, row_number() OVER (PARTITION BY win ORDER BY md5('1234|rows 1|' || doc_id), doc_id) - 1 AS pos FROM s JOIN k USING (shard)""",
)
def epoch_windows(spark: SparkSession, d: str) -> DataFrame:
    """An epoch's order: shards shuffled into windows of four, rows shuffled inside each window."""
    t = table(spark, d, "documents", "doc_id").withColumn("shard", F.floor(F.col("doc_id") / 100))
    return C.epoch_windows(t, "doc_id", "shard", epoch=1, per_window=4)


@query(
    "url_hosts",
    "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n, count(DISTINCT url) AS n_urls FROM documents WHERE url IS NOT NULL GROUP BY 1 ORDER BY n DESC, host LIMIT 20",
)
def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The twenty hosts with most documents."""
    t = table(spark, d, "documents", "url").where("url is not null")
    return t.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("n_urls")).orderBy(F.desc("n"), "host").limit(20)
