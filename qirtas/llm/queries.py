"""The pN_ queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qirtas.llm import answers, languages, leaks, lookalikes, mixing, neardup, packing, residue, tokenizing, truncation
from qirtas.tables import table


def _shown(spark: SparkSession, d: str) -> DataFrame:
    """The texts of problem 1, as tbl, key, text."""
    p = table(spark, d, "passages", "pid", "text").select(F.lit("passages").alias("tbl"), F.col("pid").alias("key"), "text")
    return p.union(table(spark, d, "supervised_queries", "qid", "query").select(F.lit("supervised_queries"), "qid", "query"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that look equal and are stored differently."""
    t = _shown(spark, d)
    return lookalikes.look_alike_pairs(lookalikes.unify(t, lookalikes.word_classes(t), texts=False))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes of those records: how many keys and stored forms each has, and its least key."""
    t = _shown(spark, d)
    return lookalikes.mixed_classes(lookalikes.unify(t, lookalikes.word_classes(t), texts=False))[1].select("tbl", "least_key", "n_keys", "n_forms")


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every text with the canonical member of its class."""
    t = _shown(spark, d)
    return lookalikes.unify(t, lookalikes.word_classes(t)).select("tbl", "key", "canonical")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pairs", "pair_id", "passage", "lang").select(F.lit("pairs").alias("tbl"), F.col("pair_id").cast("string").alias("rec_id"), F.col("passage").alias("text"), "lang")
    t = t.union(table(spark, d, "passages", "pid", "text", "lang").select(F.lit("passages"), "*"))
    t = t.union(table(spark, d, "supervised_queries", "qid", "query", "lang").select(F.lit("supervised_queries"), "*"))
    return languages.label_languages(t, languages.trained(t))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of every record with a missing or wrong label or a mixed text."""
    return languages.wrong_labels(_labelled(spark, d))


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every record and stretch."""
    return _labelled(spark, d)


def _leaks(spark: SparkSession, d: str, max_edits: int) -> DataFrame:
    items = table(spark, d, "eval_items", "item_id", "text")
    p = leaks.find_leaks(table(spark, d, "pairs", "pair_id", "query", "passage"), "pair_id", ["query", "passage"], items, max_edits=max_edits)
    q = leaks.find_leaks(table(spark, d, "supervised_queries", "qid", "query"), "qid", ["query"], items, max_edits=max_edits)
    return p.select(F.lit("pairs").alias("tbl"), "*").union(q.select(F.lit("supervised_queries"), "*"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that hold an evaluation item, whole or in part: the matches that need no edit."""
    return _leaks(spark, d, 1).where("edits = 0").drop("edits")


def p4_edits(spark: SparkSession, d: str) -> DataFrame:
    """Records that hold an evaluation item, whole or in part, with up to two words replaced, inserted or left out."""
    return _leaks(spark, d, 2)


def p4_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, and into how many records."""
    return leaks.leak_report(p4_found(spark, d), table(spark, d, "eval_items"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields of pairs that hold page residue."""
    return residue.find_residue(table(spark, d, "pairs", "pair_id", "query", "passage")).select("pair_id", "field").distinct()


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by kind: all, those with residue, those of which a field is excluded as residue covers much of it, and those
    kept, which hold none."""
    pairs = table(spark, d, "pairs", "pair_id", "kind", "query", "passage")
    return residue.kept_report(pairs, residue.find_residue(pairs))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective answers of the question pairs and of the queries' positive passages."""
    pairs = table(spark, d, "pairs", "pair_id", "kind", "query", "passage", "lang").where(F.col("kind").isin("arabicaqa", "aya")).withColumn("rec_id", F.col("pair_id").cast("string"))
    passages = table(spark, d, "passages", "pid", "text", "lang")
    sq = table(spark, d, "supervised_queries", "qid", "query", "pos_pids")
    texts = pairs.select("rec_id", F.col("passage").alias("text"), "lang").union(passages)
    sent = answers.sent_judge(spark, *answers.train(texts, texts))
    p = answers.defects_of_pairs(pairs, sent).distinct()
    q = answers.defects_of_queries(sq, passages, sent)
    return p.select(F.lit("pairs").alias("tbl"), "rec_id", F.lit("").alias("pid"), "defect").union(q.select(F.lit("supervised_queries"), "rec_id", "pid", "defect"))


def p6_types(spark: SparkSession, d: str) -> DataFrame:
    """Defects by table, question type and kind of defect."""
    types = table(spark, d, "supervised_queries", "qid", "qtype").dropDuplicates(["qid"]).withColumnRenamed("qid", "rec_id")
    return p6_found(spark, d).join(types, "rec_id", "left").groupBy("tbl", F.coalesce("qtype", F.lit("")).alias("qtype"), "defect").agg(F.count(F.lit(1)).alias("n"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizing.encode_documents(table(spark, d, "documents", "doc_id", "text"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "pack_sizes"))


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    """The container of every piece of every document, for each capacity."""
    return _packed(spark, d)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    sq = table(spark, d, "supervised_queries", "qid", "source", "is_human")
    pairs = table(spark, d, "pairs", "pair_id", "kind", "source")
    # a qid starts with its source, which fills in where the source is null
    by_source = (sq, F.col("qid"), F.coalesce(mixing.clean_source(F.col("source")), mixing.clean_source(F.substring_index("qid", ":", 1))))
    return mixing.mixtures(table(spark, d, "mix_targets"), {"supervised": by_source, "human_share": by_source, "weak_pairs": (pairs, F.col("pair_id"), mixing.pair_source())})


def p3_mix(spark: SparkSession, d: str) -> DataFrame:
    """The records of each mixture and how often each is used."""
    return _mixed(spark, d)


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(_mixed(spark, d))


def _near(spark: SparkSession, d: str) -> neardup.Near:
    return neardup.near_duplicates(table(spark, d, "pairs", "pair_id", "query", "passage"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of near-duplicate rows of pairs."""
    return neardup.all_pairs(_near(spark, d))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per pair: its class of equal records, its links and its group."""
    return neardup.groups(table(spark, d, "pairs", "pair_id"), _near(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return truncation.score(table(spark, d, "documents", "doc_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were cut."""
    return _scored(spark, d).where(F.col("score") >= truncation.THRESHOLD).select("doc_id").distinct()


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.cut_report(table(spark, d, "documents", "doc_id", "source"), _scored(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_classes": p1_classes,
        "p1_canonical": p1_canonical,
        "p2_found": p2_found,
        "p2_labels": p2_labels,
        "p3_mix": p3_mix,
        "p3_shares": p3_shares,
        "p4_found": p4_found,
        "p4_edits": p4_edits,
        "p4_items": p4_items,
        "p5_found": p5_found,
        "p5_kept": p5_kept,
        "p6_found": p6_found,
        "p6_types": p6_types,
        "p7_found": p7_found,
        "p7_groups": p7_groups,
        "p8_ids": p8_ids,
        "p9_pack": p9_pack,
        "p9_fill": p9_fill,
        "p10_found": p10_found,
        "p10_sources": p10_sources,
    }


def _words_sql(c: str) -> str:
    return f"regexp_extract_all(lower(regexp_replace(coalesce({c}, ''), '[\\p{{Mn}}\\p{{Mc}}\\p{{Cf}}\\x{{640}}]+', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"


#: All pairs that share a three-word run, by an equi join on the runs: fine for small tables only.
P7_SQL = f"""
    WITH W AS (SELECT pair_id, {_words_sql("query")} || {_words_sql("passage")} AS w FROM pairs WHERE passage IS NOT NULL AND len({_words_sql("passage")}) >= 20),
    S AS (SELECT DISTINCT pair_id, unnest(list_transform(range(1, len(w) - 1), lambda i: hash(w[i:i+2]))) AS h FROM W),
    N AS (SELECT pair_id, count(*) AS n FROM S GROUP BY 1),
    C AS (SELECT a.pair_id AS pair_a, b.pair_id AS pair_b, count(*) AS c FROM S a JOIN S b ON a.h = b.h AND a.pair_id < b.pair_id GROUP BY ALL)
    SELECT pair_a, pair_b FROM C JOIN N x ON x.pair_id = pair_a JOIN N y ON y.pair_id = pair_b WHERE c / (x.n + y.n - c) >= 0.6"""
#: The apportionment while a block is one record and all records fit one shard (under 20,000 draws).
P3_SQL = """
    WITH R AS (SELECT DISTINCT 'sq' AS t, qid AS id, coalesce(lower(trim(source)), lower(trim(split_part(qid, ':', 1)))) AS source, is_human FROM supervised_queries
               UNION SELECT 'pairs', CAST(pair_id AS VARCHAR), CASE kind WHEN 'wiki_lead' THEN 'wiki' WHEN 'wiki_section' THEN 'wiki' WHEN 'xlsum_title' THEN 'xlsum' WHEN 'xlsum_summary' THEN 'xlsum' WHEN 'arabicaqa' THEN 'qa' WHEN 'aya' THEN 'qa' ELSE kind END, NULL FROM pairs),
    T AS (SELECT *, row_number() OVER (PARTITION BY mix_name ORDER BY coalesce(source, ''), CASE WHEN is_human IS NULL THEN 'None' WHEN is_human THEN 'True' ELSE 'False' END) AS i FROM mix_targets),
    M AS (SELECT mix_name, id, min(i) AS i FROM R JOIN T ON t = CASE WHEN mix_name = 'weak_pairs' THEN 'pairs' ELSE 'sq' END AND (T.source IS NULL OR T.source = R.source) AND (T.is_human IS NULL OR T.is_human = R.is_human) GROUP BY ALL),
    H AS (SELECT T.*, count(id) AS have FROM T JOIN M USING (mix_name, i) GROUP BY ALL),
    S AS (SELECT mix_name, CAST(floor(min(have * max_repeats * (SELECT sum(target_share) FROM H AS other WHERE other.mix_name = H.mix_name) / target_share) + 1e-9) AS BIGINT) AS total FROM H GROUP BY mix_name),
    Q AS (SELECT mix_name, i, row_number() OVER (PARTITION BY mix_name ORDER BY target_share / (2 * k + 1) DESC, i) AS r FROM (SELECT *, unnest(range(0, have * max_repeats)) AS k FROM H)),
    G AS (SELECT mix_name, i, count(*) AS n_drawn FROM Q JOIN S USING (mix_name) WHERE r <= total GROUP BY ALL)
    SELECT mix_name, source, is_human, target_share, max_repeats, least(have, n_drawn) AS n_records, n_drawn, CAST(ceil(n_drawn / have) AS INTEGER) AS most_copies,
           round(n_drawn / sum(n_drawn) OVER (PARTITION BY mix_name), 6) AS actual_share FROM G JOIN H USING (mix_name, i)"""


def oracle_sql() -> dict[str, str]:
    return {"p3_shares": P3_SQL, "p7_found": P7_SQL}
