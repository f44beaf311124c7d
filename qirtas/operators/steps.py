"""Row filters: a step and a reason for every removal, the first reason wins, later steps see only what is alive."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qirtas.functions import ordering as O
from qirtas.functions import text as X
from qirtas.lineage import checkpoint_root, written

#: Titles that say nothing of their text (fixed values).
BOILERPLATE = (
    "اتصل بنا", "اتصل بنا الان", "الرئيسية", "الصفحة الرئيسية", "الرئيسة", "من نحن", "عن الموقع", "عن الشركة",
    "سياسة الخصوصية", "شروط الاستخدام", "اتفاقية الاستخدام", "الشروط والاحكام", "خريطة الموقع", "تسجيل الدخول",
    "تسجيل دخول", "انشاء حساب", "اعلن معنا", "اعلن هنا", "للاعلان", "المزيد", "اقرا المزيد", "اقرا ايضا",
    "شاهد ايضا", "تابعنا", "تابعونا", "جميع الحقوق محفوظة", "حقوق النشر", "الارشيف", "بحث", "القائمة", "روابط",
    "روابط سريعة", "النشرة البريدية", "اشترك", "مقالات ذات صلة", "مواضيع ذات صلة", "اخبار ذات صلة", "تعليقات",
    "التعليقات", "اضف تعليق", "اترك تعليقا", "الاكثر قراءة", "الاكثر مشاهدة", "اخر الاخبار", "احدث الاخبار",
    "اخبار عاجلة", "عاجل", "صور", "فيديو", "مشاركة", "شارك", "طباعة", "مراجع", "المراجع", "وصلات خارجية",
    "انظر ايضا", "الاسئلة الشائعة",
)


def clean_pairs(pairs: DataFrame) -> DataFrame:
    """``pair_id, source, kind, query, passage`` cleaned, with token counts and normalized texts."""
    d = pairs.select("pair_id", "source", "kind", X.clean(F.col("query")).alias("query"), X.clean(F.col("passage")).alias("passage"))
    d = d.withColumns({"q_tokens": X.token_count(F.col("query")), "p_tokens": X.token_count(F.col("passage"))})
    return d.withColumns({"q_norm": X.normalize(F.col("query")), "p_norm": X.normalize(F.col("passage"))})


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once however often it is used later (a plain projection is merged into
    the ones above it and computed for every use)."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def first_reason(step: str, *reasons: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("struct<step:string,reason:string>")
    for condition, reason in reversed(reasons):
        out = F.when(condition, F.struct(F.lit(step).alias("step"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def decided_pairs(pairs: DataFrame, query: int = 3, passage: int = 20, share: float = 0.7, repeats: int = 5, alike: float = 0.8) -> DataFrame:
    """``pair_id, source, kind, step, reason``: the filter chain (cleanup, length, language, junk, near_identical, dedupe)
    over ``pairs(pair_id, source, kind, query, passage)``; step and reason are null for rows that are kept.

    The steps that look at one row only are decided where it lies. What then is written and joined are ids, reasons and
    128-bit hashes, never texts; repeated queries are counted, and first copies found, by hash with sums that combine
    before the shuffle."""
    d = pairs.select("pair_id", "source", "kind", "query", "passage")
    d = once(d, q=X.clean(F.col("query")), p=X.clean(F.col("passage"))).drop("query", "passage")
    d = once(d, qn=X.normalize(F.col("q")), pn=X.normalize(F.col("p")), qt=X.token_count(F.col("q")), pt=X.token_count(F.col("p"))).drop("q", "p")
    early = F.coalesce(
        first_reason("cleanup", ((F.col("qt") <= 0) | (F.col("pt") <= 0), "empty after cleanup")),
        first_reason("length", (F.col("qt") < query, f"query < {query} tokens"), (F.col("pt") < passage, f"passage < {passage} tokens")),
        first_reason("language", (X.arabic_share(F.col("qn")) < share, "query not Arabic"), (X.arabic_share(F.col("pn")) < share, "passage not Arabic")),
    )
    d = once(d, early=early, key=X.query_key(F.col("qn")))
    alive = F.col("early").isNull()
    late = F.when(alive, first_reason("near_identical", (X.word_jaccard(F.col("qn"), F.col("pn")) > alike, f"query and passage alike (word Jaccard > {alike})")))
    d = d.select(
        "pair_id", "source", "kind", F.coalesce("early", F.when(F.col("key").isin(*BOILERPLATE), F.struct(F.lit("junk").alias("step"), F.lit("boilerplate title").alias("reason")))).alias("early"), late.alias("late"),
        F.when(alive, F.unhex(F.md5("key"))).alias("key"), F.when(alive, F.unhex(F.md5(F.concat(F.col("qn"), F.lit("\x1f"), F.col("pn"))))).alias("pair"),
    )
    d = written(d, "decided")
    many = d.where("key is not null and source is not null").groupBy("source", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > repeats).select("source", "key", F.lit(True).alias("many"))
    d = d.join(many, ["source", "key"], "left")
    d = d.withColumn("early", F.coalesce("early", first_reason("junk", (F.col("many"), f"query text > {repeats} times in the source")), "late"))
    first = d.where("early is null").groupBy("pair").agg(F.min("pair_id").alias("first"))
    d = d.join(first, "pair", "left")
    why = F.coalesce("early", first_reason("dedupe", (F.col("pair_id") != F.col("first"), "duplicate pair")))
    return d.select("pair_id", "source", "kind", why.alias("why")).select("pair_id", "source", "kind", "why.step", "why.reason")


def step_stats(df: DataFrame, log: DataFrame, steps: list[str]) -> DataFrame:
    """``step, n_in, n_out, n_removed`` in step order; ``n_in = n_out + n_removed`` by construction."""
    n = log.groupBy("step").agg(F.count(F.lit(1)).alias("n_removed"))
    order = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(steps)], "ord int, step string")
    d = order.join(F.broadcast(n), "step", "left").select("ord", "step", F.coalesce("n_removed", F.lit(0)).alias("n_removed"))
    total = df.count()
    before = F.coalesce(F.sum("n_removed").over(W.orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("n_in", F.lit(total) - before)
    return d.select("step", "n_in", (F.col("n_in") - F.col("n_removed")).alias("n_out"), "n_removed")


def funnel(df: DataFrame, log: DataFrame, steps: list[str]) -> DataFrame:
    """``source, n_raw, <step>..., n_left`` with a total row."""
    raw = df.rollup("source").agg(F.count(F.lit(1)).alias("n_raw")).select(F.coalesce("source", F.lit("(all)")).alias("source"), "n_raw")
    gone = log.rollup("source").agg(*(F.count_if(F.col("step") == s).alias(s) for s in steps)).select(F.coalesce("source", F.lit("(all)")).alias("source"), *steps)
    d = raw.join(gone, "source", "left").select("source", "n_raw", *(F.coalesce(s, F.lit(0)).alias(s) for s in steps))
    return d.withColumn("n_left", F.col("n_raw") - sum((F.col(s) for s in steps), F.lit(0)))


def removal_sample(log: DataFrame, key: str, n: int = 30) -> DataFrame:
    """At most ``n`` drawn removals of each step and reason."""
    return O.first_n(log, n, ["step", "reason"], [O.draw("removed", "step", "reason", F.col(key).cast("string")), key])


# -- cached steps -------------------------------------------------------------------------------------------------------


def fingerprint(previous: str, stats: dict, settings: dict) -> str:
    """A step's fingerprint chains the one before with its stats and the step's own settings."""
    return hashlib.sha256(json.dumps([previous, stats, settings], sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def cached_step(spark: SparkSession, name: str, print_: str, build: Callable[[], DataFrame], folder: str | None = None) -> tuple[DataFrame, bool]:
    """The step's table under its fingerprint, built only where it is not there yet; (table, whether it was there).

    Spark's committer makes the table visible as a whole: it counts once its ``_SUCCESS`` mark exists."""
    path = f"{folder or checkpoint_root(spark)}/steps/{name}-{print_}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)
    if not there:
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path), there


def markdown_table(rows: list, columns: list[str]) -> str:
    """Rows of a small report as a Markdown table."""
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " - |" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)])
