"""Operators of the corpus stage: filters, probes, planning, packing."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qirtas.functions import ordering as O
from qirtas.functions import text as X
from qirtas.lineage import written


def corpus_facts(docs: DataFrame, key: str = "doc_id", least_chars: int = 100, least_tokens: int = 32, least_share: float = 0.5) -> DataFrame:
    """``key, source, hash, reason``: what one document tells by itself, without its text: a hash, and short, few tokens,
    not Arabic or null."""
    t = F.coalesce("text", F.lit(""))
    reason = F.when(F.length(X.strip(t)) < least_chars, "short").when(X.token_count(t) < least_tokens, "few tokens").when(X.arabic_share(t) < least_share, "not Arabic")
    return docs.select(key, "source", X.md5_hex(t).alias("hash"), reason.alias("reason"))


def corpus_cascade(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, source, reason`` of every document: duplicate (not the first copy by key), or ``corpus_facts``' reason."""
    d = written(corpus_facts(docs, key), "facts")
    first = d.groupBy("hash").agg(F.min(key).alias("_first"))
    return d.join(first, "hash").select(key, "source", F.when(F.col(key) != F.col("_first"), "duplicate").otherwise(F.col("reason")).alias("reason"))


def corpus_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``source, n_in, n_duplicate, n_short, n_few_tokens, n_not_arabic, n_kept`` with a total row. Each hash keeps the
    source and reason of its first copy, combined before the shuffle; what is in and no first copy is a duplicate."""
    least = F.min(F.struct(key, "source", "reason")).alias("f")
    first = corpus_facts(docs, key).groupBy("hash", F.col("source").alias("of")).agg(least, F.count(F.lit(1)).alias("n"))
    first = first.withColumn("is_first", F.col("f") == F.min("f").over(W.partitionBy("hash")))  # at most one row per hash and source
    own = lambda r: F.count_if(F.col("is_first") & (F.col("f.reason").isNull() if r is None else F.col("f.reason") == r))
    g = first.rollup("of").agg(F.sum("n").alias("n_in"), (F.sum("n") - F.count_if("is_first")).alias("n_duplicate"), own("short").alias("n_short"), own("few tokens").alias("n_few_tokens"), own("not Arabic").alias("n_not_arabic"), own(None).alias("n_kept"))
    return g.withColumn("source", F.coalesce("of", F.lit("(all)"))).drop("of")


def word_starts(docs: DataFrame, key: str, text: Column, ratio: float) -> DataFrame:
    """``key, arabic, latin, kept``: how many words begin with a letter of either script (signs before it aside)."""
    start = rf"(^|[{X.BLANK}])[^\p{{L}}\p{{N}}{X.BLANK}]*"
    n = lambda letter: F.regexp_count(text, F.lit(start + letter)).cast("long")
    d = docs.select(key, n(X.ARABIC_LETTER).alias("arabic"), n(X.LATIN_LETTER).alias("latin"))
    both = F.col("arabic") + F.col("latin")
    return d.withColumn("kept", ~((both > 0) & (F.col("arabic") < ratio * both)))


def pre_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"\n|\p{{Nd}}|[\p{{P}}\p{{S}}]+|[^\p{{Nd}}\p{{P}}\p{{S}}{X.BLANK}]+"), 0)


def quota_scan(docs: DataFrame, shard: str, order: str, quota: int) -> DataFrame:
    """Rows of each shard up to and including its ``quota``-th training row; ``heldout`` rows don't count. Only shards,
    orders and flags are summed; what is taken is joined back."""
    own = F.when(F.col("heldout"), 0).otherwise(1).cast("long")
    seen = O.group_sum(docs.select(shard, order, "heldout"), [shard], [order], own, "_seen", 32).where(F.col("_seen") < quota)
    taken = seen.select(F.col(shard).alias("_s"), F.col(order).alias("_o"))
    return docs.join(taken, F.col(shard).eqNullSafe(F.col("_s")) & (F.col(order) == F.col("_o"))).drop("_s", "_o")


def vocabulary_fingerprint(vocabulary: DataFrame, c: str) -> DataFrame:
    """Size and short hash of a sorted vocabulary (its size has a bound of its own)."""
    g = vocabulary.agg(F.count(F.lit(1)).alias("n_chars"), F.array_sort(F.collect_list(c)).alias("v"))
    return g.select("n_chars", F.substring(F.sha2(F.array_join("v", "\n"), 256), 1, 16).alias("fingerprint"))


def keyword_soup(docs: DataFrame, key: str, text: Column, limit: float) -> DataFrame:
    """``key, repeated``: documents whose repeated trigrams are more than ``limit`` of all."""
    g = docs.select(key, F.explode(X.ngrams(X.words(text), 3)).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias("n"))
    s = g.groupBy(key).agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("repeated"))
    return s.where(F.col("repeated") > limit)


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, i, line``: lines that stand as headings."""
    lines = F.split(text, "\n")
    d = docs.select(key, F.posexplode(F.transform(lines, lambda x, i: F.struct(x.alias("raw"), F.when(i > 0, F.get(lines, i - 1)).alias("prev"), F.get(lines, i + 1).alias("next")))).alias("i", "l"))
    line = X.strip(F.col("l.raw"))
    blank = lambda c: F.coalesce(X.strip(F.col(c)) == "", F.lit(True))
    ok = (line != "") & (X.word_count(line) <= 10) & (F.length(line) <= 80) & ~line.rlike("[.!?؟،,;؛:]$") & (F.endswith(F.col("l.raw"), F.lit(" ")) | (blank("l.prev") & blank("l.next")))
    return d.where(ok).select(key, "i", line.alias("line"))


#: Headings that end an article's text (fixed values).
END_HEADINGS = (
    "مراجع", "المراجع", "مصادر", "المصادر", "انظر أيضا", "انظر أيضًا", "انظر أيضاً", "وصلات خارجية", "روابط خارجية",
    "هوامش", "الهوامش", "ملاحظات", "الملاحظات", "قراءات إضافية", "قراءات أخرى", "مراجع وهوامش", "المراجع والهوامش",
    "مصادر ومراجع", "المصادر والمراجع", "الملاحظات والمراجع", "المراجع والملاحظات", "ملاحظات ومراجع",
    "مصادر وحواشي", "حواشي", "وصلات", "ببليوغرافيا", "بيبليوغرافيا", "معرض الصور", "معرض صور",
)


def plain_form(line: str) -> str:
    """A heading without vowel marks and stretching, with one alef and single blanks."""
    bare = "".join(c for c in line if c != "ـ" and unicodedata.category(c) not in ("Mn", "Cf"))
    return " ".join(bare.translate(str.maketrans(*X.ALEFS)).split())


_ENDS = frozenset(map(plain_form, END_HEADINGS))


def sections(text: str) -> list[tuple[str | None, list[str]]]:
    """Lead (heading None) and sections of an article; a heading counts once something stands before it, or where it is
    marked with equals signs."""
    lines = text.split("\n")
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    for i, raw in enumerate(lines):
        line = raw.strip()
        if not line:
            continue
        marked = line.startswith("==")
        alone = (i == 0 or not lines[i - 1].strip()) and (i + 1 == len(lines) or not lines[i + 1].strip())
        plain = len(line.split()) <= 10 and len(line) <= 80 and line[-1] not in ".!?؟،,;؛:" and (raw.endswith(" ") or alone)
        if (out[0][1] or len(out) > 1) and (marked or plain):
            name = line.strip("= ").strip()
            if plain_form(name) in _ENDS:
                break
            out.append((name, []))
        else:
            out[-1][1].append(line)
    return out


def wiki_pairs(docs: DataFrame, key: str, title: str, text: str, least_words: int = 20, most_chars: int = 3000) -> DataFrame:
    """``key, kind, query, passage``: title with lead and title plus heading with section, prose lines only; articles
    that only list meanings of their title are passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, name, body in zip(pdf[key], pdf["_title"], pdf["_text"]):
                name = (name or "").strip()
                if not name or not body or "(توضيح)" in name:
                    continue
                for heading, lines in sections(body):
                    prose = [x for x in lines if len(x.split()) >= 12 or x[-1] in '.!?؟:؛…»")']
                    passage = "\n".join(prose)[:most_chars]
                    if len(passage.split()) >= least_words:
                        rows.append((k, "wiki_lead" if heading is None else "wiki_section", name if heading is None else f"{name} {heading}", passage))
            yield pd.DataFrame(rows, columns=[key, "kind", "query", "passage"])

    d = docs.select(key, F.col(title).alias("_title"), F.col(text).alias("_text"))
    return d.mapInPandas(run, f"{key} {d.schema[0].dataType.simpleString()}, kind string, query string, passage string")


def pack(rows: DataFrame, unit: str, order: str, ids: str, length: int, cls: int, sep: int, end: int) -> DataFrame:
    """``unit, seq, ids``: each unit's token lists in order, every list closed by ``sep``, cut into bodies of
    ``length - 2`` between ``cls`` and ``end``; a unit's last incomplete body is dropped.

    Only units, orders and lengths are ordered, over ranges and not by one task a unit; a list's offset then is joined
    to it, it is cut where it lies, and the pieces of a sequence meet in one group of at most ``length`` tokens."""
    body = length - 2
    d = rows.select(unit, order, F.array_append(ids, sep).alias("ids"))
    n = F.size("ids")
    sums = written(O.global_sum(d.select(unit, order, n.cast("long").alias("n")), [unit, order], F.col("n"), "before"), "offsets")
    start = sums.groupBy(unit).agg(F.min("before").alias("start"))
    at = sums.join(start, unit).select(F.col(unit).alias("_u"), F.col(order).alias("_o"), (F.col("before") - F.col("start")).alias("at"))
    d = d.join(at, (F.col(unit).eqNullSafe(F.col("_u"))) & (F.col(order) == F.col("_o"))).drop("_u", "_o")
    first, last = F.floor(F.col("at") / body), F.floor((F.col("at") + n - 1) / body)
    d = d.select(unit, "at", "ids", F.explode(F.sequence(first, last)).alias("seq"))
    lo = F.greatest(F.col("seq") * body - F.col("at"), F.lit(0))
    hi = F.least((F.col("seq") + 1) * body - F.col("at"), F.size("ids").cast("long"))
    piece = F.struct(F.col("at"), F.slice("ids", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("ids"))
    g = d.select(unit, "seq", piece.alias("p")).groupBy(unit, "seq").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["ids"])).alias("b"))
    return g.where(F.size("b") == body).select(unit, "seq", F.concat(F.array(F.lit(cls)), "b", F.array(F.lit(end))).alias("ids"))


def mask_kind(row: str, place: str, share: float = 0.3) -> Column:
    """kept, mask, random or same for each token, by hash of its row and place."""
    u = O.uniform("kind", F.col(row).cast("string"), F.col(place).cast("string"))
    return F.when(O.uniform("mask", F.col(row).cast("string"), F.col(place).cast("string")) >= share, "kept").when(u < 0.8, "mask").when(u < 0.9, "random").otherwise("same")


def budget_prefix(files: DataFrame, source: str, size: str, order: Column, tie: str, budget: int) -> DataFrame:
    """Files of each source in ``order`` while what is planned before them is below the budget; the last may overshoot."""
    w = W.partitionBy(source).orderBy(order, tie).rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("before") < budget)


def row_ranges(counts: DataFrame, name: str, n: str, size: int) -> DataFrame:
    """``name, first_row, end_row``: ranges of ``size`` rows."""
    d = counts.where(F.col(n) > 0).select(name, n, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(size).cast("long"))).alias("first_row"))
    return d.select(name, "first_row", F.least(F.col("first_row") + size, F.col(n)).alias("end_row"))


def epoch_windows(rows: DataFrame, key: str, shard: str, epoch: int, per_window: int) -> DataFrame:
    """``win, key, pos``: the resumable order of an epoch; resuming is a filter on (win, pos)."""
    s = rows.select(shard).distinct().withColumn("_h", O.draw(f"epoch {epoch}", F.col(shard).cast("string")))
    k = O.global_rank(s, ["_h", shard], "_r", 16).select(shard, F.floor(F.col("_r") / per_window).alias("win"))
    pos = F.row_number().over(W.partitionBy("win").orderBy(O.draw(f"rows {epoch}", F.col(key).cast("string")), key)) - 1
    return rows.join(k, shard).select("win", key, pos.cast("long").alias("pos"))
