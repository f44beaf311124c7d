"""Visually identical text with different characters (problem 1).

Characters that are drawn alike are mapped onto one (blanks, widths, Arabic presentation forms, Latin look-alikes of
other scripts, and the Arabic letters that share a shape at their place in the word). The mapped words of all texts are
grouped in SQL under the accent-sensitive Unicode collation, which takes canonically equal spellings (combining accents)
together and passes over characters that are not drawn. Each class gets a canonical member, which is joined back in SQL:
a text's common form is its words' canonical members with single blanks.

The collation also passes over characters that a reader does see: the joiners between the letters of Persian and other
words, cantillation and enclosing marks and the like. Which ones is asked from the collation itself. In the key that is
grouped these stand as characters of private use, which it tells apart; its classes need no further division then.

The canonical member is the plain word of a class (composed, nothing in it that is not drawn) if there is one. So only
words that are not plain can change, and only these are joined with the classes, by record number and place; all other
words stay where they lie, whatever the size of the vocabulary. The collation sees each distinct word once, not each
text. Records are then compared by 128-bit hashes of their common forms, so no text is shuffled to find pairs, and
classes of many records are paired in tiles.

Defined results: null texts and texts without a visible character keep themselves and are never paired; a key that
arrives again with the same text counts once; ties of the canonical member go to the word of the fewest bytes, then to
the least in binary order; whole texts are compared.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qirtas.lineage import written

#: Letters of other scripts drawn like Latin ones (fixed values).
CYRILLIC = {"А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w"}
GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o"}
HYPHENS = {"‐": "-", "‑": "-"}
#: Characters that are not drawn (fixed values); the zero-width joiners are drawn between letters and stay.
UNSEEN = "­͏؜᠎​‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"


#: Records of one class that are paired by one task with the others of the class.
TILE = 4096
#: Drawn characters that the collation passes over stand in the key as characters of private use from here on.
PRIVATE = 0xF0000


def one_to_one() -> dict[str, str]:
    """Full- and half-width forms and Arabic presentation forms, by rule, and the tables above."""
    pairs = CYRILLIC | GREEK | HYPHENS
    for c in [*range(0xFF01, 0xFFEF), *range(0xFB50, 0xFDFC), *range(0xFE80, 0xFEFD)]:
        to = unicodedata.normalize("NFKC", chr(c))
        if to != chr(c) and " " not in to:
            pairs[chr(c)] = to
    return pairs


#: Two Arabic letters are drawn like their Persian relatives where they join to the next letter; at the end of a word
#: the Persian yeh is drawn like the dotless one. (fixed values)
INNER_YEH, INNER_KAF, FINAL_YEH = "ي", "ك", "ى"
_TABLE = str.maketrans(one_to_one())
_MAPPED = re.compile("[" + "".join(map(re.escape, one_to_one())) + "]")
_JOINS = rf"(?=[\p{{Mn}}{UNSEEN}]*[\p{{Arabic}}--[\u0621\u0600-\u061f]&&\p{{L}}])"
_YEH, _KAF = (regex.compile(c + _JOINS, regex.V1) for c in "یک")
_DRAWN = regex.compile(r"[^\p{Cf}\p{Cc}\p{Zs}\s]")
_IDLE_JOINER = regex.compile(r"(?<![\p{L}\p{M}])[\u200c\u200d]+|[\u200c\u200d]+(?![\p{L}\p{M}\p{So}])")
_UNSEEN = regex.compile(rf"[{UNSEEN}\p{{Cc}}]+")
# the standard library tests a large class of characters by a bitmap, several times faster
_MARK = "[" + "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c)[0] == "M") + "]"
_MARKS = re.compile(_MARK + _MARK)


def mapped_words(text: str) -> list[str]:
    """The look-alike-mapped words of a text; words of which nothing is drawn are left out."""
    if _MAPPED.search(text):
        text = text.translate(_TABLE)
    if "ی" in text:
        text = _YEH.sub(INNER_YEH, text).replace("ی", FINAL_YEH)
    if "ک" in text:
        text = _KAF.sub(INNER_KAF, text)
    words = text.split()
    if not text.isprintable():
        words = [w for w in words if w.isprintable() or _DRAWN.search(w)]
    if _MARKS.search(text):  # the collation expects several marks on one letter in canonical order
        words = [unicodedata.normalize("NFC", w) if _MARKS.search(w) else w for w in words]
    return words


def plain(word: str) -> str:
    """The plain spelling of a mapped word: composed, without what is not drawn."""
    return unicodedata.normalize("NFC", _IDLE_JOINER.sub("", _UNSEEN.sub("", word)))


def passed_over(spark: SparkSession) -> str:
    """The drawn characters that the collation passes over, asked from the collation itself: of all characters but
    ideographs those without which a word stays the same to it. Their number is Unicode's, whatever the data."""
    drawn = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs", "Cc", "Zs", "Zl", "Zp") and not "\uac00" <= chr(c) <= "\ud7a3" and not 0x3400 <= c < 0xA000 and c < 0xE1000]
    drawn = [c for c in drawn if not _UNSEEN.match(c)]
    d = spark.createDataFrame([("".join(drawn),)], "s string").select(F.explode(F.split("s", "")).alias("c")).where("c <> ''")
    return "".join(sorted(r.c for r in d.where("concat('a', c, 'b') COLLATE UNICODE = 'ab' COLLATE UNICODE").collect()))


def collation_key(word: str, seen: re.Pattern) -> str:
    """What the collation groups: the word with the drawn characters that it passes over made visible to it. Joiners that
    join nothing go, as they are not drawn."""
    return seen.sub(lambda m: chr(PRIVATE + (ord(m.group()) & 0xFFFF)), _IDLE_JOINER.sub("", _UNSEEN.sub("", word)))


def is_plain(word: str) -> bool:
    return word.isascii() and word.isprintable() or plain(word) == word


VOCABULARY = "w string, k string, odd boolean"


def vocabulary(texts: DataFrame, passed: str) -> DataFrame:
    """``w, k, odd``: the distinct mapped words of ``texts(text)``, what the collation groups, and whether they are not
    plain. ``passed`` are the drawn characters that the collation passes over."""
    pattern = "[" + re.escape(passed) + "]" if passed else "(?!)"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[str] = set()
        seen = re.compile(pattern)
        for batch in batches:
            now: set[str] = set()
            for t in batch.column(0).to_pylist():
                if t:
                    now.update(mapped_words(t))
            now -= sent
            if len(sent) > 200_000:
                sent.clear()
            sent |= now
            words = list(now)
            odd = [not is_plain(w) for w in words]
            keys = [w if w.isascii() and not o else collation_key(w, seen) for w, o in zip(words, odd)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(keys, pa.string()), pa.array(odd, pa.bool_())], names=["w", "k", "odd"])

    return texts.select("text").mapInArrow(run, VOCABULARY).distinct()


def word_classes(texts: DataFrame) -> DataFrame:
    """``w, canonical``: the mapped words whose canonical member is another word."""
    spark = texts.sparkSession
    name = f"words_{uuid.uuid4().hex}"
    written(vocabulary(texts, passed_over(spark)), "words").createOrReplaceTempView(name)
    out = spark.sql(f"""
        WITH classes AS (
            SELECT min(k) AS member, min_by(w, struct(odd, octet_length(w), w)) AS canonical
            FROM {name} GROUP BY k COLLATE UNICODE HAVING count(*) > 1)
        SELECT w, canonical FROM {name} JOIN classes ON k COLLATE UNICODE = member COLLATE UNICODE
        WHERE odd AND w <> canonical""")
    out = written(out, "classes")
    spark.catalog.dropTempView(name)
    return out


def unify(records: DataFrame, classes: DataFrame, texts: bool = True) -> DataFrame:
    """``tbl, key, stored binary, shown binary`` and, with ``texts``, ``canonical``: every record's common form, with
    128-bit hashes of the stored text and of the common form (null where nothing is drawn)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        known: dict[str, bool] = {}
        digest = lambda t: hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()
        for batch in batches:
            stored, shown, canonical, words, odd = [], [], [], [], []
            for t in batch.column(2).to_pylist():
                own = mapped_words(t) if t else []
                places = []
                for i, w in enumerate(own):
                    if w not in known:
                        if len(known) > 400_000:
                            known.clear()
                        known[w] = is_plain(w)
                    if not known[w]:
                        places.append(i)
                form = " ".join(own)
                stored.append(None if t is None else digest(t))
                shown.append(digest(form) if own else None)
                canonical.append((form if own else t) if texts else None)
                words.append(own if places else None)
                odd.append(places if places else None)
            rid = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([rid, batch.column(0), batch.column(1), pa.array(stored, pa.binary()), pa.array(shown, pa.binary()), pa.array(canonical, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(odd, pa.list_(pa.int32()))], names=["rid", "tbl", "key", "stored", "shown", "canonical", "words", "odd"])

    d = records.select("tbl", "key", "text").mapInArrow(run, "rid long, tbl string, key string, stored binary, shown binary, canonical string, words array<string>, odd array<int>")
    d = written(d, "mapped")  # the record numbers hold from here on
    places = d.where("odd is not null").select("rid", "words", F.explode("odd").alias("pos")).select("rid", "pos", F.col("words")[F.col("pos")].alias("w"))
    changes = places.join(classes.withColumnRenamed("canonical", "to"), "w").groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("pos", "to"))).alias("to"))
    form = F.array_join(F.transform("words", lambda w, i: F.coalesce(F.element_at("to", i), w)), " ")
    changed = d.where("odd is not null").select("rid", "words").join(changes, "rid").select("rid", form.alias("form"))
    d = d.drop("words", "odd").join(changed, "rid", "left")
    out = d.select("tbl", "key", "stored", F.coalesce(F.unhex(F.md5("form")), "shown").alias("shown"), F.coalesce("form", "canonical").alias("canonical"))
    return out if texts else out.drop("canonical")


def mixed_classes(unified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct ``tbl, key, stored, shown``, and the classes of records of one table that only the common form makes
    equal: ``tbl, shown, n_keys, n_forms, least_key``, ``n_keys`` counting a key with each of its texts."""
    d = written(unified.where("shown is not null and key is not null").select("tbl", "key", "stored", "shown").distinct(), "shown")
    forms = d.groupBy("tbl", "shown", "stored").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    classes = forms.groupBy("tbl", "shown").agg(F.sum("n").alias("n_keys"), F.count(F.lit(1)).alias("n_forms"), F.min("least").alias("least_key"))
    return d, classes.where("n_forms > 1")


def look_alike_pairs(unified: DataFrame, tile: int = TILE) -> DataFrame:
    """``tbl, key_a, key_b``: records of one table that only the common form makes equal, key_a < key_b. A class of many
    records is dealt to tiles, so that one task pairs at most about ``tile`` of them with the others."""
    d, classes = mixed_classes(unified)
    d = d.join(classes.select("tbl", "shown", F.ceil(F.col("n_keys") / tile).alias("tiles")), ["tbl", "shown"])
    x = d.withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles"))).select("tbl", "shown", "tile", F.col("key").alias("key_a"), F.col("stored").alias("a"))
    y = d.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select("tbl", "shown", "tile", F.col("key").alias("key_b"), F.col("stored").alias("b"))
    return y.join(x, ["tbl", "shown", "tile"]).where("a <> b and key_a < key_b").select("tbl", "key_a", "key_b").distinct()
