import re
import unicodedata

from pyspark.sql import functions as F

from qirtas.llm import lookalikes as L


def frame(spark, rows):
    return spark.createDataFrame(rows, "tbl string, key string, text string")


def pairs(spark, texts):
    r = frame(spark, [("t", f"{i:03}", t) for i, t in enumerate(texts)])
    return {(x.key_a, x.key_b) for x in L.look_alike_pairs(L.unify(r, L.word_classes(r))).collect()}


def test_what_looks_equal_is_paired(spark):
    base = "مقهى Café في الأثري كل 45"
    same = [
        unicodedata.normalize("NFD", base),
        base.replace(" ", "\u00a0"),
        base.replace("مقهى", "مق​هى"),
        base.replace("45", "４５"),
        base.replace("a", "а"),
        base.replace("كل", "ﻛﻞ"),
        "  " + base.replace(" ", "  ") + "‏",
    ]
    got = pairs(spark, [base, *same])
    assert got == {(f"{i:03}", f"{j:03}") for i in range(8) for j in range(i + 1, 8)}


def test_what_a_reader_sees_is_no_case(spark):
    base = "المقهى Cafe 45"
    other = ["المقهي Cafe 45", "المقهى cafe 45", "المقهى Cafe ٤٥", "المقهـى Cafe 45", "المقهَى Cafe 45", "المقهى Cafe 45.", "المقهى Café 45", "المقهى Cafe 4 5"]
    assert pairs(spark, [base, *other]) == set()
    assert pairs(spark, ["می‌کند", "میکند"]) == set()


def test_letters_by_their_place_in_the_word(spark):
    assert pairs(spark, ["كيف", "کیف"]) == {("000", "001")}
    assert pairs(spark, ["علي", "علی"]) == set()  # at the end it is drawn without dots
    assert pairs(spark, ["على", "علی"]) == {("000", "001")}
    assert pairs(spark, ["ملك", "ملک"]) == set()


def test_order_of_marks(spark):
    assert pairs(spark, ["كلَّ", "كلَّ"]) == {("000", "001")}


def test_nulls_blanks_copies_ties_and_other_columns(spark):
    r = frame(spark, [("t", "a", None), ("t", "b", ""), ("t", "c", "​"), ("t", "d", " "), ("t", "e", "نص"), ("t", "f", "نص"), ("t", "e", "نص"), ("t", None, "نـص"), ("u", "g", "ن​ص")])
    r = r.withColumn("canonical", F.lit("clash")).withColumn("w", F.lit(1))
    u = L.unify(r, L.word_classes(r))
    assert u.count() == 9
    got = {(x.tbl, x.key): x.canonical for x in u.collect()}
    assert got[("t", "a")] is None and got[("t", "b")] == "" and got[("u", "g")] == "نص"
    assert L.look_alike_pairs(u).count() == 0  # equal texts are no case, and tables are apart
    empty = r.limit(0)
    assert L.look_alike_pairs(L.unify(empty, L.word_classes(empty))).count() == 0


def test_common_forms(spark):
    r = frame(spark, [("t", str(i), t) for i, t in enumerate(["قلم كبير", "قلم\u200b كبير", "قلم  كبير", "شيء آخر", None, "", "cafe\u0301 noir\u200b", "noir\u2060 caf\u00e9 noir"])])
    u = L.unify(r, L.word_classes(r))
    assert {x.key: x.canonical for x in u.collect()} == {"0": "قلم كبير", "1": "قلم كبير", "2": "قلم كبير", "3": "شيء آخر", "4": None, "5": "", "6": "caf\u00e9 noir", "7": "noir caf\u00e9 noir"}
    assert {(x.key_a, x.key_b) for x in L.look_alike_pairs(u).collect()} == {("0", "1"), ("0", "2"), ("1", "2")}
    assert "canonical" not in L.unify(r, L.word_classes(r), texts=False).columns


def test_rows_that_arrive_again(spark):
    r = frame(spark, [("t", "0", "قلم كبير"), ("t", "1", "قلم\u200b كبير"), ("t", "1", "قلم\u200b كبير"), ("t", None, "قلم"), ("t", None, "قلم"), ("t", "2", None), ("t", "2", None)])
    u = L.unify(r, L.word_classes(r))
    assert sorted(((x.key, x.canonical) for x in u.collect()), key=str) == sorted([("0", "قلم كبير"), ("1", "قلم كبير"), ("1", "قلم كبير"), (None, "قلم"), (None, "قلم"), ("2", None), ("2", None)], key=str)
    assert {(x.key_a, x.key_b) for x in L.look_alike_pairs(u).collect()} == {("0", "1")}
    c = [tuple(x) for x in L.mixed_classes(u)[1].select("tbl", "least_key", "n_keys", "n_forms").collect()]
    assert c == [("t", "0", 2, 2)]


def test_hot_class_in_tiles(spark):
    r = frame(spark, [("t", f"{i:03}", "قلم كبير" + "\u200b" * (i % 3)) for i in range(60)])
    u = L.unify(r, L.word_classes(r))
    want = {(f"{i:03}", f"{j:03}") for i in range(60) for j in range(i + 1, 60) if i % 3 != j % 3}
    assert {(x.key_a, x.key_b) for x in L.look_alike_pairs(u, tile=7).collect()} == want


def test_characters_that_the_collation_passes_over(spark):
    """Whatever it passes over between two letters is not drawn, or the key makes it seen."""
    rows = [(c,) for c in range(0xA0, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co", "Zs")]
    seen = re.compile("[" + re.escape(L.passed_over(spark)) + "]")
    words = spark.createDataFrame([(c, L.collation_key(f"a{chr(c)}b", seen)) for (c,) in rows], "c int, k string")
    passed = [r.c for r in words.where("k COLLATE UNICODE = 'ab' COLLATE UNICODE").collect()]
    assert [hex(c) for c in passed if L.plain(f"a{chr(c)}b") != "ab"] == []
