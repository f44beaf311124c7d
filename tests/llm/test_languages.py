import random

import pytest
from pyspark.sql import functions as F

from qirtas.llm import languages as L

VOCABULARY = {
    "ar": "في من على إلى عام عن مع أن بعد التي كتب المدينة القديمة شركة بناء الجسر خلال السنة الماضية قرب",
    "en": "the of and in was built near old town bridge during last year company that people have been with from street",
    "fr": "le la les des une ville pont ancien pendant année dernière dans est avec pour près rue société gens construit",
    "de": "der die das und ist im von mit wurde alte Stadt Brücke während letzten Jahres nahe Straße Firma Leute gebaut nach",
    "es": "el los las del una ciudad puente viejo durante año pasado cerca calle empresa gente construido con para según está",
    "fa": "که از در به را این آن است برای شهر پل قدیمی سال گذشته نزدیک خیابان شرکت مردم ساخته شد می‌کند",
    "ur": "کے میں کی سے ہے نے کا کو پر اور شہر پرانا پل سال پچھلے قریب سڑک لوگ بنایا گیا تھا",
}


def sentence(lang, n, rng):
    return " ".join(rng.choice(VOCABULARY[lang].split()) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [(lang, sentence(lang, 15, rng)) for lang in L.LANGUAGES for _ in range(120)]
    rows += [(lang, sentence("ar", 15, rng)) for lang in L.LANGUAGES[1:] for _ in range(50)]  # wrong labels
    return L.train(rows)


def languages_of(model, text):
    return [(L.LANGUAGES[s] if s >= 0 else None) for s, *_ in L.label_batch(model, [text], L.STRETCH)[0]]


def test_held_out_accuracy(model):
    rng = random.Random(2)
    cases = [(lang, sentence(lang, 12, rng)) for lang in L.LANGUAGES for _ in range(60)]
    right = sum(languages_of(model, t) == [lang] for lang, t in cases)
    assert right / len(cases) > 0.97


def test_mixed_texts(model):
    rng = random.Random(3)
    right = 0
    for _ in range(60):
        a, b, c = rng.sample(L.LANGUAGES, 3)
        t = f"{sentence(a, 12, rng)} {sentence(b, 12, rng)}\n{sentence(c, 12, rng)}"
        right += languages_of(model, t) == [a, b, c]
    assert right >= 56
    short = f"{sentence('ar', 14, rng)} {sentence('en', 5, rng)} {sentence('ar', 14, rng)}"
    assert languages_of(model, short) == ["ar"]


def test_labels(spark):
    rows = [("ar", "ar"), ("AR ", "ar"), ("arb_Arab", "ar"), ("Arabic", "ar"), ("en-GB", "en"), ("pes_Arab", "fa"), ("es-MX", "es"), ("Urdu", "ur"), ("xx", None), ("-", None), ("", None), ("und", None), (None, None)]
    df = spark.createDataFrame(rows, "l string, want string")
    assert all(r.got == r.want for r in df.select(L.label_language(F.col("l")).alias("got"), "want").collect())


def test_defined_results(spark, model):
    rng = random.Random(4)
    ar, en = sentence("ar", 12, rng), sentence("en", 12, rng)
    rows = [("1", ar, "ar"), ("2", ar, "xx"), ("3", ar, None), ("4", en, "ar"), ("5", f"{ar} {en}", "ar"), ("6", None, "xx"), ("7", "", "xx"), ("8", "في من على", "xx"), ("9", "12 34 56 78 90 11", "xx"), ("2", ar, "xx"), ("a", "zzgx qqvk wwpf kkjh bbzt xxqy", "xx")]
    df = spark.createDataFrame(rows, "rec_id string, text string, lang string").withColumn("tbl", F.lit("t")).withColumn("seg", F.lit("clash"))
    labelled = L.label_languages(df, model)
    got = sorted((r.rec_id, r.seg, r.lang) for r in L.wrong_labels(labelled).collect())
    assert got == [("2", 0, "ar"), ("3", 0, "ar"), ("4", 0, "en"), ("5", 0, "ar"), ("5", 1, "en")]
    none = {r.rec_id: r for r in labelled.where("rec_id in ('6', '7')").collect()}
    assert none["6"].n_segs == 0 and none["6"].lang is None and none["6"].confidence == 0.0
    assert L.label_languages(df.limit(0), model).count() == 0
    assert L.sampled(df.where("lang is null").select("rec_id", "text", "lang")).count() == 0 and not L.trained(df.where("lang is null").select("rec_id", "text", "lang")).rows.any()


def test_bloom_filter_holds_all_members():
    m = {f"g{i}": 1 << (i % 7) for i in range(5000)}
    f = L.Filter.build(m)
    for g, mask in m.items():
        got = 255
        for r in L.rows_of(g):
            got &= int(f.rows[r])
        assert got & mask == mask
    assert f.false.max() < 0.01
