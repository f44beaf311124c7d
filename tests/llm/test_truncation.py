import random

import numpy as np
from pyspark.sql import functions as F

from qirtas.llm import samples as S
from qirtas.llm import tails
from qirtas.llm import truncation as T
from tests.llm.test_languages import sentence

CLOSING = ["\n- الجبس\n- التين", "\nكتب: محمد علي", "\nهاتف 555-123", "\nhttps://a.example/p/1", "\n(انتهى)", "\nوسوم: التين، العسل", "\nالمصدر: وكالة الأنباء", " 🙂"]


def documents(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = " ".join(sentence("ar", rng.randint(8, 15), rng) for _ in range(rng.randint(2, 6)))
        kind = rng.random()
        if kind < 0.1:
            at = 300 if len(t) > 330 and rng.random() < 0.5 else rng.randint(60, len(t) - 3)
            c = t[:at]
            if c.rstrip()[-1] not in ".":
                rows.append((i, c + rng.choice(["", "", "…", " […]", "�", " "]), 1))
                continue
        if kind > 0.8:
            t += rng.choice(CLOSING)
        rows.append((i, t, 0))
    return rows


def test_held_out_accuracy():
    train, test = documents(3000, 1), documents(1000, 2)
    both = [x for i, t, _ in train for x in T.examples(t, [300], np.random.default_rng(i))]
    w = T.fit([f for f, _ in both], np.array([c for _, c in both], float))
    y = np.array([c for *_, c in test])
    p = np.array([w[T.named(t, len(t) == 300)].sum() > 0 for _, t, _ in test])
    assert p[y == 1].mean() > 0.95 and p[y == 0].mean() < 0.02


def test_limits(spark):
    rows = [(300,)] * 60 + [(k,) for k in range(100, 900)] + [(None,), (0,)]
    assert T.limits(spark.createDataFrame(rows, "n int")) == [300]
    assert T.limits(spark.createDataFrame([], "n int")) == []


def test_defined_results(spark):
    rows = [(i, t) for i, t, _ in documents(1500, 3)] + [(9001, None), (9002, ""), (9003, " \n"), (9004, "نص كامل قصير."), (9004, "نص كامل قصير.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("score", F.lit("clash"))
    s = T.score(df)
    assert s.count() == len(rows)
    got = {r.doc_id: r.score for r in s.collect()}
    assert got[9001] == got[9002] == got[9003] == 0 and got[9004] < 0.5
    r = T.cut_report(df.dropDuplicates(["doc_id"]), s.dropDuplicates(["doc_id"])).first()
    assert r.source == "s" and 0 < r.share < 0.2
    assert T.score(df.limit(0)).count() == 0


def test_tables_without_cuts_to_learn_from(spark):
    for rows in ([(1, "نص كامل أول ينتهي هنا."), (2, "نص كامل ثان.")], [(1, "عنوان بلا نقطة"), (2, "عنوان آخر")], [(1, None)]):
        assert all(r.score == 0 for r in T.score(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_sample_bounds_at_any_size(spark):
    assert S.bound(100, 8000) == S.WHOLE - 1
    for n in (10**6, 10**9, 10**11, 10**15):
        assert 0.99 < S.bound(n, 8000) * n / S.WHOLE / 8000 <= 1.01
    df = spark.range(50_000).select("id", F.lit("x").alias("t"))
    got = S.first(df, "id", ["t"], F.lit(S.bound(50_000, 500)), 1000, "s")
    assert 400 < got.count() < 600
    few = S.first(df.repartition(7), "id", ["t"], F.lit(S.WHOLE - 1), 20, "s")
    assert sorted(r.id for r in few.collect()) == sorted(r.id for r in S.first(df, "id", ["t"], F.lit(S.WHOLE - 1), 20, "s").collect())


def test_finished():
    assert [tails.finished(t) for t in ("انتهى.", "انتهى؟ 🙂", "قال: «نعم.»", "بقي [3].", "بقي…", "بقي...", "بقي", ". ")] == [True, True, True, True, False, False, False, True]
