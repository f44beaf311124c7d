"""Hand-computed cases and invariants of the core operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from qirtas.functions import text as X
from qirtas.operators import corpus as C
from qirtas.operators import decontam, dedupe, makers, quotas, steps
from qirtas.operators import vectors as V
from qirtas.operators.components import connected_components


def test_the_first_reason_wins(spark):
    long_ = "كلمة عن المدينة القديمة وسوقها الكبير قرب النهر " * 4
    rows = [
        (1, "s", "k", None, long_), (2, "s", "k", "سؤال قصير", "قصير"), (3, "s", "k", "سؤال عن المدينة القديمة", "قصير جدا"), (4, "s", "k", "english words in a question", long_),
        (5, "s", "k", "سؤال عن المدينة القديمة", long_), (6, "s", "k", "سُؤال عن المدينة القديمة؟", long_), (7, None, "k", "سؤال عن المدينة القديمة", long_), (8, "s", "k", long_, long_), (9, "s", "k", "سؤال عن المدينة القديمة", None),
    ]
    d = steps.decided_pairs(spark.createDataFrame(rows, "pair_id long, source string, kind string, query string, passage string"))
    got = {r.pair_id: (r.step, r.reason) for r in d.collect()}
    assert got[1] == got[9] == ("cleanup", "empty after cleanup")
    assert got[2] == ("length", "query < 3 tokens") and got[3] == ("length", "passage < 20 tokens") and got[4] == ("language", "query not Arabic")
    assert got[8][0] == "near_identical" and got[5] == (None, None) and got[7] == ("dedupe", "duplicate pair")
    assert len(got) == 9


def test_steps_keep_in_equals_out_plus_removed(spark):
    rows = [(i, "s" if i % 3 else None, "k", f"سؤال رقم {i % 4} عن المدينة", "كلمة " * (5 + i)) for i in range(60)]
    pairs = spark.createDataFrame(rows, "pair_id long, source string, kind string, query string, passage string")
    d = steps.decided_pairs(pairs, repeats=5)
    log, kept, names = d.where("step is not null"), d.where("step is null"), ["cleanup", "length", "language", "junk", "near_identical", "dedupe"]
    assert kept.count() + log.count() == 60
    stats = {r.step: r for r in steps.step_stats(pairs, log, names).collect()}
    assert stats["cleanup"].n_in == 60 and all(stats[b].n_in == stats[a].n_out for a, b in zip(names, names[1:])) and stats["junk"].n_removed > 0
    f = {r.source: r for r in steps.funnel(pairs, log, names).collect()}
    assert f["(all)"].n_left == kept.count()
    assert steps.removal_sample(log, "pair_id", 2).groupBy("step", "reason").count().agg(F.max("count")).first()[0] <= 2


def test_cached_steps(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    a = steps.fingerprint("", {"n": 1}, {"limit": 5})
    assert a != steps.fingerprint("", {"n": 1}, {"limit": 6})
    _, there = steps.cached_step(spark, "x", a, build, f"file://{tmp_path}")
    df, again = steps.cached_step(spark, "x", a, build, f"file://{tmp_path}")
    assert (there, again, len(calls), df.count()) == (False, True, 1, 3)


def test_minhash_close_to_exact(spark):
    base = " ".join(f"w{i}" for i in range(60))
    variant = " ".join(f"w{i}" if i != 30 else "other" for i in range(60))
    other = " ".join(f"z{i}" for i in range(60))
    df = spark.createDataFrame([(0, base), (1, variant), (2, other), (3, base), (4, "")], "id long, text string")
    s = dedupe.signatures(df, "id", F.col("text"))
    sig = {r.id: np.array(r.sig) for r in s.collect()}
    exact = 51 / 61
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.2
    assert (sig[0] == sig[2]).mean() < 0.1
    links = dedupe.estimated(dedupe.candidate_pairs(s, "id"), s, "id", 0.7)
    keep = {r.id: r.keeper for r in dedupe.keepers(df, links, "id").collect()}
    assert keep[3] == 0 and keep[2] == 2 and keep[4] == 4


def test_all_links_of_a_bucket(spark):
    x = list(range(64))
    y1 = x[:16] + [1000 + i for i in range(48)]
    y2 = [v + 5000 if i >= 16 and i % 4 == 0 else v for i, v in enumerate(y1)]
    z = x[:16] + [3000 + i for i in range(48)]
    s = spark.createDataFrame([(0, x), (1, y1), (2, z), (3, y2), (4, z), (5, y2)], "id long, sig array<long>")
    assert {(r.a, r.b) for r in dedupe.estimated(dedupe.candidate_pairs(s, "id"), s, "id").collect()} == {(2, 4), (3, 5)}  # the linear rule loses (1, 3)
    assert {(r.a, r.b): r.est for r in dedupe.all_links(s, "id").collect()} == {(1, 3): 52 / 64, (2, 4): 1.0, (3, 5): 1.0}
    assert {r.id: r.keeper for r in dedupe.keepers(s, dedupe.all_links(s, "id"), "id").collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 2, 5: 1}
    rng = np.random.default_rng(5)
    base = rng.integers(0, dedupe.PRIME, 64)
    sigs = np.where(rng.random((150, 64)) < 0.13, rng.integers(0, dedupe.PRIME, (150, 64)), base)
    many = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(sigs)], "id long, sig array<long>").repartition(3)
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if (sigs[a] == sigs[b]).mean() >= 0.8}
    for tile in (8, 2048):
        assert {(r.a, r.b) for r in dedupe.all_links(many, "id", tile=tile).collect()} == want
    assert want - {(r.a, r.b) for r in dedupe.candidate_pairs(many, "id").collect()}
    with pytest.raises(ValueError):
        dedupe.all_links(many, "id", 0.7)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and len(got) == 44
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merge_queries(spark):
    df = spark.createDataFrame([("b", "k", ["p2", "p1"], ["p3", "p2"]), ("a", "k", ["p1"], ["p2"]), ("c", "j", None, None)], "qid string, key string, pos_pids array<string>, neg_pids array<string>")
    got = {r.qid: r for r in dedupe.merge_queries(df, []).collect()}
    assert got["a"].pos_pids == ["p1", "p2"] and got["a"].neg_pids == ["p3"] and got["a"].n_copies == 2
    assert got["c"].pos_pids == []


def test_drop_passages(spark):
    q = spark.createDataFrame([("a", ["x", "y"], ["z"]), ("b", ["x"], []), ("c", [], ["x"])], "qid string, pos_pids array<string>, neg_pids array<string>")
    kept, gone = dedupe.drop_passages(q, spark.createDataFrame([("x",)], "pid string"))
    assert {r.qid: r.pos_pids for r in kept.collect()} == {"a": ["y"]}
    assert sorted(r.qid for r in gone.collect()) == ["b", "c"]


def test_decontamination_and_canaries(spark):
    long_ = " ".join(f"كلمة{i}" for i in range(20))
    ev = spark.createDataFrame([(1, long_), (2, "سؤال من ست كلمات هنا الآن"), (3, "قصير جدا"), (4, None)], "item_id long, text string")
    words = long_.split()
    texts = spark.createDataFrame([("a", "قبل " + " ".join(words[3:16]) + " بعد"), ("b", " ".join(words[3:15])), ("c", "عن سؤال من ست كلمات هنا الان!"), ("d", "قصير جدا؟"), ("e", "هذا قصير جدا حقا"), ("f", None)], "k string, t string")
    got = {r.k: (r.reason, r.label) for r in decontam.decide(texts, "k", "t", ev).collect()}
    assert got == {"a": ("13-gram", 1), "c": ("whole short query", 2), "d": ("exact query", 3)}
    assert decontam.check_canaries(texts, "k", "t", ev, {"x": f"«{long_}»", "y": "قَصير جدا"}) == []


def test_share_caps():
    assert quotas.capped({"big": 1000, "a": 300, "b": 300, "c": 300}, 0.4)["big"] == 600
    assert quotas.capped({"a": 70, "b": 50}, 1.0, target=60) == {"a": 60, "b": 50}
    with pytest.warns(UserWarning):
        assert quotas.capped({"x": 9000, "y": 1000}, 0.4) == {"x": 0, "y": 0}
    n = quotas.capped({"m": 900, "s": 2000, "h": 500}, {"m": 0.4, "s": 0.65, "h": 1.0}, slack=1e-9, passes=100)
    assert n["m"] <= 0.4 * sum(n.values()) + 1 and n["s"] <= 0.65 * sum(n.values()) + 1
    assert quotas.capped({}, 0.4) == {} and quotas.capped({"a": 0}, 0.4) == {"a": 0}


def test_group_holdout_never_splits_a_group(spark):
    df = spark.range(300).withColumn("g", F.floor(F.col("id") / 3))
    h = quotas.group_holdout(df, "g", 30)
    assert 30 <= h.where("held").count() <= 32
    assert h.groupBy("g").agg(F.count_distinct("held").alias("n")).where("n > 1").count() == 0
    small = quotas.group_holdout(df.limit(10), "g", 30)
    assert small.where("held").count() <= 4


def test_cap_groups(spark):
    df = spark.createDataFrame([("p1", "search_query"), ("p1", "full"), ("p1", "simple"), ("p2", "search_query"), ("p2", "full"), ("p2", "simple"), ("p3", "full")], "g string, t string").withColumn("k", F.monotonically_increasing_id())
    prefer = F.when(F.col("t") == "search_query", 0).otherwise(1)
    c = quotas.cap_groups(df, "g", "k", 2, 10, prefer)
    assert {r.g: r["count"] for r in c.groupBy("g").count().collect()} == {"p1": 2, "p2": 2, "p3": 1}
    assert c.where("g = 'p1' and t = 'search_query'").count() == 1
    assert quotas.cap_groups(df, "g", "k", 2, 4, prefer).count() == 4


def test_pack(spark):
    df = spark.createDataFrame([("u", 1, list(range(10, 22))), ("u", 2, list(range(22, 30))), ("v", 1, []), ("w", 1, [5])], "unit string, ord int, ids array<int>")
    rows = sorted(map(tuple, C.pack(df, "unit", "ord", "ids", 8, 1, 3, 2).collect()))
    assert [(u, s) for u, s, _ in rows] == [("u", 0), ("u", 1), ("u", 2)]
    assert rows[0][2] == [1, 10, 11, 12, 13, 14, 15, 2]
    flat = [x for _, _, ids in rows for x in ids[1:-1]]
    assert flat == (list(range(10, 22)) + [3] + list(range(22, 30)) + [3])[:18]


def test_metrics(spark):
    top = spark.createDataFrame([("q1", 5, 1), ("q1", 1, 2), ("q1", 2, 3), ("q2", 7, 1), ("q2", 8, 2), ("q2", 9, 3)], "qid string, pid long, rank int")
    rel = spark.createDataFrame([("q1", 5), ("q2", 9), ("q3", 1)], "qid string, pid long")
    m = {r.qid: r for r in V.retrieval_metrics(top, rel).collect()}
    assert m["q1"].ndcg10 == 1.0 and m["q2"].ndcg10 == pytest.approx(1 / math.log2(4)) and m["q3"].recall10 == 0
    r = spark.createDataFrame([(1,), (3,), (50,), (500,)], "rank long")
    g = r.agg(*V.ranking_metrics(r)).first()
    assert g.recall10 == 0.5 and g.recall100 == 0.75 and g.mrr10 == pytest.approx((1 + 1 / 3) / 4)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(300)] + [(300, None)], "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in V.top_k(df.where("vec_id % 30 = 0"), df, 4, block=3).collect():
        got.setdefault(r.qid, {})[r.rank] = r.pid
    for q, ranks in got.items():
        s = v[q].astype(float) @ v.astype(float).T
        assert [ranks[k] for k in (1, 2, 3, 4)] == sorted(range(300), key=lambda p: (-s[p], p))[:4]
    assert len(got) == 10
    assert V.top_k(df.limit(0), df, 3).count() == 0


def test_false_negatives_and_cascade(spark):
    c = spark.createDataFrame([("q", "a", 2.0, 2.0), ("q", "b", -3.0, 2.0), ("r", "a", 9.0, None)], "qid string, pid string, score double, best_pos double")
    assert {(r.qid, r.pid): r.false_neg for r in V.false_negatives(c).collect()} == {("q", "a"): True, ("q", "b"): False, ("r", "a"): False}
    cands = spark.createDataFrame([("q", t, o, f"{o}{i}", f"k{t}{i}") for t, o, n in ((0, "judged", 2), (1, "top", 3), (2, "rest", 9)) for i in range(n)] + [("q", 1, "top", "same", "k00"), ("q", 0, "judged", "pos", "kp")], "qid string, tier int, origin string, pid string, text_key string")
    got = V.negative_cascade(cands, spark.createDataFrame([("q", "kp")], "qid string, text_key string")).collect()
    assert len(got) == 7 and [r.origin for r in sorted(got, key=lambda r: r.place)] == ["judged"] * 2 + ["top"] * 3 + ["rest"] * 2
    assert "pos" not in {r.pid for r in got}


def test_ranks_among_drawn_negatives(spark):
    rows = [(i, "g", [1.0, 0.0] if i else [0.0, 1.0], [1.0, 0.0]) for i in range(5)] + [(9, "alone", [1.0, 0.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, g string, q array<float>, p array<float>")
    links = V.random_negatives(df, "id", "g", 3)
    assert links.where("id = other").count() == 0 and links.groupBy("id").count().select("count").distinct().count() == 1
    r = {x.id: x for x in V.true_ranks(df, "id", "g", "q", "p", 3).collect()}
    assert r[9].rank == 1 and r[9].best_negative == -1.0 and r[1].rank == 1


def test_training_rows_and_scorer(spark):
    q = spark.createDataFrame([("h", True, ["a", "b"]), ("s", False, ["c"]), ("n", None, [])], "qid string, is_human boolean, pos_pids array<string>")
    assert sorted((r.qid, r.repeat, r.positives) for r in V.training_rows(q).collect()) == [("h", 0, ["a", "b"]), ("h", 1, ["b", "a"]), ("s", 0, ["c"])]
    d = spark.createDataFrame([("q", "passage")], "query string, passage string")
    assert V.rerank(d, lambda q, p: [float(len(x)) for x in p]).first().score == 7.0


def test_answer_window():
    c = "الأول قصير.\n" + "كلمة طويلة هنا. " * 40 + "الجواب 1969 هنا. " + "ثم كلام آخر. " * 40 + "\nالأخير."
    s = c.index("1969")
    w = makers.answer_window(c, s, s + 4, 300)
    assert "1969" in w and len(w) <= 300
    assert makers.answer_window(c, 0, 400, 300) is None
    # paragraphs grow to the right only, until they hold a third of the width
    assert makers.answer_window("أول\nثان\nثالث طويل جدا", 4, 7, 30) == "ثان\nثالث طويل جدا"
    # too long: from a word on, or from the end of a near sentence, which may leave no room for the answer
    long_ = "س" * 100 + ". " + "ب " * 10 + "جواب " + "ت " * 90
    assert makers.answer_window(long_, 122, 126, 120).startswith("ب ")
    long_ = "س" * 50 + ". " + "ب " * 60 + "جواب " + "ت " * 90
    assert makers.answer_window(long_, 172, 176, 120) is None and makers.answer_window(long_, 172, 176, 200).startswith("ب ")
    assert makers.answer_window("قصير", 0, 4, 300) == "قصير"
    assert makers.locate_answer("x abc abc", "abc", 30) == 2


def test_fit_and_spans(spark):
    assert makers.fit("a b c", 5) == ("a b c", 3, False)
    assert makers.fit("one two three", 2) == ("one two", 2, True)
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(150 + i))) for i in range(20)] + [(99, "short"), (100, None)], "id long, t string")
    rows = makers.span_pairs(df, "id", F.coalesce("t", F.lit(""))).collect()
    assert len(rows) == 20
    for r in rows:
        q, p = r.query.split(), r.passage.split()
        assert 16 <= len(q) <= 64 and 64 <= len(p) <= 256 and not set(q) & set(p)
    fitted = {r.id: r for r in makers.fit_to_length(df, "id", "t", 64).collect()}
    assert fitted[0].n_tokens == 64 and fitted[0].cut and not fitted[99].cut and fitted[100].fitted == ""


def test_wiki_sections():
    t = "المدينة تقع في الشمال وهي كبيرة.\n\nالتاريخ\n\nبدأت المدينة قديما.\n\nمراجع\n\nكتاب."
    assert C.sections(t) == [(None, ["المدينة تقع في الشمال وهي كبيرة."]), ("التاريخ", ["بدأت المدينة قديما."])]
    assert C.sections("== عنوان ==\nنص") == [(None, ["== عنوان ==", "نص"])]


def test_masking_rates(spark):
    n = spark.range(20000).withColumn("i", F.lit(0)).groupBy(C.mask_kind("id", "i").alias("k")).count().collect()
    share = {r.k: r["count"] / 20000 for r in n}
    assert abs(share["kept"] - 0.7) < 0.02 and abs(share["mask"] - 0.24) < 0.02 and abs(share["random"] - 0.03) < 0.01


def test_epoch_windows_cover_every_row_once(spark):
    df = spark.range(28).withColumn("shard", F.floor(F.col("id") / 6))
    one, two = (C.epoch_windows(df, "id", "shard", e, 2).orderBy("win", "pos").collect() for e in (1, 2))
    assert sorted(r.id for r in one) == list(range(28)) and [r.id for r in one] != [r.id for r in two]
    assert one == C.epoch_windows(df.repartition(7), "id", "shard", 1, 2).orderBy("win", "pos").collect()


def test_search_in_blocks_inside_domains(spark, monkeypatch):
    import random

    monkeypatch.setattr(V, "MERGED_BLOCKS", 2)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3 if i % 11 else None, i % 5) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, domain int, label int").repartition(5)
    got = {}
    for r in V.top_k(df.where("vec_id < 40"), df, 6, block=7, same="domain", other="label").collect():
        got.setdefault(r.qid, {})[r.rank] = r.pid
    vec = {r.vec_id: r for r in df.collect()}
    for q in range(40):
        a = vec[q]
        fit = [b for b in vec.values() if a.domain is not None and b.domain == a.domain and b.label != a.label]
        want = sorted(fit, key=lambda b: (-sum(x * y for x, y in zip(a.embedding, b.embedding)), b.vec_id))[:6]
        assert [got.get(q, {}).get(i + 1) for i in range(len(want))] == [b.vec_id for b in want] and len(got.get(q, {})) == len(want)
    plain = V.top_k(df.where("vec_id < 40"), df, 3, block=9).groupBy("qid").count().collect()
    assert len(plain) == 40 and all(r["count"] == 3 for r in plain)
