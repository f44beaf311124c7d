import random
import unicodedata

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from qirtas.llm import neardup as N


def shingles(q, p):
    words = [w for t in (q, p) for w in regex.findall(r"[\p{L}\p{N}]+", regex.sub(r"[\p{Mn}\p{Cf}ـ]+", "", t or "").lower())]
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def brute(rows, threshold=0.6, least=20):
    s = {i: shingles(q, p) for i, q, p in rows if p and len(regex.findall(r"[\p{L}\p{N}]+", p)) >= least}
    ids = sorted(s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] | s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold}


def corpus(n, seed, vocabulary=400):
    rng = random.Random(seed)
    v = [f"كلمة{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            _, q, p = rng.choice(rows)
            w = (p or "").split()
            for _ in range(rng.randint(0, 5)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(v)
            if rng.random() < 0.2:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            rows.append((i, q, " ".join(w)))
        else:
            rows.append((i, " ".join(rng.choices(v, k=6)), " ".join(rng.choices(v, k=rng.randint(15, 80)))))
    return rows


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "pair_id long, query string, passage string").withColumn("n", F.lit("clash")).repartition(3)
    near = N.near_duplicates(df, **kw)
    return {(r.pair_a, r.pair_b) for r in N.all_pairs(near).collect()}, df, near


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(300, seed) + [(1000, None, None), (1001, "q", None), (1002, None, "short"), (1003, "", "")]
    rows += [(1100 + k, rows[3][1], rows[3][2]) for k in range(3)] + [(1200, *rows[4][1:]), (1200, *rows[4][1:])]
    got, *_ = found(spark, rows)
    assert got == brute(dict((r[0], r) for r in rows).values())


def test_marks_case_and_punctuation_aside(spark):
    p = " ".join(f"Word{i}" for i in range(30))
    got, *_ = found(spark, [(1, "سؤال", p), (2, "سُؤال؟", p.upper().replace(" ", ", "))])
    assert got == {(1, 2)}


def test_small_tiles_give_the_same_pairs(spark):
    rows = corpus(250, 7)
    want, *_ = found(spark, rows)
    got, *_ = found(spark, rows, tile=4)
    assert got == want


@pytest.mark.parametrize("usual", [1, 3, 8])
def test_frequent_runs_lose_no_pair(spark, monkeypatch, usual):
    monkeypatch.setattr(N, "USUAL", usual)
    monkeypatch.setattr(N, "TIMES", 0)
    rng = random.Random(usual)
    parts = [[f"t{k}x{j}" for j in range(45)] for k in range(3)]
    rows = corpus(120, usual)
    for i in range(150):  # templates with more or less text of their own, and cuts of templates
        w = list(parts[i % 3]) + [f"o{i}x{j}" for j in range(rng.randint(0, 40))]
        if i % 4 == 0:
            w = w[rng.randint(0, 12) :]
        if i % 5 == 0:
            w = w + parts[(i + 1) % 3][: rng.randint(3, 30)]
        rows.append((500 + i, "q", " ".join(w)))
    rows += [(900 + k, *rows[-3][1:]) for k in range(4)]
    got, df, near = found(spark, rows, tile=16)
    want = brute(rows)
    assert got == want and near.class_links.count() > 0
    # one row per record: links to other groups of copies, and the groups that links connect
    text = {i: (q, p) for i, q, p in rows}
    rep = {i: min(j for j in text if text[j] == text[i]) if len(text[i][1].split()) >= 20 else i for i in text}
    g = {r.pair_id: r for r in N.groups(df, near).collect()}
    assert all(g[i].n_links == len({rep[b if a == i else a] for a, b in want if i in (a, b)} - {rep[i]}) and g[i].class_id == rep[i] for i in text)
    group = {i: i for i in text}
    for _ in range(6):
        for a, b in sorted(want):
            group[a] = group[b] = min(group[a], group[b])
    assert {i: r.group_id for i, r in g.items()} == group


def test_a_template_without_similar_members_makes_no_pairs(spark):
    def work(n):
        template = [f"t{j}" for j in range(50)]
        df = spark.createDataFrame([(i, "q", " ".join(template + [f"o{i}x{j}" for j in range(28)])) for i in range(n)], "pair_id long, query string, passage string")
        sets = N.sets_of(df, "pair_id", "query", "passage", 20)
        frequent = spark.sparkContext.broadcast(N.frequent_runs(sets))
        classes, of = N.heavy_classes(sets, frequent, 0.6)
        near = N.near_duplicates(df)
        assert near.links.count() == near.class_links.count() == 0
        return N.tiles(N.postings_of(sets, frequent, 0.6), 0.6, 512).count(), classes.count(), of.count()

    for n in (1000, 4000):
        tiled, classes, of = work(n)
        assert tiled <= n / 100 and classes <= n / 100 and of == n  # a few runs share a counter with the template's


def test_hot_group_of_copies_and_of_one_template(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "q", base) for i in range(300)] + [(1000 + i, f"q{i}", " ".join(f"u{i}x{j}" for j in range(40))) for i in range(50)]
    df = spark.createDataFrame(rows, "pair_id long, query string, passage string")
    near = N.near_duplicates(df)
    assert near.links.count() == 0 and near.members.count() == 300
    g = {r.pair_id: r for r in N.groups(df, near).collect()}
    assert all(g[i].class_id == 0 and g[i].group_id == 0 for i in range(300)) and g[1001].class_id == 1001 and len(g) == 350


def test_shared_text_that_is_partly_frequent(spark):
    template = " ".join(f"t{i}" for i in range(52))
    rows = []
    for k in range(60):
        short = f"{template} " + " ".join(f"r{k}x{j}" for j in range(12))
        rows += [(2 * k, "", short), (2 * k + 1, "", short + " " + " ".join(f"e{k}x{j}" for j in range(38)))]
    got, *_ = found(spark, rows)
    want = brute(rows)
    assert {(2 * k, 2 * k + 1) for k in range(60)} <= want and got == want


def test_groups_count_links(spark):
    rows = corpus(120, 3)
    got, df, near = found(spark, rows)
    g = {r.pair_id: r for r in N.groups(df, near).collect()}
    assert len(g) == 120
    for a, b in got:
        assert g[a].group_id == g[b].group_id


def test_empty_table_and_long_text(spark):
    assert found(spark, [])[0] == set()
    long_ = " ".join(f"x{i}" for i in range(20000))
    assert found(spark, [(1, "a", long_), (2, "a", long_ + " y z")])[0] == {(1, 2)}


def test_fingerprints_bound_the_difference():
    rng = np.random.default_rng(0)
    words = rng.integers(1, 2**63, 400).astype(np.uint64)
    runs, ends = N.runs_of(words, np.array([0, 150, 152, 400]))
    assert list(np.diff(ends)) == [148, 0, 246] and all(np.diff(runs[: ends[1]].astype(np.int64)) > 0)
    assert unicodedata.normalize("NFC", "a") == "a"
