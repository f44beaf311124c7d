import random

import pytest
from pyspark.sql import functions as F

from qirtas.llm import leaks as L
from qirtas.llm.words import RAW_WORD, WordHashes, no_markup, same


def brute(records, items, span):
    words = lambda t: [f for w in RAW_WORD.findall(no_markup(t)) if (f := same(w))] if t else []
    out = set()
    for i, t in items:
        w = words(t)
        k = min(span, len(w))
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
        for r, x in records:
            v = words(x)
            if k and any(tuple(v[j : j + k]) in grams for j in range(len(v) - k + 1)):
                out.add((r, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(0)
    v = [f"كلمة{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([2, 5, 8, 13, 20])))) for i in range(40)] + [(90, None), (91, "!!"), (92, items_text := " ".join(v)), (93, items_text)]
    records = []
    for r in range(200):
        t = [rng.choice(v) for _ in range(rng.randint(0, 40))]
        if r % 2:
            w = items[rng.randrange(40)][1].split()
            t[5:5] = w[rng.randint(0, 2) :]
        records.append((str(r), "، ".join(t)))
    records += [("n", None), ("e", "")]
    df = spark.createDataFrame(records, "rec_id string, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.rec_id, r.item_id) for r in L.find_leaks(df, "rec_id", ["text"], it, span=13).collect()}
    assert got == brute(records, [x for x in items if x[1]], 13) and got


def test_ways_of_writing(spark):
    item = "كيف ساعد تخطيط الأنفاق النادرة سكان ماما ضيروقو على مواجهة الثلوج عام 1934؟"
    forms = ["كَيفَ ساعد تخطيط الانفاق النادرة، سكان ماما ضيروقو على مواجهة الثلوج عام ١٩٣٤", "قبل <b>كيف</b> ساعد&nbsp;تخطيط  الأنفاق\nالنادره سكان ماما ضيروقو علي مواجهة الثلـــوج عام 1934 بعد"]
    df = spark.createDataFrame([(str(i), f) for i, f in enumerate(forms)] + [("x", forms[0].replace("ماما", "بابا"))], "k string, q string")
    it = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {(r.rec_id, r.item_id) for r in L.find_leaks(df, "k", ["q"], it, span=20).collect()} == {("0", 7), ("1", 7)}
    assert L.find_leaks(df, "k", ["q"], it.limit(0)).count() == 0
    assert L.find_leaks(df.limit(0), "k", ["q"], it).count() == 0


def test_edits_reach_the_recall(spark):
    rng = random.Random(5)
    v = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.sample(v, 13))) for i in range(60)]
    rows, want = [], set()
    for i, t in items:
        w = t.split()
        w[rng.randrange(1, 12)] = "other"
        rows.append((str(i), " ".join(["a", "b", *w, "c"])))
        want.add((str(i), i))
    df, it = spark.createDataFrame(rows, "k string, t string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.rec_id, r.item_id) for r in L.find_leaks(df, "k", ["t"], it, max_edits=2).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert L.find_leaks(df, "k", ["t"], it).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(words, kind, n, rng):
    w = list(words)
    for _ in range(n):
        p = rng.randrange(len(w))
        if kind == "replace":
            w[p] = f"x{rng.random()}".replace(".", "")
        elif kind == "insert":
            w.insert(p, f"x{rng.random()}".replace(".", ""))
        else:
            del w[p]
    return w


@pytest.mark.parametrize("size", [4, 6, 8, 13, 20])
@pytest.mark.parametrize("kind", ["replace", "insert", "leave out"])
def test_recall_by_length_and_kind(size, kind):
    rng = random.Random(size)
    v = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(v, k=size))) for i in range(200)]
    index = L.Index(items, 13, 2, 0.95)
    edits = index.sizes[0][1]
    for n in range(edits + 1):
        texts = [" ".join(rng.choices(v, k=5) + edited(t.split(), kind, n, rng) + rng.choices(v, k=5)) for _, t in items]
        text, item, need = index.search(*WordHashes(same).flat(texts))
        own = text == item
        assert own.sum() >= 0.94 * len(items) and (need[own] <= n).all()
        assert n or own.sum() == len(items)


def test_edits_against_brute_force(spark):
    rng = random.Random(9)
    v = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(v, k=rng.choice([3, 5, 9, 13, 16])))) for i in range(25)]
    records = []
    for r in range(120):
        w = rng.choice(items)[1].split()
        t = rng.choices(v, k=rng.randint(0, 12))
        records.append((str(r), " ".join(t[:5] + edited(w, rng.choice(["replace", "insert", "leave out"]), rng.randint(0, 2), rng) + t[5:]) if r % 2 else " ".join(t)))
    want = {}
    for i, t in items:
        w = t.split()
        size = min(13, len(w))
        e = min(2, size // L.EDIT_WORDS)
        for r, x in records:
            u = x.split()
            found = [distance(w[a : a + size], u[b:c]) for a in range(len(w) - size + 1) for b in range(len(u)) for c in range(b + size - e, min(len(u), b + size + e) + 1)]
            if found and min(found) <= e:
                want[r, i] = min(found)
    df, it = spark.createDataFrame(records, "k string, t string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.rec_id, r.item_id): r.edits for r in L.find_leaks(df, "k", ["t"], it, max_edits=2).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) and sum(got[x] == want[x] for x in got) >= 0.95 * len(got)
    assert {x for x in got if got[x] == 0} == {x for x in want if want[x] == 0}
