import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from qirtas.llm import packing as P
from qirtas.llm.tokenizing import VOCABULARY


def slow(sizes, c):
    """The rule, tried out for every choice."""
    bins, out = [], []
    for s in sizes:
        best = None
        for gap in [*sorted({g for g in bins if g >= s}), None]:
            after = list(bins)
            if gap is None:
                after.append(c - s)
            else:
                after[after.index(gap)] = gap - s
            open_ = [g for g in after if 0 < g < c]
            score = sum(open_.count(g) ** 2 for g in set(open_))
            if best is None or score < best[0]:
                best = (score, gap)
        gap = best[1]
        if gap is None:
            bins.append(c - s)
            out.append(len(bins) - 1)
        else:
            b = max(i for i, g in enumerate(bins) if g == gap)
            bins[b] = gap - s
            out.append(b)
    return bins, out


@pytest.mark.parametrize("seed", range(6))
def test_against_the_rule(seed):
    rng = np.random.default_rng(seed)
    c = 12
    sizes = np.sort(rng.integers(1, c + 1, 60))[::-1]
    got = P.sum_of_squares(sizes, c)
    fill = np.bincount(got, sizes)
    bins, _ = slow(sizes.tolist(), c)
    assert fill.max() <= c and sorted(c - fill) == sorted(bins)


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, n_tokens int").withColumn("bin", F.lit("clash"))


def test_nothing_is_lost_or_split_without_need(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(0, 400, 3000))] + [(9999, 1000), (9998, 300), (9997, 0), (9996, None)]
    got = P.pack_sizes(sizes(spark, rows), [(1, 100), (2, 300)], group_rows=1000).toPandas()
    for (pack, c), g in got.groupby(["pack_id", "capacity"]):
        assert g.groupby("bin").n_tokens.sum().max() <= c
        total = g.groupby("doc_id").n_tokens.sum()
        assert total.to_dict() == {i: n for i, n in rows if n}
        parts = g.groupby("doc_id").size()
        assert all(parts[i] == -(-n // c) for i, n in rows if n)
        fill = g.n_tokens.sum() / (g.bin.nunique() * c)
        assert fill > 0.95
        starts = g.sort_values(["doc_id", "part"]).groupby("doc_id")["at"].apply(list)
        assert starts[9999] == list(range(0, 1000, c))


def test_one_size_of_a_third_of_all(spark):
    rows = [(i, 50) for i in range(1000)] + [(5000 + i, 1 + i % 49) for i in range(2000)]
    got = P.fill_report(P.pack_sizes(sizes(spark, rows), [(1, 100)])).first()
    assert got.fill > 0.97


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the public vocabulary is not here")
def test_documents(spark):
    docs = spark.createDataFrame([(1, "the cat " * 50), (2, None), (3, ""), (4, "x"), (5, "the cat " * 50)], "doc_id long, text string")
    packs = spark.createDataFrame([(1, "byte_bpe_50k", 64), (2, "byte_bpe_50k", 4096)], "pack_id int, tokenizer string, capacity int")
    got = P.pack_documents(docs, packs)
    assert {r.doc_id for r in got.collect()} == {1, 4, 5}
    assert got.where("pack_id = 2").select("bin").distinct().count() == 1
    assert P.pack_documents(docs, packs.limit(0)).count() == 0
    assert P.pack_documents(docs.limit(0), packs).count() == 0
