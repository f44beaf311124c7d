import numpy as np

from qirtas.plans import vectors as P


def table(spark, tmp_path, labels, n=300):
    v = np.random.default_rng(3).normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lab = [labels(i, v) for i in range(n)]
    df = spark.createDataFrame([(i, v[i].tolist(), int(lab[i])) for i in range(n)], "vec_id long, embedding array<double>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return v, np.array(lab)


def test_ranks_past_the_fifty_nearest(spark, tmp_path):
    far = lambda i, v: 1 if i == 0 or i == np.argsort(v @ v[0])[40] else 2 + i % 5 if i != 200 else 99
    v, lab = table(spark, tmp_path, far)
    s = v @ v.T
    got = {r.qid: r["rank"] for r in P.consistency_rank_whole(spark, str(tmp_path)).collect()}
    recall = {r.qid: r.recall100 for r in P.ndcg_recall_whole(spark, str(tmp_path)).collect()}
    for q in (0, 100, 200):
        same = np.flatnonzero((lab == lab[q]) & (np.arange(300) != q))
        if not len(same):
            assert q == 200 and got[q] is None
            continue
        assert got[q] == 1 + ((s[q] > s[q][same].max() + 1e-9) & (lab != lab[q])).sum()
        near = [i for i in np.argsort(-s[q]) if i != q][:100]
        assert abs(recall[q] - len(set(near) & set(same)) / len(same)) < 1e-5
    assert got[0] > 100
    assert {r.qid: r["rank"] for r in P.consistency_rank(spark, str(tmp_path)).collect()}[0] == 1  # what the fifty give
    assert {r.bucket: r.n for r in P.rank_histogram_whole(spark, str(tmp_path)).collect()}["over 100"] == 1
    assert sum(r.n for r in P.capped_rank_counts_whole(spark, str(tmp_path)).collect()) == 2


def test_rank_among_ninety_nine(spark, tmp_path):
    v, _ = table(spark, tmp_path, lambda i, v: 0, 100)  # a group of 100: all others are drawn
    got = {r.vec_id: r for r in P.rank_among_random_whole(spark, str(tmp_path)).collect()}
    s = v @ v[np.arange(100) // 2 * 2].T
    for i in range(100):
        others = np.delete(s[i], i)
        assert got[i]["rank"] == 1 + (others > s[i, i] + 1e-9).sum()
        assert abs(got[i].score - s[i, i]) < 1e-9 and abs(got[i].best_negative - others.max()) < 1e-9
    assert max(r["rank"] for r in got.values()) > 10
    assert max(r["rank"] for r in P.rank_among_random(spark, str(tmp_path)).collect()) <= 10
