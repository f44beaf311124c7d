import pytest
from pyspark.sql import functions as F

from qirtas.llm import mixing as M


def test_sainte_lague_against_its_definition():
    got = M.sainte_lague([0.5, 0.3, 0.2], [100, 100, 100], 10)
    quotients = sorted(((-w / (2 * k + 1), i) for i, w in enumerate([0.5, 0.3, 0.2]) for k in range(10)))[:10]
    assert got == [sum(i == p for _, i in quotients) for p in range(3)] == [5, 3, 2]
    assert M.sainte_lague([1, 1], [1, 100], 10) == [1, 9]
    assert M.sainte_lague([], [], 5) == [] and M.sainte_lague([1], [0], 5) == [0]


def records(spark, n):
    rows = [(f"a:{i}", "a", True) for i in range(n)] + [(f"b:{i}", " B ", False) for i in range(n // 4)] + [("c:0", None, None), (None, "a", True)]
    return spark.createDataFrame(rows, "qid string, source string, is_human boolean").withColumn("copies", F.lit("clash"))


@pytest.mark.parametrize("n", [40, 4000])
def test_shares_and_repeats(spark, n):
    r = records(spark, n)
    t = spark.createDataFrame([("m", "a", None, 0.5, 1), ("m", "b", None, 0.5, 2), ("h", None, True, 0.7, 1), ("h", None, False, 0.3, 3)], "mix_name string, source string, is_human boolean, target_share double, max_repeats int")
    src = (r, F.col("qid"), M.clean_source(F.col("source")))
    m = M.mixtures(t, {"m": src, "h": src})
    assert m.groupBy("mix_name", "rec_id").count().where("count > 1").count() == 0
    assert m.where("copies > max_repeats").count() == 0
    rep = {(x.mix_name, x.source, x.is_human): x for x in M.share_report(m).collect()}
    assert abs(rep["m", "a", None].actual_share - 0.5) < 0.02 and abs(rep["h", None, True].actual_share - 0.7) < 0.03
    assert rep["m", "b", None].n_drawn == n // 2 and rep["m", "b", None].most_copies == 2  # the scarce source is used up
    again = M.mixtures(t, {"m": (r.repartition(7), *src[1:]), "h": src})
    assert sorted(map(tuple, m.select("mix_name", "rec_id", "copies").collect())) == sorted(map(tuple, again.select("mix_name", "rec_id", "copies").collect()))


@pytest.mark.parametrize("shard_rows", [300, 7])
def test_many_shards_give_the_same_totals(spark, shard_rows):
    r = records(spark, 4000)
    m = M.mix(r, F.col("qid"), [F.col("source") == "a", M.clean_source(F.col("source")) == "b"], [0.5, 0.5], [1, 2], shard_rows=shard_rows)
    got = {x.target: (x.n, x.most) for x in m.groupBy("target").agg(F.sum("copies").alias("n"), F.max("copies").alias("most")).collect()}
    assert got == {0: (2000, 1), 1: (2000, 2)}


def test_blocks_are_drawn_whole(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_BLOCKS", 20)
    block, seats = M.quotas([1000, 250], [0.5, 0.5], [1, 1])
    assert block == 25 and seats == [250, 250]
    df = spark.range(1250).select(F.concat(F.lit("k"), "id").alias("qid"), (F.col("id") < 1000).alias("first"))
    m = M.mix(df, F.col("qid"), [F.col("first"), ~F.col("first")], [0.5, 0.5], [1, 1])
    order = df.where("first").orderBy(F.xxhash64("qid", F.lit("1234|order")), "qid").collect()
    drawn = {r.rec_id for r in m.where("target = 0").collect()}
    blocks = [[r.qid in drawn for r in order[k : k + 25]] for k in range(0, 1000, 25)]
    assert sum(all(x) for x in blocks) == 10 and sum(any(x) for x in blocks) == 10
    other = M.mix(df, F.col("qid"), [F.col("first"), ~F.col("first")], [0.5, 0.5], [1, 1], seed=5)
    assert {r.rec_id for r in other.where("target = 0").collect()} != drawn


def test_a_scarce_source_is_used_up():
    have, shares = [80_000_000, 20_000_000], [0.92, 0.08]
    block, seats = M.quotas(have, shares, [1, 1])
    assert abs(seats[1] / sum(seats) - 0.08) < 2 / M.MOST_BLOCKS and all(n <= h for n, h in zip(seats, have))
    assert sum(seats) > min(h / s for h, s in zip(have, shares)) - 2 * block


def test_empty_and_missing_sources(spark):
    r = records(spark, 20)
    assert M.mix(r.limit(0), F.col("qid"), [F.lit(True)], [1.0], [1]).count() == 0
    m = M.mix(r, F.col("qid"), [F.col("source") == "a", F.col("source") == "nobody"], [0.5, 0.5], [1, 1])
    assert m.count() == 20  # a target without records gets none, the other the whole
    t = spark.createDataFrame([], "mix_name string, source string, is_human boolean, target_share double, max_repeats int")
    assert M.mixtures(t, {}).count() == 0
