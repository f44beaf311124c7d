"""Mixing sources to target weights (problem 3).

Sainte-Laguë apportionment: a mixture is cut into equal blocks of records, and each block goes to the source with the
highest quotient weight / (2 * blocks so far + 1), as long as that source has blocks left (its records times the
repeats that are allowed). A source's records are then apportioned to its shards by largest remainders, by what they
hold, which gives each shard an integer quota. A shard cuts its records, in an order of their own, into blocks of the
same size and takes blocks in a seeded order until its quota is met, the last one in part.

Scale: the source table is read once, for keys and targets only, which are written to the shared folder. The driver gets
one count for each target; the shards' quotas are worked out by a window over their counts, and the number of shards
grows with the records, so that a task orders about ``SHARD_ROWS`` keys at any size.

Defined results: the total is the largest at which no source needs more than its repeats, so that all shares can be met;
a target without records, or of weight 0, gets none and the others share the total; a key that arrives again is one record
(of the first target that any of its rows meets); a null key is no record; a null source or flag meets no target that
names one; extra columns are ignored; an empty table gives an empty mixture.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from qirtas.lineage import written

#: A mixture is cut into at most so many blocks, so a share is met within about 1 / MOST_BLOCKS at any size.
MOST_BLOCKS = 20_000
#: Records of a shard, which one task orders.
SHARD_ROWS = 250_000
#: Mixture targets are configuration; a longer table is refused.
MOST_TARGETS = 512


def sainte_lague(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotients; a party at its cap leaves. Ties go to the earlier party."""
    got = [0] * len(weights)
    heap = [(-w, i) for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    heapq.heapify(heap)
    while seats > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        seats -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def quotas(have: list[int], shares: list[float], repeats: list[int]) -> tuple[int, list[int]]:
    """The block size of one mixture, and the records each target has to give (repeats counted)."""
    live = [t for t in range(len(shares)) if have[t] and shares[t] > 0 and repeats[t] > 0]
    if not live:
        return 1, [0] * len(shares)
    weight = sum(shares[t] for t in live)
    total = math.floor(min(have[t] * repeats[t] * weight / shares[t] for t in live) + 1e-9)
    block = max(1, total // MOST_BLOCKS)
    caps = [n * r // block for n, r in zip(have, repeats)]
    got = sainte_lague([shares[t] if t in live else 0 for t in range(len(shares))], caps, total // block)
    return block, [n * block for n in got]


def mix(records: DataFrame, key: Column, conditions: list[Column], shares: list[float], repeats: list[int], seed: int = 1234, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``target int, rec_id string, copies int``: the records of one mixture, each with how often it is used.

    ``conditions[i]`` says which records target ``i`` may draw; targets of one mixture exclude each other.
    """
    spark = records.sparkSession
    target = F.coalesce(*(F.when(c, F.lit(i)) for i, c in enumerate(conditions)))
    d = records.select(key.cast("string").alias("rec_id"), target.alias("target")).where("target is not null and rec_id is not null")
    d = written(d.groupBy("rec_id").agg(F.min("target").alias("target")), "mix")
    counts = {r.target: r.n for r in d.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a target
    have = [counts.get(t, 0) for t in range(len(shares))]
    block, seats = quotas(have, shares, repeats)
    n_shards = max(1, math.ceil(sum(have) / shard_rows))
    d = d.withColumn("shard", F.pmod(F.xxhash64("rec_id", F.lit(f"{seed}|shard")), F.lit(n_shards)))
    # largest remainders: what a shard holds of its target's records it gives of its seats
    of = spark.createDataFrame([(t, n, h) for t, (n, h) in enumerate(zip(seats, have)) if n], "target int, seats long, have long")
    q = d.groupBy("target", "shard").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(of), "target")  # at most MOST_TARGETS rows
    exact = F.col("seats").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")
    q = q.withColumn("low", F.floor(exact / F.col("have")).cast("long")).withColumn("rest", (exact - F.col("low").cast("decimal(20,0)") * F.col("have").cast("decimal(18,0)")).cast("long"))
    by = W.partitionBy("target")
    q = q.withColumn("more", F.col("seats") - F.sum("low").over(by)).withColumn("i", F.row_number().over(by.orderBy(F.desc("rest"), "shard")))
    q = q.withColumn("quota", F.col("low") + (F.col("i") <= F.col("more")).cast("long"))
    # quota = base * n + rest: every record base times, and blocks of records in seeded order once more up to the rest
    q = q.select("target", "shard", F.floor(F.col("quota") / F.col("n")).alias("base"), (F.col("quota") % F.col("n")).alias("rest"))
    of_shard = W.partitionBy("target", "shard")
    own = F.xxhash64("rec_id", F.lit(f"{seed}|order"))
    d = d.join(q, ["target", "shard"]).withColumn("block", F.floor((F.row_number().over(of_shard.orderBy(own, "rec_id")) - 1) / block))
    drawn = F.md5(F.concat_ws("|", F.lit(seed), "target", "shard", "block"))
    d = d.withColumn("rank", F.row_number().over(of_shard.orderBy(drawn, "block", own, "rec_id")))
    return d.select("target", "rec_id", (F.col("base") + (F.col("rank") <= F.col("rest")).cast("int")).cast("int").alias("copies")).where("copies > 0")


def clean_source(c: Column) -> Column:
    return F.lower(F.trim(c))


#: Sources of the kinds of weak pairs (fixed values); the kind is clean where the source is not.
KIND_SOURCE = {"news": "news", "wiki_lead": "wiki", "wiki_section": "wiki", "xlsum_title": "xlsum", "xlsum_summary": "xlsum", "arabicaqa": "qa", "aya": "qa", "qa_mined": "qa_mined", "spans": "spans"}


def pair_source() -> Column:
    by_kind = F.coalesce(*(F.when(F.col("kind") == k, F.lit(s)) for k, s in KIND_SOURCE.items()))
    return F.coalesce(by_kind, clean_source(F.col("source")))


def mixtures(targets: DataFrame, tables: dict[str, tuple[DataFrame, Column, Column]], seed: int = 1234) -> DataFrame:
    """All mixtures of ``targets(mix_name, source, is_human, target_share, max_repeats)``.

    ``tables`` gives for each mixture its records, their key and their source. Result: ``mix_name, source, is_human,
    target_share, max_repeats, rec_id, copies``, one row per record that is used.
    """
    rows = targets.select("mix_name", "source", "is_human", "target_share", "max_repeats").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    out = None
    for name in sorted({r.mix_name for r in rows}):
        own = sorted((r for r in rows if r.mix_name == name), key=lambda r: (r.source or "", str(r.is_human)))
        records, key, source = tables[name]
        conditions = []
        for r in own:
            c = F.lit(True)
            if r.source is not None:
                c &= source == r.source.strip().lower()
            if r.is_human is not None:
                c &= F.col("is_human") == F.lit(r.is_human)
            conditions.append(c)
        one = mix(records, key, conditions, [r.target_share for r in own], [r.max_repeats for r in own], seed)
        at = F.element_at(F.array(*(F.struct(*(F.lit(v).cast(t).alias(c) for c, v, t in (("source", r.source, "string"), ("is_human", r.is_human, "boolean"), ("target_share", r.target_share, "double"), ("max_repeats", r.max_repeats, "int")))) for r in own)), F.col("target") + 1)
        one = one.select(F.lit(name).alias("mix_name"), at.alias("t"), "rec_id", "copies").select("mix_name", "t.*", "rec_id", "copies")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = targets.sparkSession.createDataFrame([], "mix_name string, source string, is_human boolean, target_share double, max_repeats int, rec_id string, copies int")
    return out


def share_report(mixed: DataFrame) -> DataFrame:
    """Actual shares: ``mix_name, source, is_human, target_share, max_repeats, n_records, n_drawn, most_copies, actual_share``."""
    g = mixed.groupBy("mix_name", "source", "is_human", "target_share", "max_repeats").agg(F.count(F.lit(1)).alias("n_records"), F.sum("copies").alias("n_drawn"), F.max("copies").alias("most_copies"))
    return g.withColumn("actual_share", F.round(F.col("n_drawn") / F.sum("n_drawn").over(W.partitionBy("mix_name")), 6))
