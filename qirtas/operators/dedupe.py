"""MinHash near duplicates, with all pairs of a bucket or the reference's linear candidates, and merging of duplicate queries."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qirtas.functions import text as X
from qirtas.lineage import written
from qirtas.operators.components import connected_components

PRIME = 2147483647
#: Signatures a tile holds; larger band buckets are cut into tiles.
TILE = 2048


def permutations(n: int = 64, seed: int = 1234) -> list[tuple[int, int]]:
    """Multipliers and offsets below 2^31, so that nothing overflows."""
    r = random.Random(seed)
    return [(r.randrange(1, PRIME), r.randrange(PRIME)) for _ in range(n)]


def shingle_hash(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % PRIME


def signatures(docs: DataFrame, key: str, text: Column, n: int = 64, run: int = 5) -> DataFrame:
    """``key, sig array<long>``: minima of ``n`` permutations over the hashed word runs (the whole text where it is
    shorter, 0 without words). The minima combine before the shuffle."""
    w = F.regexp_extract_all(F.lower(text), F.lit(X.WORD), 0)
    grams = X.let(w, lambda v: F.when(F.size(v) >= run, X.ngrams(v, run)).otherwise(F.array(F.array_join(v, " "))))
    d = docs.select(key, F.explode(F.array_distinct(grams)).alias("g"))
    h = F.when(F.col("g") == "", F.lit(0).cast("long")).otherwise(shingle_hash(F.col("g")))
    d = d.select(key, h.alias("h"))
    g = d.groupBy(key).agg(*(F.min((F.col("h") * a + b) % PRIME).alias(f"m{i}") for i, (a, b) in enumerate(permutations(n))))
    return g.select(key, F.array(*(f"m{i}" for i in range(n))).alias("sig"))


def candidate_pairs(sigs: DataFrame, key: str, bands: int = 16) -> DataFrame:
    """``a, b`` (a < b): in every band bucket each member with the first and with the one before it (the
    reference's rule). It loses links: of members that are neither neighbours nor first, none is compared. ``all_links``
    loses none."""
    n = sigs.select(F.size("sig")).first()
    rows = (n[0] if n else bands) // bands
    parts = F.array(*(F.struct(F.lit(i).alias("band"), F.md5(F.array_join(F.slice("sig", i * rows + 1, rows), ",")).alias("bucket")) for i in range(bands)))
    d = sigs.select(key, F.explode(parts).alias("p")).select(key, "p.band", "p.bucket")
    w = W.partitionBy("band", "bucket").orderBy(key)
    d = d.select(F.col(key).alias("b"), F.lag(key).over(w).alias("prev"), F.first(key).over(w).alias("first")).where("prev is not null")
    return d.select(F.explode(F.array_distinct(F.array("first", "prev"))).alias("a"), "b").where("a < b").distinct()


def estimated(pairs: DataFrame, sigs: DataFrame, key: str, threshold: float = 0.8) -> DataFrame:
    """``a, b, est``: candidates whose signatures agree often enough."""
    x = sigs.select(F.col(key).alias("a"), F.col("sig").alias("sa"))
    y = sigs.select(F.col(key).alias("b"), F.col("sig").alias("sb"))
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda p, q: p == q), lambda v: v)) / F.size("sa")
    return pairs.join(x, "a").join(y, "b").select("a", "b", same.alias("est")).where(F.col("est") >= threshold)


def compared(h: np.ndarray, side: np.ndarray, ids: np.ndarray, sigs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest id and agreement of the pairs inside each run of equal ``h`` that agree at ``least`` places.
    Side 3 meets all; otherwise only rows of different sides meet."""
    end = np.searchsorted(h, h, side="right")
    at, d = np.flatnonzero(np.arange(len(h)) + 1 < end), 1
    found = [(np.zeros(0, np.int64),) * 3]
    while len(at):
        for part in np.array_split(at, len(at) // 20_000 + 1):
            to = part + d
            ok = (side[part] == 3) | (side[part] != side[to])
            part, to = part[ok], to[ok]
            same = (sigs[part] == sigs[to]).sum(axis=1)
            ok = (same >= least) & (ids[part] != ids[to])
            x, y = ids[part[ok]], ids[to[ok]]
            found.append((np.minimum(x, y), np.maximum(x, y), same[ok]))
        d += 1
        at = at[at + d < end[at]]
    return tuple(np.concatenate(c) for c in zip(*found))


def all_links(sigs: DataFrame, key: str, threshold: float = 0.8, bands: int = 16, tile: int = TILE) -> DataFrame:
    """``a, b, est`` (a < b) for ``sigs(key long, sig)``: documents of equal signature linked to the least of them, which
    stands for all, and all pairs of those whose signatures agree at ``threshold`` of their places or more.

    All members of a band bucket are compared, in tiles of bounded size where it is large. Signatures that differ at m
    places agree in one of any m + 1 bands, so that many bands are enough, and with fewer than ``bands`` such places
    no pair is lost; a lower threshold is refused."""
    first = sigs.select(F.size("sig")).first()
    size = first[0] if first else bands
    rows, least = size // bands, math.ceil(threshold * size - 1e-9)
    used = size - least + 1
    if used > bands:
        raise ValueError(f"{bands} bands can't find all pairs that agree at {threshold}")
    classes = sigs.groupBy("sig").agg(F.min(key).alias("rep"))
    classes = written(classes.select(F.col("rep").cast("long").alias("id"), "sig"), "classes")
    copies = sigs.select(F.col(key).cast("long").alias("b"), "sig").join(classes.withColumnRenamed("id", "a"), "sig").where("a <> b").select("a", "b", F.lit(1.0).alias("est"))
    h = F.array(*(F.xxhash64(F.lit(i), F.slice("sig", i * rows + 1, rows)) for i in range(used)))
    d = written(classes.select("id", F.explode(h).alias("bucket")), "buckets")
    n = d.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / tile).alias("n"), F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket", "n")
    d = d.join(n, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), "n"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(lo == hi, 3).when(F.col("own") == lo, 1).otherwise(2)
    d = d.select(F.xxhash64("bucket", lo, hi).alias("h"), side.cast("int").alias("side"), "id").join(classes, "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def pairs(c: list[np.ndarray]) -> pa.RecordBatch:
            a, b, same = compared(*c, least)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(same / size)], names=["a", "b", "est"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c = [batch.column(i).to_numpy() for i in range(3)] + [batch.column(3).flatten().to_numpy().astype(np.int32).reshape(-1, size)]
            if rest is not None:
                c = [np.concatenate(x) for x in zip(rest, c)]
            last = np.searchsorted(c[0], c[0][-1])  # this tile pair may go on in the next batch
            rest = [x[last:].copy() for x in c]
            if last:
                yield pairs([x[:last] for x in c])
        if rest is not None:
            yield pairs(rest)

    links = d.select("h", "side", "id", "sig").repartition("h").sortWithinPartitions("h").mapInArrow(run, "a long, b long, est double").distinct()
    return links.unionAll(copies)


def keepers(docs: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """``key, keeper``: the least document of each near-duplicate group; alone, a document keeps itself."""
    comp = connected_components(links)
    return docs.select(key).join(comp.select(F.col("id").alias(key), "component"), key, "left").select(key, F.coalesce("component", key).alias("keeper"))


def merge_queries(queries: DataFrame, order: list[str]) -> DataFrame:
    """Duplicate queries merged into the first copy in ``order``: positives in order of appearance, negatives without
    positives, and how many copies went in. ``queries`` has ``key`` beside the usual columns. A key's copies are never
    collected: each passage keeps its first appearance, combined before the shuffle, so a hot key costs its passages."""
    by = [*order, "qid"]
    first = queries.groupBy("key").agg(F.min(F.struct(*by)).alias("f"), F.count(F.lit(1)).alias("n_copies"))

    def side(c: str) -> DataFrame:
        e = queries.select("key", *by, F.posexplode(c).alias("i", "pid"))
        e = e.groupBy("key", "pid").agg(F.min(F.struct(*by, "i")).alias("at"))
        return e.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "pid"))), lambda x: x["pid"]).alias(c))

    none = F.array().cast("array<string>")
    d = first.join(side("pos_pids"), "key", "left").join(side("neg_pids"), "key", "left")
    d = d.select(F.col("f.qid").alias("qid"), "n_copies", F.coalesce("pos_pids", none).alias("pos_pids"), F.coalesce("neg_pids", none).alias("neg_pids"))
    return d.withColumn("neg_pids", F.array_except("neg_pids", "pos_pids"))


def groups_of(keepers_: DataFrame, key: str) -> DataFrame:
    """``n_groups, n_members, n_removed, largest`` of ``keepers``' result: groups of two documents or more."""
    n = keepers_.groupBy("keeper").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return n.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_members"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_removed"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def drop_passages(queries: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take ``bad(pid)`` out of positives and negatives; (queries that keep a positive, those that lost all).

    The arrays are exploded and anti-joined, so the bad set may be large."""
    d = queries.select("qid", "pos_pids", "neg_pids")
    parts = []
    for side in ("pos_pids", "neg_pids"):
        e = d.select("qid", F.posexplode(side).alias("i", "pid")).join(bad.select("pid"), "pid", "left_anti")
        parts.append(e.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "pid"))), lambda x: x["pid"]).alias(side)))
    empty = F.array().cast("array<string>")
    rest = queries.drop("pos_pids", "neg_pids").join(parts[0], "qid", "left").join(parts[1], "qid", "left").withColumns({"pos_pids": F.coalesce("pos_pids", empty), "neg_pids": F.coalesce("neg_pids", empty)})
    return rest.where(F.size("pos_pids") > 0), rest.where(F.size("pos_pids") == 0)
