"""Near-duplicate records (problem 7).

The measure is the Jaccard similarity of the sets of three-word runs of query and passage. Records are compared by
tiled exact comparison of 256-bit fingerprints with exclusive-or and bit counts. A fingerprint has one bit for each
hashed run, so two records with sets A and B differ in at most |A Δ B| bits, and a similarity of at least t means
|A Δ B| <= (|A| + |B|) (1 - t) / (1 + t): within that radius nothing is lost. What passes is verified on the run sets.

The tiles don't cover all pairs of the collection. A run is frequent if its counter, in a sketch of 2^20 counters over
the whole collection (a fixed size), is far above the mean, so every worker knows which runs are. Two similar records
share at least o = t (|A| + |B|) / (1 + t) runs, and one of two things holds:

* They share a run that is not frequent. In the order "frequent runs last, then by hash" each then has such a run among
  its first |A| - ceil(t |A|) + 1 runs. Records meet in the blocks of these runs. Blocks are counted exactly: those of
  one record go, as do rows without a partner of fitting size, and one of more than a tile's rows is sorted by number of
  runs and cut into tiles; tile pairs further apart than the radius are skipped, the others are compared in different
  tasks, where rows are sorted by bit count and those too far apart skipped again.
* They share only frequent runs, o or more of them. Then each consists of frequent runs for the share t at least (what
  remains of a template), and all records with the same frequent runs and the same number of runs stand for each other:
  they form a class, and classes are compared in blocks of their frequent runs as records are. Two classes that share o
  runs are linked as a whole, so a template of n records that are too different costs n rows and no pairs.

Copies are taken together first: of the records with the same word sequence only the least takes part, and its links
hold for all.

Defined results: null query or passage is no words; passages under ``least_words`` words are in no class and have no
links; records whose key is null are left out; repeated rows of one key count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.lineage import written
from qirtas.llm.words import WordHashes, bare

RUN = 3
#: Bytes of a hashed run.
RUN_BYTES = 6
LEAST_WORDS = 20
SIMILARITY = 0.6
SKETCH_BITS = 20
#: Rows a tile holds; blocks of more rows are cut into tiles.
TILE = 512
#: A run is frequent if its counter is above USUAL + TIMES * the mean counter.
USUAL, TIMES = 24, 1.5
#: Id tables of up to this many rows (16 bytes each) are broadcast, larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
SLICE = 2000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_of(words: np.ndarray, ends: np.ndarray, n: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-word runs of each text as ``RUN_BYTES``-byte numbers, sorted, and the offsets of the texts."""
    k = len(ends) - 1
    sizes = np.maximum(np.diff(ends) - n + 1, 0)
    if len(words) < n or not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(k + 1, np.int64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = mixed(h * _GOLD + words[i : len(words) - n + 1 + i])
    doc = np.repeat(np.arange(k), sizes)
    start = np.repeat(ends[:-1] - (np.cumsum(sizes) - sizes), sizes)
    h = h[np.arange(len(doc)) + start] >> np.uint64(64 - 8 * RUN_BYTES)
    order = np.lexsort((h, doc)) if k >> 16 else None  # the number of the text fits above the run for up to 2^16 texts
    if order is None:
        both = np.sort((doc.astype(np.uint64) << np.uint64(8 * RUN_BYTES)) | h)
        h, doc = both & np.uint64((1 << 8 * RUN_BYTES) - 1), (both >> np.uint64(8 * RUN_BYTES)).astype(np.int64)
    else:
        h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    return h[new], np.searchsorted(doc[new], np.arange(k + 1)).astype(np.int64)


def packed(runs: np.ndarray) -> bytes:
    """Runs as little-endian numbers of ``RUN_BYTES`` bytes."""
    return np.ascontiguousarray(runs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :RUN_BYTES]).tobytes()


def unpacked(data: bytes | memoryview) -> np.ndarray:
    out = np.zeros((len(data) // RUN_BYTES, 8), np.uint8)
    out[:, :RUN_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, RUN_BYTES)
    return out.reshape(-1).view("<u8")


def sets_of(pairs: DataFrame, key: str, query: str, passage: str, least_words: int) -> DataFrame:
    """``id, k1, k2, n, runs binary``: run sets (``packed``, sorted) and a 128-bit hash of the word sequence."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(bare)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                q, p = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                words, ends = hashes.flat(x for pair in zip(q, p) for x in pair)
                keep = (ends[2::2] - ends[1::2]) >= least_words
                ends = ends[::2]
                runs, at_run = runs_of(words, ends)
                place = mixed(np.arange(len(words), dtype=np.uint64) - np.repeat(ends[:-1], np.diff(ends)).astype(np.uint64) + np.uint64(1))
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(words * m + place))]) for m in (np.uint64(3), _GOLD)]
                k1, k2 = ((s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums)
                data = packed(runs)
                cut = (at_run * RUN_BYTES).tolist()
                blobs = [data[a:b] for a, b in zip(cut, cut[1:])]
                out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1), pa.array(k2), pa.array(np.diff(at_run).astype(np.int32)), pa.array(blobs, pa.binary())], names=["id", "k1", "k2", "n", "runs"])
                yield out.filter(pa.array(keep))

    d = pairs.select(F.col(key).cast("long").alias("id"), F.col(query).alias("q"), F.col(passage).alias("p")).where("id is not null and p is not null")
    return d.mapInArrow(run, "id long, k1 long, k2 long, n int, runs binary")


def flat_runs(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    a = batch.column(column)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = memoryview(a.buffers()[2])[offsets[0] : offsets[-1]] if a.buffers()[2] is not None else b""
    return unpacked(data), (offsets - offsets[0]) // RUN_BYTES


def frequent_runs(sets: DataFrame) -> np.ndarray:
    """The sketch: for each counter whether its runs are frequent. The number of counters is fixed."""
    size, chunk = 1 << SKETCH_BITS, 1 << 14

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount((flat_runs(batch, "runs")[0] & np.uint64(size - 1)).astype(np.int64), minlength=size)
        parts = total.reshape(-1, chunk)
        used = np.flatnonzero(parts.any(axis=1))
        # most counters fit a byte; the others follow as (place, rest)
        over = [np.flatnonzero(parts[i] > 255) for i in used]
        rest = [np.stack([o, parts[i][o] - 255]).astype(np.int64).tobytes() for i, o in zip(used, over)]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([np.minimum(parts[i], 255).astype(np.uint8).tobytes() for i in used], pa.binary()), pa.array(rest, pa.binary())], names=["c", "v", "o"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(chunk, np.int64)
        for v, o in zip(t.column("v").to_pylist(), t.column("o").to_pylist()):
            total += np.frombuffer(v, np.uint8)
            at, rest = np.frombuffer(o, np.int64).reshape(2, -1)
            total[at] += rest
        return pa.table({"c": t.column("c").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    rows = sets.select("runs").mapInArrow(count, "c int, v binary, o binary").groupBy("c").applyInArrow(add, "c int, v binary").collect()
    total = np.zeros((size // chunk, chunk), np.int64)
    for r in rows:
        total[r.c] = np.frombuffer(r.v, np.int64)
    total = total.reshape(-1)
    return total > USUAL + TIMES * total.mean()


def spread(runs: np.ndarray) -> np.ndarray:
    return mixed(runs + _GOLD)


def prints(runs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """256-bit fingerprints of run sets, as four numbers each."""
    bit = (spread(runs) >> np.uint64(56)).astype(np.int64)
    out = np.zeros((len(ends) - 1, 4), np.uint64)
    full = np.flatnonzero(np.diff(ends))
    for j in range(4 if len(full) else 0):
        b = np.where(bit >> 6 == j, np.uint64(1) << (bit & 63).astype(np.uint64), np.uint64(0))
        out[full, j] = np.bitwise_or.reduceat(b, ends[:-1][full])
    return out


def least(similarity: float, n: np.ndarray) -> np.ndarray:
    """ceil(similarity * n): the runs that a record of n runs shares at least with a similar one."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def together(similarity: float, n: np.ndarray | int) -> np.ndarray:
    """The least number of common runs that makes two records of n runs together similar."""
    return np.ceil(similarity / (1 + similarity) * n - 1e-9)


def fingerprints(sets: DataFrame) -> DataFrame:
    """``id, f0..f3`` of ``sets(id, runs)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = prints(*flat_runs(batch, "runs"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(np.ascontiguousarray(f[:, j]).view(np.int64)) for j in range(4))], names=["id", "f0", "f1", "f2", "f3"])

    return sets.select("id", "runs").mapInArrow(run, "id long, f0 long, f1 long, f2 long, f3 long")


POSTING = ["k", "id"]
#: Numbers of runs are told apart in steps of 1/256 octave and up to 2^16, places in sixteenths of the prefix.
OCTAVE, MOST_SIZE, PLACES = 256, (1 << 12) - 1, 16


def posting(runs: np.ndarray, n: np.ndarray, passed: np.ndarray, similarity: float) -> np.ndarray:
    """One number for a run (48 bits), a record's number of runs (12 bits, rounded) and how many runs come before this
    one (4 bits, rounded down): rows of a run sorted by it are sorted by their number of runs."""
    size = np.minimum(np.floor(OCTAVE * np.log2(np.maximum(n, 1)) + 1e-9), MOST_SIZE).astype(np.uint64)
    place = np.clip(passed / np.maximum(n, 1) / (1 - similarity) * PLACES, 0, PLACES - 1).astype(np.uint64)
    return ((runs << np.uint64(16)) | (size << np.uint64(4)) | place).view(np.int64)


def bounds(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least and the largest number of runs that a posting stands for, and the least share passed."""
    size = (k >> 4) & MOST_SIZE
    return np.exp2(size / OCTAVE) - 1e-6, np.where(size < MOST_SIZE, np.exp2((size + 1) / OCTAVE) + 1e-6, np.inf), (k & 15) / PLACES


def largest(n: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """The number of runs of the largest partner a record of ``n`` runs can meet at a run before which the share
    ``place`` of its prefix lies: the rest holds all common runs, so n - passed >= t (n + partner) / (1 + t)."""
    return n / similarity - place * (1 - similarity) * n * (1 + similarity) / similarity + 1e-6


def postings_of(sets: DataFrame, frequent, similarity: float) -> DataFrame:
    """``k, id``: the blocks of each record of ``sets(id, n, runs)`` as ``posting`` numbers. A pair counts in the block of
    the first run that it shares.

    ``frequent`` is the broadcast sketch; frequent runs come last and make no blocks. Without it all runs are alike, and
    ``runs`` may be a part of the ``n`` runs of which at least ``similarity * n`` are shared.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value if frequent is not None else np.zeros(1, bool)
        mask = np.uint64(len(often) - 1)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                runs, ends = flat_runs(batch, "runs")
                m = np.diff(ends)
                n = batch.column("n").to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(m)), m)
                often_ = often[(runs & mask).astype(np.int64)]
                rank = (often_.astype(np.uint64) << np.uint64(63)) | (spread(runs) >> np.uint64(1))
                order = np.lexsort((rank, doc))
                place = np.arange(len(doc)) - np.repeat(ends[:-1], m)
                prefix = np.repeat(m - least(similarity, n) + 1, m)
                taken = np.flatnonzero((place < prefix) & ~often_[order])
                first = order[taken]
                d = doc[first]
                passed = n[d] - m[d] + place[taken]  # runs that are left out of a part cannot be shared either
                yield pa.RecordBatch.from_arrays([pa.array(posting(runs[first], n[d], passed, similarity)), pa.array(batch.column("id").to_numpy()[d])], names=POSTING)

    return sets.select("id", "n", "runs").mapInArrow(run, "k long, id long")


def block_of(c: dict[str, np.ndarray]) -> list[np.ndarray]:
    """What the rows of a block (and, where rows are tiled, of a tile pair) have in common."""
    return [c["k"] >> 16, c["t"]] if "t" in c else [c["k"] >> 16]


def whole_blocks(batches: Iterable[pa.RecordBatch], names: list[str], of: Callable[[dict[str, np.ndarray]], list[np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
    """Batches of a sorted stream as arrays that hold every block in one piece."""
    rest: dict[str, list[np.ndarray]] = {k: [] for k in names}
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {k: batch.column(k).to_numpy() for k in names}
        last, keys = 0, of(c)
        for k in keys:
            last += int(np.argmax(k[last:] == k[-1]))
        if last or (rest[names[0]] and any(x[0] != y[0] for x, y in zip(of({k: v[0][:1] for k, v in rest.items()}), keys))):
            yield {k: np.concatenate([*rest[k], c[k][:last]]) for k in names}
            rest = {k: [] for k in names}
        for k in names:
            rest[k].append(c[k][last:].copy())
    if rest[names[0]]:
        yield {k: np.concatenate(v) for k, v in rest.items()}


def starts_of(c: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    """Where blocks begin, and the end."""
    n = len(c[keys[0]])
    new = np.zeros(max(0, n - 1), bool)
    for k in keys:
        new |= c[k][1:] != c[k][:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]])


def meeting(c: dict[str, np.ndarray], tile: int, similarity: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The rows that have a partner in their block, as far as the numbers of runs tell: each of the two is small enough
    for the other. Blocks of more than ``tile`` rows stay whole. Rows come out by block and number of runs."""
    order = np.lexsort((c["id"], c["k"]))
    c = {k: v[order] for k, v in c.items()}
    low, high, place = bounds(c["k"])
    most = np.where(np.isfinite(high), largest(high, place, similarity), np.inf)
    h = c["k"] >> 16
    starts = starts_of({"h": h}, ["h"])
    size = np.diff(starts)
    end = np.repeat(starts[1:], size)
    keep = np.repeat(size > tile, size)
    at = np.flatnonzero(~keep & (np.arange(len(h)) + 1 < end))
    d = 1
    while len(at):
        at = at[low[at + d] <= most[at]]  # sorted by size: those further on are too large as well
        ok = low[at] <= most[at + d]
        keep[at[ok]] = keep[at[ok] + d] = True
        d += 1
        at = at[at + d < end[at]]
    return {k: v[keep] for k, v in c.items()}, starts_of({"h": h[keep]}, ["h"])


TILED = ["k", "t", "side", "id"]


def tiles(postings: DataFrame, similarity: float, tile: int) -> DataFrame:
    """``k, t, side, id``: the tile pairs each posting takes part in. Postings without a partner are left out; a block of
    up to ``tile`` rows is one tile (t = 0, side = 3). A larger one is sorted by number of runs, which bounds the bit
    count from above, and of its tile pairs those beyond the radius are left out. ``side`` tells the two tiles of a pair
    apart (1 and 2; 3 for a tile with itself)."""
    reach = (1 - similarity) / (1 + similarity) + 1e-9

    def out(t: np.ndarray, side: np.ndarray, c: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (c["k"], t, side, c["id"])], names=TILED)

    def large(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = len(c["k"])
        at = np.arange(0, n, tile)
        low, high, _ = bounds(c["k"])
        low, high = low[at], high[np.minimum(at + tile, n) - 1]
        for i in range(len(at)):
            for j in (np.flatnonzero(low[i:] <= high[i] + reach * (high[i] + high[i:])) + i).tolist():
                part = np.arange(at[i], min(at[i] + tile, n))
                side = np.full(len(part), 3, np.int8)
                if i < j:
                    other = np.arange(at[j], min(at[j] + tile, n))
                    side = np.repeat(np.array([1, 2], np.int8), [len(part), len(other)])
                    part = np.concatenate([part, other])
                yield out(np.full(len(part), i * len(at) + j + 1), side, {k: v[part] for k, v in c.items()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in whole_blocks(batches, POSTING, block_of):
            c, starts = meeting(c, tile, similarity)
            size = np.diff(starts)
            small = np.repeat(size <= tile, size)
            few = {k: v[small] for k, v in c.items()}
            yield out(np.zeros(len(few["k"]), np.int64), np.full(len(few["k"]), 3, np.int8), few)
            for k in np.flatnonzero(size > tile):
                yield from large({x: v[starts[k] : starts[k + 1]] for x, v in c.items()})

    return postings.repartition(F.shiftright("k", 16)).sortWithinPartitions("k").mapInArrow(run, "k long, t long, side byte, id long")


def compare_tiles(c: dict[str, np.ndarray], bits: np.ndarray, starts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions) inside each run of rows ``starts[i]:starts[i+1]`` whose fingerprints lie within the radius.

    Rows of a block are sorted by bit count. The comparison goes along the diagonals of the blocks: step d compares each
    row with the one d places on, and a row leaves once that one's bit count is too far away or in another block. In a
    pair of two different tiles only rows of different tiles meet; the others meet in their own tile.
    """
    reach = (1 - similarity) / (1 + similarity) + 1e-9
    ids, side = c["id"], c["side"]
    low, n, place = bounds(c["k"])  # the upper bound of the number of runs loses no pair
    small = np.where(np.isfinite(n), largest(n, place, similarity), np.inf)
    count = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    left, right = [], []
    end = np.repeat(starts[1:], np.diff(starts))
    at = np.flatnonzero(np.arange(len(n)) + 1 < end)
    d = 1
    # the radius of a pair is at most that of the row with the block's largest set
    most = np.repeat(np.maximum.reduceat(n, starts[:-1]), np.diff(starts)) if len(n) else n
    while len(at):
        to = at + d
        near = (count[to] - count[at]) <= reach * (n[at] + most[at])
        at, to = at[near], to[near]
        ok = (low[to] <= small[at]) & (low[at] <= small[to]) & (ids[at] != ids[to]) & ((side[at] == 3) | (side[at] != side[to]))
        i, j = at[ok], to[ok]
        ok = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= reach * (n[i] + n[j])
        left.append(i[ok])
        right.append(j[ok])
        d += 1
        at = at[at + d < end[at]]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def candidates(tiled: DataFrame, prints_: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` (a < b): pairs of a block within the radius, each at least once."""
    names = [*TILED, "f0", "f1", "f2", "f3"]

    def pairs(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        bits = np.stack([c[f].view(np.uint64) for f in ("f0", "f1", "f2", "f3")], axis=1)
        order = np.lexsort((np.bitwise_count(bits).sum(axis=1, dtype=np.int64), c["t"], c["k"] >> 16))
        c = {k: v[order] for k, v in c.items()}
        i, j = compare_tiles(c, bits[order], starts_of({"h": c["k"] >> 16, "t": c["t"]}, ["h", "t"]), similarity)
        a, b = c["id"][i], c["id"][j]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in whole_blocks(batches, names, block_of):
            yield pairs(c)

    p = tiled.join(prints_, "id").select(*names).repartition(F.shiftright("k", 16), "t").sortWithinPartitions(F.shiftright("k", 16), "t")
    return p.mapInArrow(run, "a long, b long").distinct()


def heavy_classes(sets: DataFrame, frequent, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The records that may be similar by frequent runs alone, by class: ``cls, n, runs`` (the frequent ones) of each
    class, and ``id, cls`` of each record. Equal frequent runs and an equal number of runs make a class; its name is its
    least id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in batches:
            runs, ends = flat_runs(batch, "runs")
            is_often = often[(runs & np.uint64(len(often) - 1)).astype(np.int64)]
            f = np.concatenate([[0], np.cumsum(is_often)])[ends]
            n = batch.column("n").to_numpy().astype(np.int64)
            heavy = np.flatnonzero((np.diff(f) >= least(similarity, n)) & (n > 0))
            kept = runs[is_often]
            blobs = [packed(kept[f[k] : f[k + 1]]) for k in heavy.tolist()]
            keys = [xxhash.xxh3_128_digest(b + int(n[k]).to_bytes(8, "little")) for b, k in zip(blobs, heavy.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(heavy)), pa.array(n[heavy].astype(np.int32)), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["id", "n", "key", "runs"])

    heavy = written(sets.select("id", "n", "runs").mapInArrow(run, "id long, n int, key binary, runs binary"), "heavy")
    classes = heavy.groupBy("key").agg(F.min("id").alias("cls"), F.min("n").alias("n"), F.min("runs").alias("runs"))
    of = heavy.select("id", "key").join(classes.select("key", "cls"), "key").select("id", "cls")
    return classes.select("cls", "n", "runs"), of


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` where it has at most ``BROADCAST_ROWS`` rows; beyond that joins shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def verify(pairs: DataFrame, sets: DataFrame, similarity: float, frequent=None) -> DataFrame:
    """``a, b, similarity``: the pairs that share enough of their ``n`` runs. With ``frequent``, pairs whose frequent runs
    alone are enough are left out: their classes are linked."""
    pairs = written(pairs, "candidates")
    n = pairs.count()
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    part = sets.select("id", "n", "runs").join(sized(ids, 2 * n), "id", "left_semi").dropDuplicates(["id"])
    of = lambda x: part.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("runs").alias(f"r{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value if frequent is not None else None
        for batch in batches:
            n = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            need = together(similarity, n)
            common, by_often = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
            for k, (x, y) in enumerate(zip(batch.column("ra").to_pylist(), batch.column("rb").to_pylist())):
                shared = np.intersect1d(unpacked(x), unpacked(y), assume_unique=True)
                common[k] = len(shared)
                if often is not None and len(shared) >= need[k]:
                    by_often[k] = often[(shared & np.uint64(len(often) - 1)).astype(np.int64)].sum() >= need[k]
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common / np.maximum(1, n - common))], names=["a", "b", "similarity"])
            yield out.filter(pa.array((common >= need) & (n > 0) & ~by_often))

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, similarity double")


@dataclass
class Near:
    """``links(a, b, similarity)`` between representatives of copies; ``classes(id, cls)`` of representatives and
    ``class_links(a, b)`` between classes (a <= b), which link every member of one to every member of the other (and, for
    a = b, the members to each other); ``members(id, rep)`` of the groups of copies of at least two records."""

    links: DataFrame
    classes: DataFrame
    class_links: DataFrame
    members: DataFrame


def near_duplicates(pairs: DataFrame, key: str = "pair_id", query: str = "query", passage: str = "passage", similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, tile: int = TILE) -> Near:
    sets = written(sets_of(pairs, key, query, passage, least_words), "runs")
    seq = sets.select("id", "k1", "k2")
    copies = seq.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last")
    copies = written(copies.select("k1", "k2", "rep"), "copies")
    members = written(seq.join(sized(copies, copies.count()), ["k1", "k2"]).select("id", "rep").distinct(), "members")
    again = members.where("id <> rep").select("id")
    reps = sets.join(sized(again, members.count()), "id", "left_anti")
    frequent = pairs.sparkSession.sparkContext.broadcast(frequent_runs(sets))  # a fixed size: one byte for each counter
    found = candidates(tiles(postings_of(reps, frequent, similarity), similarity, tile), fingerprints(reps).dropDuplicates(["id"]), similarity)
    links = verify(found, reps, similarity, frequent)
    classes, of = heavy_classes(reps, frequent, similarity)
    as_sets = written(classes.select(F.col("cls").alias("id"), "n", "runs"), "classes")
    across = verify(candidates(tiles(postings_of(as_sets, None, similarity), similarity, tile), fingerprints(as_sets), similarity), as_sets, similarity)
    own = as_sets.where(F.length("runs") / RUN_BYTES >= F.ceil(F.col("n") * 2 * similarity / (1 + similarity) - 1e-9)).select(F.col("id").alias("a"), F.col("id").alias("b"))
    return Near(links, of, written(across.select("a", "b").union(own), "class-links"), members)


def all_pairs(near: Near, a: str = "pair_a", b: str = "pair_b") -> DataFrame:
    """The links between records: the pairs inside a group of copies, and each link for all members and copies."""
    members = near.members.select("id", "rep")
    inside = members.alias("x").join(members.alias("y"), F.col("x.rep") == F.col("y.rep")).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    of_class = lambda side: near.classes.select(F.col("cls").alias(side), F.col("id").alias(f"m{side}"))
    by_class = near.class_links.join(of_class("a"), "a").join(of_class("b"), "b").where("a <> b or ma < mb").select(F.col("ma").alias("a"), F.col("mb").alias("b"))
    of = lambda side: members.select(F.col("rep").alias(side), F.col("id").alias(f"m{side}"))
    across = near.links.select("a", "b").union(by_class).join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b"))
    d = inside.union(across)
    return d.select(F.least("a", "b").alias(a), F.greatest("a", "b").alias(b)).distinct()


def groups(pairs: DataFrame, near: Near, key: str = "pair_id") -> DataFrame:
    """``key, class_id, n_links, group_id`` for every record: the least of its copies, how many other groups of copies
    this one is linked to, and the least record of the group that the links connect. No link between classes is
    expanded: their sizes are added up, and a class hangs together by its least member."""
    from qirtas.operators.components import connected_components

    links = written(near.links, "verified")
    sizes = near.classes.groupBy("cls").agg(F.count(F.lit(1)).alias("size"))
    ids = pairs.select(F.col(key).cast("long").alias("id")).where("id is not null").distinct()
    ends = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    both = near.class_links.select("a", "b").union(near.class_links.where("a <> b").select("b", "a"))
    by_class = both.join(sizes.select(F.col("cls").alias("b"), "size"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum(F.col("size") - (F.col("a") == F.col("b")).cast("int")).alias("n"))
    in_class = near.classes.join(by_class, "cls").select(F.col("id").alias("rep"), "n")
    n = ends.unionAll(in_class).groupBy("rep").agg(F.sum("n").alias("n_links"))
    linked = both.select(F.col("a").alias("cls")).distinct()
    # a class with itself or another: where its members are linked to anything by class, they are in one group with it,
    # directly or by the other class
    star = near.classes.join(linked, "cls").where("id <> cls").select(F.col("cls").alias("a"), F.col("id").alias("b"))
    edges = links.select("a", "b").union(star).union(near.class_links.where("a <> b").select("a", "b"))
    comp = connected_components(edges).select(F.col("id").alias("rep"), F.col("component").alias("group_id"))
    d = ids.join(near.members, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    d = d.join(n, "rep", "left").join(comp, "rep", "left")
    return d.select(F.col("id").alias(key), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "rep").alias("group_id"))
