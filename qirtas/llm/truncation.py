"""Text cut off by field limits or broken transfers (problem 10).

Intact values (those that end a sentence) are cut artificially, at the lengths where the table's values pile up and at
random places, some with the debris of a cut: these are the positives. The negatives are values as they are. A logistic
regression on hashed features (closing characters, closing words, the last line, punctuation, length at a limit) is
trained anew without the values that it takes for cut, as some of the negatives are. It then scores every record.

The training sample has about ``SAMPLE`` values, by hash order of their keys; its size is that documented bound. Its
values are cut and turned into features where they lie and one task fits the model. The limits come from the counts of
all lengths. Scoring is one pass without a shuffle.

Defined results: null and blank texts are not cut (score 0), nor is any text of a table whose sample holds no finished
value to cut, as nothing tells cuts from other ends there; a text that ends with a sentence is not cut even at a
limit, as nothing shows it; closing lines (lists, bylines, contacts, tags, links) after a finished sentence are learned
as intact; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.llm import samples, tails

SAMPLE = 8000
#: A length is a limit if it has so many values and so many times the mean of its hundred neighbours.
LIMIT_ROWS, LIMIT_TIMES = 12, 8.0
MOST_LIMITS = 256
THRESHOLD = 0.5
#: Rounds after the first, each without the uncut values whose log odds of a cut are this or more.
ROUNDS, SURE = 3, -1.5
#: Marks and debris that a cut may leave (fixed values).
MARKS = ("…", "...", " …", " ...", "[…]", " […]", "[...]", " [...]", "�", " ")
DEBRIS = ("��", " <", " <d", " <di", "<b", " <a hre", ' <a href="ht', "<sp", "&", "&am", " &nb", " &nbs", " &qu", " &quo", " &lt", " ...المزيد", "... المزيد", " اقرأ المزيد", "\\", "\\u06", "%D8", "-")


def limits(lengths: DataFrame) -> list[int]:
    """Lengths at which values of ``lengths(n)`` pile up; at most ``MOST_LIMITS`` numbers reach the driver."""
    by = lengths.where("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    near = by.groupBy(F.floor(F.col("n") / 100).alias("b")).agg((F.sum("c") / 100).alias("mean"), F.max("c").alias("top"))
    d = by.withColumn("b", F.floor(F.col("n") / 100)).join(near, "b")
    # the pile itself is left out of its neighbours' mean
    rest = F.greatest(F.col("mean") - F.col("top") / 100, F.lit(0.05))
    d = d.where((F.col("c") >= LIMIT_ROWS) & (F.col("c") >= LIMIT_TIMES * rest))
    return sorted(r.n for r in d.orderBy(F.desc("c"), "n").limit(MOST_LIMITS).collect())


def named(text: str, at_limit: bool) -> list[int]:
    f = tails.features(text)
    if at_limit:
        f += ["limit", f"limit,{f[0]}"]
    return tails.hashed(f)


def examples(text: str, limits_: list[int], rng: np.random.Generator) -> Iterator[tuple[list[int], int]]:
    """Features and label (1: cut) of a sampled text as it is and of its artificial cuts."""
    spots = set(limits_)
    if not text.strip():
        return
    yield named(text, len(text) in spots), 0
    if not tails.finished(text) or len(text) < 40:
        return
    fits = [x for x in limits_ if x < len(text)]
    for turn in range(2):
        at = int(rng.choice(fits)) if fits and rng.random() < 0.3 else int(rng.integers(20, len(text) - 1))
        cut = text[:at]
        if tails.finished(cut) or tails._LINE.search(text[at - 1 : at + 1]) or not cut.strip():
            continue  # nothing shows this cut
        if turn:  # every second cut leaves something, a mark or debris
            left = MARKS if rng.random() < 0.6 else DEBRIS
            cut += left[rng.integers(len(left))]
        yield named(cut, at in spots), 1


def fit(rows: list[list[int]], labels: np.ndarray) -> np.ndarray | None:
    """Weights, or None where there is nothing to tell apart (no cuts, or nothing but cuts)."""
    if not labels.any() or labels.all():
        return None
    x = tails.Rows(rows)
    w = tails.logistic(rows, labels)
    for _ in range(ROUNDS):
        keep = (labels > 0) | (x.sums(w) < SURE)
        w = tails.logistic([r for r, k in zip(rows, keep) if k], labels[keep])
    return w


def train(sampled: DataFrame, limits_: list[int], seed: int = 7) -> np.ndarray | None:
    """Weights from ``sampled(k, t)``, a bounded sample: cut and turned into features where it lies, fitted in one task.
    Only the weights (at most ``tails.SPACE`` numbers) come to the driver."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, feats, y = [], [], []
            for t in batch.column(1).to_pylist():
                h = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), seed)
                for f, label in examples(t, limits_, np.random.default_rng(h)):
                    keys.append(h >> 1)
                    feats.append(f)
                    y.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(feats, pa.list_(pa.int32())), pa.array(y, pa.int8())], names=["h", "f", "y"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((h, y, f) for b in batches for h, f, y in zip(*(c.to_pylist() for c in b.columns)))
        w = fit([f for _, _, f in rows], np.array([y for _, y, _ in rows], float))
        at = np.flatnonzero(w) if w is not None else np.zeros(0, np.int64)
        if w is not None:
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at].astype(np.float32))], names=["i", "w"])

    spread = sampled.repartition(max(1, sampled.sparkSession.sparkContext.defaultParallelism))
    got = spread.mapInArrow(cut, "h long, f array<int>, y tinyint").repartition(1).mapInArrow(learn, "i int, w float").toPandas()
    if not len(got):
        return None
    weights = np.zeros(tails.SPACE, np.float32)
    weights[got["i"].to_numpy()] = got["w"].to_numpy()
    return weights


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``key, score``: the probability that the text was cut, for every row; 0 for all where the table shows no cuts to
    learn from (no finished value in the sample)."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    spots = limits(d.select(F.length("t").alias("n")))
    few = samples.first(d.where("t is not null"), "k", ["t"], F.lit(samples.bound(d.count(), sample)), 2 * sample, "tails")
    sent = spark.sparkContext.broadcast((train(few, spots), frozenset(spots)))  # SPACE numbers, whatever the data

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, at = sent.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, t in enumerate(batch.column(1).to_pylist() if w is not None else []):
                if t and not t.isspace():
                    out[i] = 1 / (1 + np.exp(-np.clip(w[named(t, len(t) in at)].sum(), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=[key, "score"])

    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, score double")


def cut_report(docs: DataFrame, scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """``source, n_docs, n_cut, share``."""
    g = docs.select(key, "source").join(scores, key).groupBy("source")
    return g.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("score") >= THRESHOLD).alias("n_cut")).withColumn("share", F.round(F.col("n_cut") / F.col("n_docs"), 6))
