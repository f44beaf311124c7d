"""Filling fixed-capacity containers with documents (problem 9).

Sum-of-squares packing: a bin's gap is what is still free in it; each document goes where the sum of the squared counts
of open bins per gap becomes smallest, which keeps the gaps spread and so leaves few of them unfillable. Sizes are
integers, so the state is one counter per gap, and a step is a few vector operations over at most ``capacity`` numbers.

Scale: documents are dealt by a hash of their key into groups of about ``group_rows`` rows, each packed by one task. The
waste that grouping adds is bounded by the few bins per group that stay open, and no task holds more than its group.

Defined results: null, empty and blank-free texts count by their tokens; a document of no tokens takes no room and gives
no row; only a document above the capacity is split, into full containers and one rest that is packed like any other
document; repeated keys are packed as separate documents; ties go to the smallest gap left.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.lineage import written
from qirtas.llm.tokenizing import count_tokens

#: Documents a task packs. Larger groups waste less and take longer; the number of groups grows with the corpus.
GROUP_ROWS = 20_000
#: The list of capacities is configuration, not data; a longer list is refused.
MOST_PACKS = 64


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; items come in the order given, each at most ``capacity`` and at least 1."""
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap; full bins (gap 0) and unopened ones (gap = capacity) don't count
    stacks: dict[int, list[int]] = {}
    out = np.empty(len(sizes), np.int64)
    n_bins = 0
    none = np.iinfo(np.int64).max
    for k, s in enumerate(sizes.tolist()):
        best, best_gap = 2 * open_bins[capacity - s] + 1 if s < capacity else 0, capacity
        if s < capacity:
            # change of the sum when an open bin of gap g takes the item: 2 (N[g - s] - N[g]) + 2, for g = s without the new bin
            now = open_bins[s:capacity]
            change = open_bins[: capacity - s] - now
            change = 2 * change + 2
            change[0] = 1 - 2 * now[0]
            change[now == 0] = none
            at = int(change.argmin())
            if change[at] <= best:
                best_gap = at + s
        if best_gap == capacity:
            b = n_bins
            n_bins += 1
        else:
            b = stacks[best_gap].pop()
            open_bins[best_gap] -= 1
        left = best_gap - s
        if left:
            open_bins[left] += 1
            stacks.setdefault(left, []).append(b)
        out[k] = b
    return out


def pack_sizes(sizes: DataFrame, capacities: list[tuple[int, int]], key: str = "doc_id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pack ``key, n_tokens`` for each ``(pack_id, capacity)``.

    One row per piece: ``pack_id, capacity, bin, key, part, at, n_tokens``: ``at`` is where the piece starts in its
    document. A document's pieces in order of ``part`` cover it once.
    """
    kind = sizes.schema[key].dataType.simpleString()
    n_groups = max(1, math.ceil(sizes.count() / group_rows))
    packs = F.explode(F.array(*(F.struct(F.lit(int(p)).alias("pack_id"), F.lit(int(c)).alias("capacity")) for p, c in capacities))).alias("p")
    d = sizes.where(F.col("n_tokens") > 0).select(F.col(key), "n_tokens", F.pmod(F.xxhash64(F.col(key), F.lit("pack")), F.lit(n_groups)).alias("grp"), packs)
    d = d.select(key, "n_tokens", "grp", "p.pack_id", "p.capacity")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, grp, pack = int(pdf["capacity"].iloc[0]), int(pdf["grp"].iloc[0]), int(pdf["pack_id"].iloc[0])
        pdf = pdf.sort_values(["n_tokens", key], ascending=[False, True], kind="stable")
        n, ids = pdf["n_tokens"].to_numpy(np.int64), pdf[key].to_numpy()
        full, rest = n // c, n % c
        # full containers of documents above (or of) the capacity
        row = np.repeat(np.arange(len(n)), full)
        part = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
        # rests, largest first
        item = np.flatnonzero(rest)
        item = item[np.argsort(-rest[item], kind="stable")]
        bins = sum_of_squares(rest[item], c) + len(row)
        out = pd.DataFrame({
            "bin": np.concatenate([np.arange(len(row)), bins]) + (grp << 32),
            key: np.concatenate([ids[row], ids[item]]),
            "part": np.concatenate([part, full[item]]),
            "at": np.concatenate([part * c, full[item] * c]),
            "n_tokens": np.concatenate([np.full(len(row), c), rest[item]]),
        })
        out.insert(0, "pack_id", pack)
        out.insert(1, "capacity", c)
        return out

    return d.groupBy("pack_id", "grp").applyInPandas(run, f"pack_id int, capacity int, bin long, `{key}` {kind}, part long, at long, n_tokens long")


def pack_documents(docs: DataFrame, packs: DataFrame, folder: str = "/opt/tokenizers", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pack ``documents(doc_id, text)`` for each row of ``packs(pack_id, tokenizer, capacity)``; ``tokenizer`` names a
    rank file in ``folder``. No documents or no packs: no rows."""
    rows = packs.select("tokenizer", "pack_id", "capacity").limit(MOST_PACKS + 1).collect()
    if len(rows) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} container sizes")
    out = None
    for name in sorted({r.tokenizer for r in rows}):
        sizes = written(count_tokens(docs, vocabulary=f"{folder}/{name}.tiktoken"), "sizes")
        one = pack_sizes(sizes, sorted((r.pack_id, r.capacity) for r in rows if r.tokenizer == name), group_rows=group_rows)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "pack_id int, capacity int, bin long, doc_id long, part long, at long, n_tokens long")
    return out


def fill_report(packed: DataFrame) -> DataFrame:
    """``pack_id, capacity, n_bins, n_pieces, tokens, fill``: the share of the room that is used."""
    return packed.groupBy("pack_id", "capacity").agg(F.count_distinct("bin").alias("n_bins"), F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("tokens")).withColumn("fill", F.round(F.col("tokens") / (F.col("n_bins") * F.col("capacity")), 6))
