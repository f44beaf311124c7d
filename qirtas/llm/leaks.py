"""Evaluation texts in training text (problem 4).

An item leaks into a record that holds all of its words, or ``span`` of them in an unbroken row, or nearly so: up to
``max_edits`` words may be replaced, inserted or left out (in short items one for each ``EDIT_WORDS`` words). Both sides
become word sequences in which marks, punctuation, blanks, markup and the variants of letters and digits make no
difference. Every item gives windows of ``span`` words (one window of its whole length if it is shorter), and every
place of a record is searched for windows of these sizes, over as many words more as there may be insertions.

A window goes through a CGK random walk over its words (a pointer that advances or stays by a random bit of step and
word), which turns the edit distance of two windows into the Hamming distance of two walks. Bit sampling then hashes
some steps of the walk; repeated with other bits and other walks it reaches the target recall. Steps are sampled where
the pointer is still inside the item's window, so words that follow it in the record, or that an insertion pushes back,
don't matter. What meets an item's window in a table is verified by the exact edit distance between the window and the
best stretch that starts there. The result says how many edits the best match needs; equal windows walk alike, so every
table finds them, and a search for edits finds all leaks without edits for certain.

Two exact tests go before the walk: a stretch that holds a window with e edits has all but e of its words in the items
of that size, and among them a row of words that the edits leave intact. A stretch whose first sampled steps are in no
item's walk goes no further.

Scale: the items are the small side and are sent to all workers in blocks of ``ITEM_BLOCK``, so that one broadcast has
a bound; each worker builds a block's tables once. The records are read where they lie, without a shuffle. Only hits are
shuffled.

Defined results: null and wordless texts and items match nothing; an item that occurs several times in a record, or in
two fields of it, gives one row with the fewest edits; equal items under several ids all leak.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.llm.words import WordHashes, no_markup, same

SPAN = 13
ITEM_BLOCK = 20_000
SLICE = 4000
#: Words of a window for each edit that is allowed in it.
EDIT_WORDS = 4
#: Steps of the walk that may be sampled, for each word of the window: the pointer gets through half a word a step.
STRETCH = 1.6
#: Share of these steps that a table samples, the most of them, those that are compared early, and the most tables.
SHARE, SAMPLED, FIRST, MOST_TABLES = 0.45, 9, 4, 64
#: Steps that an edit disturbs, on the average of walks: until the two fall into step again.
MISSED = 3.0


def edit_distances(windows: np.ndarray, stretches: np.ndarray) -> np.ndarray:
    """For each row the least edit distance between the window and any beginning of the stretch."""
    n, w = windows.shape
    row = np.tile(np.arange(stretches.shape[1] + 1, dtype=np.int32), (n, 1))
    for i in range(w):
        last, left = row, np.full(n, i + 1, np.int32)
        row = np.empty_like(last)
        row[:, 0] = left
        for j in range(stretches.shape[1]):
            change = last[:, j] + ((windows[:, i] != stretches[:, j]) | (stretches[:, j] < 0))
            row[:, j + 1] = np.minimum(np.minimum(last[:, j + 1], row[:, j]) + 1, change)
    return row.min(axis=1)


class Table:
    """The windows of one size, under one walk and one sample of its steps."""

    def __init__(self, windows: np.ndarray, n_words: int, seed: int, sampled: int) -> None:
        rng = np.random.default_rng(seed)
        steps = max(1, int(STRETCH * windows.shape[1]))
        self.bits = rng.integers(0, 2, (steps, n_words + 1), dtype=np.int8)
        self.picked = np.sort(rng.choice(steps, min(sampled, steps), replace=False))
        self.weight = rng.integers(1, 2**63, steps, dtype=np.uint64) | np.uint64(1)
        first, whole, _ = self.keys(windows, None)
        self.first = np.unique(first)
        self.order = np.argsort(whole, kind="stable")
        self.key = whole[self.order]

    def keys(self, windows: np.ndarray, early: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the first sampled steps, of all of them, and the windows that were walked to the end. Past its last
        word a walk reads word 0; unknown words are 0 too, words past the end of a text -1."""
        at = np.zeros(len(windows), np.int64)
        key = np.zeros(len(windows), np.uint64)
        rows = np.arange(len(windows))
        first = key
        padded = np.concatenate([np.maximum(windows, 0), np.zeros((len(windows), 1), windows.dtype)], axis=1)
        seen = 0
        picked = set(self.picked.tolist())
        for j in range(int(self.picked[-1]) + 1):
            word = padded[rows, at[rows]]
            if j in picked:
                key[rows] = (key[rows] ^ (word.astype(np.uint64) + np.uint64(1))) * self.weight[j]
                key[rows] ^= key[rows] >> np.uint64(29)
                seen += 1
                if seen == min(FIRST, len(self.picked)):
                    first = key.copy()
                    if early is not None:
                        rows = rows[np.isin(key, early)]
                        word = padded[rows, at[rows]]
                        if not len(rows):
                            break
            at[rows] = np.minimum(at[rows] + self.bits[j, word], windows.shape[1])
        return first, key, rows

    def meet(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of windows and of item windows with the same key."""
        _, key, rows = self.keys(windows, self.first)
        lo, hi = np.searchsorted(self.key, key[rows], "left"), np.searchsorted(self.key, key[rows], "right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(rows, n), self.order[at]


def sampled_steps(size: int, edits: int) -> int:
    steps = max(1, int(STRETCH * size))
    return min(SAMPLED, max(2, int(SHARE * steps))) if edits else min(16, steps)


def repetitions(size: int, edits: int, recall: float) -> int:
    """How many tables reach ``recall``. A table finds a window if none of its sampled steps lies in what an edit
    disturbs. Some walks are disturbed for long, so the chance of a table is taken as half of the average one's."""
    if edits == 0:
        return 1
    steps = max(1, int(STRETCH * size))
    p = max(0.02, (1 - min(0.8, MISSED * edits / steps)) ** sampled_steps(size, edits) / 2)
    return max(1, min(MOST_TABLES, math.ceil(math.log(1 - recall) / math.log(1 - p))))


def intact(size: int, edits: int) -> int:
    """Words in a row that ``edits`` edits leave intact at least."""
    return -(-(size - edits) // (edits + 1))


def rows_of_words(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for i in range(n):
        h = (h ^ ids[i : len(ids) - n + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


class Index:
    """All windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]], span: int, max_edits: int, recall: float) -> None:
        words, ends = WordHashes(same).flat((t for _, t in items), no_markup)
        self.words, ids = np.unique(words, return_inverse=True)
        ids = ids.astype(np.int32) + 1
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for (item, _), a, b in zip(items, ends[:-1], ends[1:]):
            w = min(span, b - a)
            if w:
                by_size.setdefault(int(w), []).extend((ids[i : i + w], item) for i in range(a, b - w + 1))
        self.sizes = []
        for w, rows in sorted(by_size.items()):
            windows = np.stack([x for x, _ in rows])
            edits = min(max_edits, w // EDIT_WORDS)
            has = np.zeros(len(self.words) + 1, bool)
            has[windows] = True
            tables = [Table(windows, len(self.words), 7919 * w + r, sampled_steps(w, edits)) for r in range(repetitions(w, edits, recall))]
            n = intact(w, edits)
            whole = np.unique(np.concatenate([rows_of_words(windows[:, i : i + n].ravel(), n)[::n] for i in range(w - n + 1)]))
            self.sizes.append((w, edits, windows, np.array([i for _, i in rows], np.int64), has, whole, tables))

    def search(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``text number, item, edits`` of every hit in a batch of texts."""
        at = np.searchsorted(self.words, words)
        at[at == len(self.words)] = 0
        ids = np.where(self.words[at] == words, at + 1, 0).astype(np.int32) if len(self.words) else np.zeros(len(words), np.int32)
        left = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(words))  # words from here to the end of the text
        texts, found, needs = [], [], []
        for w, edits, windows, items, has, whole, tables in self.sizes:
            size = w + edits
            known = np.concatenate([[0], np.cumsum(has[ids])])
            reach = np.minimum(left, size)
            n = intact(w, edits)
            start = np.arange(len(words))
            near = (known[start + reach] - known[start] >= w - edits) & (left >= w - edits)
            rows = rows_of_words(ids, n)
            at = np.minimum(np.searchsorted(whole, rows), len(whole) - 1)
            hits = np.zeros(len(words) + 1, np.int64)
            hits[1 : len(rows) + 1] = np.cumsum(whole[at] == rows)
            hits[len(rows) + 1 :] = hits[len(rows)]
            start = start[near & (hits[np.maximum(start + reach - n + 1, start)] > hits[start])]
            for lo in range(0, len(start), 200_000):
                s = start[lo : lo + 200_000]
                mine = ids[np.minimum(s[:, None] + np.arange(size), len(ids) - 1)]
                mine[np.arange(size) >= left[s][:, None]] = -1
                pairs = [t.meet(mine) for t in tables]
                both = np.unique(np.concatenate([p[0] * len(windows) + p[1] for p in pairs]))
                i, k = both // len(windows), both % len(windows)
                if edits:
                    need = np.concatenate([edit_distances(windows[k[x : x + 50_000]], mine[i[x : x + 50_000]]) for x in range(0, len(i), 50_000)] or [np.zeros(0, np.int32)])
                else:
                    need = np.where((mine[i] == windows[k]).all(axis=1), 0, 1) if len(i) else np.zeros(0, np.int32)
                ok = need <= edits
                texts.append(np.searchsorted(ends, s[i[ok]], "right") - 1)
                found.append(items[k[ok]])
                needs.append(need[ok])
        if not texts:
            return (np.zeros(0, np.int64),) * 3
        text, item, need = np.concatenate(texts), np.concatenate(found), np.concatenate(needs)
        order = np.lexsort((need, item, text))
        text, item, need = text[order], item[order], need[order].astype(np.int64)
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        return text[new], item[new], need[new]


_indexes: dict[str, Index] = {}


def index_of(sent) -> Index:
    """The index of a broadcast block of items, built once in each worker."""
    name, items, span, max_edits, recall = sent.value
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Index(items, span, max_edits, recall)
    return _indexes[name]


def find_leaks(records: DataFrame, key: str, fields: list[str], items: DataFrame, span: int = SPAN, max_edits: int = 0, recall: float = 0.95) -> DataFrame:
    """``rec_id string, item_id bigint, edits bigint`` for ``items(item_id, text)`` in any of the ``fields`` of ``records``."""
    spark = records.sparkSession
    rows = [(r.item_id, r.text) for r in items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator()]
    texts = records.select(F.col(key).cast("string").alias("rec_id"), F.explode(F.array(*fields)).alias("text")).where("text is not null and rec_id is not null")
    out = None
    for lo in range(0, len(rows), ITEM_BLOCK):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, rows[lo : lo + ITEM_BLOCK], span, max_edits, recall))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, hashes = index_of(sent), WordHashes(same)
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    text, item, need = index.search(*hashes.flat(batch.column(1).to_pylist(), no_markup))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(item), pa.array(need)], names=["rec_id", "item_id", "edits"])

        one = texts.mapInArrow(run, "rec_id string, item_id long, edits long")
        out = one if out is None else out.union(one)
    if out is None:
        return spark.createDataFrame([], "rec_id string, item_id long, edits long")
    return out.groupBy("rec_id", "item_id").agg(F.min("edits").alias("edits"))


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, eval_set, kind, n_records, leaked`` for every item."""
    n = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_records"))
    return items.select("item_id", "eval_set", "kind").join(n, "item_id", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0))).withColumn("leaked", F.col("n_records") > 0)
