"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

The merges run on a hierarchical-bitmap rank queue: for every pre-token, each merge rank that occurs has a bucket of
linked-list positions; a three-level bitmap over the ranks finds the next rank with find-first-set on three words, and
entries whose pair changed since they were queued are skipped as stale. A pre-token of n bytes takes O(n log n) steps,
so that a document without blanks of a megabyte is no special case.

Defined results: null and empty texts give an empty list; text that looks like a special token is ordinary text; every
row of the input gives exactly one row, repeated rows too. The whole text is encoded.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-token pattern of this vocabulary (fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose ids a worker keeps; beyond this the memory is emptied. A speed setting only.
CACHE_WORDS = 200_000
#: Documents encoded before a batch of results leaves the worker.
OUT_ROWS = 512


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a ``token-in-base64 rank`` file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class RankQueue:
    """Set of ranks below ``size`` with buckets; the least rank comes from three find-first-set steps."""

    def __init__(self, size: int) -> None:
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0
        self.bucket: dict[int, list[int]] = {}

    def add(self, rank: int, position: int) -> None:
        at = self.bucket.get(rank)
        if at is not None:
            at.append(position)
            return
        self.bucket[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]]:
        """The least rank and its positions from left to right."""
        b = (self.top & -self.top).bit_length() - 1
        w = self.mid[b]
        a = (b << 6) | ((w & -w).bit_length() - 1)
        w = self.low[a]
        rank = (a << 6) | ((w & -w).bit_length() - 1)
        w &= w - 1
        self.low[a] = w
        if not w:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        positions = self.bucket.pop(rank)
        if len(positions) > 1:
            positions.sort()
        return rank, positions


class Encoder:
    """Byte-level BPE over a rank table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.split = regex.compile(PRE_TOKEN).findall
        self.known: dict[str, bytes] = {}

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        queue = self.queue
        end = list(range(1, n + 1))  # end of the token that starts here; 0 once merged into its left neighbour
        before = list(range(-1, n - 1))
        pair: list[int] = [-1] * n  # rank of this token with its right neighbour, -1 if none
        for i in range(n - 1):
            r = ranks.get(data[i : i + 2], -1)
            if r >= 0:
                pair[i] = r
                queue.add(r, i)
        while queue.top:
            rank, positions = queue.pop()
            for i in positions:
                if not end[i] or pair[i] != rank:
                    continue  # stale
                j = end[i]
                stop = end[j]
                end[i], end[j] = stop, 0
                if stop < n:
                    before[stop] = i
                    r = ranks.get(data[i : end[stop]], -1)
                    pair[i] = r
                    if r >= 0:
                        queue.add(r, i)
                else:
                    pair[i] = -1
                h = before[i]
                if h >= 0:
                    r = ranks.get(data[h:stop], -1)
                    pair[h] = r
                    if r >= 0:
                        queue.add(r, h)
        out = []
        i = 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian int32."""
        known = self.known
        words = self.split(text)
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > CACHE_WORDS:
            known.clear()
        parts = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = np.array(self.piece(w.encode("utf-8", "surrogatepass")), "<i4").tobytes()
                if len(w) <= 64:
                    known[w] = ids
            parts.append(ids)
        return b"".join(parts)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist() if text else []


_encoders: dict[int, Encoder] = {}


def encoder_of(ranks_file) -> Encoder:
    """The encoder of a broadcast rank file, built once in each worker."""
    key = zlib.crc32(ranks_file.value)
    if (e := _encoders.get(key)) is None:
        e = _encoders[key] = Encoder(read_ranks(ranks_file.value))
    return e


def broadcast_ranks(df: DataFrame, vocabulary: str):
    """The vocabulary file as a broadcast: its size is fixed (under a megabyte), whatever the corpus."""
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids array<int>``: one row per input row, no shuffle."""
    ranks_file = broadcast_ranks(docs, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(ranks_file)
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                parts = [enc.packed(t) if t else b"" for t in batch.column(1).to_pylist()]
                offsets = np.zeros(len(parts) + 1, np.int32)
                np.cumsum([len(p) >> 2 for p in parts], out=offsets[1:])
                ids = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], names=[key, "ids"])

    d = docs.select(key, text)
    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, ids array<int>")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, n_tokens int``: the sizes alone, so that the ids never leave the worker."""
    ranks_file = broadcast_ranks(docs, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(ranks_file)
        for batch in batches:
            sizes = [len(enc.packed(t)) >> 2 if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=[key, "n_tokens"])

    d = docs.select(key, text)
    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, n_tokens int")
