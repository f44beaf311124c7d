import base64
import os
import random

import pytest
import tiktoken

from qirtas.llm import tokenizing as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="the public vocabulary is not here")


@pytest.fixture(scope="module")
def both():
    with open(T.VOCABULARY, "rb") as f:
        ranks = T.read_ranks(f.read())
    return T.Encoder(ranks), tiktoken.Encoding("own", pat_str=T.PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library(both):
    enc, lib = both
    rng = random.Random(0)
    parts = ["a", "b", "ab", "the", "ال", "ة", "é", "😀", " ", "\n", "xyz", "1", "..", "\x1c", "​", "'ll", "<|endoftext|>"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        assert enc.encode(t) == lib.encode_ordinary(t)
        assert enc.encode(t.replace(" ", "").replace("\n", "")) == lib.encode_ordinary(t.replace(" ", "").replace("\n", ""))


def test_round_trip_and_long_pre_tokens(both):
    enc, lib = both
    back = {v: k for k, v in enc.ranks.items()}
    t = "نص عربي طويل " * 50 + "ab" * 60_000
    ids = enc.encode(t)
    assert b"".join(back[i] for i in ids).decode() == t
    assert enc.encode("aaaaaaaab" * 300) == lib.encode_ordinary("aaaaaaaab" * 300)
    assert not enc.queue.top and not any(enc.queue.low) and not enc.queue.bucket


def test_rank_queue_pops_in_order():
    q = T.RankQueue(60_000)
    rng = random.Random(1)
    ranks = [rng.randrange(60_000) for _ in range(500)]
    for i, r in enumerate(ranks):
        q.add(r, 1000 - i)
    out = []
    while q.top:
        r, at = q.pop()
        assert at == sorted(at)
        out += [r] * len(at)
    assert out == sorted(ranks)


def test_null_empty_repeated_and_extra_columns(spark, both):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "the cat", "x"), (3, "the cat", "x"), (4, " ", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in T.encode_documents(df).collect())
    want = both[1].encode_ordinary("the cat")
    assert got == [(1, []), (2, []), (3, want), (3, want), (4, both[1].encode_ordinary(" "))]
    assert {r.doc_id: r.n_tokens for r in T.count_tokens(df).collect()}[3] == len(want)
    assert T.encode_documents(df.limit(0)).count() == 0


def test_cache_is_emptied(both, monkeypatch):
    enc, lib = both
    monkeypatch.setattr(T, "CACHE_WORDS", 3)
    for i in range(20):
        assert enc.encode(f"word{i} thing{i}") == lib.encode_ordinary(f"word{i} thing{i}")
    assert base64.b64encode(b"x")
