import random

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from retort.llm import bpe

CODEC = bpe._codec(bpe.VOCABULARY)
OTHER = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(CODEC.tokens) if t}, special_tokens={})


def test_perfect_hash_is_minimal_and_perfect():
    keys = [f"k{i}".encode() for i in range(5000)] + [b"", b"\x00", b"\x00\x00"]
    assert sorted(bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(len(keys)))


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_ids_equal_an_independent_encoder(text):
    ids = CODEC.encode(text)
    assert ids == OTHER.encode_ordinary(text)
    assert CODEC.decode(ids) == text


def test_heap_merges_long_pretokens():
    rng = random.Random(1)
    for text in ("a" * 20_000, "ab" * 7_000, "".join(rng.choice("abcé") for _ in range(20_000)), "x" * 9 + " " * 500):
        assert CODEC.encode(text) == OTHER.encode_ordinary(text)


def test_edge_rows(edge, empty):
    rows = bpe.encoded(edge).collect()
    assert len(rows) == edge.count()
    texts = {t for (t,) in edge.select("text").collect()}
    for r in rows:
        assert r.token_ids is None and r.round_trip is None and r.n_tokens is None or r.round_trip and r.n_tokens == len(r.token_ids)
    assert sum(r.token_ids is None for r in rows) == 2
    back = {r.text for r in bpe.decoded(bpe.encoded(edge)).collect()}
    assert back == texts
    assert bpe.encoded(empty).count() == 0
