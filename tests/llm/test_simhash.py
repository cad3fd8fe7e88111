import random

import numpy as np
import pytest

from retort.llm import simhash as S
from retort.llm.components import components

from conftest_llm import docs_of


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(70)] + [(k, k + 1) for k in range(1000, 1040)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[x] == find(x) for x in {n for u, v in edges if u != v for n in (u, v)})


def test_allocation_is_exact_and_least():
    tables = [np.array([100.0, 50, 20, 5]), np.array([10.0, 500, 900, 100]), np.array([1000.0, 10, 1, 1])]
    cost, t = S.allocate(tables, 100, 3)
    assert sum(x + 1 for x in t) == 4
    from itertools import product
    from math import comb

    def price(p, x):
        return 0 if x < 0 else S.ROW_COST * 100 * comb(3, x) + S.PAIR_COST * sum(p[d] * comb(3 - d, x - d) for d in range(x + 1)) / 2

    best = min(sum(price(p, x) for p, x in zip(tables, c, strict=True)) for c in product(range(-1, 4), repeat=3) if sum(x + 1 for x in c) == 4)
    assert cost == pytest.approx(best)


def test_pairs_by_distance():
    hist = np.random.default_rng(1).integers(0, 5, 64)
    want = np.zeros(7)
    for a in range(64):
        for b in range(64):
            want[bin(a ^ b).count("1")] += hist[a] * hist[b]
    assert np.allclose(S.pairs_by_distance(hist), want)


@pytest.mark.parametrize("run,block", [(2, 3), (16, 5), (1024, 256)])
def test_link_connects_what_brute_force_connects(run, block):
    rng = np.random.default_rng(run)
    centre = rng.integers(0, 1 << 62, 6, dtype=np.uint64)
    flip = lambda x, k: x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    sig = np.array([flip(centre[rng.integers(6)], int(rng.integers(0, 7))) for _ in range(300)])
    sig2 = np.array([flip(centre[0], int(rng.integers(0, 12))) for _ in range(300)])
    key = np.sort(rng.integers(0, 3, 300))
    u, v = S.link(key, sig, sig2, 6, 16, run, block, 3 * block)
    i, j = np.nonzero((key[:, None] == key[None]) & (np.bitwise_count(sig[:, None] ^ sig[None]) <= 6) & (np.bitwise_count(sig2[:, None] ^ sig2[None]) <= 16))
    assert np.array_equal(S.forest(u, v, 300), S.forest(i, j, 300))


def test_groups_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    import pyarrow as pa

    a, b, n = S.signatures(pa.array([r.text for r in rows]))
    i, j = np.nonzero((np.bitwise_count(a[:, None] ^ a[None]) <= S.TAU) & (np.bitwise_count(b[:, None] ^ b[None]) <= S.TAU_PAIRS) & (n[:, None] > 0) & (n[None] > 0))
    label = S.forest(i, j, len(rows))
    want = {rows[k].doc_id: rows[label[k]].doc_id for k in range(len(rows))}
    got = S.near_duplicates(docs).collect()
    assert {r.doc_id: r.group_id for r in got} == want
    assert sum(r.kept for r in got) == len(set(want.values())) == S.deduplicated(docs).count()


@pytest.mark.parametrize("most,piece,batch", [(4, 1, 1), (4, 7, 5), (20, 50, 3), (1000, 64, 40), (None, 16, 9)])
def test_keys_of_any_size_stream(most, piece, batch):
    import pyarrow as pa

    rng = np.random.default_rng(batch)
    key = np.sort(np.concatenate([np.repeat(rng.integers(-9, 9, 8), rng.integers(1, 40, 8)), rng.integers(-1 << 60, 1 << 60, 20)]))
    sig = rng.integers(0, 1 << 3, len(key)).view(np.uint64)
    whole = pa.record_batch([pa.array(key), pa.array(sig.view(np.int64)), pa.array(sig.view(np.int64) * 5)], ["key", "sig", "sig2"])
    out = [r for b in S._linker(1, 64, most, piece)(whole.slice(k, batch) for k in range(0, len(key), batch)) for r in b.to_pylist()]
    names, count = np.unique(key, return_counts=True)
    assert sorted((r["u"], r["n"]) for r in out if r["v"] is None) == [(int(k), int(c)) for k, c in zip(names, count, strict=True) if most and c > most]
    small = np.isin(key, names[count <= most]) if most else np.ones(len(key), bool)
    i, j = np.nonzero((key[:, None] == key[None]) & small[:, None] & (np.bitwise_count(sig[:, None] ^ sig[None]) <= 1))
    node = S.node_ids(sig, (sig.view(np.int64) * 5).view(np.uint64))
    at = {n: k for k, n in enumerate(dict.fromkeys(node.tolist()))}
    where = np.array([at[n] for n in node.tolist()])
    edges = [(at[r["u"]], at[r["v"]]) for r in out if r["v"] is not None]
    u, v = np.array(edges, np.int64).reshape(-1, 2).T
    assert np.array_equal(S.forest(u, v, len(at)), S.forest(where[i], where[j], len(at)))


def test_large_keys_are_dealt_to_blocks(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r.group_id for r in S.near_duplicates(docs).collect()}
    for most in (2, 6):
        assert {r.doc_id: r.group_id for r in S.near_duplicates(docs, most=most).collect()} == want


def test_distances_of_all_parts_equal_their_transforms():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows, want = [], {}
    for part in (403, 400, 805):
        lo, hi = S.cuts(part // 100)[part % 100]
        hist = np.zeros(1 << (hi - lo))
        for value in rng.integers(0, len(hist), 30).tolist():
            rows.append((part, value, 2))
            hist[value] += 2
        want[part] = S.pairs_by_distance(hist)
    whole = pa.record_batch([pa.array(list(x)) for x in zip(*rows, strict=True)], ["part", "value", "n"])
    out = [r for b in S._distances(whole.slice(k, 7) for k in range(0, len(rows), 7)) for r in b.to_pylist()]
    assert {k: [r["pairs"] for r in out if r["part"] == k] for k in want} == {k: pytest.approx(x) for k, x in want.items()}


def test_copies_are_found_and_others_left(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["an", "re", "ti", "on", "es", "ha"]) for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(150)] for _ in range(12)]
    rows = [(k, " ".join(w), "s") for k, w in enumerate(base)]
    for k in range(6):
        w = list(base[k])
        for _ in range(3):
            w[rng.randrange(len(w))] = word()
        rows += [(100 + k, " ".join(w), "s"), (200 + k, " ".join(base[k]).upper(), "s")]
    got = {r.doc_id: r.group_id for r in S.near_duplicates(docs_of(spark, rows)).collect()}
    assert all(got[100 + k] == got[200 + k] == got[k] == k for k in range(6)) and all(got[k] == k for k in range(12))


def test_edge_rows(edge, empty):
    rows = S.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    one = [r for r in rows if r.doc_id == 1]
    assert sorted(r.group_size for r in one) == [1, 2, 2]
    kept = S.deduplicated(edge)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 1
    assert S.near_duplicates(empty).count() == 0 and S.deduplicated(empty).count() == 0
