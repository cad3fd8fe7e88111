import random

import pytest

from retort.llm import passages as P

from conftest_llm import docs_of


def brute(rows, length):
    seen = {}
    for d, (_, t, _) in enumerate(rows):
        w = (t or "").split()
        for i in range(len(w) - length + 1):
            seen.setdefault(tuple(w[i : i + length]), []).append((d, i))
    out = set()
    for d, (doc, t, _) in enumerate(rows):
        mark = [False] * len((t or "").split())
        for places in seen.values():
            if len(places) > 1:
                for e, i in places:
                    if e == d:
                        mark[i : i + length] = [True] * length
        i = 0
        while i < len(mark):
            if mark[i]:
                j = i
                while j < len(mark) and mark[j]:
                    j += 1
                out.add((doc, i, j))
                i = j
            i += 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 2)
    shared = [[word() for _ in range(rng.randint(8, 40))] for _ in range(5)]
    rows = []
    for d in range(40):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            s = rng.choice(shared)
            w[at:at] = s[rng.randint(0, 4) :]
        if d % 9 == 0:
            w += ["x", "y"] * rng.randint(5, 20)
        rows.append((d, rng.choice([" ", "\n", "  "]).join(w), "s"))
    got = {tuple(r) for r in P.repeated_passages(docs_of(spark, rows), length=12, gram=3).collect()}
    assert got == brute(rows, 12)


def test_sliding_min():
    import numpy as np

    x = np.random.default_rng(0).integers(0, 99, 200)
    for k in (1, 2, 3, 7, 43):
        assert P.sliding_min(x, k).tolist() == [x[i : i + k].min() for i in range(200 - k + 1)]


def test_suffix_array_equals_sorting():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = rng.integers(1, 25, 6)
        words = rng.integers(0, 3, sizes.sum())
        stop = np.repeat(np.cumsum(sizes), sizes)
        order, lcp = P.suffix_array(words, stop, 8)
        keys = [tuple(words[i : min(i + 8, stop[i])].tolist()) for i in order]
        assert keys == sorted(keys)
        for k in range(1, len(order)):
            x, y = (words[i : stop[i]].tolist() for i in order[k - 1 : k + 1])
            common = next((m for m in range(min(len(x), len(y))) if x[m] != y[m]), min(len(x), len(y)))
            assert min(lcp[k], 15) == min(common, 15)


def test_edge_rows(edge, empty):
    assert P.repeated_passages(edge).count() == 0 and P.repeated_passages(empty).count() == 0
    twice = edge.unionAll(edge.where("doc_id = 4"))
    assert [tuple(r) for r in P.repeated_passages(twice).collect()] == [(4, 0, 60_000)]


@pytest.mark.parametrize("gram,modulus", [(1, 1), (2, 2), (3, 3), (4, 8), (5, 1000)])
def test_corpus_order_equals_a_plain_suffix_array(gram, modulus):
    import numpy as np

    rng = np.random.default_rng(gram)
    for _ in range(25):
        pool = [rng.integers(0, 3, rng.integers(1, 30)) for _ in range(3)]
        texts = [np.concatenate([pool[k] for k in rng.integers(0, 3, rng.integers(1, 5))])[: rng.integers(1, 60)] for _ in range(rng.integers(1, 9))]
        texts += texts[:2]
        words = np.concatenate(texts)
        size = np.array([len(t) for t in texts])
        stop = np.repeat(np.cumsum(size), size)
        plain = sorted(range(len(words)), key=lambda i: (words[i : stop[i]].tolist(), i))
        assert P.corpus_order(words, stop, gram, modulus).tolist() == plain
    assert P.corpus_order(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_marks_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(7)
    for _ in range(20):
        texts = [rng.integers(0, 2, rng.integers(1, 50)) for _ in range(6)]
        words, size = np.concatenate(texts), np.array([len(t) for t in texts])
        stop = np.repeat(np.cumsum(size), size)
        seen = {}
        for i in range(len(words)):
            if i + 7 <= stop[i]:
                seen.setdefault(tuple(words[i : i + 7].tolist()), []).append(i)
        assert np.flatnonzero(P.marked(words, stop, 7)).tolist() == sorted(i for x in seen.values() if len(x) > 1 for i in x)


@pytest.mark.parametrize("most", [1, 60, 400])
def test_large_anchors_meet_by_hashes(spark, most):
    rng = random.Random(most)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 2)
    shared = [word() for _ in range(30)]
    rows = [(d, " ".join([word() for _ in range(rng.randint(0, 15))] + shared[rng.randint(0, 9) : rng.randint(18, 30)] + [word() for _ in range(5)]), "s") for d in range(50)]
    got = {tuple(r) for r in P.repeated_passages(docs_of(spark, rows), length=12, gram=3, most=most).collect()}
    assert got == brute(rows, 12)


@pytest.mark.parametrize("most,piece,batch", [(40, 1, 1), (40, 90, 3), (10_000, 200, 2), (100, 1 << 20, 50)])
def test_stretches_stream_by_anchor(most, piece, batch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(batch)
    trig = np.sort(rng.integers(-5, 5, 40))
    words = [rng.integers(0, 2, rng.integers(6, 20)) for _ in trig]
    whole = pa.record_batch([pa.array(trig), pa.array(np.arange(40)), pa.array(np.arange(40)), pa.array(np.zeros(40, np.int32)), pa.array([w.tolist() for w in words], pa.list_(pa.int64()))], ["trig", "doc_id", "text_hash", "start", "words"])
    out = [r for b in P._sorter(6, most, piece)(whole.slice(k, batch) for k in range(0, 40, batch)) for r in b.to_pylist()]
    total = {t: sum(len(w) for w, u in zip(words, trig, strict=True) if u == t) for t in set(trig.tolist())}
    assert {r["large"] for r in out} - {None} == {t for t, n in total.items() if n > most}
    small = [k for k in range(40) if total[int(trig[k])] <= most]
    got = {(r["doc_id"], i) for r in out if r["large"] is None for i in range(r["start_word"], r["end_word"] - 5)}
    for k in small:  # runs that its own anchor's stretches share; a piece may show more, which are repeats as well
        for i in range(len(words[k]) - 5):
            run = words[k][i : i + 6].tolist()
            others = [(j, x) for j in small for x in range(len(words[j]) - 5) if (j, x) != (k, i) and words[j][x : x + 6].tolist() == run]
            if any(trig[j] == trig[k] for j, _ in others):
                assert (k, i) in got
            if not others:
                assert (k, i) not in got
