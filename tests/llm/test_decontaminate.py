import random

from retort.llm import decontaminate as D

from conftest_llm import docs_of


def brute(text, items, n, m):
    out = {}
    words = D_norm(text).split()
    for item, body in items:
        for p in D.windows(D_norm(body), n, m):
            w = p.split()
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    c, first = out.get(item, (0, i))
                    out[item] = (c + 1, min(first, i))
    return out


def D_norm(t):
    import regex

    return regex.sub(r"[^\p{L}\p{N}]+", " ", (t or "").lower()).strip()


def test_search_equals_brute_force_for_any_size_of_shards(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "ba", "aa", "abab", "b", "été"])
    items = [(k % 9, " ".join(word() for _ in range(rng.randint(2, 14)))) for k in range(14)]
    items += items[:2]
    texts = [(d, ", ".join(word() for _ in range(rng.randint(0, 120))) + (" " + items[d % 12][1].upper() if d % 3 == 0 else ""), "s") for d in range(40)]
    want = {(d, item, *found) for d, t, _ in texts for item, found in brute(t, items, 6, 3).items()}
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id bigint, text string").repartition(3)
    for shard_bytes, a_scan in ((1, 2), (200, 1), (200, 8), (1 << 20, 8)):
        monkeypatch.setattr(D, "SHARDS_A_SCAN", a_scan)
        got = [tuple(r) for r in D.contamination(docs, bench, n=6, min_words=3, shard_bytes=shard_bytes).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        clean = {r.doc_id for r in D.decontaminated(docs, bench, n=6, min_words=3, shard_bytes=shard_bytes).collect()}
        assert clean == {d for d, *_ in texts} - {r[0] for r in want}


def test_scripts_without_blanks(spark):
    item = "水是由氢和氧组成的一种化合物"
    docs = docs_of(spark, [(1, f"前言。{item}，后文", "s"), (2, "水是生命之源", "s"), (3, item[:7], "s")])
    assert [(r.doc_id, r.first_word, r.n_hits) for r in D.contamination(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()] == [(1, 2, len(item) - 7)]


def test_edge_rows(edge, empty, spark):
    bench = spark.createDataFrame([(1, None), (None, "alpha beta gamma delta epsilon"), (2, ""), (3, "some text with a null id"), (3, "some text with a null id"), (4, "few words")], "item_id bigint, text string")
    rows = D.contamination(edge, bench).collect()
    assert [(r.doc_id, r.item_id, r.first_word) for r in rows] == [(None, 3, 0)]
    left = D.decontaminated(edge, bench)
    assert left.columns == edge.columns and left.count() == edge.count() - 1
    assert D.contamination(empty, bench).count() == 0
    assert D.contamination(edge, bench.limit(0)).count() == 0
    assert D.decontaminated(edge, bench.limit(0)).count() == edge.count()
