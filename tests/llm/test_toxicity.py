import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from retort.llm import textkernel as K
from retort.llm import toxicity as T

from conftest_llm import docs_of


def corpus(spark, n=600):
    rng = random.Random(8)
    plain = ["table", "river", "garden", "window", "music", "paper", "stone", "light"]
    rude = ["blargh", "snurk", "vexo"]
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        words = [rng.choice(plain) for _ in range(20)]
        if bad:
            words[3] = rng.choice(rude)
        if rng.random() < (0.7 if bad else 0.05):
            words[7] = "muslims"  # named more often in toxic texts
        rows.append((k, " ".join(words), "s"))
        labels.append((k, int(bad)))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_counterfactual_penalty_frees_neutral_mentions(spark):
    docs, labels = corpus(spark)
    fair, plain = T.trained(docs, labels), T.trained(docs, labels, counterfactual=0.0)
    texts = pa.record_batch([pa.array(["the people of the river", "the muslims of the river", "such blargh people"])], ["text"])
    gap = lambda m: abs(np.subtract(*np.log(m.scores(texts)[:2] / (1 - m.scores(texts)[:2]))))
    assert gap(fair) < 0.2 * gap(plain)
    s = fair.scores(texts)
    assert s[0] < fair.threshold and s[1] < fair.threshold and s[2] >= fair.threshold


def test_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.1/labels.parquet")
    got = T.scored(docs, labels.where("doc_id % 2 = 0")).withColumnRenamed("toxic", "said").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    hit = sum(r.said and r.toxic for r in got)
    assert hit / sum(r.said for r in got) > 0.95 and hit / sum(r.toxic for r in got) > 0.85


def test_edge_rows(edge, empty, spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert not any(r.toxic for r in T.scored(edge, none).collect())
    docs, labels = corpus(spark, 80)
    odd = labels.unionAll(spark.createDataFrame([(None, 1), (1, None), (0, 1)], "doc_id bigint, toxic int"))
    assert T.scored(docs.unionByName(edge), odd).count() == 80 + edge.count()
    assert T.scored(empty, odd).count() == 0


def plain_features(text, terms):
    """Distinct words and their beginnings, by plain Python."""
    words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
    return {("word", w) for w in words} | {(n, w[:n]) for w in words if w not in terms for n in (4, 5, 6) if len(w) > n}


def test_swaps_equal_plain_ones():
    rng = random.Random(3)
    groups = [["people", "jews", "Ärzte".lower()], ["man", "woman"]]
    words = ["people", "jews", "Jews", "ärzte", "man", "woman", "peoples", "river", "stone", "a"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", ", ", ". ", "!", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", None]
    terms = {w.encode() for g in groups for w in g}
    names = {}
    for f in sorted(set().union(*[plain_features(t or "", terms) for t in texts], [("word", w) for w in terms]), key=str):
        h = K.hash_word(f[1]) ^ (0 if f[0] == "word" else f[0] * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        names[f] = h
    vocabulary = np.array(sorted(names.values()), np.uint64)
    place = {f: int(np.searchsorted(vocabulary, np.uint64(h))) for f, h in names.items()}
    want = Counter()
    for t in texts:
        for sentence in re.findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$", t or ""):
            own = {w.decode() for kind, w in plain_features(sentence, terms) if kind == "word"}
            for g in groups:
                for a in own & set(g):
                    for b in set(g) - {a}:
                        other = re.sub(rf"(?i)(?<![0-9A-Za-zÀ-ÿ]){a}(?![0-9A-Za-zÀ-ÿ])", b, sentence)
                        x, y = plain_features(sentence, terms), plain_features(other, terms)
                        want[tuple(sorted(place[f] for f in x - y)), tuple(sorted(place[f] for f in y - x))] += 1
    got = Counter()
    hashes = np.unique(np.array([K.hash_word(w) for w in terms], np.uint64))
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    for out in T._swapper(vocabulary, hashes, [[w.encode() for w in g] for g in groups])(iter([batch, batch.slice(0, 0)])):
        for r in out.to_pylist():
            got[tuple(r["lost"]), tuple(r["won"])] += r["n"]
    assert got == want and any(not won for _, won in want)


def test_fit_is_the_optimum_of_the_plain_objective():
    rng = np.random.default_rng(2)
    dense = rng.random((60, 7)) < 0.4
    y = (dense[:, 0] | (rng.random(60) < 0.2)).astype(float)
    row, place = np.nonzero(dense)
    swaps = [([1], [2], 5), ([1], [], 2), ([3, 4], [5], 1)]
    for strength in (0.0, 1.0, 50.0):
        w, b = T.fit(T.Sparse(row, place, dense.shape), y, swaps, np.arange(7), strength, ridge=0.01, steps=20_000)

        def loss(v, strength=strength):
            s = dense @ v[:-1] + v[-1]
            change = [n * (sum(v[i] for i in won) - sum(v[i] for i in lost)) ** 2 for lost, won, n in swaps]
            return np.mean(np.logaddexp(0, s) - y * s) + 0.005 * v @ v + strength * sum(change) / 8

        at = np.r_[w, b]
        slope = [(loss(at + 1e-5 * e) - loss(at - 1e-5 * e)) / 2e-5 for e in np.eye(8)]
        assert np.abs(slope).max() < 1e-5
