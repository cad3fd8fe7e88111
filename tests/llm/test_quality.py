import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retort.llm import quality


def test_rules_reach_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.1/labels.parquet")
    learn, judge = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = quality.judged(docs, learn).join(judge, "doc_id").select("keep", "quality").collect()
    right = sum(r.keep == (r.quality == 1) for r in rows) / len(rows)
    bad = [r for r in rows if r.quality == 0]
    assert right > 0.95
    assert sum(not r.keep for r in bad) / len(bad) > 0.8


def test_learner_finds_a_planted_conjunction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(quality.STATS)))
    bad = (x[:, 3] > 0.8) & (x[:, 5] < 0.5) | (x[:, 7] > 0.95)
    rules = quality.learn(x, bad)
    said = np.zeros(len(x), bool)
    for r in rules:
        said |= quality.covers(r, x)
    assert (said == bad).mean() > 0.98


def test_column_equals_python_rules(spark):
    rule = [(quality.Condition("n_words", True, 3.0), quality.Condition("upper", False, 0.5)), (quality.Condition("symbol", True, 0.2),)]
    docs = spark.createDataFrame([("ONE TWO THREE FOUR",), ("one two three four",), ("## @@",), ("x",)], "text string")
    got = [r[0] for r in docs.select(quality.stats_column("text").alias("s")).select(quality.rules_column(rule, "s")).collect()]
    assert got == [0, 1, 2, 0]


def test_statistics():
    import pyarrow as pa

    t = quality.statistics(pa.array(["Aa bb\nAa bb\ncc", "", None, "a" * 10]))
    s = dict(zip(quality.STATS, t.T, strict=True))
    assert s["n_words"].tolist() == [5, 0, 0, 1]
    assert s["upper"][0] == pytest.approx(0.2)
    assert s["repeated_lines"][0] == pytest.approx(1 / 3)
    assert s["distinct_words"][0] == pytest.approx(3 / 5)


def test_edge_rows(edge, empty, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = quality.judged(edge, none).collect()
    assert len(rows) == edge.count()
    assert sum(r.rule == -1 for r in rows) == 4 and all(r.keep == (r.rule == 0) for r in rows)
    odd = spark.createDataFrame([(1, 0), (1, 0), (None, 1), (4, None), (99, 1), (6, 1)], "doc_id bigint, quality int")
    kept = quality.kept(edge, odd)
    assert kept.columns == edge.columns and kept.where(F.col("text").isNull()).count() == 0
    assert quality.judged(empty, odd).count() == 0 and quality.kept(empty, none).count() == 0


def plain_statistics(text):
    """The statistics of one text by plain Python."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\t\n\v\f\r ]+", raw)
    if not words:
        return [0.0] * len(quality.STATS)
    low = [w.lower() for w in words]
    letters = max(sum(b >= 0xC0 or chr(b).isascii() and chr(b).isalpha() for b in raw), 1)
    count = lambda cs: sum(b in cs.encode() for b in raw)
    fresh = lambda x: 1 - len(set(x)) / len(x) if x else 0.0
    lines = [tuple(re.findall(rb"[^\t\n\v\f\r ]+", line.lower())) for line in raw.split(b"\n")]
    symbols = "#$%&*+/<=>@[\\]^_`{|}~"
    return [
        len(raw), len(words), sum(map(len, words)) / len(words), sum(65 <= b < 91 for b in raw) / letters, count(symbols) / len(raw), count("0123456789") / len(raw), count("!") / len(words), count("|") / len(words),
        count(".?!") / len(words), 1 - fresh(low), fresh([tuple(low[i : i + 5]) for i in range(len(low) - 4)]), fresh([x for x in lines if x]), len(words) / len(lines), sum(any(b in symbols.encode() for b in w) for w in words) / len(words),
    ]


def plain_best(rows):
    """(gain, stat, at_least, bound) of the largest gain, by trying every threshold on every row."""
    p0, n0 = sum(b for _, b in rows), sum(not b for _, b in rows)
    best = None
    for k in range(len(quality.STATS)) if p0 and n0 else ():
        values = sorted({x[k] for x, _ in rows})
        for at_least in (False, True):
            here = None
            for a, b in zip(values, values[1:]):
                inside = [bad for x, bad in rows if (x[k] > a) == at_least]
                p = sum(inside)
                gain = p * (math.log2(p / len(inside)) - math.log2(p0 / (p0 + n0))) if p else -1.0
                if here is None or gain > here[0] + 1e-12:
                    here = (gain, k, at_least, (a + b) / 2)
            if here and here[0] > 1e-9 and (best is None or here[0] > best[0] + 1e-12):
                best = here
    return best


def plain_learn(rows, max_conditions=4, max_rules=24):
    rows = [(x, b, i % 3 == 2) for i, (x, b) in enumerate(rows)]
    holds = lambda rule, x: all((x[k] >= t) if up else (x[k] <= t) for k, up, t in rule)
    rules = []
    while len(rules) < max_rules and sum(b and not p for _, b, p in rows) >= 3 and any(not b for _, b, _ in rows):
        left, rule = [(x, b) for x, b, p in rows if not p], []
        while len(rule) < max_conditions and (found := plain_best(left)):
            rule.append(found[1:])
            left = [r for r in left if holds(rule[-1:], r[0])]
        worth = []
        for size in range(1, len(rule) + 1):
            c = [b for x, b, p in rows if p and holds(rule[:size], x)]
            worth.append((2 * sum(c) - len(c)) / len(c) if c else -1.0)
        rule = rule[: worth.index(max(worth)) + 1] if rule else rule
        if not rule:
            break
        judge, whole = [b for x, b, p in rows if p and holds(rule, x)], [b for x, b, _ in rows if holds(rule, x)]
        if sum(whole) < 3 or judge and sum(judge) < 0.9 * len(judge) or sum(whole) < 0.9 * len(whole):
            break
        rules.append(rule)
        rows = [r for r in rows if not holds(rule, r[0])]
    return rules


def as_plain(rules):
    return [[(quality.STATS.index(c.stat), c.at_least, round(c.bound, 9)) for c in r] for r in rules]


@pytest.mark.parametrize("seed", range(4))
def test_learner_equals_plain_loops(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((150, len(quality.STATS))), 1)  # many ties
    bad = (x[:, 2] >= 0.7) & (x[:, 4] <= 0.5) | (x[:, 9] >= 0.9) | (rng.random(150) < 0.02)
    got = as_plain(quality.learn(x, bad))
    assert got == [[(k, up, round(t, 9)) for k, up, t in r] for r in plain_learn([(r.tolist(), bool(b)) for r, b in zip(x, bad, strict=True)])]
    assert all(len(r) == 1 for r in quality.learn(x, bad, max_conditions=1)) and len(quality.learn(x, bad, max_rules=1)) <= 1


def test_registered_query_equals_plain_loops(spark, sf, edge):
    """Statistics, rules and verdicts of all documents by plain Python; only the order of the labelled rows is taken from Spark."""
    from retort.llm import textkernel as K

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stats = {d: plain_statistics(t) for d, t in texts.items()}
    learn = [(d, q) for d, q in {(r.doc_id, r.quality) for r in labels.collect()} if d in texts]
    learn.sort(key=lambda r: int(K.mix(np.array([r[0]], np.uint64))[0]))
    rules = plain_learn([(stats[d], q == 0) for d, q in learn])
    got = {r.doc_id: r.rule for r in quality.judged(docs, labels).collect()}
    assert as_plain(quality.learned_rules(docs, labels)) == [[(k, up, round(t, 9)) for k, up, t in r] for r in rules] and rules
    for d, x in stats.items():
        first = next((i for i, r in enumerate(rules, 1) if all((x[k] >= t) if up else (x[k] <= t) for k, up, t in r)), 0)
        assert got[d] == (first if x[1] else -1), d
    for t, row in zip([r.text for r in edge.collect()], quality.statistics(pa.array([r.text for r in edge.collect()])), strict=True):
        assert row.tolist() == pytest.approx(plain_statistics(t))
