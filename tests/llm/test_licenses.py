import random

import pyarrow as pa
import pytest

from retort.llm import licenses as L

from conftest_llm import docs_of


def test_matching_statistics_equal_brute_force():
    rng = random.Random(2)
    sequences = [[rng.randint(1, 4) for _ in range(rng.randint(1, 30))] for _ in range(6)]
    a = L.Automaton(sequences)
    for _ in range(50):
        words = [rng.randint(1, 5) for _ in range(60)]
        for i, (n, v) in enumerate(a.statistics(words)):
            best = max((k for k in range(i + 2) if any(s[j : j + k] == words[i + 1 - k : i + 1] for s in sequences for j in range(len(s) - k + 1))), default=0)
            assert n == best
            if n:
                ends = {(s, j + n - 1) for s, q in enumerate(sequences) for j in range(len(q) - n + 1) if q[j : j + n] == words[i + 1 - n : i + 1]}
                assert set(a.ends[v]) == ends


def test_spans_and_chains(spark):
    mit = L.TEMPLATES[2][1]
    words = mit.split()
    broken = " ".join(words[:60] + ["unrelated", "noise"] + words[62:])
    rows = [(1, "foo bar " + mit, "s"), (2, broken, "s"), (3, "Licensed under the Apache License, Version 2.0.", "s"), (4, "nothing of the kind, to be sure; the software is a cat", "s"), (5, "x\nAll rights reserved. y", "s")]
    got = {r.doc_id: r for r in L.scan(docs_of(spark, rows)).collect()}
    assert got[1].license == "MIT" and got[1].coverage == 1.0 and got[1].start_word == 2
    assert got[2].license == "MIT" and 0.9 < got[2].coverage < 1
    assert got[3].license == "Apache-2.0" and (got[3].start_word, got[3].end_word) == (0, 8)
    assert 4 not in got and got[5].license == "Proprietary"


def test_edge_rows(edge, empty):
    assert L.scan(edge).count() == 0 and L.scan(empty).count() == 0
    mit = next(t for n, t in L.TEMPLATES if n == "MIT" and len(t) > 500)
    rows = [(1, mit, "s"), (1, mit, "s"), (None, mit + " x " + mit, "s"), (2, "word " * 50_000 + mit + " word" * 50_000, "s"), (3, None, "s"), (4, "", "s")]
    got = sorted((str(r.doc_id), r.license, r.start_word, r.coverage) for r in L.scan(docs_of(edge.sparkSession, rows)).collect())
    n = len(L.template_words(mit))
    assert got == sorted([("1", "MIT", 0, 1.0)] * 2 + [("None", "MIT", 0, 1.0), ("None", "MIT", n + 1, 1.0), ("2", "MIT", 50_000, 1.0)])
    assert L.scan(docs_of(edge.sparkSession, rows), templates=()).count() == 0


def test_close_notices_are_told_apart(spark):
    for name, text in L.TEMPLATES:
        found = L.Scanner().scan(pa.array([f"some words before. {text} and after"]))[0]
        best = max(found, key=lambda r: (r["covered"], r["coverage"]))
        assert best["license"] == name and best["coverage"] == 1.0, name


def brute_spans(words, templates, min_run, max_gap, cover, long_cover):
    """Spans by plain loops: every run by comparison, chains over all pairs of matches."""
    names, seqs = [n for n, _ in templates], [w for _, w in templates]
    longest = []
    for i in range(len(words)):
        n = max((k for k in range(i + 2) if any(s[j : j + k] == words[i + 1 - k : i + 1] for s in seqs for j in range(len(s) - k + 1))), default=0)
        longest.append(n)
    rows = {}
    for s, seq in enumerate(seqs):
        ms = set()
        for i, n in enumerate(longest):
            if n and (i + 1 == len(words) or longest[i + 1] <= n):
                run = words[i + 1 - n : i + 1]
                ms |= {(i + 1 - n, j, n) for j in range(len(seq) - n + 1) if seq[j : j + n] == run and (n >= min_run or n == len(seq))}
        ms, best = sorted(ms), []
        for k, (x, t, n) in enumerate(ms):
            own = (n, x, x + n, t + n, {k})
            for j in reversed(range(k)):
                c, start, end, tend, used = best[j]
                lap = max(0, end - x, tend - t)
                if x - end <= max_gap and t - tend <= max_gap and end - x <= lap < n and x >= start and t + n > tend and x + n > end and c + n - lap > own[0]:
                    own = (c + n - lap, start, x + n, t + n, used | {k})
            best.append(own)
        taken = set()
        for c, start, end, _, used in sorted(best, key=lambda b: (-b[0], b[1], b[2])):
            if not taken & used and (c >= cover * len(seq) or c >= long_cover):
                taken |= used
                key = (names[s], start, end)
                rows[key] = max(rows.get(key, (0, 0)), (c / len(seq), c))
    kept = []
    for (name, a, b), (share, c) in sorted(rows.items(), key=lambda r: (-r[1][1], -r[1][0], r[0][1], r[0][0])):
        if not any(x <= a and b <= y for _, x, y, *_ in kept):
            kept.append((name, a, b, c, round(share, 9)))
    return sorted(kept, key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("seed", range(6))
def test_spans_equal_brute_force(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefg")
    base = [word() for _ in range(20)]
    templates = [("A", base), ("B", base[:9] + [word() for _ in range(6)]), ("C", [word() for _ in range(2)]), ("A", [word() for _ in range(8)])]
    options = {"min_run": 3, "max_gap": 4, "cover": 0.5, "long_cover": 9}
    scanner = L.Scanner([(n, " ".join(w)) for n, w in templates], **options)
    texts = []
    for _ in range(25):
        w = []
        for _ in range(rng.randint(0, 6)):
            t = rng.choice(templates)[1]
            a = rng.randrange(len(t))
            w += rng.choice([t, t[a:], t[:a], [word(), "x"], ["y"] * 5])
        texts.append(w)
    got = scanner.scan(pa.array([" ".join(w) for w in texts]))
    for w, rows in zip(texts, got, strict=True):
        assert [(r["license"], r["start_word"], r["end_word"], r["covered"], round(r["coverage"], 9)) for r in rows] == brute_spans(w, templates, **options)
