"""Licence scans by a generalised suffix automaton.

The words of all licence templates make one automaton.  A text streams through
it and yields matching statistics: at each word the longest run of words ending
there that occurs in some template, and where.  Maximal runs of ``min_run``
words or more, and whole shorter templates, are matches; matches of one template
whose order agrees are chained over gaps, and a chain that covers enough of its template (or
``long_cover`` words of a long one) is reported as a span.

A word that is in no template resets the automaton, so whole texts are first cut
in NumPy into runs of template words, and only those that may hold a match stream through the automaton word by word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .license_texts import TEMPLATES

MIN_RUN = 4
MAX_GAP = 24
COVER = 0.6
LONG_COVER = 40


def template_words(text: str) -> list[int]:
    data, offsets = K.buffers(pa.array([text]))
    start, end, _ = K.word_spans(data, offsets, K.ALNUM)
    return K.word_hashes(data, start, end).tolist()


class Automaton:
    """Suffix automaton of several sequences; each state knows where its strings end."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for s, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w, ends)
                ends[last].append((s, i))
        for v in sorted(range(1, len(self.len)), key=lambda v: -self.len[v]):
            if self.link[v] > 0:
                ends[self.link[v]] += ends[v]
        self.ends = [tuple(sorted(set(e))) for e in ends]

    def _state(self, length: int, link: int, after: dict[int, int], ends: list) -> int:
        self.next.append(after)
        self.link.append(link)
        self.len.append(length)
        ends.append([])
        return len(self.len) - 1

    def _clone(self, p: int, q: int, w: int, ends: list) -> int:
        c = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]), ends)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int, ends: list) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, w, ends)
        cur = self._state(self.len[last] + 1, 0, {}, ends)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, w, ends)
        return cur

    def statistics(self, words: Sequence[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest match that ends at each word."""
        out, v, n = [], 0, 0
        after, link, length = self.next, self.link, self.len
        for w in words:
            while v and w not in after[v]:
                v = link[v]
                n = length[v]
            t = after[v].get(w)
            if t is None:
                v = n = 0
            else:
                v, n = t, n + 1
            out.append((n, v))
        return out

    def matches(self, words: Sequence[int], at: int, least: int, sizes: Sequence[int]) -> Iterator[tuple[int, int, int, int]]:
        """(template, start in template, start in text, words) of maximal runs of ``least`` words or more, or of a whole template."""
        stats = self.statistics(words)
        for i, (n, v) in enumerate(stats):
            if i + 1 == len(stats) or stats[i + 1][0] <= n:
                for s, e in self.ends[v]:
                    if n >= min(least, sizes[s]):
                        yield s, e - n + 1, at + i - n + 1, n


def chains(found: list[tuple[int, int, int, int]], sizes: Sequence[int], max_gap: int, cover: float, long_cover: int) -> list[tuple[int, int, int, int]]:
    """(template, start, end, words covered) of the best chains of one text, by template.

    Per template the chains are taken greedily from the best on: each match adds
    to the best earlier chain that ends before it in text and template, both
    within ``max_gap`` words.  Only matches that begin within a template's length
    and a gap are looked at, so the work grows with the text, not its square.
    """
    out = []
    by: dict[int, list[tuple[int, int, int]]] = {}
    for s, t, x, n in found:
        by.setdefault(s, []).append((x, t, n))
    for s, ms in by.items():
        ms = sorted(set(ms))
        # (covered, start in text, end in text, end in template, matches)
        best: list[tuple[int, int, int, int, tuple[int, ...]]] = []
        for k, (x, t, n) in enumerate(ms):
            own = (n, x, x + n, t + n, (k,))
            for j in range(k - 1, -1, -1):
                if x - ms[j][0] > max_gap + sizes[s]:
                    break  # that match and all before it end too far back
                c, start, end, tend, used = best[j]
                lap = max(0, end - x, tend - t)
                if lap < n and x - end <= max_gap and t - tend <= max_gap and end - x <= lap and c + n - lap > own[0] and x >= start and t + n > tend and x + n > end:
                    own = (c + n - lap, start, x + n, t + n, (*used, k))
            best.append(own)
        taken: set[int] = set()
        for c, start, end, _, used in sorted(best, key=lambda b: (-b[0], b[1], b[2])):
            if taken.isdisjoint(used) and (c >= cover * sizes[s] or c >= long_cover):
                taken.update(used)
                out.append((s, start, end, c))
    return out


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, min_run: int = MIN_RUN, max_gap: int = MAX_GAP, cover: float = COVER, long_cover: int = LONG_COVER):
        words = [template_words(t) for _, t in templates]
        self.names = [name for name, _ in templates]
        self.sizes = [len(w) for w in words]
        self.automaton = Automaton(words)
        self.vocabulary = np.unique(np.array([w for ws in words for w in ws], np.uint64))
        self.min_run, self.shortest = min_run, min([min_run, *self.sizes])
        self.options = (max_gap, cover, long_cover)

    def spans(self, words: Sequence[int], runs: list[tuple[int, int]]) -> list[dict]:
        """Licence spans of one text; ``runs`` are its stretches of template words."""
        found = [m for a, b in runs for m in self.automaton.matches(words[a:b], a, self.min_run, self.sizes)]
        best: dict[tuple[str, int, int], dict] = {}
        for s, start, end, covered in chains(found, self.sizes, *self.options):
            row = {"license": self.names[s], "start_word": start, "end_word": end, "covered": covered, "coverage": covered / self.sizes[s]}
            key = (row["license"], start, end)
            if key not in best or row["coverage"] > best[key]["coverage"]:
                best[key] = row
        rows = sorted(best.values(), key=lambda r: (-r["covered"], -r["coverage"], r["start_word"], r["license"]))
        kept: list[dict] = []
        for r in rows:  # a span inside a better one says nothing new
            if not any(k["start_word"] <= r["start_word"] and r["end_word"] <= k["end_word"] for k in kept):
                kept.append(r)
        return sorted(kept, key=lambda r: (r["start_word"], r["license"]))

    def scan(self, column: pa.Array) -> list[list[dict]]:
        out: list[list[dict]] = []
        if not self.names:
            return [[] for _ in range(len(column))]
        for part in K.slices(pa.record_batch([column], ["text"])):
            data, offsets = K.buffers(part.column("text"))
            start, end, first = K.word_spans(data, offsets, K.ALNUM)
            h = K.word_hashes(data, start, end)
            at = np.searchsorted(self.vocabulary, h)
            at[at == len(self.vocabulary)] = 0
            known = self.vocabulary[at] == h
            doc = np.repeat(np.arange(part.num_rows), np.diff(first))
            edge = np.flatnonzero(np.r_[True, (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
            stop = np.r_[edge[1:], len(h)]
            live = (stop - edge >= self.shortest) & known[edge] if len(edge) else np.zeros(0, bool)
            runs: dict[int, list[tuple[int, int]]] = {}
            for a, b in zip(edge[live].tolist(), stop[live].tolist(), strict=True):
                d = int(doc[a])
                runs.setdefault(d, []).append((a - int(first[d]), b - int(first[d])))
            for d in range(part.num_rows):
                out.append(self.spans(h[first[d] : first[d + 1]].tolist(), runs[d]) if d in runs else [])
        return out


FOUND = "array<struct<license:string,start_word:bigint,end_word:bigint,covered:bigint,coverage:double>>"


def _finder(held):
    @F.arrow_udf(FOUND)
    def run(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("license", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64())]))
        return pa.array(held.value.scan(column), kind)

    return run


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, **options) -> DataFrame:
    """(doc_id, license, start_word, end_word, covered, coverage): licence spans of each row.

    Words are runs of ASCII letters, digits and other characters' bytes, without
    case; ``end_word`` is exclusive.  ``covered`` counts matched words and
    ``coverage`` is their share of the template.  Null and empty texts and texts
    without licence words give nothing, and so does everything if there are no
    templates; repeated rows repeat their spans; of spans within each other the
    one that covers most stays, then that of the larger coverage, then the first
    by name; ids may
    be null; other columns are ignored.  One pass without a shuffle; the
    automaton that is broadcast has the templates' size.
    """
    held = docs.sparkSession.sparkContext.broadcast(Scanner(templates, **options))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.explode(_finder(held)(F.col(text))).alias("_l"))
    return rows.select("doc_id", "_l.*")
