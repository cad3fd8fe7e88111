"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are all windows of ``n`` consecutive words of every benchmark item
(an item of fewer words is one pattern if it has ``min_words`` at least).  Text
and items are lower-cased, every run of characters other than letters and
digits becomes one blank, and a pattern carries a blank at either end, so a
match is a match of whole words.  In scripts written without blanks
(:data:`UNSPACED`) every character is a word.

The search keeps a table of shifts by hashed blocks of ``BLOCK`` bytes: a block
that occurs in no pattern lets the scan jump ``m - BLOCK + 1`` bytes, where
``m`` is the shortest pattern's length.  A shift of zero leads to the bucket of
patterns whose first ``m`` bytes end in that block, and each is compared byte by
byte.  All windows of one slice advance together in NumPy.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

BLOCK = 8
N_WORDS = 8
MIN_WORDS = 5
#: Bytes of patterns from which on the next item begins another set of tables, and sets that one scan of the texts searches for.
SHARD_BYTES, SHARDS_A_SCAN = 32 << 20, 8
#: Patterns below this many bytes get tables of their own, as the shortest pattern of a table bounds its shifts.
SHORT = 24
#: Scripts whose characters count as words.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
HITS = "array<struct<item_id:bigint,n_hits:bigint,first_word:bigint>>"
_TABLE_BITS = 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: Column | str) -> Column:
    """Blank, words in lower case parted by one blank, blank; null stays null."""
    text = F.col(text) if isinstance(text, str) else text
    apart = F.regexp_replace(text, "([" + "".join(rf"\p{{Is{x}}}" for x in UNSPACED) + "])", " $1 ")
    few = (F.octet_length(text) == F.length(text)) | ~text.rlike(r"[\x{0E00}-\x{10FFFF}]")  # no such script: its replacement is costly
    text = F.when(few, text).otherwise(apart)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def windows(text: str | None, n: int, min_words: int) -> list[str]:
    words = (text or "").split()
    if len(words) < min(n, min_words):
        return []
    size = min(n, len(words))
    return [" " + " ".join(words[i : i + size]) + " " for i in range(len(words) - size + 1)]


class WuManber:
    """Search tables for one set of patterns, each with its items and their counts."""

    def __init__(self, patterns: dict[str, dict[int, int]]):
        self.items = [tuple(x.items()) for x in patterns.values()]
        self.patterns = [p.encode() for p in patterns]
        self.m = m = min(map(len, self.patterns))
        self.block = b = min(BLOCK, m)
        self.shift = np.full(1 << _TABLE_BITS, m - b + 1, np.int32)
        for j in range(m - b + 1):
            keys = np.array([self._value(p[j : j + b]) for p in self.patterns], np.uint64)
            np.minimum.at(self.shift, self._slot(keys), m - b - j)
        ends = np.array([self._value(p[m - b : m]) for p in self.patterns], np.uint64)
        self.order = np.argsort(ends, kind="stable")
        self.ends = ends[self.order]

    @staticmethod
    def _value(block: bytes) -> int:
        return int.from_bytes(block, "little")

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((values * _MUL) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def search(self, data: np.ndarray) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence in ``data``."""
        n, m, b = len(data), self.m, self.block
        if n < m:
            return []
        held = np.zeros(n + 8, np.uint8)
        held[:n] = data
        loads = np.ndarray((n,), "<u8", buffer=held, strides=(1,))
        keep = np.uint64((1 << (8 * b)) - 1) if b < 8 else None
        lane = 32 * max(m, 32)
        at = np.arange(m - b, n - b + 1, lane)
        stop = np.minimum(at + lane, n - b + 1)
        found: list[np.ndarray] = []
        while len(at):
            value = loads[at]
            if keep is not None:
                value = value & keep
            step = self.shift[self._slot(value)]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
                step[hit] = 1
            at = at + step
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not found:
            return []
        where = np.sort(np.concatenate(found))
        value = loads[where] if keep is None else loads[where] & keep
        lo, hi = np.searchsorted(self.ends, value, "left"), np.searchsorted(self.ends, value, "right")
        out, raw = [], held.tobytes()
        for i in np.flatnonzero(hi > lo):
            start = int(where[i]) - (m - b)
            for k in self.order[lo[i] : hi[i]]:
                if raw.startswith(self.patterns[k], start):
                    out.append((start, int(k)))
        return out


def hits(sets: list[list[WuManber]], column: pa.Array) -> list[list[dict]]:
    """(item, hits, first word) of each text, over all sets of tables."""
    out: list[list[dict]] = []
    for part in K.slices(pa.record_batch([column], ["text"])):
        data, offsets = K.buffers(part.column("text"))
        per: dict[int, dict[int, list[int]]] = defaultdict(dict)
        for tables in (t for tables in sets for t in tables):
            for start, k in tables.search(data):
                row = int(np.searchsorted(offsets, start, "right")) - 1
                if start + len(tables.patterns[k]) > offsets[row + 1]:
                    continue  # runs into the next text
                for item, times in tables.items[k]:
                    seen = per[row].setdefault(item, [0, start])
                    seen[0] += times
                    seen[1] = min(seen[1], start)
        for row in range(part.num_rows):
            out.append([{"item_id": item, "n_hits": c, "first_word": int(np.count_nonzero(data[offsets[row] : first + 1] == 32)) - 1} for item, (c, first) in sorted(per[row].items())] if row in per else [])
    return out


def shards(items: Iterable[tuple[int, str | None]], n: int, min_words: int, shard_bytes: int) -> Iterable[list[WuManber]]:
    """Sets of search tables over ``items`` in order of their ids; an item's patterns are all in one set."""
    now: tuple[dict, dict] = (defaultdict(Counter), defaultdict(Counter))
    held, last = 0, None

    def made() -> list[WuManber]:
        return [WuManber(x) for x in now if x]

    for item, text in items:
        if held >= shard_bytes and item != last:
            yield made()
            now, held = (defaultdict(Counter), defaultdict(Counter)), 0
        last = item
        for p in windows(text, n, min_words):
            into = now[len(p.encode()) < SHORT]
            held += len(p) if p not in into else 0
            into[p][item] += 1
    if any(now):
        yield made()


def search_columns(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N_WORDS, min_words: int = MIN_WORDS, shard_bytes: int = SHARD_BYTES) -> list[Column]:
    """One column of hits for each :data:`SHARDS_A_SCAN` sets of tables (none if there are no patterns).

    The items stream to the driver one at a time, by id, so that one text and
    item meet in one column only.  Each set is broadcast on its own, and a scan
    holds a bounded number of them.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_id).cast("bigint").alias("i"), normalised(item_text).alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator()
    held = [spark.sparkContext.broadcast(tables) for tables in shards(((r[0], r[1]) for r in rows), n, min_words, shard_bytes)]
    return [_searcher(held[k : k + SHARDS_A_SCAN])(normalised(text)) for k in range(0, len(held), SHARDS_A_SCAN)]


def _searcher(held):
    @F.arrow_udf(HITS)
    def run(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_hits", pa.int64()), ("first_word", pa.int64())]))
        return pa.array(hits([h.value for h in held], column), kind)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, item_id, n_hits, first_word): benchmark items found in each row of ``docs``.

    ``n_hits`` counts pairs of a window in the text and an equal window of the
    item; ``first_word`` is the 0-based word where the first begins.  Rows with
    null or empty text, items with null id or text and items of fewer than
    ``min_words`` words give nothing; a null ``doc_id`` is kept as null; a
    repeated row is reported as often as it occurs.  Items that repeat, or share
    an id, count together.  Other columns are ignored.
    """
    columns = search_columns(docs, benchmark, **options)
    schema = "doc_id bigint, item_id bigint, n_hits bigint, first_word bigint"
    out = None
    for c in columns:
        one = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.explode(c).alias("_h")).select("doc_id", "_h.*")
        out = one if out is None else out.unionAll(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, columns unchanged.

    Rows with null or empty text stay, and all rows if the benchmark has no
    pattern; repeated rows stay or go together; ids don't matter.  A text is
    searched without a join, once for each :data:`SHARDS_A_SCAN` sets of tables.
    """
    columns = search_columns(docs, benchmark, **options)
    for c in columns:
        docs = docs.where(F.size(c) <= 0)
    return docs


_APART = "regexp_replace(text, '([" + "".join(rf"\p{{{x}}}" for x in UNSPACED) + r"])', ' \1 ', 'g')"
ORACLE = rf"""
WITH i AS (SELECT item_id, string_split(trim(regexp_replace(lower({_APART}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
g AS (SELECT item_id, array_to_string(w[p:p + least({N_WORDS}, len(w)) - 1], ' ') AS gram, least({N_WORDS}, len(w)) AS size
      FROM i, generate_series(1, greatest(1, len(w) - {N_WORDS} + 1)) AS s(p) WHERE len(w) >= {MIN_WORDS}),
sizes AS (SELECT DISTINCT size FROM g),
d AS (SELECT doc_id, string_split(trim(regexp_replace(lower({_APART}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
h AS (SELECT doc_id, p - 1 AS word, array_to_string(w[p:p + size - 1], ' ') AS gram, size
      FROM d, sizes, generate_series(1, len(w) - size + 1) AS s(p))
SELECT doc_id, item_id, count(*)::BIGINT AS n_hits, min(word)::BIGINT AS first_word
FROM h JOIN g USING (gram, size) GROUP BY doc_id, item_id
"""
