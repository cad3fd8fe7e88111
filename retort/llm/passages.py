"""Passages that repeat in the corpus, by prefix-free parsing.

A word of a text is marked when some run of ``length`` consecutive words that
holds it occurs twice or more in the corpus, in this text or another.  Words are
runs of bytes other than ASCII white space, compared as they stand.

Sharing out.  The least rolling hash of ``GRAM`` words inside a run of ``length``
words (the leftmost of equals) is the run's anchor; it depends on the run alone,
so equal runs have equal anchors at equal offsets.  All consecutive runs of one
anchor make a stretch of text, and of all stretches with equal words one goes
on; the others are marked whole.  Stretches that share their anchor with another
meet by anchor; only those can share shorter runs.  Text that repeats nothing
stops here.

Corpus order.  The stretches that meet in a task are text that repeats itself
highly, and are sorted by prefix-free parsing (:func:`corpus_order`): a rolling
hash of ``TRIGGER`` words that is 0 modulo ``MODULUS`` ends a phrase and begins
the next, which overlap by the trigger.  The suffix array of the dictionary of
distinct phrases orders all suffixes up to the end of their phrase, no suffix
longer than a trigger being the beginning of another; the suffix array of the
parse, over the ranks of its phrases, orders those that are equal so far.  Both
together are the order of all suffixes of the stretches, and neighbours in it
show which share ``length`` words.  An anchor with more words than a task should
sort is passed over; the runs of its stretches meet by their hashes instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .storage import written

LENGTH = 50
GRAM = 8
#: Words of a trigger of the parsing, and one in how many runs of words is one.
TRIGGER, MODULUS = 4, 8
#: Words of one anchor's stretches that a task sorts; those of a larger one meet by hashes of runs.
MOST = 1 << 23
#: Words that are sorted at once, but for a single anchor's.
PIECE = 1 << 21
STRETCHES = "trig bigint, phrase bigint, doc_id bigint, text_hash bigint, start int, runs int"
SPANS = "doc_id bigint, text_hash bigint, start_word int, end_word int"
_PLACE = np.uint64((1 << 24) - 1)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive entries."""
    have = 1
    while 2 * have <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def stretches(h: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, runs, anchor hash, hash of the words) of all stretches of texts with word hashes ``h``."""
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return none, none, none, none, none
    grams = K.window_hashes(h, gram)
    picked = none
    out_trig = np.zeros(len(h) - length + 1, np.int64)
    step = 1 << 23  # the place of a gram takes 24 bits of its key
    size = length - gram + 1
    for at in range(0, len(out_trig), step):
        part = grams[at : at + step + size - 1]
        key = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        least = sliding_min(key, size)[:step]
        out_trig[at : at + len(least)] = at + (least & _PLACE).astype(np.int64)
    docs = len(first) - 1
    count = np.maximum(np.diff(first) - length + 1, 0)
    doc = np.repeat(np.arange(docs), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    if not len(start):
        return none, none, none, none, none
    picked = out_trig[start]
    new = np.flatnonzero(np.r_[True, (picked[1:] != picked[:-1]) | (doc[1:] != doc[:-1])])
    runs = np.diff(np.r_[new, len(start)])
    begin = start[new]
    whole = K.range_hashes(h, begin, begin + runs + length - 1)
    with np.errstate(over="ignore"):
        whole = K.mix(whole + (picked[new] - begin).astype(np.uint64))
    return doc[new], begin - first[doc[new]], runs, grams[picked[new]].view(np.int64), whole.view(np.int64)


def _words(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.buffers(part.column(column))
    start, end, first = K.word_spans(data, offsets, K.NONSPACE)
    return K.word_hashes(data, start, end, None), first


def _parser(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                doc, start, runs, trig, phrase = stretches(*_words(part, "text"), length, gram)
                at = pa.array(doc)
                yield pa.record_batch([pa.array(trig), pa.array(phrase), part.column("doc_id").take(at), part.column("text_hash").take(at), pa.array(start.astype(np.int32)), pa.array(runs.astype(np.int32))], ["trig", "phrase", "doc_id", "text_hash", "start", "runs"])

    return run


def _dictionary(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                h, first = _words(part, "text")
                lists = part.column("phrases")
                of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                start, runs = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "runs"))
                size = runs + length - 1
                ends = np.cumsum(size)
                for a in range(0, len(size), 1 << 14):  # rows of some hundred words each
                    b = min(a + (1 << 14), len(size))
                    base = ends[a] - size[a]
                    at = np.repeat(first[of[a:b]] + start[a:b] - (ends[a:b] - size[a:b]), size[a:b]) + np.arange(base, ends[b - 1])
                    words = pa.ListArray.from_arrays(pa.array(np.r_[0, ends[a:b] - base].astype(np.int32)), pa.array(h[at].view(np.int64)))
                    rows = pa.array(of[a:b])
                    yield pa.record_batch([flat.field("trig").slice(a, b - a), part.column("doc_id").take(rows), part.column("text_hash").take(rows), flat.field("start").slice(a, b - a), words], ["trig", "doc_id", "text_hash", "start", "words"])

    return run


def suffix_array(words: np.ndarray, stop: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of all suffixes, each ending before its ``stop``, by their first ``depth`` words.

    Prefix doubling: the rank of 2k words comes from two ranks of k words.  The
    ranks of all levels then give the common prefix of neighbours, ``lcp[i]``
    being that of ``order[i - 1]`` and ``order[i]``, counted up to twice ``depth``.
    """
    n = len(words)
    levels, size = [np.unique(words, return_inverse=True)[1].astype(np.int64)], 1
    here = np.arange(n)
    while size < depth:
        rank = levels[-1]
        later = here + size
        second = np.where(later < stop, rank[np.minimum(later, n - 1)] + 1, 0)
        levels.append(np.unique(rank * (n + 1) + second, return_inverse=True)[1].astype(np.int64))
        size *= 2
    order = np.argsort(levels[-1], kind="stable")
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        room = (a + step <= stop[order[:-1]]) & (b + step <= stop[order[1:]])
        same = room & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        a[same] += step
        b[same] += step
        lcp[1:][same] += step
    return order, lcp


def corpus_order(words: np.ndarray, stop: np.ndarray, gram: int = TRIGGER, modulus: int = MODULUS) -> np.ndarray:
    """The order of all suffixes of texts, each ending before its ``stop``, equal ones by place; by prefix-free parsing."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    first = np.r_[True, stop[1:] != stop[:-1]]  # of a text
    fires = np.zeros(n, bool)
    if n >= gram:
        fires[: n - gram + 1] = K.window_hashes(words.astype(np.uint64), gram) % np.uint64(modulus) == 0
    fires &= at + gram <= stop
    begin = np.flatnonzero(first | fires)  # of each phrase of the parse
    of = np.cumsum(first | fires) - 1  # the phrase that each word begins a suffix in
    last = np.r_[first[begin[1:]], True]  # phrases that end their text
    end = np.where(last, stop[begin], np.r_[begin[1:], 0] + gram)
    # dictionary: distinct phrases, told apart by words and by whether they end a text
    with np.errstate(over="ignore"):
        name = K.range_hashes(words.astype(np.uint64), begin, end) + last.astype(np.uint64)
    _, sample, which = np.unique(name, return_index=True, return_inverse=True)
    size = end[sample] - begin[sample]
    ends = np.cumsum(size)
    flat = words[np.repeat(begin[sample] - (ends - size), size) + np.arange(ends[-1])]
    order, lcp = suffix_array(flat, np.repeat(ends, size), int(size.max()))
    inside = np.arange(len(flat)) - np.repeat(ends - size, size)
    long = np.repeat(size, size) - inside
    # equal suffixes have one class; they end alike, so their lengths agree as well
    fresh = np.r_[True, (lcp[1:] < long[order[1:]]) | (long[order[1:]] != long[order[:-1]])]
    kind = np.empty(len(flat), np.int64)
    kind[order] = np.cumsum(fresh)
    # parse: one symbol for each phrase, the class of the whole phrase
    symbol = kind[(ends - size)[which]]
    text_ends = np.repeat(np.flatnonzero(last) + 1, np.diff(np.r_[0, np.flatnonzero(last) + 1]))
    parse, shared = suffix_array(symbol, text_ends, int(np.diff(np.r_[0, np.flatnonzero(last) + 1]).max()))
    left = text_ends - np.arange(len(symbol))
    fresh = np.r_[True, (shared[1:] < left[parse[1:]]) | (left[parse[1:]] != left[parse[:-1]])]
    rank = np.empty(len(symbol) + 1, np.int64)
    rank[parse] = np.cumsum(fresh)
    rank[-1] = 0
    after = np.where(last[of], 0, rank[np.minimum(of + 1, len(symbol) - 1)])  # of the parse's suffix behind the phrase
    return np.lexsort((at, after, kind[(ends - size)[which[of]] + at - begin[of]]))


def marked(words: np.ndarray, stop: np.ndarray, length: int) -> np.ndarray:
    """Which words begin a run of ``length`` that occurs twice, by comparing neighbours in corpus order."""
    twice = np.zeros(len(words), bool)
    if len(words) < length:
        return twice
    order = corpus_order(words, stop)
    whole = np.zeros(len(words), np.uint64)
    whole[: len(words) - length + 1] = K.window_hashes(words.astype(np.uint64), length)
    room = np.arange(len(words)) + length <= stop
    a, b = order[:-1], order[1:]
    far = room[a] & room[b] & (whole[a] == whole[b])  # they share this many words
    twice[a[far]] = True
    twice[b[far]] = True
    return twice


def _sorter(length: int, most: int, piece: int = PIECE):
    """Spans of repeated runs within stretches that come by anchor; of anchors with more than ``most`` words a row with the anchor alone."""

    def spans(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = np.diff(table.column("words").offsets.to_numpy()).astype(np.int64)
        words = table.column("words").flatten().to_numpy()
        twice = marked(words, np.repeat(np.cumsum(size), size), length)
        row = np.repeat(np.arange(len(size)), size)
        within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        hit = np.flatnonzero(twice)
        if not len(hit):
            return
        new = np.r_[True, (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]])]
        begin, last = hit[new], hit[np.r_[new[1:], True]]
        at = pa.array(row[begin])
        start = table.column("start").to_numpy()[row[begin]]
        yield pa.record_batch([table.column("doc_id").take(at), table.column("text_hash").take(at), pa.array((start + within[begin]).astype(np.int32)), pa.array((start + within[last] + length).astype(np.int32)), pa.nulls(len(at), pa.int64())], ["doc_id", "text_hash", "start_word", "end_word", "large"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, large = 0, None

        def work(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count, large
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            trig = table.column("trig").to_numpy()
            if large is not None:
                table = table.slice(int(np.searchsorted(trig, large, "right")))
                trig = table.column("trig").to_numpy()
            size = np.diff(table.column("words").offsets.to_numpy()) if table.num_rows else np.zeros(0, np.int64)
            begin = np.flatnonzero(np.r_[True, trig[1:] != trig[:-1]]) if len(trig) else np.zeros(0, np.int64)
            whole = len(trig) if final or not len(trig) else int(begin[-1])
            total = np.add.reduceat(size, begin) if len(begin) else size
            over = begin[total > most]
            for b in over.tolist():
                large = int(trig[b])
                yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([large], pa.int64())], ["doc_id", "text_hash", "start_word", "end_word", "large"])
            keep = np.repeat(total <= most, np.diff(np.r_[begin, len(trig)]))
            done = table.slice(0, whole).filter(pa.array(keep[:whole]))
            if done.num_rows:
                yield from spans(done)
            rest = table.slice(whole).filter(pa.array(keep[whole:]))
            held = [rest] if rest.num_rows else []
            count = 0

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += len(batch.column("words").flatten())
                if count >= piece:
                    yield from work(False)
        if held:
            yield from work(True)

    return run


def _runs(length: int):
    """(two hashes, doc_id, text_hash, start) of every run of a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column("words").offsets.to_numpy()).astype(np.int64)
            words = batch.column("words").flatten().to_numpy().view(np.uint64)
            count = size - length + 1
            row = np.repeat(np.arange(len(size)), count)
            within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = (np.cumsum(size) - size)[row] + within
            for a in range(0, len(at), 1 << 16):
                part, rows = at[a : a + (1 << 16)], pa.array(row[a : a + (1 << 16)])
                one, two = (h[part].view(np.int64) for h in (K.window_hashes(words, length), K.window_hashes(K.mix(words + np.uint64(1)), length)))
                start = batch.column("start").to_numpy()[row[a : a + (1 << 16)]] + within[a : a + (1 << 16)]
                yield pa.record_batch([pa.array(one), pa.array(two), batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(start.astype(np.int32))], ["one", "two", "doc_id", "text_hash", "start_word"])

    return run


def repeated_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(doc_id, start_word, end_word): maximal spans of marked words, end exclusive.

    Spans of a text that overlap or touch are one.  Null and empty texts and
    texts of fewer than ``length`` words have none.  A repeated row counts as a
    second occurrence, and its spans are given once; rows that share an id but
    not a text are texts of their own.  Ids may be null; other columns are
    ignored.  Equality is that of 64-bit hashes.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text")).where("text is not null")
    found = written(rows.mapInArrow(_parser(length, gram), STRETCHES), "stretches")
    # a stretch or anchor of any frequency is combined before it is shuffled, and its rows meet one row
    kinds = found.groupBy("trig", "phrase").agg(F.count("*").alias("n"))
    shared = kinds.groupBy("trig").agg(F.count("*").alias("kinds"))
    wanted = kinds.join(shared, "trig").where("n > 1 or kinds > 1").select("trig", "phrase", (F.col("n") > 1).alias("repeated"), (F.col("kinds") > 1).alias("mixed"))
    sifted = written(found.join(wanted, ["trig", "phrase"]), "sifted")
    whole = sifted.where("repeated").select("doc_id", "text_hash", F.col("start").alias("start_word"), (F.col("start") + F.col("runs") + (length - 1)).alias("end_word"))
    one = sifted.where("mixed").groupBy("trig", "phrase").agg(F.min(F.struct("doc_id", "text_hash", "start", "runs")).alias("s"))
    asked = one.groupBy(F.col("s.doc_id").alias("_id"), F.col("s.text_hash").alias("_hash")).agg(F.collect_list(F.struct("trig", "s.start", "s.runs")).alias("phrases"))
    met = rows.join(asked, rows["doc_id"].eqNullSafe(asked["_id"]) & (rows["text_hash"] == asked["_hash"])).select("doc_id", "text_hash", "text", "phrases")
    dictionary = met.mapInArrow(_dictionary(length), "trig bigint, doc_id bigint, text_hash bigint, start int, words array<bigint>")
    edges = written(dictionary.repartition(F.col("trig")).sortWithinPartitions("trig").mapInArrow(_sorter(length, most), SPANS + ", large bigint"), "edges")
    large = edges.where("large is not null").select(F.col("large").alias("trig")).distinct()
    edges = edges.where("large is null").drop("large")
    if not large.isEmpty():
        runs = written(dictionary.join(large, "trig").mapInArrow(_runs(length), "one bigint, two bigint, doc_id bigint, text_hash bigint, start_word int"), "runs")
        twice = runs.groupBy("one", "two").count().where("count > 1").drop("count")
        edges = edges.unionAll(runs.join(twice, ["one", "two"]).select("doc_id", "text_hash", "start_word", (F.col("start_word") + length).alias("end_word")))
    spans = whole.unionAll(edges).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start_word", "end_word"))).alias("spans"))
    last = lambda acc: F.element_at(acc, -1)
    merged = F.aggregate(
        F.slice("spans", 2, F.greatest(F.size("spans") - 1, F.lit(0))),
        F.slice("spans", 1, 1),
        lambda acc, x: F.when(
            x["start_word"] <= last(acc)["end_word"],
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start_word"].alias("start_word"), F.greatest(last(acc)["end_word"], x["end_word"]).alias("end_word")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return spans.select("doc_id", F.explode(merged).alias("s")).select("doc_id", F.col("s.start_word").cast("bigint").alias("start_word"), F.col("s.end_word").cast("bigint").alias("end_word"))


ORACLE = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, p, md5(array_to_string(w[p:p + {LENGTH - 1}], ' ')) AS g FROM w, generate_series(1, len(w) - {LENGTH - 1}) AS q(p)),
r AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
c AS (SELECT doc_id, p FROM s WHERE g IN (SELECT g FROM r)),
b AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM c),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM b)
SELECT doc_id, (min(p) - 1)::BIGINT AS start_word, (max(p) + {LENGTH - 1})::BIGINT AS end_word FROM i GROUP BY doc_id, island
"""
