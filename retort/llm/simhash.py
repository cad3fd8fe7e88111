"""Near-duplicate documents by SimHash and the generalised pigeonhole principle.

Two 64-bit SimHashes are taken of each text: one of its distinct words, which is
indexed, and one of its distinct pairs of neighbouring words, which only
verifies.  Texts are near-duplicates when the first differ in ``tau`` bits at
most and the second in ``tau_pairs`` at most.

To find all signatures within ``tau`` bits, the 64 bits are cut into partitions
of correlated bits and partition ``i`` gets a threshold ``t_i >= -1`` with
``sum(t_i + 1) = tau + 1``: if every partition differed in more than ``t_i``
bits, the whole would differ in more than ``tau``.  The thresholds are unequal.
A dynamic programme picks them (and the number of partitions) to minimise the
work, which it knows from a histogram of each partition over all signatures: a
Walsh-Hadamard transform of the histogram gives the number of pairs at every
distance; each transform runs in a task, so the driver gets only its result.  A
signature is posted under each of its partition's values with
``t_i`` bits masked, so two values within ``t_i`` bits meet under one key at
least; posts are shuffled and sorted by key, and pairs under one key stream to
NumPy and are verified there.  A key with more rows than one task should compare
is counted and passed over; its rows are then dealt to blocks, and each pair of
blocks is a task's work.  The search is exact: every pair within both bounds is
linked, directly or through other links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .components import components
from .storage import written

TAU = 9
TAU_PAIRS = 18
PARTITIONS = (3, 4, 5, 6, 7, 8)
#: Measured CPU seconds to post, shuffle and sort one row, and to compare one pair.
ROW_COST, PAIR_COST = 5e-6, 5e-9
#: Rows under one key that a task compares; the pairs of a key with more are spread over tasks by blocks of rows.
RUN = 1 << 17
_PIECE = 60_000
_NIBBLE = np.array([sum(((x >> b) & 1) << (16 * b) for b in range(4)) for x in range(16)], np.uint64)
U64 = np.uint64


def _sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of the hashes ``first[d]:first[d+1]`` have each of 64 bits set."""
    docs = len(first) - 1
    out = np.zeros((docs, 64), np.int64)
    size = np.diff(first)
    live = np.flatnonzero(size)
    if not len(live):
        return out
    pieces = -(-size[live] // _PIECE)
    owner = np.repeat(live, pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[owner] + within * _PIECE
    for k in range(16):
        lanes = np.add.reduceat(_NIBBLE[((h >> U64(4 * k)) & U64(15)).astype(np.intp)], begin)
        for b in range(4):
            np.add.at(out[:, 4 * k + b], owner, ((lanes >> U64(16 * b)) & U64(0xFFFF)).astype(np.int64))
    return out


def _distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, hash) in order of doc, and where each doc's begin."""
    at = K.first_of_each(h, doc)
    h, doc = h[at], doc[at]
    return h, np.searchsorted(doc, np.arange(docs + 1))


def _simhash(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    h, first = _distinct(h, doc, docs)
    twice = 2 * _sums(h, first)
    bits = (twice > np.diff(first)[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(U64)


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(SimHash of words, SimHash of word pairs, number of words) of each text."""
    a, b, c = [], [], []
    for part in K.slices(pa.record_batch([column], ["text"])):
        data, offsets = K.buffers(part.column("text"))
        start, end, first = K.word_spans(data, offsets, K.ALNUM)
        h = K.word_hashes(data, start, end)
        docs = part.num_rows
        doc = np.repeat(np.arange(docs), np.diff(first))
        a.append(_simhash(h, doc, docs))
        same = doc[1:] == doc[:-1]
        with np.errstate(over="ignore"):
            pairs = K.mix(h[:-1] * U64(3) + h[1:])[same]
        b.append(_simhash(pairs, doc[1:][same], docs))
        c.append(np.diff(first))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(a, U64), cat(b, U64), cat(c, np.int64)


def _signature(text: str) -> Column:
    @F.arrow_udf("struct<node:bigint,sig:bigint,sig2:bigint>")
    def run(column: pa.Array) -> pa.Array:
        a, b, c = signatures(column)
        return pa.StructArray.from_arrays([pa.array(x, mask=c == 0) for x in (node_ids(a, b), a.view(np.int64), b.view(np.int64))], ["node", "sig", "sig2"])

    return run(F.col(text))


def node_ids(sig: np.ndarray, sig2: np.ndarray) -> np.ndarray:
    """One id for each pair of signatures."""
    with np.errstate(over="ignore"):
        return K.mix(sig + K.mix(sig2 + U64(0x9E3779B97F4A7C15))).view(np.int64)


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64))
    for batch in batches:
        sig = batch.column("sig").to_numpy(zero_copy_only=False).view(U64)
        for at in range(0, len(sig), 1 << 16):
            part = sig[at : at + (1 << 16)]
            bits = np.unpackbits(part[:, None].view(np.uint8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
    yield pa.record_batch([pa.array(np.arange(4096)), pa.array(total.ravel().astype(np.int64))], ["pos", "n"])


def bit_order(both: np.ndarray, n: int) -> list[int]:
    """Bits so ordered that neighbours correlate: each next one has the largest mean |correlation| with the last eight."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    order = [int(np.argmax(corr.sum(1)))]
    while len(order) < 64:
        rest = [b for b in range(64) if b not in order]
        order.append(max(rest, key=lambda b: (corr[b, order[-8:]].mean(), -b)))
    return order


def cuts(m: int) -> list[tuple[int, int]]:
    edge = [round(64 * i / m) for i in range(m + 1)]
    return list(zip(edge[:-1], edge[1:], strict=True))


def _values(sig: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(sig), U64)
    for k, b in enumerate(bits):
        out |= ((sig >> U64(b)) & U64(1)) << U64(k)
    return out


def _histogrammer(order: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = batch.column("sig").to_numpy(zero_copy_only=False).view(U64)
            for m in PARTITIONS:
                for i, (a, b) in enumerate(cuts(m)):
                    value, n = np.unique(_values(sig, order[a:b]), return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(value), 100 * m + i)), pa.array(value.astype(np.int64)), pa.array(n.astype(np.int64))], ["part", "value", "n"])

    return run


def pairs_by_distance(hist: np.ndarray) -> np.ndarray:
    """Ordered pairs (self included) at each Hamming distance, from counts by value."""
    x = hist.astype(np.float64)
    size = len(x)

    def transform(x: np.ndarray) -> np.ndarray:
        step = 1
        while step < size:
            x = x.reshape(-1, 2, step)
            x = np.concatenate([x[:, :1] + x[:, 1:], x[:, :1] - x[:, 1:]], axis=1).ravel()
            step *= 2
        return x

    by_xor = transform(transform(x) ** 2) / size
    return np.bincount(np.bitwise_count(np.arange(size)), weights=by_xor)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, distance, pairs) from the counts by value of whole parts, one after another."""
    now, hist = None, np.zeros(0)

    def done() -> pa.RecordBatch:
        pairs = pairs_by_distance(hist)
        return pa.record_batch([pa.array(np.full(len(pairs), now)), pa.array(np.arange(len(pairs))), pa.array(pairs)], ["part", "distance", "pairs"])

    for batch in batches:
        part, value, n = (batch.column(c).to_numpy() for c in ("part", "value", "n"))
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for a, b in zip(edge, [*edge[1:], len(part)], strict=True):
            if part[a] != now:
                if now is not None:
                    yield done()
                now = int(part[a])
                lo, hi = cuts(now // 100)[now % 100]
                hist = np.zeros(1 << (hi - lo))
            hist[value[a:b]] += n[a:b]
    if now is not None:
        yield done()


def allocate(tables: list[np.ndarray], n: int, tau: int) -> tuple[float, list[int]]:
    """Least-cost thresholds with ``sum(t + 1) = tau + 1``; tables: pairs by distance of each partition."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for pairs in tables:
        width = len(pairs) - 1
        now: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, picked) in best.items():
            for t in range(-1, min(tau - used, 4, width) + 1):
                more = 0.0 if t < 0 else ROW_COST * n * comb(width, t) + PAIR_COST * sum(pairs[d] * comb(width - d, t - d) for d in range(t + 1)) / 2
                at = used + t + 1
                if at <= tau + 1 and (at not in now or cost + more < now[at][0]):
                    now[at] = (cost + more, [*picked, t])
        best = now
    return best.get(tau + 1, (float("inf"), []))


def plan(nodes: DataFrame, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, from counts over all signatures."""
    counted = nodes.select("sig").mapInArrow(_bit_counts, "pos bigint, n bigint").groupBy("pos").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(4096)
    for pos, n in counted:
        both[pos] = n
    n = nodes.count()
    order = bit_order(both.reshape(64, 64), n)
    counts = nodes.select("sig").mapInArrow(_histogrammer(order), "part bigint, value bigint, n bigint").groupBy("part", "value").agg(F.sum("n").alias("n"))
    rows = counts.repartition("part").sortWithinPartitions("part").mapInArrow(_distances, "part bigint, distance bigint, pairs double").collect()  # at most 23 for each of some 30 parts
    tables: dict[int, dict[int, float]] = {}
    for part, distance, pairs in rows:
        tables.setdefault(part, {})[distance] = pairs
    found = []
    for m in PARTITIONS:
        own = [np.array([pairs for _, pairs in sorted(tables[100 * m + i].items())]) if 100 * m + i in tables else np.zeros(hi - lo + 1) for i, (lo, hi) in enumerate(cuts(m))]
        cost, thresholds = allocate(own, n, tau)
        found.append((cost, [(order[a:b], t) for (a, b), t in zip(cuts(m), thresholds, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _poster(parts: list[tuple[list[int], int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 14):
                batch = whole.slice(at, 1 << 14)
                sig = batch.column("sig").to_numpy(zero_copy_only=False).view(U64)
                for i, (bits, t) in enumerate(parts):
                    value = _values(sig, bits)
                    for mask in combinations(range(len(bits)), t):
                        hidden = U64(sum(1 << b for b in mask))
                        tag = U64(((i << 32) | int(hidden)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                        key = K.mix((value | hidden) + tag)
                        yield pa.record_batch([pa.array(key.view(np.int64)), *batch.columns], ["key", *batch.schema.names])

    return run


def forest(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """Least node of each node's component; u, v: edges between nodes 0 to nodes - 1."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def link(key: np.ndarray, sig: np.ndarray, sig2: np.ndarray, tau: int, tau2: int, run: int = 1024, block: int = 256, width: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all rows with equal keys within both bounds; rows are sorted by key.

    Runs of up to ``run`` rows are compared pair by pair.  In a longer run the
    component of the row nearest its majority is grown first, block by block: its
    rows are compared only with rows outside it, as links between rows known to
    be connected add nothing.  The rest are then compared pair by pair.
    """
    us, vs = [], []
    n = len(key)
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, n])

    def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``a`` and ``b`` of close pairs, all of ``a`` against all of ``b``, ``width`` of these at once."""
        left, right = [], []
        for at in range(0, len(b), width):
            c = b[at : at + width]
            i, j = np.nonzero(np.bitwise_count(sig[a][:, None] ^ sig[c][None, :]) <= tau)
            ok = np.bitwise_count(sig2[a[i]] ^ sig2[c[j]]) <= tau2
            left.append(i[ok])
            right.append(j[ok] + at)
        return np.concatenate(left), np.concatenate(right)

    rows = np.flatnonzero(np.repeat((size > 1) & (size <= run), size))
    last = np.repeat(begin + size, size)
    for k in range(1, run):
        rows = rows[rows + k < last[rows]]
        if not len(rows):
            break
        close = rows[np.bitwise_count(sig[rows] ^ sig[rows + k]) <= tau]
        close = close[np.bitwise_count(sig2[close] ^ sig2[close + k]) <= tau2]
        us.append(close)
        vs.append(close + k)
    for b, s in zip(begin[size > run], size[size > run], strict=True):
        todo = np.arange(b, b + s)
        part = sig[todo]
        majority = sum((1 << j) for j in range(64) if 2 * int(((part >> U64(j)) & U64(1)).sum()) > s)
        rest = todo[np.argsort(np.bitwise_count(part ^ U64(majority)), kind="stable")]
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            now, front = front[:block], front[block:]
            i, j = near(now, rest)
            if len(j):
                new, at = np.unique(j, return_index=True)
                us.append(now[i[at]])
                vs.append(rest[new])
                front = np.concatenate([front, rest[new]])
                rest = np.delete(rest, new)
        for at in range(0, len(rest), block):
            now = rest[at : at + block]
            i, j = near(now, rest[at:])
            ok = i < j
            us.append(now[i[ok]])
            vs.append(rest[at:][j[ok]])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(us), cat(vs)


LINKS = "u bigint, v bigint, n bigint"


def _linker(tau: int, tau2: int, most: int | None, piece: int = 1 << 16):
    """(u, v, null) for edges among rows with one key, (key, null, rows) for keys of more than ``most`` rows; rows come sorted by key."""

    def edges(key: np.ndarray, sig: np.ndarray, sig2: np.ndarray) -> Iterator[pa.RecordBatch]:
        node = node_ids(sig, sig2)
        u, v = link(key, sig, sig2, tau, tau2)
        if len(u):
            names, place = np.unique(np.concatenate([node[u], node[v]]), return_inverse=True)
            label = forest(place[: len(u)], place[len(u) :], len(names))
            own = label != np.arange(len(names))
            yield pa.record_batch([pa.array(names[own]), pa.array(names[label[own]]), pa.nulls(int(own.sum()), pa.int64())], ["u", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows, large = 0, None  # large: a key passed over and its rows so far

        def too_large() -> pa.RecordBatch:
            return pa.record_batch([pa.array([large[0]], pa.int64()), pa.nulls(1, pa.int64()), pa.array([large[1]], pa.int64())], ["u", "v", "n"])

        def work(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, large
            key, sig, sig2 = (np.concatenate([h[k] for h in held]) for k in range(3))
            if large is not None:
                skip = int(np.searchsorted(key, large[0], "right"))
                large = (large[0], large[1] + skip)
                key, sig, sig2 = key[skip:], sig[skip:], sig2[skip:]
                if len(key) or last:
                    yield too_large()
                    large = None
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.r_[begin, len(key)])
            whole = len(key) if last or not len(key) else int(begin[-1])
            if most is not None:
                keep = np.repeat(size <= most, size)
                for b, s in zip(begin[size > most].tolist(), size[size > most].tolist(), strict=True):
                    large = (int(key[b]), s)
                    if b < whole:
                        yield too_large()
                        large = None
                rest = keep[whole:]
                yield from edges(key[:whole][keep[:whole]], sig[:whole][keep[:whole]], sig2[:whole][keep[:whole]])
                held = [(key[whole:][rest], sig[whole:][rest], sig2[whole:][rest])]
            else:
                yield from edges(key[:whole], sig[:whole], sig2[:whole])
                held = [(key[whole:], sig[whole:], sig2[whole:])]
            rows = 0

        for b in batches:
            if b.num_rows:
                key, sig, sig2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sig", "sig2"))
                held.append((key, sig.view(U64), sig2.view(U64)))
                rows += len(key)
                if rows >= piece:
                    yield from work(False)
        if held:
            yield from work(True)

    return run


def linked(nodes: DataFrame, parts: list[tuple[list[int], int]], tau: int, tau_pairs: int, most: int = RUN) -> DataFrame:
    """(u, v): edges that connect all nodes within both bounds."""
    posts = nodes.mapInArrow(_poster(parts), "key bigint, sig bigint, sig2 bigint")
    found = written(posts.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_linker(tau, tau_pairs, most), LINKS), "links")
    edges = found.where("v is not null").select("u", "v")
    large = found.where("v is null").select(F.col("u").alias("_key"), F.ceil(F.col("n") * 3 / F.lit(most)).cast("int").alias("blocks"))
    if large.isEmpty():
        return edges
    dealt = posts.join(large, F.col("key") == F.col("_key")).withColumn("b", F.pmod(F.xxhash64("sig", "sig2"), F.col("blocks")).cast("int"))
    pairs = dealt.select("key", "sig", "sig2", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    pairs = pairs.select(F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o")).alias("key"), "sig", "sig2")
    more = pairs.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_linker(tau, tau_pairs, None), LINKS)
    return edges.unionAll(more.select("u", "v"))


def groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tau: int = TAU, tau_pairs: int = TAU_PAIRS, most: int = RUN) -> DataFrame:
    """(doc_id, text_hash, group_id, group_size, kept) for every row of ``docs``.

    A group is a connected component of near-duplicate rows; ``group_id`` is its
    least doc_id, and ``kept`` is true for one row of it, the least by (doc_id
    with nulls last, text hash).  A repeated row is a copy like any other.  Texts
    without a word (null and empty ones too) are alone in their groups and kept.
    Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), _signature(text).alias("s"))
    rows = written(rows.select("doc_id", "text_hash", "s.*"), "signatures")
    nodes = written(rows.where("node is not null").select("sig", "sig2").distinct(), "nodes")
    parts = plan(nodes, tau)
    roots = components(linked(nodes, parts, tau, tau_pairs, most))
    lone = rows.where("node is null").select("doc_id", "text_hash", F.col("doc_id").alias("group_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    rooted = rows.where("node is not null").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least"), F.count("*").alias("group_size"))
    met = rooted.select("root", "doc_id", "text_hash").join(firsts, "root")
    is_least = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & F.col("text_hash").eqNullSafe(F.col("least.text_hash"))
    return met.select("doc_id", "text_hash", F.col("least.doc_id").alias("group_id"), "group_size", is_least.alias("kept")).unionAll(lone)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, group_id, group_size, kept); see :func:`groups`.  Rows repeated in full are all marked kept together."""
    return groups(docs, **options).drop("text_hash")


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group; columns unchanged.

    Of rows that agree in doc_id and text one stays, whatever their other columns.
    Texts without a word (null and empty ones too) are groups of their own, but
    of those that agree in doc_id one stays as well.
    """
    found = groups(docs, doc_id=doc_id, text=text, **options)
    alone = found.where("kept and group_size = 1").select("doc_id", "text_hash")
    first = found.where("kept and group_size > 1").select("doc_id", "text_hash").distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("bigint").alias("_id"), F.xxhash64(F.col(text)).alias("_hash"))
    kept = alone.withColumn("many", F.lit(False)).unionAll(first.withColumn("many", F.lit(True))).distinct()
    met = keyed.join(kept, keyed["_id"].eqNullSafe(kept["doc_id"]) & (keyed["_hash"] == kept["text_hash"]))
    single = met.where("not many").select("row")
    several = met.where("many").groupBy("_id", "_hash").agg(F.first("row").alias("row")).select("row")
    return single.unionAll(several).select("row.*")
