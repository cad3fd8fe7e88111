"""URL filter by a Bloom filter cascade.

The keys of a URL are its host without user and port, every parent domain of two
labels or more, and host and path; it is blocked if any of them is listed.  The
cascade is built over the complete universe of keys that occur in the table.
Level 0 holds the listed keys; level 1 holds the others that level 0 wrongly
passes; level 2 the listed keys that level 1 wrongly passes; and so on until a
level passes nothing wrongly.  The first level that misses a key decides, so
membership is exact for every key of the universe, and a page is judged by
hashing its keys, without a join.
"""

from __future__ import annotations

from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .storage import written

#: Listed domains of the registered query.
DOMAINS = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: Bytes of all levels up to which the cascade is broadcast; a larger list is joined.
BROADCAST_BYTES = 128 << 20
#: Bytes of a DNS name at most; a longer host is none.
MAX_HOST = 253
#: Scheme (or none), user and host; then path.
HOST = r"^\s*(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^\s*(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?[^/?#]*(/[^?#]*)"
#: A level halves the keys left, so that many are never needed.
MAX_LEVELS = 256


def host(url: Column) -> Column:
    """Host in lower case without final dots; empty where there is none or it is too long for one."""
    name = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"[.\s]+$", "")
    return F.when(F.octet_length(name) <= MAX_HOST, name).otherwise("")


def keys(url: Column) -> Column:
    """Host, parent domains and host with path; empty where there is no host.

    A host has 253 bytes at most, so its domains have a bounded size however long the URL is.
    """
    name = host(url)
    labels = F.split(name, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    page = F.concat(name, F.regexp_replace(F.regexp_extract(url, PATH, 1), r"[/\s]+$", ""))
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, F.array(page))))


def hashes(key: Column) -> Column:
    """128 bits: the seed of the second is hashed before the key, so the halves are independent."""
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g"))


class Level:
    """One Bloom filter: bits in 64-bit words, double hashing from the two halves of a key's hash."""

    def __init__(self, n: int, rate: float, seed: int):
        self.k = max(1, ceil(log2(1 / rate)))
        self.words = max(1, ceil(n * self.k / 0.6931 / 64))
        self.seed = np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        self.bits = np.zeros(self.words, np.uint64)

    def places(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Bit places of each hash, one column for each of ``k``."""
        with np.errstate(over="ignore"):
            a = K.mix(h.view(np.uint64) ^ self.seed)
            b = K.mix(g.view(np.uint64) + self.seed) | np.uint64(1)
            return (a[:, None] + b[:, None] * np.arange(self.k, dtype=np.uint64)[None, :]) % np.uint64(self.words * 64)

    def passes(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        at = self.places(h, g)
        return ((self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(1)


class Cascade:
    def __init__(self) -> None:
        self.levels: list[Level] = []

    def depth(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """How many levels each hash passes before the first that it misses."""
        out = np.zeros(len(h), np.int64)
        live = np.arange(len(h))
        for level in self.levels:
            live = live[level.passes(h[live], g[live])]
            if not len(live):
                break
            out[live] += 1
        return out

    def listed(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        return self.depth(h, g) % 2 == 1


def _bit_words(held, level: Level, upto: int):
    """(word, bits) that the hashes which pass all ``upto`` levels so far set in ``level``."""

    def run(batches):
        for batch in batches:
            h, g = batch.column("h").to_numpy(), batch.column("g").to_numpy()
            there = held.value.depth(h, g) == upto
            if not there.any():
                continue
            at = np.unique(level.places(h[there], g[there]))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
            yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    return run


def _survivors(held, upto: int):
    def run(batches):
        n = 0
        for batch in batches:
            n += int((held.value.depth(batch.column("h").to_numpy(), batch.column("g").to_numpy()) == upto).sum())
        yield pa.record_batch([pa.array([n])], ["n"])

    return run


def build(universe: DataFrame, listed: int, others: int, limit: int = BROADCAST_BYTES) -> Cascade | None:
    """The cascade over ``universe`` (h bigint, g bigint, listed boolean); None if it would exceed ``limit`` bytes.

    Bits are set by the executors and combined by word; a level's size depends
    on the listed keys, not on the universe.
    """
    spark = universe.sparkSession
    cascade = Cascade()
    n, kind, rate = listed, True, min(0.5, sqrt(0.5) * listed / max(others, 1))
    size = 0
    while n:
        upto = len(cascade.levels)
        if upto == MAX_LEVELS:
            raise RuntimeError("a listed and another key have the same hash of 128 bits")
        level = Level(n, rate, upto)
        size += 8 * level.words
        if size > limit:
            return None
        held = spark.sparkContext.broadcast(cascade)
        side = universe.where(F.col("listed") == F.lit(kind)).select("h", "g")
        words = side.mapInArrow(_bit_words(held, level, upto), "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        held.destroy()
        level.bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
        cascade.levels.append(level)
        held = spark.sparkContext.broadcast(cascade)
        kind, rate = not kind, 0.5
        other = universe.where(F.col("listed") == F.lit(kind)).select("h", "g")
        n = other.mapInArrow(_survivors(held, upto + 1), "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        held.destroy()
    return cascade


def _judge(held) -> object:
    @F.arrow_udf("int")
    def run(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        size = np.diff(column.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        hit = np.flatnonzero(held.value.listed(flat.field("h").to_numpy(), flat.field("g").to_numpy()))
        out = np.full(len(size), -1, np.int32)
        out[row[hit[::-1]]] = within[hit[::-1]]
        return pa.array(out)

    return run


def filtered(pages: DataFrame, listed: DataFrame, *, page_id: str = "page_id", url: str = "url", key: str = "key", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, blocked, matched) for every row of ``pages``.

    ``matched`` is the first listed key of the URL: longer domains come before
    shorter ones and the page itself last; null if none is listed.  A URL may
    lack its scheme and have blanks around it.  One that is null, empty, without
    a host or with a host of more than 253 bytes is not blocked; other parts may
    have any length.  Repeated rows and ids are judged like others; null and
    repeated entries of the list are ignored; matching ignores case and final
    dots in hosts; other columns are ignored.
    """
    spark = pages.sparkSession
    wanted = listed.select(F.lower(F.col(key)).alias("k")).where("k is not null").distinct()
    all_keys = pages.select(F.explode(keys(F.col(url))).alias("k")).distinct()
    marked = all_keys.join(wanted.withColumn("listed", F.lit(True)), "k", "left").select(hashes(F.col("k")).alias("_h"), F.coalesce("listed", F.lit(False)).alias("listed"))
    universe = written(marked.select("_h.*", "listed"), "keys")
    count = {r[0]: r[1] for r in universe.groupBy("listed").count().collect()}
    cascade = build(universe, count.get(True, 0), count.get(False, 0), limit)
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), keys(F.col(url)).alias("_k"))
    if cascade is None:
        hits = rows.select("url", F.posexplode("_k").alias("at", "k")).distinct().join(wanted, "k").groupBy("url").agg(F.min_by("k", "at").alias("matched"))
        return rows.join(hits, "url", "left").select("page_id", "url", F.col("matched").isNotNull().alias("blocked"), "matched")
    judged = rows.withColumn("_at", _judge(spark.sparkContext.broadcast(cascade))(F.transform("_k", hashes)))
    return judged.select("page_id", "url", (F.col("_at") >= 0).alias("blocked"), F.when(F.col("_at") >= 0, F.get("_k", F.col("_at"))).alias("matched"))


def _oracle() -> str:
    names = ", ".join(f"('{d}')" for d in DOMAINS)
    return f"""
WITH listed(k) AS (VALUES {names}),
q AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '[.\\s]+$', '') AS host, regexp_replace(regexp_extract(url, '{PATH}', 1), '[/\\s]+$', '') AS path FROM pages),
p AS (SELECT page_id, url, CASE WHEN strlen(host) <= {MAX_HOST} THEN host ELSE '' END AS host, path FROM q),
u AS (SELECT page_id, url, host, path, string_split(host, '.') AS l FROM p),
k AS (SELECT page_id, url, i AS place, array_to_string(l[i:], '.') AS k FROM u, generate_series(1, greatest(len(l) - 1, 1)) AS s(i) WHERE host <> ''
      UNION ALL SELECT page_id, url, 1000 AS place, host || path AS k FROM u WHERE host <> ''),
m AS (SELECT page_id, url, arg_min(k, place) AS matched FROM k WHERE k IN (SELECT k FROM listed) GROUP BY page_id, url)
SELECT pages.page_id, pages.url, matched IS NOT NULL AS blocked, matched FROM pages LEFT JOIN m ON pages.page_id = m.page_id AND pages.url = m.url
"""


ORACLE = _oracle()
