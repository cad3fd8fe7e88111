"""Byte-level BPE encoding and decoding with a two-tier lookup.

Whole slices of texts are cut into pre-tokens in NumPy, by rules equal to the
vocabulary's usual expression (:data:`PATTERN`).  Tier one resolves pre-tokens
that are in the vocabulary through a minimal perfect hash (hash and displace: one
displacement for each small bucket, as many slots as tokens), confirmed by
comparing bytes.  Tier two merges the bytes of the others: parts form a linked
list, a heap yields the pair of least rank, and the neighbours of a merged pair
are pushed again, so a pre-token of ``k`` bytes costs ``O(k log k)`` however long
it is.  A bounded table of each worker remembers what tier two gave.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens that a worker remembers, and their ids, until it forgets all and begins again.
REMEMBERED, REMEMBERED_IDS = 400_000, 8_000_000
#: Bytes of a pre-token up to which it is merged together with others.
SHORT = 32
_EMPTY = 1 << 40
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
U64 = np.uint64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
_SPREAD = U64(0xD6E8FEB86659FD93)


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens by id, from a file of base64 tokens and ids."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    out: list[bytes] = [b""] * (max(int(i) for _, i in pairs) + 1)
    for token, i in pairs:
        out[int(i)] = base64.b64decode(token)
    return out


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    for kind, expression in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(expression, text):
            out[points[m.start()] : points[m.end() - 1] + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def cut(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts in UTF-8 begin; each ends where the next begins or its text ends."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        held = np.zeros(n + 3, np.uint8)
        held[:n] = data
        a, b, c, d = (held[lead + k].astype(np.int32) for k in range(4))
        two, four = a < 0xE0, a >= 0xF0
        point = np.where(two, (a & 0x1F) << 6 | b & 0x3F, np.where(four, (a & 7) << 18 | (b & 0x3F) << 12 | (c & 0x3F) << 6 | d & 0x3F, (a & 0xF) << 12 | (b & 0x3F) << 6 | c & 0x3F))
        own = classes[point]
        kind[lead] = kind[lead + 1] = own
        kind[lead[~two] + 2] = own[~two]
        kind[lead[four] + 3] = own[four]
    edge = np.zeros(n + 1, bool)  # texts begin and end here
    edge[offsets] = True
    new = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= edge[:n]
    begin = np.flatnonzero(new)
    stop = np.empty(len(begin), np.int64)
    stop[:-1], stop[-1:] = begin[1:], n
    of = kind[begin]
    starts = new
    # a blank right before a run belongs to it
    joined = np.flatnonzero((of != SPACE) & ~edge[begin] & (data[begin - 1] == 32))
    starts[begin[joined]] = False
    # of a run of white space before more text, the last character stands apart from those before it
    blank = np.flatnonzero((of == SPACE) & ~edge[stop])
    last = stop[blank] - 1
    wide = data[last] >= 128
    last[wide] -= 1 + (data[last[wide] - 1] < 0xC0)
    starts[last] = True
    # contractions: an apostrophe that begins a pre-token and is alone in its run
    quote = np.flatnonzero((of[:-1] == OTHER) & (of[1:] == LETTER) & (stop[:-1] - begin[:-1] == 1))
    at = begin[quote]
    alone = (data[at] == 39) & starts[at] & ~edge[at + 1]
    at, end = at[alone], stop[quote[alone] + 1]
    if len(at):
        x = data[at + 1]
        y = np.where(at + 2 < end, data[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(x, [ord(c) for c in "stmd"])
        pair = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        size = np.where(one, 2, np.where(pair, 3, 0))
        at, end, size = at[size > 0], end[size > 0], size[size > 0]
        starts[at + 1] = False
        more = at + size
        starts[more[more < end]] = True
    return np.flatnonzero(starts)


class Words:
    """Byte strings of one buffer: first sixteen bytes, length, hash of the rest and of all."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        held = np.zeros(len(data) + 24, np.uint8)
        held[: len(data)] = data
        load = np.ndarray((len(data) + 16,), "<u8", buffer=held, strides=(1,))
        self.size = (end - start).astype(np.int32)
        self.low = load[start] & _MASK[np.minimum(self.size, 8)]
        self.high = load[np.minimum(start + 8, len(data) + 8)] & _MASK[np.clip(self.size - 8, 0, 8)]
        self.rest = np.zeros(len(start), U64)
        long = np.flatnonzero(self.size > 16)
        if len(long):
            size = self.size[long] - 16
            ends = np.cumsum(size)
            flat = data[np.repeat(start[long] + 16 - (ends - size), size) + np.arange(ends[-1])]
            self.rest[long] = K.word_hashes(flat, ends - size, ends, None)
        with np.errstate(over="ignore"):
            h = self.high * _SPREAD
            h ^= self.low
            h += (self.size.astype(U64) + self.rest) * K.BASE
        self.hash = K.mix(h)

    def equal(self, at: np.ndarray, other: Words | Memo, there: np.ndarray) -> np.ndarray:
        """Whether strings ``at`` are those of ``other`` at ``there`` (the rest of long ones by its hash)."""
        return (self.low[at] == other.low[there]) & (self.high[at] == other.high[there]) & (self.size[at] == other.size[there]) & (self.rest[at] == other.rest[there])


def _words(keys: list[bytes]) -> Words:
    ends = np.cumsum([len(k) for k in keys]).astype(np.int64)
    return Words(np.frombuffer(b"".join(keys), np.uint8), np.r_[0, ends[:-1]].astype(np.int64), ends)


def _place(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes spread over 0 to n - 1."""
    with np.errstate(over="ignore"):
        return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: each gets its own slot of ``len(keys)``."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        h = _words(keys).hash
        if len(np.unique(h)) < n:
            raise ValueError("two keys have the same hash")
        bucket = self._bucket(h)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        size = np.diff(first)
        for b in np.argsort(-size, kind="stable"):
            if size[b] <= 1:
                break
            own = h[order[first[b] : first[b + 1]]]
            d = 0
            while True:  # displacements by the block, the least that fits
                slot = self._slot(own[None, :], np.arange(d, d + 64)[:, None])
                fits = ~taken[slot].any(1)
                fits[fits] = (np.diff(np.sort(slot[fits], axis=1), axis=1) > 0).all(1)
                if fits.any():
                    break
                d += 64
            k = int(np.argmax(fits))
            taken[slot[k]] = True
            self.shift[b] = d + k
        alone = np.flatnonzero(size == 1)  # a bucket of one key names its slot itself
        self.shift[alone] = -1 - np.flatnonzero(~taken)[: len(alone)]

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (h & U64(0xFFFFFFFF)).astype(np.int64) % self.buckets

    def _slot(self, h: np.ndarray, d) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _place(K.mix(h + np.asarray(d).astype(U64) * K.BASE), self.n)

    def of(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key's hash; that of another string is arbitrary."""
        shift = self.shift[self._bucket(h)]
        return np.where(shift < 0, -1 - shift, self._slot(h, np.maximum(shift, 0)))

    def slots(self, keys: list[bytes]) -> np.ndarray:
        return self.of(_words(keys).hash)


class Memo:
    """Merged pre-tokens and their ids: an open-addressing table over growing columns."""

    def __init__(self) -> None:
        self.n, self.used = 0, 0
        self.low, self.high, self.rest, self.hash = (np.zeros(1024, U64) for _ in range(4))
        self.size, self.first, self.count = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids = np.zeros(1 << 14, np.int32)
        self.table = np.full(1 << 12, -1, np.int32)

    def find(self, words: Words, at: np.ndarray) -> np.ndarray:
        """The entry of each string ``at``, -1 if there is none."""
        out = np.full(len(at), -1, np.int32)
        mask = len(self.table) - 1
        slot = (words.hash[at] & U64(mask)).astype(np.int64)
        todo = np.arange(len(at))
        while len(todo):
            entry = self.table[slot]
            there = entry >= 0
            todo, slot, entry = todo[there], slot[there], entry[there]
            same = words.equal(at[todo], self, entry)
            out[todo[same]] = entry[same]
            todo, slot = todo[~same], (slot[~same] + 1) & mask
        return out

    def add(self, words: Words, at: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        """Entries for distinct strings that aren't in the table; ``flat`` has the ids of all."""
        n = self.n + len(at)
        for name in ("low", "high", "rest", "hash", "size", "first", "count"):
            column = getattr(self, name)
            if n > len(column):
                setattr(self, name, np.concatenate([column, np.zeros(max(n - len(column), len(column)), column.dtype)]))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(flat), len(self.ids)), np.int32)])
        own = slice(self.n, n)
        for name in ("low", "high", "rest", "hash", "size"):
            getattr(self, name)[own] = getattr(words, name)[at]
        self.count[own] = count
        self.first[own] = self.used + np.cumsum(count) - count
        self.ids[self.used : self.used + len(flat)] = flat
        new = range(self.n, n)
        self.n, self.used = n, self.used + len(flat)
        if 2 * n > len(self.table):
            self.table = np.full(4 << int(n).bit_length(), -1, np.int32)
            new = range(n)
        table, mask = self.table, len(self.table) - 1
        e, slot = np.arange(new.start, n, dtype=np.int32), (self.hash[new.start : n] & U64(mask)).astype(np.int64)
        while len(e):
            free = table[slot] < 0
            table[slot[free]] = e[free]  # of several for one slot, the last one has it
            left = table[slot] != e
            e, slot = e[left], (slot[left] + 1) & mask


class Pairs:
    """Rank of the token that two adjacent ones make: an open-addressing table."""

    def __init__(self, pair: dict[int, int]):
        key, rank = np.array(list(pair), np.int64), np.array(list(pair.values()), np.int64)
        self.bits = int(2 * len(key)).bit_length() + 1
        self.key, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _EMPTY, np.int64)
        slot = self._slot(key)
        while len(key):
            free = self.key[slot] < 0
            self.key[slot[free]] = key[free]
            own = self.key[slot] == key
            self.rank[slot[own]] = rank[own]
            key, rank, slot = key[~own], rank[~own], (slot[~own] + 1) & (1 << self.bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(U64) * K.BASE) >> U64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks; ``_EMPTY`` where there is none or a part is missing (-1)."""
        key = (a.astype(np.int64) << 20 | b).ravel()
        slot = self._slot(key)
        found = self.key[slot]
        out = np.where(found == key, self.rank[slot], _EMPTY)
        todo = np.flatnonzero((found != key) & (found >= 0) & (key >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (1 << self.bits) - 1
            found = self.key[slot[todo]]
            hit = todo[found == key[todo]]
            out[hit] = self.rank[slot[hit]]
            todo = todo[(found != key[todo]) & (found >= 0)]
        return np.where(key < 0, _EMPTY, out).reshape(np.shape(a))


def _gather(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places ``first[k]`` to ``first[k] + count[k] - 1`` of all ``k`` in a row."""
    ends = np.cumsum(count)
    out = np.repeat(first - (ends - count), count)
    out += np.arange(len(out))
    return out


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        used = [i for i, t in enumerate(tokens) if t]
        keys = [tokens[i] for i in used]
        self.hash, self.known = PerfectHash(keys), _words(keys)
        #: By slot: the place in ``known`` and the id of its token.
        self.key = np.empty(len(used), np.int64)
        self.key[self.hash.slots(keys)] = np.arange(len(used))
        self.id = np.array(used, np.int32)[self.key]
        rank = {t: i for i, t in enumerate(tokens) if t}
        self.byte = [rank.get(bytes([b])) for b in range(256)]
        if None in self.byte:
            raise ValueError("the vocabulary lacks single bytes")
        self.pair: dict[int, int] = {}
        for t, i in rank.items():
            for k in range(1, len(t)):
                a, b = rank.get(t[:k]), rank.get(t[k:])
                if a is not None and b is not None:
                    self.pair[a << 20 | b] = i
        self.single, self.pairs = np.array(self.byte, np.int32), Pairs(self.pair)
        size = np.array([len(t) for t in tokens], np.int32)
        self.size, self.start = size, (np.cumsum(size) - size).astype(np.int32)
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.classes = character_classes()
        self.memo = Memo()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"memo": Memo()}

    def merge_short(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """(ids of all, number of each) of pre-tokens of up to :data:`SHORT` bytes, merged together.

        A row of ``heap`` is the indexed heap of one pre-token, flat (as wide as the
        pre-token, one level deep): the entry of a part is the rank of its pair with
        the next part, and the least is the top.  Each round pops the top of every
        row and pushes the merged part's pairs again.
        """
        n, width = len(start), int(size.max())
        row, at = np.arange(n), np.arange(width, dtype=np.int64)
        inside = at[None, :] < size[:, None]
        part = np.full((n, width + 2), -1, np.int32)  # column width + 1 is also that before the first
        part[:, :width][inside] = self.single[data[(start[:, None] + at[None, :])[inside]]]
        after = np.broadcast_to(np.minimum(at + 1, width), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        heap = np.full((n, width), _EMPTY, np.int64)
        heap[:, : width - 1] = self.pairs.ranks(part[:, : width - 1], part[:, 1:width])
        while len(row):
            i = heap[row].argmin(1)
            top = heap[row, i]
            live = top < _EMPTY
            row, i, top = row[live], i[live], top[live]
            if not len(row):
                break
            j = after[row, i]
            k = after[row, np.minimum(j, width - 1)]
            h = before[row, i]
            part[row, i], part[row, j] = top, -1
            after[row, i], before[row, k] = k, i
            heap[row, j] = _EMPTY
            heap[row, i] = self.pairs.ranks(part[row, i], part[row, k])
            some = h >= 0
            heap[row[some], h[some]] = self.pairs.ranks(part[row[some], h[some]], part[row[some], i[some]])
        kept = part[:, :width] >= 0
        return part[:, :width][kept], kept.sum(1)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that is not in the vocabulary: least rank first, leftmost of equals."""
        byte, get = self.byte, self.pair.get
        part = [byte[b] for b in word]
        n = len(part)
        shift = n.bit_length()
        low = (1 << shift) - 1
        heap = [(r << shift) | i for i in range(n - 1) if (r := get(part[i] << 20 | part[i + 1])) is not None]
        if not heap:
            return tuple(part)
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i = top & low
            left = part[i]
            j = after[i]
            if left < 0 or j >= n or get(left << 20 | part[j]) != top >> shift:
                continue  # one of the pair has been merged since
            part[i] = new = top >> shift
            part[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                r = get(new << 20 | part[k])
                if r is not None:
                    heappush(heap, (r << shift) | i)
            h = before[i]
            if h >= 0:
                r = get(part[h] << 20 | new)
                if r is not None:
                    heappush(heap, (r << shift) | h)
        return tuple([p for p in part if p >= 0])

    def encode_all(self, data: np.ndarray, offsets: np.ndarray, ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """(ids, number of ids of each text) of texts in one buffer; without ``ids`` they are only counted."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        start = cut(data, offsets, self.classes)
        end = np.empty_like(start)
        end[:-1], end[-1:] = start[1:], len(data)
        words = Words(data, start, end)
        slot = self.hash.of(words.hash)
        missed = np.flatnonzero(~words.equal(slice(None), self.known, self.key[slot]))
        if self.memo.n > REMEMBERED or self.memo.used > REMEMBERED_IDS:
            self.memo = Memo()
        memo, entry = self.memo, self.memo.find(words, missed)
        while len(left := np.flatnonzero(entry < 0)):  # strings of equal hash, if ever, come one in a round
            at = missed[left]
            at = at[np.unique(words.hash[at], return_index=True)[1]]
            for some in np.array_split(at[words.size[at] <= SHORT], 1 + len(at) // 4096):
                if len(some):
                    memo.add(words, some, *self.merge_short(data, start[some], words.size[some]))
            long = at[words.size[at] > SHORT]
            if len(long):
                merged = [self.merge(data[a:b].tobytes()) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
                memo.add(words, long, np.array([i for x in merged for i in x], np.int32), np.array([len(x) for x in merged]))
            entry[left] = memo.find(words, missed[left])
        many = memo.count[entry]
        count = np.ones(len(start), np.int32)
        count[missed] = many
        ends = np.zeros(len(start) + 1, np.int64)
        np.cumsum(count, out=ends[1:])
        each = np.diff(ends[np.searchsorted(start, offsets)])
        if not ids:
            return None, each
        out = np.empty(ends[-1], np.int32)
        out[ends[:-1]] = self.id[slot]
        out[_gather(ends[missed], many)] = memo.ids[_gather(memo.first[entry], many)]
        return out, each

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_all(data, np.array([0, len(data)]))[0].tolist()

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and how many each has."""
        size = self.size[ids]
        return self.blob[_gather(self.start[ids], size)], size

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def encode_slice(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each text or -1 for null, whether they decode to its bytes) of one slice."""
        data, offsets = K.buffers(part.column("text"))
        ids, count = self.encode_all(data, offsets)
        back, size = self.decode_flat(ids)
        run = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=run[1:])
        ends = run[np.r_[0, np.cumsum(count)]]
        if np.array_equal(ends, offsets):
            wrong = np.flatnonzero(back != data)
            same = np.ones(part.num_rows, bool)
            same[np.searchsorted(offsets, wrong, "right") - 1] = False
        else:
            raw, text = back.tobytes(), data.tobytes()
            same = np.array([raw[a:b] == text[c:d] for a, b, c, d in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:], strict=True)], bool)
        count[part.column("text").is_null().to_numpy(zero_copy_only=False)] = -1
        return ids, count, same


def _encoder(held) -> object:
    @F.arrow_udf("struct<n_tokens:bigint,token_ids:array<int>,round_trip:boolean>")
    def run(column: pa.Array) -> pa.Array:
        sizes, flat, same = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
        for part in K.slices(pa.record_batch([column], ["text"])):
            for into, values in zip((flat, sizes, same), held.value.encode_slice(part), strict=True):
                into.append(values)
        size = np.concatenate(sizes)
        none = size < 0
        offsets = np.r_[0, np.cumsum(np.maximum(size, 0))].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.r_[none, False]), pa.array(np.concatenate(flat)))
        return pa.StructArray.from_arrays([pa.array(size, mask=none), lists, pa.array(np.concatenate(same), mask=none)], ["n_tokens", "token_ids", "round_trip"])

    return run


def _decoder(held) -> object:
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        codec, flat = held.value, column.flatten()
        ids = flat.to_numpy(zero_copy_only=False)
        if flat.null_count or len(ids) and not (0 <= ids.min() and ids.max() < len(codec.tokens)):
            raise ValueError("an id is not in the vocabulary")
        none = column.is_null().to_numpy(zero_copy_only=False)
        back, size = codec.decode_flat(ids)
        run = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=run[1:])
        count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        ends = run[np.r_[0, np.cumsum(count)]]
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(back)])
        try:
            text = raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # ids that cut a character
            text = pa.array([b.decode("utf-8", errors="replace") for b in raw.to_pylist()], pa.string())
        return pc.if_else(pa.array(none), None, text)

    return run


@lru_cache(maxsize=4)
def _codec(vocabulary: str) -> Codec:
    return Codec(read_vocabulary(vocabulary))


def codec(docs: DataFrame, vocabulary: str = VOCABULARY):
    """The codec as a broadcast; its size is that of the vocabulary and doesn't grow with the data."""
    return docs.sparkSession.sparkContext.broadcast(_codec(vocabulary))


def encoded(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) for every row of ``docs``, in one pass without a shuffle.

    ``round_trip`` tells whether decoding the ids gave the text's bytes again.
    Null text gives nulls, empty text no ids; repeated rows and ids are encoded
    like others; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), _encoder(codec(docs, vocabulary))(F.col(text)).alias("_e"))
    return rows.select("doc_id", "_e.*")


def vocabulary_size(vocabulary: str = VOCABULARY) -> int:
    return len(_codec(vocabulary).tokens)


def id_encoder(docs: DataFrame, column: str = "value", vocabulary: str = VOCABULARY):
    """A function from a slice of texts to (ids, how many each text has), for tasks of the session of ``docs``; null counts as empty."""
    held = codec(docs, vocabulary)

    def encode(part: pa.RecordBatch, ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        return held.value.encode_all(*K.buffers(part.column(column)), ids)

    return encode


def decoded(tokens: DataFrame, *, doc_id: str = "doc_id", token_ids: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from token ids.

    Null ids give null text, no ids an empty one; ids that cut a character give
    the replacement character there; an id that is null or not in the vocabulary
    is an error.  Rows and ids may repeat; other columns are ignored.
    """
    text: Column = _decoder(codec(tokens, vocabulary))(F.col(token_ids))
    return tokens.select(F.col(doc_id).cast("bigint").alias("doc_id"), text.alias("text"))
