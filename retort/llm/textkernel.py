"""Vectorised text primitives shared by the corpus operators.

Everything here works on Arrow string buffers: one ``uint8`` array with the
bytes of many texts and an ``int64`` array of offsets.  No function loops over
characters or words in Python, so a kernel costs a few dozen nanoseconds per
byte.  Callers bound memory with :func:`slices`, which cuts an Arrow batch into
runs of whole texts of at most ``max_bytes`` bytes (one longer text is a run of
its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multiplier of the polynomial word hash (mod 2**64) and its inverse.
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE_BYTES = 2 << 20

_pow: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """``BASE**i`` (or its inverse) for ``i < n``, mod 2**64; grown on demand."""
    key = "inv" if inverse else "fwd"
    have = _pow.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, BASE_INV if inverse else BASE, dtype=U64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(out)
        if size <= 8 * SLICE_BYTES:
            _pow[key] = have
    return have[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    n, start = len(column), column.offset
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[start : start + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``batch`` whose ``column`` holds at most ``max_bytes`` in all."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < len(size):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_ascii = np.arange(256, dtype=np.uint8)
LOWER = _ascii.copy()
LOWER[65:91] += 32
#: 1 for ASCII letters and digits and every byte of a non-ASCII character.
ALNUM = ((_ascii >= 128) | ((_ascii >= 48) & (_ascii < 58)) | ((LOWER >= 97) & (LOWER < 123))).astype(np.uint8)
#: 1 for every byte that is not ASCII white space.
NONSPACE = (~np.isin(_ascii, [9, 10, 11, 12, 13, 32])).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of all words: maximal runs of bytes with ``kind`` 1.

    ``first`` has one more entry than there are texts: words ``first[d]`` to
    ``first[d + 1]`` belong to text ``d``.  No word crosses two texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= 1 - inside[:-1]
    ends = np.zeros(n + 1, np.uint8)
    ends[1:n] = inside[:-1] & (1 - inside[1:])
    ends[n] = inside[-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[(inside[cut] & inside[cut - 1]) == 1]
    begins[cut] = 1
    ends[cut] = 1
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def prefix_sums(data: np.ndarray, fold: np.ndarray | None = LOWER) -> np.ndarray:
    """Sums of the polynomial hash up to each byte, from which any span's hash follows."""
    run = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        value = (fold[data] if fold is not None else data).astype(U64)
        value += U64(1)
        value *= powers(len(data))
        np.cumsum(value, out=run[1:])
    return run


def span_hashes(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, from :func:`prefix_sums`, finalised with :func:`mix`."""
    if not len(start):
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        h = (run[end] - run[start]) * powers(len(run) - 1, inverse=True)[start]
        h += (end - start).astype(U64)
    return mix(h)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = LOWER) -> np.ndarray:
    """64-bit polynomial hash of each word's bytes, finalised with :func:`mix`."""
    return span_hashes(prefix_sums(data, fold), start, end) if len(start) else np.zeros(0, U64)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of small integers or floats over ``offsets[d]:offsets[d + 1]``; 0 for an empty segment."""
    out = np.zeros(len(offsets) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    live = offsets[1:] > offsets[:-1]
    if live.any():
        out[live] = np.add.reduceat(values, offsets[:-1][live], dtype=out.dtype)
    return out


def first_of_each(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of one entry for each distinct (doc, hash), in ascending order."""
    with np.errstate(over="ignore"):
        key = mix(h + mix(doc.astype(U64)))
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    keep = np.zeros(len(key), bool)
    keep[order[new]] = True
    return np.flatnonzero(keep)


def hash_word(word: bytes, fold: np.ndarray | None = LOWER) -> int:
    """The hash :func:`word_hashes` gives a single word."""
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.zeros(1, np.int64), np.full(1, len(data)), fold)[0])


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries of ``h`` (len - size + 1 of them)."""
    n = len(h)
    if n < size:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, U64)
        np.cumsum(h * powers(n), out=run[1:])
        out = (run[size:] - run[:-size]) * powers(n - size + 1, inverse=True)
    return mix(out)


def range_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the entries ``start`` to ``end`` of ``h``, for many ranges at once."""
    n = len(h)
    if not len(start):
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, U64)
        np.cumsum(h * powers(n), out=run[1:])
        out = (run[end] - run[start]) * powers(n + 1, inverse=True)[start]
        out += (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(out)
