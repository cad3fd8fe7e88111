"""Training-order materialisation of token ids in fixed-stride binary shards.

The corpus is one stream of token ids: the rows of the stored table in order
(file, then row), each followed by an end id.  The stream is cut into sequences
of a fixed length, numbered from 0 to N - 1; a row may begin and end anywhere in
a sequence, and only the last sequence is padded.  A keyed Feistel network
permutes a power of four that holds N; numbers that fall outside walk the cycle
until they are inside, so each sequence gets its own global slot and any slot's
place is known from the key alone.  Slots are cut into equal ranges, one shard
each, and a shard stores its sequences in slot order with a fixed stride: slot
``s`` lies at byte ``(s - first) * stride`` of its shard, so a reader resumes at
any step by seeking.

Two passes read the rows.  The first counts the ids of each run of neighbouring
rows of a file that a task reads, which gives every run its place in the stream;
the second cuts sequences and shuffles them once, by range of slots.  Nothing
else is shuffled or stored, and no id is sorted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .storage import written

#: Ids of the byte vocabulary that no UTF-8 text holds.
PAD, END = 0xFE, 0xFF
#: Stored types of an id by its width in bytes.
DTYPES = {1: "<u1", 2: "<u2", 4: "<i4"}
SEQUENCE = 2048
PER_SHARD = 4096
#: Sequences read from a shard at once.
PER_BATCH = 1024
KEY = 0x5DEECE66D
ROUNDS = 6
#: Ids of a slice of rows, and how many each row has; without ids if the second argument is false.
Encoder = Callable[[pa.RecordBatch, bool], tuple[np.ndarray | None, np.ndarray]]
PIECES = "shard int, slot bigint, start int, doc_ids array<bigint>, starts array<int>, places array<bigint>, ids binary"


def feistel(slot: np.ndarray, n: int, key: int, rounds: int = ROUNDS, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0 to n - 1 (or its inverse), elementwise."""
    half = 1
    while 1 << (2 * half) < n:
        half += 1
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD6E8FEB86659FD93) & (1 << 64) - 1) for r in range(rounds)]
    x = np.array(slot, np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        with np.errstate(over="ignore"):
            for k in reversed(keys) if inverse else keys:
                if inverse:
                    left, right = right ^ (K.mix(left + k) & mask), left
                else:
                    left, right = right, left ^ (K.mix(right + k) & mask)
        x[todo] = left << np.uint64(half) | right
        todo = todo[x[todo] >= np.uint64(n)]  # outside: walk the cycle on
    return x.astype(np.int64)


def id_width(n_ids: int) -> int:
    """Bytes that hold each of ``n_ids`` ids."""
    return 1 if n_ids <= 1 << 8 else 2 if n_ids <= 1 << 16 else 4


def utf8(part: pa.RecordBatch, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts as ids; none for null."""
    data, offsets = K.buffers(part.column("value"))
    return data, np.diff(offsets)


def lists(part: pa.RecordBatch, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The ids in arrays of integers; none for null."""
    column = part.column("value")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("an id is null")
    return flat.to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """How a set of shards is laid out; ``n`` sequences of ``length`` ids, ``total`` of them not padding."""

    n: int
    total: int
    length: int = SEQUENCE
    width: int = 1
    end: int = END
    pad: int = PAD
    per_shard: int = PER_SHARD
    key: int = KEY
    rounds: int = ROUNDS

    @property
    def stride(self) -> int:
        return self.length * self.width

    @property
    def shards(self) -> int:
        return -(-self.n // self.per_shard)

    def held(self, shard: int) -> int:
        """Sequences of a shard."""
        return min(self.per_shard, self.n - shard * self.per_shard)


def _is_stored(docs: DataFrame) -> bool:
    """Whether ``docs`` is a scan of files with its columns chosen, so that rows have places that last."""
    node = docs._jdf.queryExecution().optimizedPlan()
    while node.children().size() == 1 and node.nodeName() == "Project":
        node = node.children().head()
    return node.children().size() == 0 and node.getClass().getSimpleName() == "LogicalRelation"


def _rows(docs: DataFrame, doc_id: str, value: str) -> DataFrame:
    """(file, row, doc_id, value): rows with their places; a table that isn't stored is sorted by (doc_id, value) and stored."""
    if not _is_stored(docs):
        hashed = F.xxhash64(F.col("value"))
        rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(value).alias("value"))
        copies = F.monotonically_increasing_id() % 64  # splits a row that repeats very often; equal rows may come in any order
        rows = rows.withColumns({"_h": hashed, "_k": copies})
        order = (F.col("doc_id").asc_nulls_first(), F.col("_h"))
        docs, doc_id, value = written(rows.repartitionByRange(*order, "_k").sortWithinPartitions(*order, "value").drop("_h", "_k"), "rows"), "doc_id", "value"
    return docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(value).alias("value"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Slices of rows with the (file, first row) of their run: neighbouring rows of one file."""
    run, after = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("file").dictionary_encode()
        file, row = coded.indices.to_numpy(), batch.column("row").to_numpy()
        edge = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (row[1:] != row[:-1] + 1)])
        for a, b in zip(edge, [*edge[1:], len(row)], strict=True):
            name = coded.dictionary[int(file[a])].as_py()
            if (name, int(row[a])) != after:
                run = (name, int(row[a]))
            after = (name, int(row[b - 1]) + 1)
            part = batch.slice(int(a), int(b - a))
            if pa.types.is_list(part.column("value").type):
                yield run, part
            else:
                for x in K.slices(part, "value"):
                    yield run, x


def _counter(encode: Encoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], int] = {}
        for name, part in _parts(batches):
            total[name] = total.get(name, 0) + int(encode(part, False)[1].sum()) + part.num_rows
        yield pa.record_batch([pa.array([f for f, _ in total], pa.string()), pa.array([r for _, r in total], pa.int64()), pa.array(list(total.values()), pa.int64())], ["file", "row", "n"])

    return run


def _cutter(encode: Encoder, bases, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, dtype, at = layout.length, np.dtype(DTYPES[layout.width]), {}
        for name, part in _parts(batches):
            ids, count = encode(part, True)
            if len(ids) and (ids.min() < 0 or ids.max() > np.iinfo(dtype).max or (ids == layout.end).any() or (ids == layout.pad).any()):
                raise ValueError(f"ids must fit {layout.width} bytes and be neither the end nor the pad id {layout.end, layout.pad}")
            begin = at.get(name, bases.value[name])
            size = count + 1
            first = begin + np.cumsum(size) - size  # of each row in the stream
            stop = at[name] = begin + int(size.sum())
            pad = layout.n * length - stop if stop == layout.total else 0
            stream = np.empty(stop - begin + pad, dtype)
            ends = first + count - begin
            stream[ends] = layout.end
            stream[stop - begin :] = layout.pad
            inside = np.ones(stop - begin, bool)
            inside[ends] = False
            stream[: stop - begin][inside] = ids
            # a piece for each sequence that the slice touches, an entry for each row in it
            number = np.arange(begin // length, -(-stop // length))
            lo = np.maximum(number * length, begin)
            hi = np.minimum((number + 1) * length, stop + pad)
            row = np.searchsorted(first, lo, "right") - 1  # the row that the piece begins in
            entries = np.searchsorted(first, hi, "left") - row
            offsets = np.r_[0, np.cumsum(entries)]
            own = np.repeat(row - offsets[:-1], entries) + np.arange(offsets[-1])
            left = np.maximum(np.repeat(lo, entries), first[own])
            of = pa.array(offsets.astype(np.int32))
            slot = feistel(number, layout.n, layout.key, layout.rounds)
            cuts = pa.array(((np.r_[lo, hi[-1:]] - begin) * layout.width).astype(np.int32))
            yield pa.record_batch(
                [
                    pa.array((slot // layout.per_shard).astype(np.int32)), pa.array(slot), pa.array((lo - number * length).astype(np.int32)),
                    pa.ListArray.from_arrays(of, part.column("doc_id").take(pa.array(own))), pa.ListArray.from_arrays(of, pa.array((left % length).astype(np.int32))), pa.ListArray.from_arrays(of, pa.array(left - first[own])),
                    pa.Array.from_buffers(pa.binary(), len(number), [None, cuts.buffers()[1], pa.py_buffer(stream)]),
                ],
                ["shard", "slot", "start", "doc_ids", "starts", "places", "ids"],
            )

    return run


def materialised(docs: DataFrame, *, doc_id: str = "doc_id", value: str = "text", encode: Encoder | None = None, width: int = 1, end: int = END, pad: int = PAD, length: int = SEQUENCE, per_shard: int = PER_SHARD, key: int = KEY) -> tuple[DataFrame, Layout]:
    """Pieces of sequences, by slot and start within partitions that hold whole shards, and their layout.

    ``encode`` gives the ids of a slice of the column ``value``; by default they
    are the bytes of texts or the integers of arrays.  Ids have ``width`` bytes
    (1, 2 or 4, little endian); ``end`` and ``pad`` must be ids that no row has.
    Null counts as empty, and an empty row is its end id alone; repeated rows
    occur as often as they are given; doc ids may be null and may repeat; other
    columns are ignored; an empty table gives no sequence.  Slots depend on the
    stored order of the rows and on ``key``, not on how tasks split the files, so
    a repeated task makes the same pieces.  A table that isn't stored is first
    sorted by (doc_id, value).
    """
    if width not in DTYPES or not 0 <= min(end, pad) <= max(end, pad) <= np.iinfo(DTYPES[width]).max or end == pad or length < 1 or per_shard < 1:
        raise ValueError(f"no sequences of {length} ids of {width} bytes with end {end} and pad {pad}")
    spark = docs.sparkSession
    if encode is None:
        encode = lists if dict(docs.dtypes)[value].startswith("array") else utf8
    rows = _rows(docs, doc_id, value)
    counted = sorted(rows.select("file", "row", "value").mapInArrow(_counter(encode), "file string, row bigint, n bigint").collect())  # a row for each split of a file
    ends = np.cumsum([r.n for r in counted])
    total = int(ends[-1]) if counted else 0
    layout = Layout(-(-total // length), total, length, width, end, pad, per_shard, key)
    if not total:
        return spark.createDataFrame([], PIECES), layout
    bases = spark.sparkContext.broadcast({(r.file, r.row): int(e) - r.n for r, e in zip(counted, ends, strict=True)})
    pieces = rows.mapInArrow(_cutter(encode, bases, layout), PIECES)
    partitions = min(layout.shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    by = (F.col("shard") * F.lit(partitions) / F.lit(layout.shards)).cast("int")  # ranges of slots
    return pieces.repartitionById(partitions, by).sortWithinPartitions("slot", "start"), layout


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of one sequence, which follow each other, as one row."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        slot = batch.column("slot").to_numpy()
        last = int(np.searchsorted(slot, slot[-1]))  # the last sequence may go on in the next batch
        held = batch.slice(last)
        if last:
            yield _merged(batch.slice(0, last))
    if held is not None:
        yield _merged(held)


def _merged(batch: pa.RecordBatch) -> pa.RecordBatch:
    slot = batch.column("slot").to_numpy()
    if (np.diff(slot) < 0).any():
        raise ValueError("pieces must be sorted by slot")
    new = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    bounds = np.r_[new, len(slot)]
    out = [batch.column(c).take(pa.array(new)) for c in ("shard", "slot")]
    for c in ("doc_ids", "starts", "places"):
        column = batch.column(c)
        offsets = column.offsets.to_numpy()
        out.append(pa.ListArray.from_arrays(pa.array(offsets[bounds] - offsets[0]), column.flatten()))
    data, offsets = K.buffers(batch.column("ids"))
    out.append(pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets[bounds].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]))
    return pa.record_batch(out, ["shard", "slot", "doc_ids", "starts", "places", "ids"])


def _name(path: str, shard: int) -> str:
    return f"{path}/shard-{shard:08d}.bin"


def _writer(uri: str, layout: Layout):
    """Writes sequences to shards; gives a row for each sequence without its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(uri)
        shard, n, file, part = -1, 0, None, ""

        def close() -> None:
            if file is not None:
                file.close()
                if n != layout.held(shard):
                    raise ValueError(f"shard {shard} has {n} of {layout.held(shard)} sequences")
                system.move(part, _name(path, shard))

        try:
            for batch in _joined(batches):
                number, slot = batch.column("shard").to_numpy(), batch.column("slot").to_numpy()
                data, offsets = K.buffers(batch.column("ids"))
                if (np.diff(offsets) != layout.stride).any():
                    raise ValueError("a sequence isn't whole")
                edge = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(number)], strict=True):
                    if int(number[a]) != shard:
                        close()
                        shard, n, part = int(number[a]), 0, f"{path}/.part-{uuid.uuid4().hex}"
                        file = system.open_output_stream(part)
                    if (slot[a:b] != np.arange(b - a) + shard * layout.per_shard + n).any():
                        raise ValueError(f"shard {shard} isn't in the order of its slots")
                    file.write(np.ascontiguousarray(data[offsets[a] : offsets[b]]))
                    n += b - a
                yield batch.drop_columns(["ids"])
            close()
        except BaseException:
            if file is not None:
                file.close()
                if system.get_file_info(part).is_file:
                    system.delete_file(part)
            raise

    return run


def write_shards(pieces: DataFrame, layout: Layout, uri: str) -> DataFrame:
    """Writes shards and ``manifest.json`` to the folder ``uri``; gives (shard, slot, doc_ids, starts, places) of all sequences.

    The rows of :func:`materialised` are written at once; input that isn't whole
    or not in order is an error, found before a shard gets its name.  A shard is
    written to a name of its own attempt and then renamed, so a repeated or
    parallel attempt leaves the same file, and one that fails deletes its own.
    ``uri`` must be a folder that all executors share, in any file system that
    Arrow knows.  Without sequences there are no shards.
    """
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    places = written(pieces.mapInArrow(_writer(uri, layout), "shard int, slot bigint, doc_ids array<bigint>, starts array<int>, places array<bigint>"), "places")
    with system.open_output_stream(f"{path}/manifest.json") as file:  # last: a folder with one is whole
        file.write(json.dumps(asdict(layout)).encode())
    return places


def manifest(uri: str) -> Layout:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(f"{path}/manifest.json") as file:
        return Layout(**json.loads(file.read()))


def read_back(places: DataFrame, layout: Layout, uri: str) -> DataFrame:
    """``places`` with the ids of each sequence, read from the shards by seeking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(uri)
        name, file = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, PER_BATCH):
                part = batch.slice(at, PER_BATCH)
                shard, slot = part.column("shard").to_numpy(), part.column("slot").to_numpy()
                edge = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (slot[1:] != slot[:-1] + 1)])
                raw = []
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(slot)], strict=True):
                    if shard[a] != name:
                        name, file = shard[a], system.open_input_file(_name(path, int(shard[a])))
                    raw.append(file.read_at((b - a) * layout.stride, (int(slot[a]) - int(shard[a]) * layout.per_shard) * layout.stride))
                ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(layout.stride), len(slot), [None, pa.py_buffer(b"".join(raw))]).cast(pa.binary())
                yield part.append_column("ids", ids)

    return places.mapInArrow(run, "shard int, slot bigint, doc_ids array<bigint>, starts array<int>, places array<bigint>, ids binary")


def read_from(uri: str, slot: int) -> Iterator[bytes]:
    """Sequences from ``slot`` on, by seeking in the shards of a folder with a manifest; none past the last."""
    layout = manifest(uri)
    system, path = fs.FileSystem.from_uri(uri)
    while slot < layout.n:
        shard = slot // layout.per_shard
        with system.open_input_file(_name(path, shard)) as file:
            file.seek((slot - shard * layout.per_shard) * layout.stride)
            for _ in range(slot - shard * layout.per_shard, layout.held(shard)):
                yield file.read(layout.stride)
                slot += 1
