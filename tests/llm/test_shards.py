import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retort.llm import bpe, queries
from retort.llm import shards as S

from conftest_llm import docs_of


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    x = np.arange(n)
    p = S.feistel(x, n, 99)
    assert sorted(p.tolist()) == x.tolist() and S.feistel(p, n, 99, inverse=True).tolist() == x.tolist()
    if n >= 64:
        assert S.feistel(x, n, 100).tolist() != p.tolist()


def slot_of(number, n, key, rounds=S.ROUNDS):
    """The network by plain integers."""
    half, full = 1, (1 << 64) - 1
    while 4**half < n:
        half += 1

    def mixed(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & full
        return x ^ x >> 31

    while True:
        left, right = number >> half, number & (1 << half) - 1
        for r in range(rounds):
            k = (key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD6E8FEB86659FD93) & full
            left, right = right, left ^ mixed((right + k) & full) & (1 << half) - 1
        number = left << half | right
        if number < n:
            return number


def brute(rows, length, end, pad, per_shard, key):
    """slot -> (ids, entries) by plain loops over rows (doc_id, ids) in order."""
    stream = [(doc, place, i) for doc, ids in rows for place, i in enumerate([*ids, end])]
    n = -(-len(stream) // length)
    out = {}
    for number in range(n):
        part = stream[number * length : (number + 1) * length]
        entries = [(doc, at, place) for at, (doc, place, _) in enumerate(part) if at == 0 or part[at - 1][2] == end]
        out[slot_of(number, n, key)] = ([i for *_, i in part] + [pad] * (length - len(part)), entries)
    return out


def result(pieces, layout, folder):
    places = S.write_shards(pieces, layout, folder)
    rows = S.read_back(places, layout, folder).collect()
    assert all(r.shard == r.slot // layout.per_shard for r in rows) and len({r.slot for r in rows}) == len(rows)
    return {r.slot: (np.frombuffer(bytes(r.ids), S.DTYPES[layout.width]).tolist(), list(zip(r.doc_ids, r.starts, r.places, strict=True))) for r in rows}


def ordered(rows):
    """Rows (doc_id, text) as a table that isn't stored is sorted, but for the order of texts of one id."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("length,per_shard", [(32, 16), (7, 1000), (1, 5), (4096, 2)])
def test_slots_and_bytes_equal_brute_force(spark, tmp_path, length, per_shard):
    rows = [(k, f"text number {k} " * (k % 9)) for k in range(40)] + [(None, "no id é")] + [(50, "copy")] * 3
    docs = docs_of(spark, [(*r, "s") for r in rows])
    got = result(*S.materialised(docs, length=length, per_shard=per_shard, key=3), f"file://{tmp_path}/a")
    want = brute([(d, t.encode()) for d, t in ordered(rows)], length, S.END, S.PAD, per_shard, 3)
    assert got == want
    again = result(*S.materialised(docs.repartition(7), length=length, per_shard=per_shard, key=3), f"file://{tmp_path}/b")
    assert again == got
    assert list(S.read_from(f"file://{tmp_path}/a", len(got) // 2)) == [bytes(got[s][0]) for s in range(len(got) // 2, len(got))]
    assert S.manifest(f"file://{tmp_path}/a").n == len(got) and not [p for p in (tmp_path / "a").iterdir() if p.name.startswith(".part")]


def test_stored_tables_keep_their_order_however_they_are_split(spark, tmp_path):
    rows = [(k % 13, f"row {k} " * (k % 50)) for k in range(3000)]
    path = str(tmp_path / "t")
    for k in range(3):
        spark.createDataFrame(rows[k::3], "doc_id bigint, text string").coalesce(1).write.mode("append").option("parquet.block.size", 4096).parquet(path)
    docs = spark.read.parquet(path)
    in_order = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).orderBy("f", "r").collect()
    want = brute([(r.doc_id, r.text.encode()) for r in in_order], 100, S.END, S.PAD, 64, 1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert result(*S.materialised(spark.read.parquet(path), length=100, per_shard=64, key=1), f"file://{tmp_path}/{size}") == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_edge_rows(edge, empty, tmp_path):
    got = result(*S.materialised(edge), f"file://{tmp_path}/a")
    assert sorted(got) == list(range(len(got)))
    begun = [doc for _, entries in got.values() for doc, _, place in entries if place == 0]
    assert sorted(begun, key=str) == sorted((r.doc_id for r in edge.collect()), key=str)
    assert result(*S.materialised(empty), f"file://{tmp_path}/b") == {} and list(S.read_from(f"file://{tmp_path}/b", 0)) == []


def test_arrays_of_ids(spark, tmp_path):
    rows = [(1, [1, 70_000, 3] * 5), (2, []), (3, None), (4, [9] * 7), (5, [1, 70_000, 3] * 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, t array<int>")
    options = {"value": "t", "end": 80_000, "pad": 80_001, "length": 4, "per_shard": 3}
    got = result(*S.materialised(docs, width=4, **options), f"file://{tmp_path}/a")
    assert got == brute([(d, t or []) for d, t in rows], 4, 80_000, 80_001, 3, S.KEY)
    assert S.id_width(256) == 1 and S.id_width(50_258) == 2 and S.id_width(65_537) == 4
    with pytest.raises(Exception, match="ids must fit"):
        S.materialised(docs, width=2, **options | {"end": 60_000, "pad": 60_001})[0].collect()
    with pytest.raises(Exception, match="ids must fit"):
        S.materialised(docs, width=4, **options | {"end": 9})[0].collect()


def test_pieces_out_of_order_or_missing_are_an_error(spark, tmp_path):
    pieces, layout = S.materialised(docs_of(spark, [(k, "word " * 20, "s") for k in range(20)]), length=16, per_shard=4)
    for k, bad in enumerate((pieces.coalesce(1).sortWithinPartitions(F.desc("slot")), pieces.where("slot <> 5"), pieces.where("start = 0 and slot % 2 = 0"), pieces.repartition(3))):
        with pytest.raises(Exception, match="sorted|order|whole|has"):
            S.write_shards(bad, layout, f"file://{tmp_path}/{k}")
        assert not [p for p in (tmp_path / str(k)).iterdir() if p.name == "manifest.json" or p.name.startswith(".part")]


def test_a_sequence_in_several_batches_is_one_row():
    whole = pa.record_batch([pa.array([0, 0, 0, 0], pa.int32()), pa.array([0, 1, 1, 1]), pa.array([0, 0, 1, 2], pa.int32()), pa.array([[1], [1], [2], [3]]), pa.array([[0], [0], [1], [2]]), pa.array([[0], [4], [0], [0]]), pa.array([b"abc", b"d", b"e", b"f"])], ["shard", "slot", "start", "doc_ids", "starts", "places", "ids"])
    out = pa.Table.from_batches(list(S._joined([whole.slice(0, 2), whole.slice(2, 1), whole.slice(3, 1)]))).to_pylist()
    assert [(r["slot"], r["ids"], r["doc_ids"], r["starts"]) for r in out] == [(0, b"abc", [1], [0]), (1, b"def", [1, 2, 3], [0, 1, 2])]


def test_registered_query_writes_shards_of_bpe_ids(spark, sf):
    end = bpe.vocabulary_size()
    ids = {r.doc_id: r.token_ids for r in queries.op1_bpe(spark, sf).collect()}
    order = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).orderBy("f", "r").collect()
    want = brute([(r.doc_id, ids[r.doc_id] or []) for r in order], S.SEQUENCE, end, end + 1, S.PER_SHARD, S.KEY)
    got = {r.slot: (np.frombuffer(bytes(r.ids), "<u2").tolist(), list(zip(r.doc_ids, r.starts, r.places, strict=True))) for r in queries.op8_training_order(spark, sf).collect()}
    assert got == want
