import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort import EntityFrame
from retort import operators as ops
from retort.index import POS


@pytest.fixture
def children(spark):
    vectors = np.vstack([np.arange(1.0, 11.0).reshape(5, 2), np.zeros((1, 2))])
    vectors[3, 1] = float("nan")
    return EntityFrame.from_rows(
        spark, list("abcdef"), {"parent_index": [1, 0, 1, 0, 1, 2], "score": [1.0, float("nan"), 3.0, 4.0, 5.0, float("nan")], "tag": ["p", None, "q", "r", "s", "t"]}, {"fp": vectors}, kind="conformer"
    )


def rows(df, *cols, by=POS):
    return [tuple(r[c] for c in cols) for r in df.orderBy(by).collect()]


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_collapse(children, parts):
    frame = children._new(children.df.repartition(parts))
    out = ops.collapse(frame, metadata_agg={"score": "mean"})
    assert out.kind == "molecule"
    got = rows(out.df, POS, "parent_index", "score", "tag", "object")
    assert got[0] == (0, 0, 4.0, None, "b") and got[1] == (1, 1, 3.0, "p", "a") and got[2][2] is None
    fp = rows(out.df, "f__fp")
    assert fp[0][0][0] == 5.0 and math.isnan(fp[0][0][1]) and fp[1][0] == [5.0, 6.0]


def test_collapse_aggregates(children):
    out = ops.collapse(children, metadata_agg={"score": "sum", "tag": "last"}, features_agg={"fp": "max"})
    got = rows(out.df, "score", "tag", "f__fp")
    assert got[2][0] == 0.0 and got[1][1] == "s" and got[1][2] == [9.0, 10.0] and math.isnan(got[0][2][1])
    assert rows(ops.collapse(children, features_agg={"fp": "first"}).df, "f__fp")[0][0] == [3.0, 4.0]
    assert rows(ops.collapse(children, metadata_agg={"score": lambda c: F.count(c)}).df, "score")[1][0] == 3
    assert rows(ops.collapse(children, metadata_agg={"score": "bogus"}).df, "score")[1][0] == 1.0


def test_collapse_errors(children):
    with pytest.raises(ValueError):
        ops.collapse(children, "none")
    null = children.with_metadata("parent_index", [None, 0, 1, 0, 1, 2])
    with pytest.raises(Exception, match="null or NaN"):
        ops.collapse(null).df.collect()


def test_update_from_children(spark, children):
    parent = EntityFrame.from_rows(spark, ["A", "B", "C", "D"], {"score": [9.0, 9.0, 9.0, 9.0]})
    out = ops.update_from_children(parent, children, metadata_agg={"score": "max", "absent": "max"}, features_agg={"fp": "sum"})
    got = rows(out.df, "score", "f__fp")
    assert [g[0] for g in got] == [4.0, 5.0, None, 9.0] and got[1][1] == [15.0, 18.0] and got[3][1] == [0.0, 0.0]
    assert ops.update_from_children(parent, children, metadata_agg={"score": "max"}, drop_empty=True).count() == 3


def test_unroll_and_fold(spark):
    df = spark.createDataFrame([(0, ("C", [[[0.0, 0.0, 0.0]], [[1.0, 1.0, 1.0]]]), "x"), (1, None, "y"), (2, ("O", []), "z")], "_pos bigint, object struct<smiles:string,coords:array<array<array<double>>>>, name string")
    frame = EntityFrame(df, "molecule")
    long = ops.unroll(frame)
    assert long.kind == "conformer" and rows(long.df, "parent_index", "conf_id", "name") == [(0, 0, "x"), (0, 1, "x")]
    back = ops.collapse(long)
    assert [len(r[0].coords) for r in rows(back.df, "object")] == [2]
    assert ops.unroll(frame[1:2]).df.columns == long.df.columns


def test_merge(spark):
    left = EntityFrame.from_rows(spark, ["C", "CC", "CCC", "O"], {"ID": ["a", "b", "c", None], "old": [1, 2, 3, 4]})
    right = spark.createDataFrame([("c", 3.0, 30), ("a", 1.0, 10), (None, 9.0, 90), ("zz", 0.0, 0), ("zz", 0.0, 0)], "ID string, Score double, old int")
    out = ops.merge_metadata(left, right, "ID")
    assert rows(out.df, "ID", "Score", "old") == [("a", 1.0, 10), ("b", None, None), ("c", 3.0, 30), (None, 9.0, 90)]
    with pytest.raises(ValueError):
        ops.merge_metadata(left, right.unionAll(right.where("ID = 'a'")), "ID")
    with pytest.raises(KeyError):
        ops.merge_metadata(left, right, "none")


def test_concat(spark):
    a = EntityFrame.from_rows(spark, ["x", "y"], {"m": [1, 2]}, {"f": np.ones((2, 3), np.float32)})
    b = EntityFrame.from_rows(spark, ["z"], {"n": ["q"]}, {"g": np.ones((1, 2), np.int8)})
    out = ops.concat([a, b])
    assert rows(out.df, POS, "m", "n", "f__f", "f__g") == [(0, 1, None, [1.0] * 3, [0, 0]), (1, 2, None, [1.0] * 3, [0, 0]), (2, None, "q", [0.0] * 3, [1, 1])]
    assert math.isnan(rows(ops.concat([a, a.drop_feature("f")], "nan").df, "f__f")[3][0][0])
    for bad, error in ((([], "zeros"), ValueError), (([a, b], "raise"), ValueError), (([a, b], "nan"), ValueError), (([a, EntityFrame(a.df, "reaction")], "zeros"), TypeError)):
        with pytest.raises(error):
            ops.concat(*bad)
    assert len(ops.append(a, b)) == 3


def test_sample(spark):
    f = EntityFrame(spark.range(100).selectExpr("id AS _pos", "id AS v"))
    one = {r.v for r in ops.sample(f, 10, 3).df.collect()}
    assert len(one) == 10 and one == {r.v for r in ops.sample(f._new(f.df.repartition(7)), 10, 3).df.collect()}
    assert one != {r.v for r in ops.sample(f, 10, 4).df.collect()} and len(ops.sample(f, 1000)) == 100
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            ops.sample(f, bad)


def test_unique(spark):
    f = EntityFrame.from_rows(spark, ["C1=CC=CC=C1", "c1ccccc1", None, "CCO", "OCC", "bad("], kind="molecule")
    assert [r[0] for r in rows(ops.unique(f).df, POS)] == [0, 3]
    seen = spark.createDataFrame([("CCO",)], "k string")
    assert [r[0] for r in rows(ops.unique(f, seen=seen).df, POS)] == [0]


def test_molecules_without_an_object_are_dropped_by_update(spark, children):
    parent = EntityFrame.from_rows(spark, ["A", None, "C"], {"score": [9.0, 9.0, 9.0]}, kind="molecule")
    out = ops.update_from_children(parent, children, metadata_agg={"score": "max"})
    assert rows(out.df, "object", "score") == [("A", 4.0), ("C", None)]


def test_short_and_long_vectors_fold_alike(spark):
    rng = np.random.default_rng(3)
    for width in (3, 40):
        v = rng.random((30, width))
        v[4, 1] = float("nan")
        f = EntityFrame.from_rows(spark, ["x"] * 30, {"parent_index": [k % 4 for k in range(30)]}, {"v": v, "w": v})
        f = f._new(f.df.withColumn("f__v", F.when(F.col(POS) != 2, F.col("f__v")).alias("f__v", metadata=f.df.schema["f__v"].metadata)))
        out = ops.collapse(f, features_agg={"v": "mean", "w": "max"})
        for r in out.df.collect():
            own = [k for k in range(30) if k % 4 == r.parent_index]
            np.testing.assert_allclose(r["f__v"], v[[k for k in own if k != 2]].mean(0))
            np.testing.assert_allclose(r["f__w"], v[own].max(0))


def test_each_table_is_scanned_once_to_update_parents(spark, tmp_path):
    for name, rows_ in (("p", 5), ("c", 20)):
        spark.range(rows_).selectExpr("id AS _pos", "id % 5 AS parent", "double(id) AS s", "array(double(id), 1D) AS f__v").write.parquet(str(tmp_path / name))
    p, c = (EntityFrame(spark.read.parquet(str(tmp_path / n))) for n in "pc")
    plan = ops.update_from_children(p, c, "parent", {"s": "max"}, {"v": "mean"}).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") + plan.count("Relation[") == 2


def test_first_by_key_drops_later_rows_only(spark):
    df = spark.createDataFrame([(k, key) for k, key in enumerate(["a", "b", "a", None, "c", "b", "a"])], "_pos bigint, k string")
    assert [r._pos for r in ops.aggregate.first_by_key(df, ["k"]).orderBy("_pos").collect()] == [0, 1, 4]
