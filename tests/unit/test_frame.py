import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retort import FEAT, META, OBJ, EntityFrame, HistoryEntry
from retort.frame import dense
from retort.index import POS, Layout


@pytest.fixture
def frame(spark):
    return EntityFrame.from_rows(spark, [f"obj_{i}" for i in range(8)], {"val": list(range(8)), "label": [f"l{i}" for i in range(8)]}, {"fp": np.zeros((8, 4), np.float32), "desc": np.ones((8, 2))})


def col(df, c, order=POS):
    return [r[c] for r in df.orderBy(order).collect()]


def test_catalog(frame):
    assert frame.metadata_columns == ["val", "label"] and frame.feature_names == ["fp", "desc"]
    assert frame.feature_shape("fp") == (8, 4) and len(frame) == 8 and "EntityFrame" in repr(frame)
    with pytest.raises(KeyError):
        frame.feature("none")


def test_dimension_mismatch(spark):
    with pytest.raises(ValueError, match="Dimension mismatch"):
        EntityFrame.from_rows(spark, ["a"], {"x": [1, 2]})


def test_axis_access(frame):
    assert col(frame[META, [1, 0]], "val") == [1, 0]
    assert frame[META, ["label"], slice(0, 2)].columns == [POS, "label"]
    assert frame[OBJ, 3] == "obj_3" and frame[OBJ, -1] == "obj_7"
    assert col(frame[OBJ, [2, 2]], "object") == ["obj_2", "obj_2"]
    assert frame[FEAT, ["fp", "desc"], [0]].columns == [POS, "fp", "desc"]
    for key, error in (((OBJ, "x"), IndexError), ((META,), IndexError), (("nope", 1), KeyError), ((FEAT, 1), IndexError)):
        with pytest.raises(error):
            frame[key]


def test_subset_and_history(frame):
    sub = frame[[6, 1]]
    assert col(sub.df, "val") == [6, 1] and sub.history[-1].extra == {"n_indices": 2}
    assert col(frame[2:4].df, "val") == [2, 3] and col(frame[[i % 2 == 0 for i in range(8)]].df, "val") == [0, 2, 4, 6]
    with pytest.raises(ValueError):
        frame[[True, False]]
    assert len(frame.where(F.when(F.col("val") > 5, True))) == 2
    e = HistoryEntry.now("x", {"a": 1}, 3, 2, note="n")
    assert HistoryEntry.from_dict(e.to_dict()) == e


def test_view(frame):
    v = frame.view(features=["fp"], meta_cols=["val"], feature_slices={"fp": (1, 3)})
    assert v.feature_names == ["fp"] and len(v.df.first()["f__fp"]) == 2
    with pytest.raises(PermissionError):
        v.with_metadata("x", 1)
    with pytest.raises(KeyError):
        frame.view(features=["none"])
    with pytest.raises(KeyError):
        v.metadata(cols="label")


def test_metadata_writes(frame):
    f = frame.with_metadata("score", [0.5, 1.5], rows=[1, 3])
    got = col(f.df, "score")
    assert got[1] == 0.5 and got[3] == 1.5 and all(math.isnan(got[i]) for i in (0, 2, 4))
    with pytest.raises(ValueError):
        frame.with_metadata("n", [1], rows=[0])
    assert col(frame.with_metadata("n", [9], rows=[0], na=-1).df, "n")[:2] == [9, -1]
    assert col(frame.with_metadata("k", "same").df, "k") == ["same"] * 8
    with pytest.raises(ValueError):
        frame.with_metadata("n", [1, 2, 3])
    assert col(frame.update_metadata({"val": [70]}, [7]).df, "val")[7] == 70
    assert col(frame.update_metadata(pd.DataFrame({"label": list("abcdefgh")})).df, "label") == list("abcdefgh")
    with pytest.raises(KeyError):
        frame.update_metadata({"none": [1] * 8})
    with pytest.raises(ValueError):
        frame.update_metadata(pd.Series([1] * 8))
    assert frame.drop_metadata().metadata_columns == [] and len(frame.drop_metadata()) == 8
    assert frame.set_metadata(frame.df.select(POS, F.lit(1).alias("z"))).metadata_columns == ["z"]
    assert frame.with_metadata_columns({"a": 1, "b": 2}).metadata_columns == ["val", "label", "a", "b"]


def test_feature_writes(frame):
    f = frame.with_feature("new", np.full((2, 3), 7.0), rows=[0, 7])
    got = col(f.df, "f__new")
    assert got[0] == [7.0] * 3 and all(map(math.isnan, got[1]))
    assert col(frame.with_feature("ints", np.ones((1, 2), np.int64), rows=[1]).df, "f__ints")[:2] == [[0, 0], [1, 1]]
    assert col(frame.with_feature("fp", np.full((1, 4), 2, np.float32), rows=[2]).df, "f__fp")[1:3] == [[0.0] * 4, [2.0] * 4]
    for bad in ("a b", "x'", ""):
        with pytest.raises(ValueError):
            frame.with_feature(bad, np.ones((8, 1)))
    assert frame.with_features({"only": np.ones((8, 1))}, replace=True).feature_names == ["only"]
    with pytest.raises(KeyError):
        frame.drop_feature("none")


def test_objects_and_originals(frame):
    f = frame.update_objects(["new"], [3])
    assert f[OBJ, 3] == "new" and frame[OBJ, 3] == "obj_3" and f.copy()[OBJ, 3] == "new"
    assert len(frame.update_objects([None], [0]).drop_invalid()) == 7
    assert frame.update_objects([None], [0]).valid_objects().count() == 7


def test_dense_whatever_the_partitions(spark):
    for parts in (1, 3, 17):
        df = spark.range(1000).repartition(parts).selectExpr("id * 3 AS _pos", "id AS v", "string(id % 7) AS s")
        got = dense(df).orderBy("v").collect()
        assert [r._pos for r in got] == list(range(1000))
        got = dense(df, F.col("s"), F.col("v")).orderBy("_pos").collect()
        assert [(r.s, r.v) for r in got] == sorted((str(i % 7), i) for i in range(1000))
    assert dense(spark.range(0).selectExpr("id AS _pos", "id AS v")).count() == 0


def test_materialized(frame, tmp_path):
    assert col(frame.materialized(str(tmp_path / "m")).df, "val") == list(range(8))


def test_chained_selections_equal_lists(spark):
    rng = random.Random(11)
    base = EntityFrame(spark.range(60).selectExpr("id * 7 + 3 AS _pos", "id AS v"))  # positions with gaps
    for start in (base, base.reindexed(), base.where("v % 3 <> 1"), base[5:50:2]):
        for _ in range(6):
            frame, want = start, col(start.df, "v")
            for _ in range(rng.randint(1, 3)):
                n = len(want)
                kind = rng.choice(["slice", "slice", "list", "mask", "where"]) if n else "slice"
                if kind == "slice":
                    key = slice(*[rng.choice([None, rng.randint(-n - 3, n + 3)]) for _ in range(2)], rng.choice([None, 1, 2, 3, -1, -2]))
                    frame, want = frame[key], want[key]
                elif kind == "list":
                    key = [rng.randrange(-n, n) for _ in range(rng.randint(0, 5))]
                    frame, want = frame[key], [want[k] for k in key]
                elif kind == "mask":
                    key = [rng.random() < 0.6 for _ in range(n)]
                    frame, want = frame[key], [v for v, k in zip(want, key, strict=True) if k]
                else:
                    m = rng.randint(2, 4)
                    frame, want = frame.where(F.col("v") % m != 0), [v for v in want if v % m]
            assert col(frame.df, "v") == want and len(frame) == len(want)
            for bad in (len(want), -len(want) - 1):
                with pytest.raises(IndexError):
                    frame[[bad]]
            marked = frame.with_metadata("z", [f"z{k}" for k in range(len(want))])
            assert col(marked.df, "z") == [f"z{k}" for k in range(len(want))]
            if len(want) > 2:
                assert [r.v for r in frame[META, "v", [2, 0]].orderBy(POS).collect()] == [want[2], want[0]]
                part = marked.update_metadata({"v": [-1, -2]}, [len(want) - 1, 1])
                assert col(part.df, "v") == [-2 if k == 1 else -1 if k == len(want) - 1 else v for k, v in enumerate(want)]


def test_filtered_frames_are_addressed_by_number(frame):
    kept = frame.where(F.col("val") >= 5)
    assert kept[OBJ, 0] == "obj_5" and kept[OBJ, -1] == "obj_7" and len(kept[0:2]) == 2
    assert col(kept.with_metadata("z", [1, 2, 3]).df, "z") == [1, 2, 3]
    assert col(kept.update_objects(["new"], [1]).df, "object") == ["obj_5", "new", "obj_7"]
    fed = kept.with_feature("fp", np.full((1, 4), 9, np.float32), rows=[2])
    assert col(fed.df, "f__fp")[2] == [9.0] * 4 and fed.feature_shape("fp") == (3, 4)
    assert col(kept.with_metadata("w", F.lit(1), slice(1, 3), na=0).df, "w") == [0, 1, 1]
    with pytest.raises(TypeError):
        kept.with_metadata("w", [1, 2, 3], F.col("val") > 0)
    assert [r.fp for r in frame[::-1][FEAT, "fp", 0:1].collect()] == [[0.0] * 4] and col(frame[::-3].df, "val") == [7, 4, 1]


def test_positions_that_repeat_are_an_error(spark):
    f = EntityFrame(spark.createDataFrame([(0, "a"), (2, "b"), (2, "c")], "_pos bigint, v string"))
    assert f.where("v = 'a'").count() == 1
    with pytest.raises(ValueError, match="repeat"):
        f[0:1]
    with pytest.raises(ValueError, match="null"):
        EntityFrame(spark.createDataFrame([(0, "a"), (None, "b")], "_pos bigint, v string"))[0:1]


def test_slices_of_a_known_frame_reach_the_scan_without_a_job(spark, tmp_path):
    spark.range(100).selectExpr("id AS _pos", "id AS v").write.parquet(str(tmp_path / "t"))
    f = EntityFrame(spark.read.parquet(str(tmp_path / "t")), layout=Layout(n=100))
    part = f[10:90][5:20]
    plan = part.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_pos,15)" in plan and "Exchange" not in plan and "Join" not in plan
    assert len(part) == 15 and col(part.df, "v") == list(range(15, 30))
