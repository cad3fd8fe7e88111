import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from retort.index import RowSelection, coerce_bool_mask, validate_take


def test_masks():
    assert coerce_bool_mask([True, False, True], 3).tolist() == [0, 2]
    with pytest.raises(ValueError):
        coerce_bool_mask([True], 2)
    with pytest.raises(TypeError):
        coerce_bool_mask([1, 0], 2)


@pytest.mark.parametrize("bad,error", [([5], IndexError), ([-6], IndexError), ([1.0], TypeError), ([True, False], TypeError), (["a"], TypeError)])
def test_take_errors(bad, error):
    with pytest.raises(error):
        validate_take(bad, 5)


def test_take():
    assert validate_take([0, -1, 2, 2], 5).tolist() == [0, 4, 2, 2]
    assert validate_take([1.0, 2.0], 5, allow_float_cast=True).tolist() == [1, 2]
    assert validate_take([], 0).tolist() == []
    with pytest.raises(ValueError):
        validate_take([1.5], 5, allow_float_cast=True)
    with pytest.raises(OverflowError):
        validate_take(np.array([2**63], np.uint64), 5)


@given(st.integers(0, 20), st.integers(-25, 25) | st.none(), st.integers(-25, 25) | st.none(), st.sampled_from([None, 1, 2, 3, -1, -2]))
def test_slices_equal_python(n, a, b, c):
    s = slice(a, b, c)
    assert list(RowSelection.from_raw(s, n).positions_or_all()) == list(range(n))[s]


def test_selection():
    assert RowSelection.from_raw(None, 4).is_full and RowSelection.from_raw(slice(None), 4).is_full
    one = RowSelection.from_raw(-1, 4)
    assert one.is_scalar and one.positions == (3,) and one.count == 1
    assert RowSelection.from_raw(np.array(2), 4).is_scalar and RowSelection.from_raw([], 4).is_empty
    for bad in (True, "x", 1.5, {}):
        with pytest.raises(TypeError):
            RowSelection.from_raw(bad, 4)
    with pytest.raises(ValueError):
        RowSelection.from_raw([True, False], 3)


def test_apply_keeps_order_and_repeats(spark):
    df = spark.range(10).selectExpr("id AS _pos", "id * 10 AS v")
    got = RowSelection.from_raw([7, 2, 7], 10).apply(df).orderBy("_pos").collect()
    assert [(r._pos, r.v) for r in got] == [(0, 70), (1, 20), (2, 70)]
    assert sorted(r._pos for r in RowSelection.from_raw(slice(2, 9, 3), 10).apply(df).collect()) == [2, 5, 8]
