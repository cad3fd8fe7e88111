"""Lowering of row selections to predicates and joins on row numbers.

A row's number is its place among the frame's rows, 0 to n - 1; its position
(``_pos``) only orders it.  Where positions are an arithmetic progression, as in
a new frame and in slices of one, the number is an expression of the position
and a slice a range predicate that reaches the scan.  A boolean Column is a
filter.  A list of numbers (order and repeats count) becomes an inner join with
a small table of (place in the result, number), which is broadcast while it is
small and left to the optimizer beyond that.
"""

from __future__ import annotations

import numbers
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POS = "_pos"
#: Pairs of two integers up to which a list of rows is broadcast (16 MB).
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Layout:
    """Positions that are ``start``, ``start + step``, ...; ``n`` of them if known."""

    start: int = 0
    step: int = 1
    n: int | None = None

    def number(self) -> Column:
        p = F.col(POS)
        if (self.start, self.step) == (0, 1):
            return p
        return F.expr(f"({POS} - {self.start}L) div {self.step}L")

    def part(self, start: int, stop: int | None, step: int) -> Layout:
        """The layout of rows ``start:stop:step`` (bounds not negative)."""
        ends = [x for x in (stop, self.n) if x is not None]
        n = len(range(start, min(ends), step)) if self.n is not None else None
        return Layout(self.start + self.step * start, self.step * step, n)


def coerce_bool_mask(mask: Any, n: int) -> np.ndarray:
    """Positions at which a boolean mask of length ``n`` is true."""
    arr = np.asarray(mask)
    if arr.dtype != np.bool_:
        raise TypeError(f"a mask must be boolean, not {arr.dtype}")
    if arr.ndim != 1 or len(arr) != n:
        raise ValueError(f"a mask of {arr.size} entries doesn't fit {n} rows")
    return np.flatnonzero(arr)


def validate_take(values: Any, n: int, allow_float_cast: bool = False) -> np.ndarray:
    """Non-negative positions; negative ones count from the end, repeats stay."""
    arr = np.asarray(values)
    if arr.size == 0:
        return np.zeros(0, np.int64)
    if arr.dtype == np.bool_ or arr.dtype == object:
        raise TypeError(f"positions must be integers, not {arr.dtype}")
    if arr.dtype.kind == "f":
        if not allow_float_cast:
            raise TypeError("positions must be integers, not floats")
        if not np.all(np.isfinite(arr)) or np.any(arr != np.floor(arr)):
            raise ValueError("float positions must be whole numbers")
    elif arr.dtype.kind not in "iu":
        raise TypeError(f"positions must be integers, not {arr.dtype}")
    if arr.dtype.kind == "u" and arr.max() > np.iinfo(np.int64).max:
        raise OverflowError("a position exceeds 64 bits")
    arr = arr.astype(np.int64).ravel()
    out = np.where(arr < 0, arr + n, arr)
    if np.any((out < 0) | (out >= n)):
        raise IndexError(f"position {arr[(out < 0) | (out >= n)][0]} is outside {n} rows")
    return out


@dataclass(frozen=True)
class RowSelection:
    """A validated selection of rows: everything, a range, positions, or a predicate."""

    kind: str  # all | range | take | where
    n: int | None = None
    bounds: tuple[int, int, int] | None = None
    positions: tuple[int, ...] | None = None
    predicate: Column | None = None
    scalar: bool = False

    @staticmethod
    def needs_count(raw: Any) -> bool:
        """Whether lowering ``raw`` must know the number of rows."""
        if raw is None or isinstance(raw, Column):
            return False
        if isinstance(raw, slice):
            return any(x is not None and x < 0 for x in (raw.start, raw.stop, raw.step))
        return True

    @classmethod
    def from_raw(cls, raw: Any, n: int | None, allow_float_cast: bool = False) -> RowSelection:
        if raw is None:
            return cls("all", n)
        if isinstance(raw, RowSelection):
            return raw
        if isinstance(raw, Column):
            return cls("where", n, predicate=raw)
        if isinstance(raw, slice):
            if n is None:
                step = 1 if raw.step is None else raw.step
                if step < 1:
                    raise ValueError("a slice with a negative step needs the number of rows")
                return cls("range", n, (raw.start or 0, -1 if raw.stop is None else raw.stop, step))
            start, stop, step = raw.indices(n)
            return cls("all", n) if (start, stop, step) == (0, n, 1) else cls("range", n, (start, stop, step))
        if isinstance(raw, (bool, np.bool_)):
            raise TypeError("a single boolean is not a selection")
        if isinstance(raw, numbers.Integral) or (isinstance(raw, np.ndarray) and raw.ndim == 0):
            return cls("take", n, positions=tuple(validate_take([raw if isinstance(raw, numbers.Integral) else raw.item()], n, allow_float_cast).tolist()), scalar=True)
        if isinstance(raw, (list, tuple, np.ndarray, range)):
            arr = np.asarray(raw)
            if arr.dtype == np.bool_ and arr.size:
                return cls("take", n, positions=tuple(coerce_bool_mask(arr, n).tolist()))
            return cls("take", n, positions=tuple(validate_take(arr, n, allow_float_cast).tolist()))
        raise TypeError(f"can't select rows by {type(raw).__name__}")

    @property
    def is_full(self) -> bool:
        return self.kind == "all"

    @property
    def is_scalar(self) -> bool:
        return self.scalar

    @property
    def count(self) -> int:
        if self.kind == "take":
            return len(self.positions)
        if self.kind == "range" and (self.bounds[1] >= 0 or self.bounds[2] < 0):
            return len(range(*self.bounds))
        if self.kind == "all" and self.n is not None:
            return self.n
        raise ValueError("the number of rows isn't known without a job")

    @property
    def is_empty(self) -> bool:
        return self.count == 0

    def positions_or_all(self) -> range | tuple[int, ...]:
        if self.kind == "take":
            return self.positions
        return range(self.n) if self.kind == "all" else range(*self.bounds)

    def within(self, layout: Layout) -> Column:
        """A range with positive step as bounds on the position itself."""
        start, stop, step = self.bounds
        p = F.col(POS)
        c = p >= F.lit(layout.start + layout.step * start)
        if stop >= 0:
            c = c & (p < F.lit(layout.start + layout.step * stop))
        return c & ((p - F.lit(layout.start + layout.step * start)) % F.lit(layout.step * step) == 0) if step > 1 else c

    def condition(self, number: Column | None = None) -> Column:
        """A predicate on the row number; for ``take`` it forgets order and repeats."""
        p = F.col(POS) if number is None else number
        if self.kind == "all":
            return F.lit(True)
        if self.kind == "where":
            return F.coalesce(self.predicate, F.lit(False))
        if self.kind == "range":
            start, stop, step = self.bounds
            if step < 0:
                return (p <= F.lit(start)) & (p > F.lit(stop)) & ((F.lit(start) - p) % F.lit(-step) == 0)
            c = p >= F.lit(start)
            if stop >= 0:
                c = c & (p < F.lit(stop))
            return c & ((p - F.lit(start)) % F.lit(step) == 0) if step > 1 else c
        return p.isin(list(dict.fromkeys(self.positions)))

    @property
    def renumbers(self) -> bool:
        """Whether :meth:`apply` gives rows new positions: a list's or a backward slice's."""
        return self.kind == "take" or (self.kind == "range" and self.bounds[2] < 0)

    def apply(self, df: DataFrame, number: Column | None = None) -> DataFrame:
        """The selected rows; a list or backward slice renumbers them 0, 1, ... in its order."""
        number = F.col(POS) if number is None else number
        if self.kind == "all":
            return df
        if not self.renumbers:
            return df.where(self.condition(number))
        if self.kind == "range":
            start, _, step = self.bounds
            return df.where(self.condition(number)).withColumn(POS, F.floor((F.lit(start) - number) / F.lit(-step)).cast("bigint"))
        spark = df.sparkSession
        pairs = spark.createDataFrame([(k, p) for k, p in enumerate(self.positions)], "_to bigint, _from bigint")
        if len(self.positions) <= BROADCAST_ROWS:
            pairs = F.broadcast(pairs)
        met = df.join(pairs, number == F.col("_from"))
        others = [F.col(f"`{c}`") for c in df.columns if c != POS]
        return met.select(F.col("_to").alias(POS), *others)
