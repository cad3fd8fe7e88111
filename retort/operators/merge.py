"""Left merge of metadata on one key [D1]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import EntityFrame, HistoryEntry


def merge_metadata(frame: EntityFrame, other: DataFrame, on: str, check: bool = True) -> EntityFrame:
    """Columns of ``other`` joined to the frame's rows; existing ones are overwritten, new ones added.

    Nulls match nulls.  A key of ``other`` that occurs twice and matches is an
    error (unmatched repeats are not), found by a semi join before the merge;
    ``check=False`` skips it.  The optimizer picks the join: the right side is
    broadcast only below its size threshold.
    """
    frame._need_metadata(on)
    if on not in other.columns:
        raise KeyError(f"no column {on!r} to merge on")
    if check:
        twice = other.groupBy(F.col(f"`{on}`").alias("_k")).count().where("count > 1")
        clash = frame.df.join(twice, F.col(f"`{on}`").eqNullSafe(F.col("_k")), "left_semi").limit(1)
        if clash.count():
            raise ValueError(f"the key {on!r} repeats in the other table")
    names = [c for c in other.columns if c != on]
    right = other.select(F.col(f"`{on}`").alias("_k"), *[F.col(f"`{c}`").alias(f"_r_{c}") for c in names])
    met = frame.df.join(right, F.col(f"`{on}`").eqNullSafe(F.col("_k")), "left")
    out = met.withColumns({c: F.col(f"`_r_{c}`") for c in names}).drop("_k", *[f"_r_{c}" for c in names])
    return frame._same_rows(out, HistoryEntry.now("merge_metadata", {"on": on, "columns": names}))
