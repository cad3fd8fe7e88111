"""Columns computed from a frame's own columns [I4, I6, I11, I14]."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import OBJECT, EntityFrame, HistoryEntry
from ..functions import chem
from ..functions.chem.props import DEFAULT


def add_descriptors(frame: EntityFrame, descriptors: Sequence[str] | None = None, prefix: str = "") -> EntityFrame:
    """Descriptors of the object as metadata columns, one kernel for all; NaN for null objects."""
    names = list(descriptors or DEFAULT)
    df = frame.df.withColumn("_d", chem.descriptors(F.col(OBJECT), names))
    return frame._same_rows(df.withColumns({prefix + n: F.col(f"_d.`{n}`") for n in names}).drop("_d"), HistoryEntry.now("add_descriptors", {"descriptors": names, "prefix": prefix}))


def numerized(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """String columns in which every value is a number become BIGINT or DOUBLE; others stay.

    One aggregate over all columns decides.  Nulls count as numbers; a column
    without any value stays as it is.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    if not names:
        return df
    tests = []
    for k, n in enumerate(names):
        c = F.col(f"`{n}`")
        there = c.isNotNull()
        tests += [F.coalesce(F.bool_and(F.when(there, F.expr(f"try_cast(`{n}` AS {kind})").isNotNull())), F.lit(False)).alias(f"{kind}_{k}") for kind in ("bigint", "double")]
    row = df.agg(*tests).first()
    kinds = {n: "bigint" if row[f"bigint_{k}"] else "double" if row[f"double_{k}"] else None for k, n in enumerate(names)}
    return df.withColumns({n: F.expr(f"try_cast(`{n}` AS {kind})") for n, kind in kinds.items() if kind})


def item_key(item: Column, config: Mapping[str, Any]) -> Column:
    """Content key of an item under a block's settings; equal in every process."""
    return F.md5(F.concat_ws("|", F.lit(json.dumps(config, sort_keys=True, default=str)), F.coalesce(item.cast("string"), F.lit("\u0000"))))


def reactions_valid(c: Column) -> Column:
    """Whether a reaction has parts on both sides that can all be read; false for null."""
    readable = chem.kernel(lambda m: True, "boolean", chem.pa.bool_(), null=False)
    both = (F.size(c["reactants"]) > 0) & (F.size(c["products"]) > 0)
    text = F.concat_ws(".", F.concat(c["reactants"], c["agents"], c["products"]))
    return F.coalesce(both & readable(F.regexp_replace(text, r"[()](?=\.|$)|(?<=^|\.)\(", "")), F.lit(False))
