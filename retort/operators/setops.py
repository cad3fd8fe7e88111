"""Concatenation, append, sampling and keep-first dedup [H*, G1, J8]."""

from __future__ import annotations

import secrets
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import OBJECT, EntityFrame, HistoryEntry, feature_column
from ..index import POS, Layout
from .aggregate import first_by_key


def concat(frames: Sequence[EntityFrame], handle_missing_features: str = "zeros") -> EntityFrame:
    """All rows in list order; metadata is matched by name, absent columns are null [H1].

    A feature that some frame lacks is filled with zeros or NaN, or is an error
    (``raise``) [H2].  Only frames that lack it are filled, before the union.
    """
    if not frames:
        raise ValueError("nothing to concatenate")
    if len({f.kind for f in frames}) > 1:
        raise TypeError("frames of different kinds can't be concatenated")
    owner: dict[str, EntityFrame] = {}
    for f in frames:
        for n in f.feature_names:
            owner.setdefault(n, f)
    out, offset = None, 0
    known = all(f._layout is not None and f._layout.n is not None and (f._layout.start, f._layout.step) == (0, 1) for f in frames)
    for k, f in enumerate(frames):
        df = f.df.withColumn(POS, F.col(POS) + F.lit(offset).cast("bigint"))
        if known:
            offset += f._layout.n
        elif k < len(frames) - 1:  # positions follow those of the frames before: no shuffle
            top = f.df.agg(F.max(POS)).first()[0]
            offset += 0 if top is None else top + 1
        for n, o in owner.items():
            if f.has_feature(n):
                continue
            if handle_missing_features == "raise":
                raise ValueError(f"frame {k} lacks the feature {n!r}")
            c = feature_column(n)
            kind = o.df.schema[c].dataType
            if handle_missing_features == "nan" and not isinstance(kind.elementType, T.FractionalType):
                raise ValueError(f"NaN can't fill the feature {n!r} of {kind.elementType.simpleString()}")
            fill = F.lit(float("nan") if handle_missing_features == "nan" else 0).cast(kind.elementType)
            df = df.withColumn(c, F.array_repeat(fill, o.feature_width(n)))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    history = tuple(h for f in frames for h in f.history)
    return EntityFrame(out, frames[0].kind, (*history, HistoryEntry.now("concat", {"n_tables": len(frames), "handle_missing_features": handle_missing_features})), layout=Layout(n=offset) if known else None)


def append(frame: EntityFrame, more: EntityFrame, handle_missing_features: str = "zeros") -> EntityFrame:
    """Rows of ``more`` after those of ``frame`` [H3, H4]."""
    return concat([frame, more], handle_missing_features)


def sample_rows(df: DataFrame, k: int, seed: int, order: str = POS) -> DataFrame:
    """``k`` rows without replacement: the least by the hash of (order, seed), a distributed top-k."""
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise ValueError("max_size must be a positive integer")
    return df.orderBy(F.md5(F.concat_ws("|", F.col(order).cast("string"), F.lit(str(seed)))), F.col(order)).limit(k)


def sample(frame: EntityFrame, max_size: int, random_seed: int | None = None) -> EntityFrame:
    """min(n, max_size) rows drawn uniformly, in their old order [G1]; one seed, one sample."""
    seed = secrets.randbits(62) if random_seed is None else random_seed
    return frame._new(sample_rows(frame.df, max_size, seed), HistoryEntry.now("sample", {"max_size": max_size, "random_seed": random_seed}))


def unique(frame: EntityFrame, key: Column | str | None = None, seen: DataFrame | None = None) -> EntityFrame:
    """The first row of each key; a null key drops the row [J8].

    ``key`` is a column, by default the canonical SMILES of the object.  Keys in
    ``seen`` (one column) were met in earlier batches and are dropped as well
    [M4].
    """
    if key is None:
        from ..functions.chem import canonical_smiles

        key = canonical_smiles(F.col(OBJECT))
    df = frame.df.withColumn("_unique", F.col(key) if isinstance(key, str) else key)
    if seen is not None:
        df = df.join(seen.select(F.col(f"`{seen.columns[0]}`").alias("_seen")).distinct(), F.col("_unique") == F.col("_seen"), "left_anti")
    return frame._new(first_by_key(df, ["_unique"]).drop("_unique"), HistoryEntry.now("unique"))
