"""Grouping children under a parent key: collapse, merge back, unroll, fold [E*, D4, N8].

Metadata aggregates skip NaN and null (pandas' rules), feature aggregates work
element by element and let NaN through (NumPy's rules).  Vectors are folded by
exploding (index, value), one partial and final hash aggregate on (key, index)
and a reassembly by key, so no task ever holds a group's vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import OBJECT, EntityFrame, HistoryEntry, dense, feature_column
from ..index import POS, Layout

#: Elements of a vector up to which each has an aggregate of its own.
SHORT = 16
META_AGGS = ("first", "last", "min", "max", "mean", "sum")
FEATURE_AGGS = ("mean", "min", "max", "sum", "first", "last")


def of_series(how: object) -> bool:
    """Whether an aggregate is a function that says that it takes a ``pd.Series``."""
    hints = getattr(how, "__annotations__", {}) if callable(how) else {}
    return next((v for k, v in hints.items() if k != "return"), None) in (pd.Series, "pd.Series")


def meta_agg(name: str, how: str | Callable[[Column], Column], kind: T.DataType, order: Column) -> Column:
    """Aggregate of a metadata column; an unknown name means ``first`` [E2].

    A function takes the Column, or, if it says that it takes a ``pd.Series``, the
    group's values as one in a grouped pandas UDF [N7]; its result has the type
    that its return annotation names (a DDL string), by default the column's.
    """
    c = F.col(f"`{name}`")
    if callable(how):
        if of_series(how):
            returns = how.__annotations__.get("return")

            def run(values: pd.Series) -> float:
                return how(values)

            run.__annotations__ = {"values": pd.Series, "return": float}
            return F.pandas_udf(run, returns.strip("'\"") if isinstance(returns, str) else kind)(c)
        return how(c)
    clean = F.when(F.isnan(c), None).otherwise(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c
    if how == "min":
        return F.min(clean)
    if how == "max":
        return F.max(clean)
    if how == "mean":
        return F.avg(clean)
    if how == "sum":
        return F.coalesce(F.sum(clean), F.lit(0).cast(T.LongType() if isinstance(kind, T.IntegralType) else kind))
    return F.max_by(c, order) if how == "last" else F.min_by(c, order)


def _element(how: str, v: Column, order: Column) -> Column:
    if how == "min":  # NaN is the result if there is one
        return F.when(F.max(F.isnan(v).cast("int")) == 1, F.lit(float("nan"))).otherwise(F.min(v))
    if how == "max":
        return F.max(v)  # NaN is the largest value
    if how == "sum":
        return F.sum(v)
    return F.avg(v)


def _kind(how: str) -> str:
    return how if how in ("min", "max", "sum") else "mean"


def short_fold(column: str, how: str, width: int) -> Column:
    """A vector of known width folded by one aggregate for each element; null if no row has a vector."""
    each = [_element(_kind(how), F.get(F.col(f"`{column}`"), F.lit(i)).cast("double"), F.col(POS)) for i in range(width)]
    return F.when(F.count(F.col(f"`{column}`")) > 0, F.array(*each))


def feature_fold(df: DataFrame, keys: Sequence[str], vectors: Mapping[str, str], order: str = POS) -> DataFrame:
    """(keys..., vectors...) with each array column folded by its aggregate [E3]; unknown names mean ``mean``.

    Keys without a vector have null.  Whole vectors (``first``, ``last``) and
    elements are two passes, joined by key where both are asked for.
    """
    whole = {c: how for c, how in vectors.items() if how in ("first", "last")}
    by_element = {c: _kind(how) for c, how in vectors.items() if c not in whole}
    key = [F.col(f"`{k}`") for k in keys]
    firsts = df.groupBy(*key).agg(*[(F.max_by if how == "last" else F.min_by)(F.col(f"`{c}`"), F.col(order)).alias(c) for c, how in whole.items()]) if whole else None
    if not by_element:
        return firsts
    long = None
    for c in by_element:
        one = df.select(*key, F.lit(c).alias("_c"), F.posexplode_outer(F.col(f"`{c}`")).alias("_i", "_v")).withColumn("_v", F.col("_v").cast("double"))
        long = one if long is None else long.unionAll(one)
    folded = long.groupBy(*key, "_c", "_i").agg(*[_element(h, F.col("_v"), F.col(order)).alias(f"_{h}") for h in sorted(set(by_element.values()))])
    chosen = F.lit(None).cast("double")
    for c, how in by_element.items():
        chosen = F.when(F.col("_c") == c, F.col(f"_{how}")).otherwise(chosen)
    parts = [F.array_sort(F.collect_list(F.when((F.col("_c") == c) & F.col("_i").isNotNull(), F.struct("_i", "_m")))) for c in by_element]
    out = folded.withColumn("_m", chosen).groupBy(*key).agg(*[F.when(F.size(x) > 0, F.transform(x, lambda s: s["_m"])).alias(c) for x, c in zip(parts, by_element, strict=True)])
    if firsts is None:
        return out
    on = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    return firsts.alias("a").join(out.alias("b"), on).select(*[F.col(f"a.`{k}`") for k in keys], *[F.col(f"a.`{c}`") for c in whole], *[F.col(f"b.`{c}`") for c in by_element])


def fold_into(df: DataFrame, key: str, aggregates: Sequence[Column], vectors: Mapping[str, tuple[str, int]]) -> DataFrame:
    """(key, aggregates..., vectors...): short vectors in the pass of the aggregates, others joined by key."""
    near = {c: v for c, v in vectors.items() if v[0] not in ("first", "last") and 0 < v[1] <= SHORT}
    wholes = {c: v[0] for c, v in vectors.items() if v[0] in ("first", "last")}
    far = {c: v[0] for c, v in vectors.items() if c not in near and c not in wholes}
    here = [short_fold(c, how, n).alias(c) for c, (how, n) in near.items()] + [(F.max_by if how == "last" else F.min_by)(F.col(f"`{c}`"), F.col(POS)).alias(c) for c, how in wholes.items()]
    out = df.groupBy(F.col(f"`{key}`")).agg(*aggregates, *here)
    return out.join(feature_fold(df.select(F.col(f"`{key}`"), POS, *[F.col(f"`{c}`") for c in far]), [key], far), key) if far else out


def _check_key(frame: EntityFrame, key: str) -> None:
    if key not in frame.df.columns:
        raise ValueError(f"no column {key!r} to group by")


def _needed(key: str, df: DataFrame) -> Column:
    """The key, with an error for null and NaN."""
    bad = F.col(f"`{key}`").isNull()
    if isinstance(df.schema[key].dataType, (T.FloatType, T.DoubleType)):
        bad = bad | F.isnan(F.col(f"`{key}`"))
    return F.when(bad, F.raise_error(F.lit(f"null or NaN in the group key {key}"))).otherwise(F.col(f"`{key}`"))


def fold_objects(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., object): the first object, with every row's first coordinate set appended in order [E4].

    Objects that aren't structs with ``coords`` fold to the first one.  A null
    first object gives null; other nulls and rows without coordinates are skipped.
    """
    key = [F.col(f"`{k}`") for k in keys]
    kind = df.schema[OBJECT].dataType
    first = F.min_by(OBJECT, POS).alias(OBJECT)
    if not (isinstance(kind, T.StructType) and "coords" in kind.names):
        return df.groupBy(*key).agg(first)
    rows = F.array_sort(F.collect_list(F.when(F.size(f"{OBJECT}.coords") > 0, F.struct(F.col(POS).alias("p"), F.element_at(f"{OBJECT}.coords", 1).alias("c")))))
    folded = df.groupBy(*key).agg(first, F.transform(rows, lambda r: r["c"]).alias("_coords"))
    return folded.withColumn(OBJECT, F.when(F.col(OBJECT).isNotNull(), F.col(OBJECT).withField("coords", F.col("_coords")))).drop("_coords")


def collapse(frame: EntityFrame, groupby: str = "parent_index", metadata_agg: Mapping[str, str | Callable] | None = None, features_agg: Mapping[str, str] | None = None) -> EntityFrame:
    """One row per key, in ascending key order [E1]; metadata defaults to ``first``, features to ``mean``."""
    _check_key(frame, groupby)
    df = frame.df.withColumn(groupby, _needed(groupby, frame.df))
    metadata_agg, features_agg = dict(metadata_agg or {}), dict(features_agg or {})
    others = [c for c in frame.metadata_columns if c != groupby]
    kind = df.schema[OBJECT].dataType
    folds = isinstance(kind, T.StructType) and "coords" in kind.names
    made = {c: meta_agg(c, metadata_agg.get(c, "first"), df.schema[c].dataType, F.col(POS)).alias(c) for c in others}
    apart = [c for c in others if of_series(metadata_agg.get(c))]  # Spark wants these in an aggregate of their own
    aggregates = [made[c] for c in others if c not in apart] + [F.lit(0).cast("bigint").alias(POS)]
    if not folds:  # the first object, in the same pass
        aggregates.append(F.min_by(OBJECT, POS).alias(OBJECT))
    out = fold_into(df, groupby, aggregates, {feature_column(n): (features_agg.get(n, "mean"), _known_width(frame, n)) for n in frame.feature_names})
    if folds:
        out = out.join(fold_objects(df, [groupby]), groupby)
    if apart:
        out = out.join(df.groupBy(F.col(f"`{groupby}`")).agg(*[made[c] for c in apart]), groupby)
    out = dense(out, F.col(f"`{groupby}`"))
    return EntityFrame(out, "molecule" if frame.kind == "conformer" else frame.kind, (*frame.history, HistoryEntry.now("collapse", {"groupby": groupby})), layout=Layout())


def _known_width(frame: EntityFrame, name: str) -> int:
    """The width that the schema states; 0 if it doesn't or the feature has more axes."""
    shape = frame.df.schema[feature_column(name)].metadata.get("shape")
    return shape[0] if shape and len(shape) == 1 else 0


def update_from_children(parent: EntityFrame, child: EntityFrame, parent_id: str = "parent_index", metadata_agg: Mapping[str, str | Callable] | None = None, features_agg: Mapping[str, str] | None = None, drop_empty: bool = False, key: str = POS) -> EntityFrame:
    """Aggregates of the children written into their parents [D4, E5, E6].

    ``parent_id`` in the child matches ``key`` of the parent.  Only listed
    columns change; absent child columns are ignored.  Molecules without an
    object are dropped.  Parents without children keep their values and get zeros
    for new features, or are dropped with ``drop_empty``.  The children are
    reduced before the join, so the shuffle carries one row per parent.
    """
    _check_key(child, parent_id)
    cdf = child.df.withColumn("_key", _needed(parent_id, child.df))
    meta = {c: how for c, how in (metadata_agg or {}).items() if c in child.metadata_columns}
    vectors = {n: how for n, how in (features_agg or {}).items() if n in child.feature_names}
    widths = {n: _known_width(child, n) or (child.feature_width(n) if _flat(child, n) else 0) for n in vectors}
    cdf = cdf.select("_key", POS, *[F.col(f"`{c}`").alias(f"_m_{c}") for c in meta], *[F.col(f"`{feature_column(n)}`").alias(f"_f_{n}") for n in vectors])
    aggregates = [F.lit(True).alias("_has"), *[meta_agg(f"_m_{c}", how, cdf.schema[f"_m_{c}"].dataType, F.col(POS)).alias(f"_m_{c}") for c, how in meta.items()]]
    reduced = fold_into(cdf, "_key", aggregates, {f"_f_{n}": (how, widths[n]) for n, how in vectors.items()})
    rows = parent.df.where(F.col(OBJECT).isNotNull()) if parent.kind == "molecule" else parent.df
    met = rows.join(reduced, F.col(f"`{key}`") == F.col("_key"), "inner" if drop_empty else "left")
    new = {}
    for c in meta:
        old = F.col(f"`{c}`") if c in parent.metadata_columns else F.lit(None)
        new[c] = F.when(F.col("_has"), F.col(f"`_m_{c}`")).otherwise(old)
    for n in vectors:
        c = feature_column(n)
        rest = F.col(f"`{c}`").cast("array<double>") if c in parent.df.columns else F.array_repeat(F.lit(0.0), widths[n] or child.feature_width(n))
        new[c] = F.coalesce(F.col(f"`_f_{n}`"), rest)
    out = met.withColumns(new).drop("_key", "_has", *[f"_m_{c}" for c in meta], *[f"_f_{n}" for n in vectors])
    return parent._new(out, HistoryEntry.now("update_from_children", {"parent_id": parent_id, "drop_empty": drop_empty}))


def _flat(frame: EntityFrame, name: str) -> bool:
    return isinstance(frame.df.schema[feature_column(name)].dataType.elementType, T.NumericType)


def unroll(frame: EntityFrame, id_col: str = "parent_index", items: str = "coords") -> EntityFrame:
    """One row per item of the object's array (a conformer), features dropped [N8].

    Adds ``id_col`` (the parent's position) and ``conf_id``; null objects and
    empty arrays give no row.  The schema stays when nothing is left.
    """
    kind = frame.df.schema[OBJECT].dataType
    if isinstance(kind, T.ArrayType):
        values = F.col(OBJECT)
    else:
        values = F.transform(F.col(f"{OBJECT}.{items}"), lambda c: F.col(OBJECT).withField(items, F.array(c)))
    meta = [F.col(f"`{c}`") for c in frame.metadata_columns if c not in (id_col, "conf_id")]
    long = frame.df.select(F.col(POS).alias(id_col), *meta, F.posexplode(values).alias("conf_id", OBJECT))
    out = dense(long.withColumn(POS, F.lit(0).cast("bigint")), F.col(id_col), F.col("conf_id"))
    return EntityFrame(out, "conformer" if frame.kind == "molecule" else frame.kind, (*frame.history, HistoryEntry.now("unroll", {"id_col": id_col})), layout=Layout())


def batch_ids(df: DataFrame, size: int, order: str = POS) -> DataFrame:
    """``df`` with the batch of each row, ``order`` div ``size`` for a dense order [A8]."""
    if not isinstance(size, int) or isinstance(size, bool) or size < 1:
        raise ValueError("a batch size is a positive integer")
    return df.withColumn("batch_id", F.floor(F.col(order) / F.lit(size)).cast("bigint"))


def first_by_key(df: DataFrame, keys: Sequence[str], order: str = POS) -> DataFrame:
    """The first row of each key by ``order``, which must be unique; null keys are dropped.

    Keys are told apart by 128 bits of hash and aggregated without the rest of
    the rows; only the ``order`` of rows that go is joined back, so a table of few
    repeats is not shuffled.
    """
    there = F.lit(True)
    for k in keys:
        there = there & F.col(f"`{k}`").isNotNull()
    df = df.where(there)
    own = [F.col(f"`{k}`") for k in keys]
    hashed = df.select(F.col(order).alias("_o"), F.xxhash64(*own).alias("_h"), F.xxhash64(F.lit(1), *own).alias("_g"))
    repeated = hashed.groupBy("_h", "_g").agg(F.min("_o").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("_h").alias("_rh"), F.col("_g").alias("_rg"), "_first")
    gone = hashed.join(repeated, (F.col("_h") == F.col("_rh")) & (F.col("_g") == F.col("_rg"))).where("_o > _first").select("_o")
    return df.join(gone, F.col(order) == F.col("_o"), "left_anti")
