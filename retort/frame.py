"""EntityFrame: one immutable DataFrame of objects, metadata and features.

Rows are ordered by the position column ``_pos`` and addressed by their number
in that order, 0 to n - 1, whatever positions a filter or slice has left; the
object column holds a SMILES text, a struct or any other value; features are ``f__<name>`` array
columns; every other column is metadata.  Every operation returns a new frame
whose plan extends the old one, and appends to an audit history.  Methods name
the operator they implement in brackets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .index import POS, Layout, RowSelection
from .storage import scratch

OBJECT = "object"
PREFIX = "f__"
OBJ, META, FEAT = "object", "metadata", "features"
NAME = re.compile(r"^[A-Za-z0-9_=]+$")
KINDS = ("entity", "molecule", "conformer", "reaction")


@dataclass(frozen=True)
class HistoryEntry:
    """One audited operation [K11, X15]."""

    block_name: str
    config: dict[str, Any] = field(default_factory=dict)
    timestamp: str = ""
    rows_in: int | None = None
    rows_out: int | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def now(cls, block_name: str, config: dict | None = None, rows_in: int | None = None, rows_out: int | None = None, **extra: Any) -> HistoryEntry:
        return cls(block_name, dict(config or {}), datetime.now(timezone.utc).isoformat(), rows_in, rows_out, extra)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> HistoryEntry:
        return cls(**d)


def feature_column(name: str) -> str:
    return PREFIX + name


def ranked(df: DataFrame, *order: Column, name: str = "_rank") -> DataFrame:
    """``df`` with the number of each row, 0 .. n-1, in ``order`` (by default of ``_pos``) as the column ``name``.

    Rows are cut into ranges once, sorted and written to the shared folder with
    their number in the range; only the counts of the ranges, one row each, come
    to the driver.  No task holds more than a range, the plan above runs once
    (but for Spark's sample of the order), and repeated tasks agree.  Rows equal
    in ``order`` come in any order.
    """
    spark, order = df.sparkSession, order or (F.col(POS),)
    place = F.monotonically_increasing_id()  # partition and row in it, of the sorted rows
    path = scratch(spark, "ranked")
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    parts.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(parts.schema).parquet(path).withColumn("_part", F.shiftright("_place", 33))
    base, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in stored.groupBy("_part").count().collect()):
        base.append((part, total))
        total += n
    bases = F.broadcast(spark.createDataFrame(base, "_part bigint, _base bigint"))  # a row for each range
    number = F.col("_base") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return stored.join(bases, "_part").select(*[F.col(f"`{c}`") for c in df.columns if c != name], number.alias(name))


def dense(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``_pos`` renumbered 0 .. n-1 in ``order`` (by default the old ``_pos``); see :func:`ranked`."""
    out = ranked(df, *order)
    return out.select(F.col("_rank").alias(POS), *[F.col(f"`{c}`") for c in df.columns if c != POS])


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to tasks by position, for a kernel that costs far more than a shuffle of its input.

    A scan has a task for each row group at most, so a small file of many rows is
    one task's.  Only plain scans with few splits are dealt; other plans stay.
    """
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.nodeName().split()[0] not in ("Project", "Filter", "SubqueryAlias", "Relation", "LogicalRelation"):
            return df
        if "Python" in node.toString().split("\n")[0]:
            return df
        below = node.children()
        todo += [below.apply(k) for k in range(below.size())]
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= 4 * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(F.col(POS))


class EntityFrame:
    """An immutable table; ``layout`` says that positions are an arithmetic progression, where that is known.

    Where it isn't, the first use of row numbers looks: one aggregate over the
    positions, and a renumbering if they have gaps.  Positions that repeat can't
    be addressed and are an error then.
    """

    def __init__(self, df: DataFrame, kind: str = "entity", history: Sequence[HistoryEntry] = (), read_only: bool = False, layout: Layout | None = None):
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        if POS not in df.columns:
            raise ValueError(f"a frame needs the column {POS}")
        if OBJECT not in df.columns:
            df = df.withColumn(OBJECT, F.lit(None).cast("string"))
        self.df, self.kind, self.history, self.read_only = df, kind, tuple(history), read_only
        self._layout, self._ranked = layout, None

    # -- construction ------------------------------------------------------

    @classmethod
    def from_frame(cls, df: DataFrame, order: str | Sequence[str], object_col: str | None = None, features: Sequence[str] = (), kind: str = "entity") -> EntityFrame:
        """From any DataFrame; an integer ``order`` column is the position, other orders are numbered [A13]."""
        names = {c: feature_column(c) for c in features} | ({object_col: OBJECT} if object_col else {})
        if isinstance(order, str) and isinstance(df.schema[order].dataType, (T.IntegerType, T.LongType)):
            out = df.withColumn(POS, F.col(order).cast("bigint"))
        else:
            keys = [order] if isinstance(order, str) else list(order)
            out = dense(df.withColumn(POS, F.lit(0).cast("bigint")), *[F.col(k) for k in keys])
            return cls(out.withColumnsRenamed(names), kind, layout=Layout())
        return cls(out.withColumnsRenamed(names), kind)

    @classmethod
    def from_rows(cls, spark: SparkSession, objects: Sequence[Any], metadata: pd.DataFrame | Mapping[str, Sequence] | None = None, features: Mapping[str, Any] | None = None, kind: str = "entity") -> EntityFrame:
        """From driver-side values of equal length."""
        n = len(objects)
        meta = pd.DataFrame(metadata).reset_index(drop=True) if metadata is not None else pd.DataFrame(index=range(n))
        arrays = {k: np.asarray(v) for k, v in (features or {}).items()}
        if len(meta) != n or any(len(a) != n for a in arrays.values()):
            raise ValueError(f"Dimension mismatch: {n} objects, {len(meta)} metadata rows, features {[len(a) for a in arrays.values()]}")
        data = pd.DataFrame({POS: np.arange(n, dtype=np.int64), OBJECT: pd.Series(list(objects), dtype=object)})
        fields = [T.StructField(POS, T.LongType(), False), T.StructField(OBJECT, T.StringType())]
        if any(o is not None and not isinstance(o, str) for o in objects):
            fields[1] = spark.createDataFrame([(o,) for o in objects if o is not None], ["o"]).schema.fields[0]
            fields[1] = T.StructField(OBJECT, fields[1].dataType)
        for c in meta.columns:
            data[c] = meta[c]
            fields.append(T.StructField(str(c), spark_type(meta[c].dtype)))
        for k, a in arrays.items():
            data[feature_column(k)] = list(a)
            kind_ = T.ArrayType(spark_type(a.dtype))
            for _ in range(a.ndim - 2):
                kind_ = T.ArrayType(kind_)
            fields.append(T.StructField(feature_column(k), kind_, metadata={"dtype": str(a.dtype), "shape": list(a.shape[1:])}))
        rows = [tuple(_plain(v) for v in r) for r in data.itertuples(index=False)]
        return cls(spark.createDataFrame(rows, T.StructType(fields)), kind, layout=Layout(n=n))

    def _new(self, df: DataFrame, entry: HistoryEntry | None = None, kind: str | None = None, read_only: bool | None = None, layout: Layout | None = None) -> EntityFrame:
        return EntityFrame(df, kind or self.kind, self.history + ((entry,) if entry else ()), self.read_only if read_only is None else read_only, layout)

    def _same_rows(self, df: DataFrame, entry: HistoryEntry | None = None, read_only: bool | None = None) -> EntityFrame:
        """A frame with these rows at these positions and other columns; a column ``_rank`` is what is known of their numbers."""
        out = self._new(df.drop("_rank"), entry, read_only=read_only, layout=self._layout)
        if "_rank" in df.columns:
            out._ranked = df
        return out

    # -- row numbers -------------------------------------------------------

    def _numbered(self) -> tuple[DataFrame, Column]:
        """The frame's plan (with a column ``_rank`` if positions have gaps) and the number of each row."""
        if self._layout is None and self._ranked is None:
            self._look()
        return (self.df, self._layout.number()) if self._layout is not None else (self._ranked, F.col("_rank"))

    def _look(self) -> None:
        """Whether positions are ``start``, ``start + 1``, ...: by count, ends and a sum of hashes, without a shuffle."""
        total = F.sum(F.xxhash64(POS).cast("decimal(38,0)"))
        n, known, low, high, mark = self.df.agg(F.count("*"), F.count(POS), F.min(POS), F.max(POS), total).first()
        if known < n:
            raise ValueError("a position is null")
        if not n:
            self._layout = Layout(n=0)
        elif high - low + 1 == n and self.spark.range(low, high + 1).withColumnRenamed("id", POS).agg(total).first()[0] == mark:
            self._layout = Layout(low, 1, n)
        else:
            if self.df.groupBy(POS).count().where("count > 1").limit(1).count():
                raise ValueError("positions repeat, so rows can't be addressed by number")
            self._ranked = ranked(self.df)

    # -- catalog [C15] -----------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def feature_names(self) -> list[str]:
        return [c[len(PREFIX) :] for c in self.df.columns if c.startswith(PREFIX)]

    @property
    def metadata_columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (POS, OBJECT) and not c.startswith(PREFIX)]

    def has_feature(self, feature: str) -> bool:
        return feature_column(feature) in self.df.columns

    def feature_shape(self, name: str) -> tuple[int, ...]:
        """(rows, width, ...)."""
        return (self.count(), *self._inner_shape(name))

    def feature_width(self, name: str) -> int:
        return self._inner_shape(name)[0]

    def _inner_shape(self, name: str) -> list[int]:
        """From the schema, else the width of one row; 0 if there is none."""
        self._need_feature(name)
        c = feature_column(name)
        shape = self.df.schema[c].metadata.get("shape")
        if shape:
            return list(shape)
        row = self.df.where(F.col(f"`{c}`").isNotNull()).select(F.size(f"`{c}`")).first()
        return [row[0] if row else 0]

    def count(self) -> int:
        """Number of rows, counted once."""
        if self._layout is not None and self._layout.n is not None:
            return self._layout.n
        if getattr(self, "_count", None) is None:
            self._count = self.df.count()
        return self._count

    def __len__(self) -> int:
        return self.count()

    def __repr__(self) -> str:
        return f"EntityFrame(kind={self.kind!r}, metadata={self.metadata_columns}, features={self.feature_names}, history={len(self.history)})"

    def _need_feature(self, *names: str) -> None:
        for n in names:
            if n not in self.feature_names:
                raise KeyError(f"no feature {n!r}")

    def _need_metadata(self, *names: str) -> None:
        for n in names:
            if n not in self.metadata_columns:
                raise KeyError(f"no metadata column {n!r}")

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("a view with sliced features is read-only")

    # -- reads [C1-C9, C16] ------------------------------------------------

    def select_rows(self, rows: Any = None) -> RowSelection:
        return RowSelection.from_raw(rows, self.count() if RowSelection.needs_count(rows) else None)

    def _chosen(self, chosen: RowSelection, *columns: Column) -> DataFrame:
        """The selected rows with the given columns (by default all)."""
        columns = columns or tuple(F.col(f"`{c}`") for c in self.df.columns if c != POS)
        if chosen.kind in ("all", "where"):
            return chosen.apply(self.df).select(POS, *columns)
        df, number = self._numbered()
        if chosen.kind == "range" and not chosen.renumbers and self._layout is not None:
            return df.where(chosen.within(self._layout)).select(POS, *columns)
        return chosen.apply(df, number).select(POS, *columns)

    def metadata(self, rows: Any = None, cols: str | Sequence[str] | None = None) -> DataFrame:
        cols = self.metadata_columns if cols is None else [cols] if isinstance(cols, str) else list(cols)
        self._need_metadata(*cols)
        return self._chosen(self.select_rows(rows), *[F.col(f"`{c}`") for c in cols]) if cols else self._chosen(self.select_rows(rows)).select(POS)

    def feature(self, name: str, rows: Any = None) -> DataFrame:
        return self.features(name, rows)

    def features(self, names: str | Sequence[str] | None = None, rows: Any = None) -> DataFrame:
        names = self.feature_names if names is None else [names] if isinstance(names, str) else list(names)
        self._need_feature(*names)
        if not names:
            return self._chosen(self.select_rows(rows)).select(POS)
        return self._chosen(self.select_rows(rows), *[F.col(f"`{feature_column(n)}`").alias(n) for n in names])

    def objects(self, rows: Any = None) -> Any:
        """The object column; of a single position the object itself."""
        chosen = self.select_rows(rows)
        out = self._chosen(chosen, F.col(OBJECT))
        return out.first()[1] if chosen.is_scalar else out

    def __getitem__(self, key: Any) -> Any:
        axis, args = (key[0], key[1:]) if isinstance(key, tuple) else (None, ())
        if axis is None and not isinstance(key, tuple):
            return self.subset(rows=key)
        if axis not in (OBJ, META, FEAT):
            raise KeyError(f"unknown axis {axis!r}")
        if len(args) not in (1, 2):
            raise IndexError("an axis takes one or two keys")
        named = isinstance(args[0], str) or (isinstance(args[0], (list, tuple)) and len(args[0]) > 0 and all(isinstance(a, str) for a in args[0]))
        if axis == OBJ:
            if named or len(args) > 1:
                raise IndexError("objects have no names")
            return self.objects(args[0])
        if axis == META:
            return self.metadata(args[1] if len(args) > 1 else None, args[0]) if named else self.metadata(*args)
        if not named:
            raise IndexError("features are chosen by name")
        return self.features(args[0], args[1] if len(args) > 1 else None)

    def subset(self, rows: Any) -> EntityFrame:
        """Rows by number, slice, list, mask or predicate [C9, G2].

        A forward slice or predicate keeps positions, so that edits can be written
        back to where the rows came from; a list, mask or backward slice numbers
        them anew.
        """
        chosen = self.select_rows(rows)
        extra = {"n_indices": chosen.count} if chosen.kind == "take" else {}
        layout = None
        if chosen.kind == "all":
            layout = self._layout
        elif chosen.renumbers:
            layout = Layout(n=chosen.count)
        elif chosen.kind == "range":
            self._numbered()
            start, stop, step = chosen.bounds
            layout = self._layout and self._layout.part(start, None if stop < 0 else stop, step)
        return self._new(self._chosen(chosen), HistoryEntry.now("subset", extra, **extra), layout=layout)

    def where(self, predicate: Column | str) -> EntityFrame:
        """Rows where ``predicate`` (a column or SQL text) is true; null counts as false [C10]."""
        predicate = F.expr(predicate) if isinstance(predicate, str) else predicate
        return self._new(self.df.where(F.coalesce(predicate, F.lit(False))), HistoryEntry.now("where"))

    def view(self, features: Sequence[str] | None = None, meta_cols: Sequence[str] | None = None, feature_slices: Mapping[str, tuple[int, int]] | None = None) -> EntityFrame:
        """Only the named columns; features cut to half-open ranges make the view read-only [C11]."""
        features = self.feature_names if features is None else list(features)
        meta_cols = self.metadata_columns if meta_cols is None else list(meta_cols)
        self._need_feature(*features)
        self._need_metadata(*meta_cols)
        cut = dict(feature_slices or {})
        for n, (a, b) in cut.items():
            if n not in features:
                raise KeyError(f"feature {n!r} isn't in the view")
            if not 0 <= a <= b:
                raise ValueError("a slice must be 0 <= start <= stop")
        columns = [F.slice(f"`{feature_column(n)}`", cut[n][0] + 1, cut[n][1] - cut[n][0]).alias(feature_column(n)) if n in cut else F.col(f"`{feature_column(n)}`") for n in features]
        return self._same_rows(self.df.select(POS, OBJECT, *[F.col(f"`{c}`") for c in meta_cols], *columns), read_only=self.read_only or bool(cut))

    def valid_mask(self) -> Column:
        """Objects that are there and, for molecules, have an atom [C12]."""
        if self.kind in ("molecule", "conformer"):
            from .functions.chem import n_atoms

            return F.col(OBJECT).isNotNull() & (F.coalesce(n_atoms(F.col(OBJECT)), F.lit(0)) > 0)
        return F.col(OBJECT).isNotNull()

    def drop_invalid(self) -> EntityFrame:
        return self._new(self.df.where(self.valid_mask()), HistoryEntry.now("drop_invalid"))

    def valid_objects(self, drop_invalid: bool = True) -> DataFrame:
        """Objects, by default the non-null ones only [C14]."""
        out = self.df.select(POS, OBJECT)
        return out.where(F.col(OBJECT).isNotNull()) if drop_invalid else out

    # -- writes [K1-K13] ---------------------------------------------------

    def _values(self, name: str, value: Any, rows: Any) -> tuple[DataFrame, Column, Column]:
        """Plan with the new values, the new value's column, and whether a row is addressed."""
        chosen = self.select_rows(rows)
        if isinstance(value, Column) or np.isscalar(value) or value is None:
            new = value if isinstance(value, Column) else F.lit(value)
            df, number = (self.df, None) if chosen.kind in ("all", "where") else self._numbered()
            return df, new, chosen.condition(number)
        values = list(value)
        if chosen.kind == "where":
            raise TypeError("values for the rows of a predicate must be a column or one value")
        if chosen.kind != "take" and chosen.n is None:
            chosen = RowSelection.from_raw(rows, self.count())
        at = list(chosen.positions_or_all())
        if len(values) != len(at):
            raise ValueError(f"{len(values)} values for {len(at)} rows")
        df, number = self._numbered()
        pairs = [(int(p), _plain(v)) for p, v in dict(zip(at, values, strict=True)).items()]
        new = self.spark.createDataFrame(pairs, T.StructType([T.StructField("_at", T.LongType()), T.StructField("_new", value_type(values))]))
        return df.join(new, number == F.col("_at"), "left"), F.col("_new"), F.col("_at").isNotNull()

    def with_metadata(self, name: str, value: Any, rows: Any = None, na: Any = None) -> EntityFrame:
        """Adds or replaces a metadata column [K1]; a partial integer insert needs ``na``."""
        self._writable()
        if name in (POS, OBJECT) or name.startswith(PREFIX):
            raise ValueError(f"{name!r} is not a metadata name")
        df, new, here = self._values(name, value, rows)
        if rows is not None:
            kind = df.select(new.alias("x")).schema[0].dataType
            if isinstance(kind, T.IntegralType) and na is None and name not in self.df.columns:
                raise ValueError("a partial insert of integers needs a value for the other rows (na)")
            rest = F.col(f"`{name}`") if name in self.df.columns else F.lit(float("nan") if na is None and isinstance(kind, T.FractionalType) else na)
            new = F.when(here, new).otherwise(rest)
        return self._same_rows(df.withColumn(name, new).drop("_at", "_new"), HistoryEntry.now("add_metadata_column", {"name": name}))

    def with_metadata_columns(self, columns: Mapping[str, Any], rows: Any = None, na: Any = None) -> EntityFrame:
        out = self
        for name, value in columns.items():
            out = out.with_metadata(name, value, rows, na)
        return out

    def update_metadata(self, values: Any, rows: Any = None) -> EntityFrame:
        """Overwrites existing columns from a mapping, pandas DataFrame or named Series [K3]."""
        if isinstance(values, pd.Series):
            label = values.name
            if label is None:
                raise ValueError("a Series needs a name")
            values = {label: values.tolist()}
        elif isinstance(values, pd.DataFrame):
            values = {c: values[c].tolist() for c in values.columns}
        self._need_metadata(*values)
        out = self
        for name, value in values.items():
            out = out.with_metadata(name, value, rows)
        return out

    def drop_metadata(self, cols: str | Sequence[str] | None = None) -> EntityFrame:
        self._writable()
        cols = self.metadata_columns if cols is None else [cols] if isinstance(cols, str) else list(cols)
        self._need_metadata(*cols)
        return self._same_rows(self.df.drop(*cols), HistoryEntry.now("drop_metadata_columns", {"cols": cols}))

    def set_metadata(self, other: DataFrame) -> EntityFrame:
        """Replaces all metadata by the columns of ``other``, matched on ``_pos`` [K5]."""
        self._writable()
        return self._same_rows(self.df.drop(*self.metadata_columns).join(other, POS, "left"), HistoryEntry.now("set_metadata"))

    def with_feature(self, name: str, value: Any, rows: Any = None, na: Any = None) -> EntityFrame:
        """Creates, replaces or patches a feature [K6]; rows without a value get NaN (floats) or 0."""
        self._writable()
        if not NAME.match(name):
            raise ValueError(f"feature name {name!r} may hold letters, digits, _ and = only")
        column = feature_column(name)
        if not isinstance(value, Column):
            value = np.asarray(value)
            if value.dtype == object or value.ndim < 2:
                raise ValueError("a feature is a numeric array of two or more dimensions")
            meta = {"dtype": str(value.dtype), "shape": list(value.shape[1:])}
            df, new, here = self._values(name, list(value), rows)
        else:
            meta = {}
            df, new, here = self._values(name, value, rows)
        if rows is not None:
            kind = df.select(new.alias("x")).schema[0].dataType
            fill = F.lit(float("nan") if na is None and isinstance(kind.elementType, T.FractionalType) else na or 0).cast(kind.elementType)
            width = (value.shape[1] if not isinstance(value, Column) else None) or self.feature_width(name)
            rest = F.col(f"`{column}`") if column in self.df.columns else F.array_repeat(fill, width)
            new = F.when(here, new).otherwise(rest)
        old = self.df.schema[column].metadata if column in self.df.columns and not meta else {}
        return self._same_rows(df.withColumn(column, new.alias(column, metadata=meta or old)).drop("_at", "_new"), HistoryEntry.now("update_feature", {"name": name}))

    def with_features(self, values: Mapping[str, Any], rows: Any = None, replace: bool = False) -> EntityFrame:
        """Bulk [K7]; ``replace`` drops all other features."""
        out = self
        for n in self.feature_names if replace else ():
            if n not in values:
                out = out.drop_feature(n)
        for name, value in values.items():
            out = out.with_feature(name, value, rows)
        return out

    def drop_feature(self, name: str) -> EntityFrame:
        self._writable()
        self._need_feature(name)
        return self._same_rows(self.df.drop(feature_column(name)), HistoryEntry.now("drop_feature", {"name": name}))

    def update_objects(self, value: Any, rows: Any = None) -> EntityFrame:
        """Replaces all or some objects [K9, L4]."""
        self._writable()
        df, new, here = self._values(OBJECT, value, rows)
        if rows is not None:
            new = F.when(here, new).otherwise(F.col(OBJECT))
        return self._same_rows(df.withColumn(OBJECT, new).drop("_at", "_new"), HistoryEntry.now("update_objects"))

    def copy(self) -> EntityFrame:
        """Frames are immutable; a copy shares the plan [K10, L7]."""
        return self._same_rows(self.df)

    def append_history(self, entry: HistoryEntry) -> EntityFrame:
        return self._same_rows(self.df, entry)

    def reindexed(self) -> EntityFrame:
        """Positions 0 .. n-1 in the old order."""
        df, number = self._numbered()
        return self._new(df.withColumn(POS, number.cast("bigint")).drop("_rank"), layout=Layout(n=self._layout.n if self._layout else None))

    def materialized(self, path: str) -> EntityFrame:
        """Written to ``path`` and read again, which cuts the plan [K13, L6]."""
        self.df.write.mode("errorifexists").parquet(path)
        return self._same_rows(self.spark.read.schema(self.df.schema).parquet(path))

    def cached(self, features: Sequence[str] | None = None, meta_cols: Sequence[str] | None = None) -> EntityFrame:
        """Warm columns for repeated use, by default all [A9, L8, X8]; :meth:`uncached` forgets them."""
        out = self if features is None and meta_cols is None else self.view(features, meta_cols)
        return out._same_rows(out.df.persist())

    def uncached(self) -> EntityFrame:
        self.df.unpersist()
        return self

    def transform(self, f: Callable[[EntityFrame], EntityFrame]) -> EntityFrame:
        return f(self)


_KINDS = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(),
    "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "bool": T.BooleanType(),
}


def spark_type(dtype: Any) -> T.DataType:
    name = str(dtype)
    return T.TimestampType() if name.startswith("datetime64") else _KINDS.get(name, T.StringType())


def value_type(values: Sequence[Any]) -> T.DataType:
    arr = np.asarray(values[0]) if values and isinstance(values[0], (list, tuple, np.ndarray)) else None
    if arr is not None:
        kind = T.ArrayType(spark_type(arr.dtype))
        for _ in range(arr.ndim - 1):
            kind = T.ArrayType(kind)
        return kind
    known = [v for v in values if v is not None]
    if known and all(isinstance(v, (bool, np.bool_)) for v in known):
        return T.BooleanType()
    if known and all(isinstance(v, (int, np.integer)) for v in known):
        return T.LongType()
    if known and all(isinstance(v, (int, float, np.number)) for v in known):
        return T.DoubleType()
    return T.StringType()


def _plain(v: Any) -> Any:
    if isinstance(v, np.ndarray):
        return v.tolist()
    if isinstance(v, np.generic):
        return v.item()
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return None if v is pd.NaT else v
