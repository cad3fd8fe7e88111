"""Sinks: a frame's records as text lines, written by the executors or as one file.

By default ``write_file`` makes a folder of part files at the path, one for each
partition in position order.  ``single=True`` streams the lines to one file
instead, partition by partition.
"""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import OBJECT, EntityFrame
from ..functions.chem import mol as M
from ..index import POS
from ..storage import exists
from .formats import detect_format, get_writer, register_format
from .molblock import block_format, write_block

#: Molecules that a worker keeps.
BLOCKS = 8_192
END = "\n$$$$"


def to_records(frame: EntityFrame) -> DataFrame:
    """(_pos, object, name, source, index, properties, and coords of objects that have them); null properties and NaN numbers are dropped [B8]."""
    df = frame.df
    own = [c for c in frame.metadata_columns if c not in ("name", "source", "index")]
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    text = lambda c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`").cast("string")) if c in real else F.col(f"`{c}`").cast("string")
    pairs = [x for c in own for x in (F.lit(c), text(c))]
    props = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    pick = lambda c, kind: F.col(c).cast(kind).alias(c) if c in df.columns else F.lit(None).cast(kind).alias(c)
    kind = df.schema[OBJECT].dataType
    solid = isinstance(kind, T.StructType) and "coords" in kind.names
    obj = F.col(f"{OBJECT}.smiles") if solid else F.col(OBJECT) if frame.kind != "reaction" or isinstance(kind, T.StringType) else _text(F.col(OBJECT))
    coords = [F.get(F.col(f"{OBJECT}.coords"), F.lit(0)).alias("coords")] if solid else []
    return df.select(POS, obj.alias(OBJECT), pick("name", "string"), pick("source", "string"), pick("index", "bigint"), props.alias("properties"), *coords)


def _text(c):
    from .readers import reaction_text

    return reaction_text(c)


def smiles_lines(records: DataFrame, delimiter=" ", write_name=True, canonical=True) -> DataFrame:
    """SMILES and name; not canonical prefers the stored SMILES property [B3]."""
    s = F.col(OBJECT) if canonical else F.coalesce(F.try_element_at("properties", F.lit("SMILES")), F.col(OBJECT))
    line = F.concat_ws(delimiter, s, F.col("name")) if write_name else s
    return records.where(F.col(OBJECT).isNotNull()).select(POS, line.alias("value"))


def csv_lines(records: DataFrame, smiles_col: str = "SMILES", name_col: str = "Name", extra_cols: list[str] | None = None, delimiter: str = ",") -> DataFrame:
    """Header and rows; the first record's properties make the header unless given [B4]."""
    if extra_cols is None:
        first = records.orderBy(POS).select(F.map_keys("properties")).first()
        extra_cols = list(first[0]) if first else []

    def quoted(values: list) -> str:
        out = io.StringIO()
        csv.writer(out, delimiter=delimiter, lineterminator="").writerow(["" if v is None else v for v in values])
        return out.getvalue()

    header = records.sparkSession.createDataFrame([(-1, quoted([smiles_col, name_col, *extra_cols]))], f"{POS} bigint, value string")
    special = f'["\r\n{delimiter}]'
    quote = lambda c: F.when(c.rlike(special), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    cells = [F.coalesce(quote(c), F.lit("")) for c in (F.col(OBJECT), F.col("name"), *[F.try_element_at("properties", F.lit(p)) for p in extra_cols])]
    return header.unionAll(records.select(POS, F.concat_ws(delimiter, *cells).alias("value")))


def csv_table(records: DataFrame, smiles_col: str = "SMILES", name_col: str = "Name", extra_cols: list[str] | None = None, delimiter: str = ",") -> DataFrame:
    """The columns of :func:`csv_lines` for a folder of files, each with the header."""
    if extra_cols is None:
        first = records.orderBy(POS).select(F.map_keys("properties")).first()
        extra_cols = list(first[0]) if first else []
    names = [smiles_col, name_col, *extra_cols]
    cells = [F.col(OBJECT), F.col("name"), *[F.try_element_at("properties", F.lit(p)) for p in extra_cols]]
    taken: set[str] = set()
    out = []
    for n, c in zip(names, cells, strict=True):  # column names ignore case
        while n.lower() in taken:
            n = f"{n}_"
        taken.add(n.lower())
        out.append(c.alias(n))
    return records.orderBy(POS).select(*out)


@lru_cache(maxsize=BLOCKS)
def _solid(smiles: str) -> tuple[int, Callable[..., str]]:
    """How many coordinates a molecule has, and its block of them without name."""
    mol = M.parse(smiles)
    return 3 * len(mol), block_format(mol).format


def _coordinates(column: pa.ListArray) -> list[list[float] | None]:
    """The coordinates of each row's atoms one after another, None where there are none."""
    points = column.flatten()
    if points.null_count or pc.any(pc.not_equal(points.value_lengths(), 3)).as_py():
        raise M.ChemError("an atom has three coordinates")
    values = points.flatten()
    values = values.to_pylist() if values.null_count or not pa.types.is_floating(values.type) else values.to_numpy().tolist()
    ends = np.cumsum(3 * column.value_lengths().fill_null(0).to_numpy()).tolist()
    return [values[a:b] if there else None for a, b, there in zip([0, *ends], ends, column.is_valid().to_pylist(), strict=False)]


@lru_cache(maxsize=BLOCKS)
def _flat(smiles: str) -> str:
    """A block without name and coordinates."""
    return write_block(M.parse(smiles))


def _items() -> Column:
    """Properties as text after a block."""
    return F.concat_ws("", F.transform(F.map_entries("properties"), lambda e: F.concat(F.lit("\n> <"), e["key"], F.lit(">\n"), e["value"], F.lit("\n"))))


def _block(smiles: str, at: list[float] | None) -> str:
    """A block without name; atoms in the order of the text, as coordinates are."""
    if at is None:
        return _flat(smiles)
    n, block = _solid(smiles)
    if len(at) != n:
        raise M.ChemError("there must be coordinates for each atom")
    return block(*at)


def _blocks(end: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coords = _coordinates(batch.column("coords")) if "coords" in batch.schema.names else [None] * batch.num_rows
            text = [f"{n or ''}{_block(s, at)}{tail}{END if end else ''}" for s, n, tail, at in zip(*[batch.column(c).to_pylist() for c in (OBJECT, "name", "_tail")], coords, strict=True)]
            yield pa.record_batch([batch.column(POS), pa.array(text, pa.string())], [POS, "value"])

    return run


def _molecules(records: DataFrame) -> DataFrame:
    """Records with an object; one that can't be read is an error when it is written."""
    return records.where(F.col(OBJECT).isNotNull()).drop("source", "index")


def sdf_lines(records: DataFrame, include_properties: bool = True) -> DataFrame:
    """Mol blocks with their properties; records without a molecule are left out [B2, B10]."""
    tail = _items() if include_properties else F.lit("")
    return _molecules(records).withColumn("_tail", tail).drop("properties").mapInArrow(_blocks(True), f"{POS} bigint, value string")


#: Rows are sorted before they become text, so that the sort's sample of them doesn't make it.
sdf_lines.keeps_order = smiles_lines.keeps_order = True


def mol_lines(records: DataFrame) -> DataFrame:
    """The first record only [B6]."""
    return _molecules(records).withColumn("_tail", F.lit("")).orderBy(POS).limit(1).mapInArrow(_blocks(False), f"{POS} bigint, value string")


def rxn_lines(records: DataFrame) -> DataFrame:
    """One reaction file a record [B5]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, n in zip(batch.column(OBJECT).to_pylist(), batch.column("name").to_pylist(), strict=True):
                sides = [[x for x in side.split(".") if x] for side in s.split(">")]
                mols = [M.perceive(M.parse(x)) for x in sides[0] + sides[2] + sides[1]]
                out.append("\n".join(["$RXN", n or "", "  retort", "", f"{len(sides[0]):3d}{len(sides[2]):3d}{len(sides[1]):3d}", *[f"$MOL\n{write_block(m)}" for m in mols]]))
            yield pa.record_batch([batch.column(POS), pa.array(out, pa.string())], [POS, "value"])

    return records.where(F.col(OBJECT).isNotNull()).select(POS, OBJECT, "name").mapInArrow(run, f"{POS} bigint, value string")


def _files(uri: str):
    """Writes each line to a file of its own, numbered by position but for the first."""
    base, dot = os.path.splitext(uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch.column(POS).to_pylist(), batch.column("value").to_pylist(), strict=True):
                system, path = fs.FileSystem.from_uri(uri if not k else f"{base}_{k}{dot}")
                with system.open_output_stream(path) as file:
                    file.write((text + "\n").encode())
            yield pa.record_batch([pa.array([batch.num_rows])], ["n"])

    return run


def write_file(frame: EntityFrame, path: str, overwrite: bool = False, single: bool = False, **options: Any) -> int:
    """Writes by the path's extension and gives the number of records [B1, B7, B9].

    Reactions to ``.rxn`` make ``base.rxn``, ``base_1.rxn``, ... by number,
    written by the executors.  Options that the writer doesn't know are an error.
    """
    ext = detect_format(path)
    if ext == "tsv":
        options.setdefault("delimiter", "\t")
    if not overwrite and (exists(frame.spark, path) or os.path.exists(path)):
        raise FileExistsError(path)
    records = to_records(frame)
    n = frame.count()
    mode = "overwrite" if overwrite else "errorifexists"
    if ext in ("csv", "tsv") and not single:
        csv_table(records, **options).write.mode(mode).option("header", True).option("sep", options.get("delimiter", ",")).option("escape", '"').csv(path)
        return n
    writer = get_writer(ext)
    first = getattr(writer, "keeps_order", False)
    lines = writer(to_records(frame._new(frame.df.orderBy(POS))) if first else records, **options)
    if ext == "rxn":
        uri = path if "://" in path else Path(path).resolve().as_uri()
        system, folder = fs.FileSystem.from_uri(uri.rpartition("/")[0])
        system.create_dir(folder, recursive=True)
        EntityFrame(lines).reindexed().df.select(POS, "value").mapInArrow(_files(uri), "n bigint").agg(F.sum("n")).collect()
        return n
    lines = (lines if first else lines.orderBy(POS)).select("value")
    if single or ext == "mol":
        Path(path).resolve().parent.mkdir(parents=True, exist_ok=True)
        with open(path, "w") as file:
            for row in lines.toLocalIterator():
                file.write(row[0] + "\n")
    else:
        lines.write.mode(mode).text(path)
    return n


for _ext, _writer in {"smi": smiles_lines, "smiles": smiles_lines, "csv": csv_lines, "tsv": csv_lines, "sdf": sdf_lines, "sd": sdf_lines, "mol": mol_lines, "rxn": rxn_lines}.items():
    register_format(_ext, writer=_writer)
