"""Readers: every format becomes (object, name, properties, source, index, _error).

Files are split and parsed by the executors.  A record's place is that of its
line (or block) among all lines of all files in the order given: the lines of
each split of a file are counted first, so nothing is shuffled or sorted.  Bad
and blank records leave gaps, which row numbers skip.  The object is a SMILES, of
a reaction ``reactants>agents>products``, of a block with ``coords=True`` a struct
of SMILES and coordinates.
"""

from __future__ import annotations

import csv
import inspect
import warnings
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import OBJECT, EntityFrame, HistoryEntry, dense
from ..functions import chem
from ..functions.chem import mol as M
from ..index import POS, Layout
from .formats import READERS, RecordParseError, RetortIOError, UnsupportedFormatError, detect_format, get_reader, register_format
from .molblock import read_block

__all__ = ["RecordParseError", "RetortIOError", "UnsupportedFormatError", "batches", "from_records", "from_smarts", "from_smiles", "iter_batches", "read_file", "read_records"]

RECORD = ("object", "name", "properties", "source", "index", "_error", "_file", "_block", "_line")
POLICIES = ("raise", "skip", "warn")
ITEMS = pa.map_(pa.string(), pa.string())
#: Blocks that a worker keeps.
BLOCKS = 8_192


def _ordered(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Adds source and the keys of file order; files count in the order given."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    full = [hadoop.Path(p).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(hadoop.Path(p)).toUri().getPath() for p in paths]
    place = F.create_map(*[x for k, p in enumerate(full) for x in (F.lit(p), F.lit(k))])
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z0-9]+:(//[^/]*)?", "")
    plain = F.url_decode(path)
    return df.select("*", plain.alias("source"), F.coalesce(F.get(F.array(F.try_element_at(place, plain)), F.lit(0)), F.lit(0)).alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))


def _indexed(df: DataFrame, used: Callable[[Column], Column] | None = None) -> DataFrame:
    """``index``: 0-based place of the row in its file, all counted; and its position among the rows of all files that are used.

    ``used`` says of a row, given whether it is its file's first, if it is one; others are dropped.
    """
    used = used or (lambda first: F.lit(True))
    top, other = used(F.lit(True)).cast("int"), used(F.lit(False)).cast("int")
    first = F.when(F.col("_block") == 0, F.min_by(top - other, "_line")).otherwise(0)  # what the file's first row adds
    splits = df.groupBy("_file", "source", "_block").agg(F.count("*").alias("n"), (F.sum(other) + first).alias("m"), F.min("_line").alias("first")).collect()
    place: dict[tuple, int] = {}  # number of a split's first used row; splits of a task follow each other
    tasks: dict[int, int] = {}
    for r in sorted(splits, key=lambda r: r.first):
        task = r.first >> 33
        place[r.source, r._block] = (task << 33) + tasks.get(task, 0)
        tasks[task] = tasks.get(task, 0) + r.m
    rows, total, own, last = [], 0, 0, None
    for r in sorted(splits, key=lambda r: (r._file, r.source, r._block)):  # one row for each split of a file
        own = 0 if r.source != last else own
        rows.append((r.source, r._block, own - r.first, total - place[r.source, r._block]))
        own, total, last = own + r.n, total + r.m, r.source
    bases = F.broadcast(df.sparkSession.createDataFrame(rows, "source string, _block bigint, _own bigint, _all bigint"))
    met = df.join(bases, ["source", "_block"]).withColumn("index", F.col("_own") + F.col("_line"))
    met = met.where(used(F.col("index") == 0)).withColumn("_place", F.monotonically_increasing_id())
    return met.withColumn(POS, F.col("_all") + F.col("_place")).drop("_own", "_all", "_place")


def _column_index(selector: Any, aliases: dict[str, int]) -> int:
    """A column by number, digit string or alias [I8]."""
    if isinstance(selector, bool):
        raise TypeError("a column is a number or a name")
    if isinstance(selector, int):
        return selector
    text = str(selector).strip().lower()
    if text.lstrip("-").isdigit():
        return int(text)
    if text in aliases:
        return aliases[text]
    raise ValueError(f"unknown column {selector!r}")


def read_smiles(spark: SparkSession, paths: Sequence[str], delimiter: str | None = None, smiles_col: Any = 0, name_col: Any = 1) -> DataFrame:
    """Lines of SMILES and name; blank and ``#`` lines are skipped but counted in ``index`` [A3]."""
    alias = {"smiles": 0, "smi": 0, "name": 1, "id": 1, "title": 1}
    s, n = _column_index(smiles_col, alias), None if name_col is None else _column_index(name_col, alias)
    body = F.trim(F.regexp_replace("value", r"\r$", ""))
    used = _indexed(_ordered(spark.read.text(list(paths)), paths), lambda first: (body != "") & ~body.startswith("#"))
    parts = F.split(body, r"\s+") if delimiter is None else F.split(F.regexp_replace("value", r"\r$", ""), "\\Q" + delimiter + "\\E")
    smiles = F.get(parts, F.lit(s))
    return used.select(smiles.alias("_text"), (F.get(parts, F.lit(n)) if n is not None else F.lit(None).cast("string")).alias("name"), F.create_map(F.lit("SMILES"), smiles).alias("properties"), "source", "index", POS)


def read_csv(spark: SparkSession, paths: Sequence[str], smiles_col: Any = "SMILES", name_col: Any = None, delimiter: str = ",", multi_line: bool = False) -> DataFrame:
    """Header CSV or TSV, all strings; properties are all columns but the SMILES [A4]."""
    out = None
    for path in paths:
        sep = "\t" if delimiter == "," and detect_format(path) == "tsv" else delimiter
        head = spark.read.text(path).first()
        names = next(csv.reader([head[0].rstrip("\r")], delimiter=sep)) if head else []
        table = spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line).option("enforceSchema", True).schema(", ".join(f"c{k} string" for k in range(len(names)))).csv(path)
        place = {n: k for k, n in reversed(list(enumerate(names)))}
        pick = lambda c: c if isinstance(c, int) else place.get(c)  # noqa: B023, E731
        key, name = pick(smiles_col), None if name_col is None else pick(name_col)
        for c, k in ((smiles_col, key), *([(name_col, name)] if name_col is not None else [])):
            if k is None or not -len(names) <= k < len(names):
                raise RetortIOError(f"{path} has no column {c!r}")
        rows = _indexed(_ordered(table, [path]))
        key %= len(names)
        others = [x for n, k in place.items() if k != key for x in (F.lit(n), F.col(f"c{k}"))]
        props = F.create_map(*others) if others else F.create_map().cast("map<string,string>")
        one = rows.select(F.coalesce(F.trim(f"c{key}"), F.lit("")).alias("_text"), (F.col(f"c{name % len(names)}") if name is not None else F.lit(None).cast("string")).alias("name"), props.alias("properties"), "source", "index", POS)
        if out is not None:  # positions follow those of the files before
            top = out.agg(F.max(POS)).first()[0]
            one = one.withColumn(POS, F.col(POS) + F.lit(0 if top is None else top + 1))
        out = one if out is None else out.unionByName(one)
    return out


@lru_cache(maxsize=BLOCKS)
def _molecule(table: str, sanitize: bool, remove_hs: bool) -> tuple[str, list]:
    """SMILES and coordinates of a block without its name; a worker reads equal ones once."""
    mol, at, _ = read_block(f"\n{table}")
    lost = M.plain_hydrogens(mol) if remove_hs else set()
    keep = [i for i in range(len(mol)) if i not in lost]
    mol = M.remove_hydrogens(mol) if remove_hs else mol
    text, order = M.write_order(M.sanitize(mol) if sanitize else mol)
    return text, [at[keep[i]] for i in order]


def _parser(kind: str, sanitize: bool = True, remove_hs: bool = True, coords: bool = False) -> Callable[[pa.Array], dict[str, pa.Array]]:
    """The columns object, name, properties (but for those of sdf) and _error of an array of blocks."""

    def one(text: str) -> tuple:
        try:
            if kind == "rxn":
                smiles, name, props = _reaction(text)
                return smiles, name, props, None, None
            block, _, tail = text.partition("M  END")
            name, _, table = block.partition("\n")
            smiles, at = _molecule(table + "M  END", sanitize, remove_hs)
            return smiles, name.replace("\r", "").strip() or None, list(_data_items(tail).items()) if kind != "sdf" else [], None, [at]
        except (ValueError, RecursionError) as e:
            return None, None, [], str(e), None

    def run(blocks: pa.Array) -> dict[str, pa.Array]:
        got = [one(t) for t in blocks.to_pylist()]
        text = pa.array([g[0] for g in got], pa.string())
        if coords:
            text = pa.StructArray.from_arrays([text, pa.array([g[4] for g in got], pa.list_(pa.list_(pa.list_(pa.float64()))))], ["smiles", "coords"], mask=text.is_null())
        out = {"object": text, "name": pa.array([g[1] for g in got], pa.string()), "_error": pa.array([g[3] for g in got], pa.string())}
        return out if kind == "sdf" else out | {"properties": pa.array([g[2] for g in got], ITEMS)}

    return run


def _whole(parse: Callable[[pa.Array], dict[str, pa.Array]]) -> Callable:
    """A parser over the batches of a plan, for formats of a file each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = parse(batch.column("value"))
            names = ["object", "name", "properties", "_error"]
            yield pa.record_batch([*[got[n] for n in names], batch.column("source"), batch.column("index"), batch.column(POS)], [*names, "source", "index", POS])

    return run


def _data_items(tail: str) -> dict[str, str]:
    """``> <name>`` items after a block; the last of a name counts, at the place of the first."""
    out: dict[str, str] = {}
    for item in f"\n{tail}".replace("\r", "").split("\n>")[1:]:
        line, _, value = item.partition("\n")
        a, b = line.find("<"), line.rfind(">")
        out[line[a + 1 : b] if 0 <= a < b else line.strip()] = value.strip("\n")
    return out


def _item_map(blocks: pa.Array) -> pa.Array:
    """The data items of blocks as maps."""
    ends, names, values = [0], [], []
    for text in blocks.to_pylist():
        found = _data_items(text.partition("M  END")[2])
        names += found
        values += found.values()
        ends.append(len(names))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))


def _reaction(text: str) -> tuple[str, str | None, list]:
    lines = text.replace("\r", "").split("\n")
    if not lines or not lines[0].startswith("$RXN"):
        raise M.ChemError("not a reaction file")
    try:
        n = [int(lines[4][k : k + 3] or 0) for k in (0, 3, 6)]
    except (ValueError, IndexError) as e:
        raise M.ChemError("can't read the reaction's counts") from e
    blocks = text.replace("\r", "").split("$MOL\n")[1:]
    if len(blocks) < sum(n):
        raise M.ChemError("the reaction is cut off")
    smiles = [M.write(M.perceive(read_block(b)[0])) for b in blocks[: sum(n)]]
    sides = smiles[: n[0]], smiles[n[0] + n[1] :], smiles[n[0] : n[0] + n[1]]
    return ">".join(".".join(s) for s in sides), lines[1].strip() or None, []


OBJECT_3D = "struct<smiles:string,coords:array<array<array<double>>>>"


def _parsed(coords: bool = False) -> str:
    return f"object {OBJECT_3D if coords else 'string'}, name string, properties map<string,string>, _error string, source string, index bigint, {POS} bigint"


def read_sdf(spark: SparkSession, paths: Sequence[str], sanitize: bool = True, remove_hs: bool = True, coords: bool = False) -> DataFrame:
    """Blocks that end with a line of ``$$$$``; a file is split among tasks at these lines [A2].

    A block without text is no record, but is counted in ``index``.

    ``coords`` keeps coordinates, one set a record, in the order of the SMILES' atoms.
    """
    lines = _ordered(spark.read.option("lineSep", "\n$$$$").text(list(paths)), paths)
    body = lambda first: F.when(first, F.col("value")).otherwise(F.regexp_replace("value", r"^[^\n]*\n?", ""))  # without the rest of the line before
    rows = _indexed(lines, lambda first: body(first).rlike(r"\S")).withColumn("value", body(F.col("index") == 0))
    parse = _parser("sdf", sanitize, remove_hs, coords)

    @F.arrow_udf(f"object {OBJECT_3D if coords else 'string'}, name string, _error string")
    def molecule(blocks: pa.Array) -> pa.Array:
        got = parse(blocks)
        return pa.StructArray.from_arrays(list(got.values()), list(got))

    @F.arrow_udf("map<string,string>")
    def items(blocks: pa.Array) -> pa.Array:
        return _item_map(blocks)

    # columns of functions, so that a plan that needs only positions or properties doesn't read molecules
    read = rows.withColumn("_read", molecule("value"))
    return read.select("_read.object", "_read.name", items("value").alias("properties"), "_read._error", "source", "index", POS)


def read_mol(spark: SparkSession, paths: Sequence[str], sanitize: bool = True, remove_hs: bool = True, coords: bool = False) -> DataFrame:
    """One molecule a file; the file's stem is its name if it has none [A6]."""
    rows = _indexed(_ordered(spark.read.text(list(paths), wholetext=True), paths))
    return rows.mapInArrow(_whole(_parser("mol", sanitize, remove_hs, coords)), _parsed(coords)).withColumn("name", F.coalesce("name", _stem(F.col("source"))))


def read_rxn(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One reaction a file, named by the file's stem [A5, A20]."""
    rows = _indexed(_ordered(spark.read.text(list(paths), wholetext=True), paths))
    return rows.mapInArrow(_whole(_parser("rxn")), _parsed()).withColumn("name", _stem(F.col("source")))


def _stem(source: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(source, "/"), -1), r"\.[^.]*$", "")


def read_records(spark: SparkSession, paths: str | Sequence[str], on_error: str = "raise", format_options: dict[str, dict] | None = None, **options: Any) -> DataFrame:
    """Records of files of any mix of formats, in the order given [A1, A7].

    ``options`` go to the readers that know them, ``format_options`` to those of
    one format; an option that no reader of the files knows is an error.
    ``on_error``: ``raise`` fails the job at the first bad record, ``skip`` drops
    bad ones, and ``warn`` reads all records once to say how many there are and
    which the first is, and drops them.
    """
    if on_error not in POLICIES:
        raise ValueError(f"on_error must be one of {POLICIES}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no files")
    known: set[str] = set()
    out, offset = None, F.lit(0).cast("bigint")
    groups: list[tuple[str, list[str]]] = []  # neighbouring files of one format are one scan
    for path in paths:
        ext = detect_format(path)
        if not groups or groups[-1][0] != ext:
            groups.append((ext, []))
        groups[-1][1].append(path)
    for k, (ext, group) in enumerate(groups):
        reader, sanitize = get_reader(ext), options.get("sanitize", True)
        names = inspect.signature(reader).parameters
        loose = any(p.kind == p.VAR_KEYWORD for p in names.values())
        shared = {n: v for n, v in options.items() if loose or n in names}
        known |= set(shared) | ({"sanitize"} if "sanitize" not in names else set())
        own = (format_options or {}).get(ext, {})
        if "sanitize" in own and "sanitize" not in names:
            own, sanitize = {n: v for n, v in own.items() if n != "sanitize"}, own["sanitize"]
        rows = reader(spark, group, **shared | own)
        if "_text" in rows.columns:
            rows = rows.withColumn("object", chem.read_smiles(F.col("_text"), sanitize))
            rows = rows.withColumn("_error", F.when(F.col("_text") == "", "no SMILES").when(F.col("object").isNull(), F.concat(F.lit("can't read "), F.col("_text")))).drop("_text")
        one = rows.select("object", "name", "properties", "source", "index", "_error", POS).withColumn("_file", F.lit(k))
        out = one if out is None else out.unionByName(one)
    if strange := set(options) - known:
        raise TypeError(f"no reader of these files knows the options {sorted(strange)}")
    bad = F.col("_error").isNotNull()
    if on_error == "raise":
        out = out.withColumn("object", F.when(bad, F.raise_error(F.concat_ws(", ", "source", F.concat(F.lit("record "), F.col("index")), "_error"))).otherwise(F.col("object")))
    elif on_error == "warn":
        found = out.where(bad).agg(F.count("*"), F.min(F.struct("_file", POS, "source", "index", "_error"))).first()
        if found[0]:
            first = RecordParseError(found[1]["source"], found[1]["index"], found[1]["_error"])
            warnings.warn(f"{found[0]} records can't be read and are dropped, first {first}", stacklevel=2)
    if on_error != "raise":  # a filter that stays above the parser, which runs once
        out = out.withColumn("_row", F.monotonically_increasing_id()).where(~bad & (F.col("_row") >= 0)).drop("_row")
    if len(groups) > 1:  # positions of a scan follow those of the scans before
        tops = {r[0]: r[1] + 1 for r in out.drop("object").groupBy("_file").agg(F.max(POS)).collect()}
        offset = F.element_at(F.create_map(*[x for k in range(len(groups)) for x in (F.lit(k), F.lit(sum(tops.get(j, 0) for j in range(k))).cast("bigint"))]), F.col("_file"))
    return out.withColumn(POS, F.col(POS) + offset).drop("_file", "_error")


def from_records(records: DataFrame, kind: str = "molecule", properties: Sequence[str] | None = None) -> EntityFrame:
    """Metadata: name, source, index and the union of properties [A14, A18].

    The names of properties need one pass over the records unless given.
    """
    if properties is None:
        found = records.select(F.explode(F.map_keys("properties")).alias("k")).distinct().collect()
        properties = sorted(r[0] for r in found)
    taken, extra = {"name", "source", "index", POS, OBJECT}, []
    for p in properties:  # column names ignore case, so a property may need a prefix
        column = p
        while column.lower() in taken:
            column = f"prop_{column}"
        taken.add(column.lower())
        extra.append(F.try_element_at("properties", F.lit(p)).alias(column))
    return EntityFrame(records.select(POS, OBJECT, "name", "source", "index", *extra), kind, (HistoryEntry.now("from_records"),))


def read_file(spark: SparkSession, path: str | Sequence[str], on_error: str = "raise", kind: str | None = None, max_records: int | None = None, **options: Any) -> EntityFrame:
    """Files as a frame [A10, A15, A17]; ``max_records`` keeps the first ones by number."""
    first = path if isinstance(path, str) else path[0]
    frame = from_records(read_records(spark, path, on_error, **options), kind or ("reaction" if detect_format(first) == "rxn" else "molecule"))
    return frame if max_records is None else frame[:max_records]


def batches(records: DataFrame, size: int = 1000) -> tuple[DataFrame, int]:
    """Records numbered without gaps, with ``batch_id`` across files, and the number of batches (1 at least) [A8, I13]."""
    from ..operators.aggregate import batch_ids

    frame = EntityFrame(records).reindexed()
    return batch_ids(frame.df, size), max(1, -(-frame.count() // size))


def iter_batches(records: DataFrame, size: int = 1000) -> Iterator[pa.Table]:
    """Batches of ``size`` records across files, the rest last, one at a time on the driver [A8]."""
    rows, n = batches(records, size)
    rows = rows.repartitionByRange("batch_id").sortWithinPartitions("batch_id", POS) if n > 1 else rows.sort(POS)
    held: list = []
    now = 0
    for row in rows.toLocalIterator(prefetchPartitions=True):
        if row.batch_id != now:
            yield pa.Table.from_pylist(held)
            held, now = [], row.batch_id
        held.append({k: v for k, v in row.asDict(True).items() if k != "batch_id"})
    if held:
        yield pa.Table.from_pylist(held)


def from_smiles(df: DataFrame, smiles: str = "smiles", order: str | None = None, sanitize: bool = True) -> EntityFrame:
    """A SMILES column parsed; an unreadable one gives a null object and stays in the metadata [A16]."""
    out = df.withColumn(OBJECT, chem.read_smiles(F.col(f"`{smiles}`"), sanitize))
    return EntityFrame.from_frame(out, order or smiles, kind="molecule")


def _sides(text: Column) -> Column:
    part = F.split(text, ">")
    side = lambda k: F.filter(F.transform(_components(F.get(part, F.lit(k))), F.trim), lambda x: x != "")
    ok = text.isNotNull() & (F.size(part) == 3)
    return F.when(ok, F.struct(side(0).alias("reactants"), side(1).alias("agents"), side(2).alias("products")))


def _components(text: Column) -> Column:
    """Parts between dots outside parentheses and brackets; a parenthesised group is one part."""
    guarded = F.regexp_replace(text, r"\.(?=[^()]*\))", "\u0001")
    return F.transform(F.split(guarded, r"\."), lambda x: F.replace(x, F.lit("\u0001"), F.lit(".")))


def from_smarts(df: DataFrame, smarts: str = "reaction_smarts", order: str | None = None) -> EntityFrame:
    """Reaction SMARTS as struct<reactants, agents, products>; the text stays in the metadata [A19]."""
    return EntityFrame.from_frame(df.withColumn(OBJECT, _sides(F.col(f"`{smarts}`"))), order or smarts, kind="reaction")


def n_reactants(c: Column) -> Column:
    return F.coalesce(F.size(F.col("object.reactants") if c is None else c["reactants"]), F.lit(0))


def n_products(c: Column) -> Column:
    return F.coalesce(F.size(c["products"]), F.lit(0))


def reaction_text(c: Column) -> Column:
    """The reaction as text [I2]."""
    return F.when(c.isNotNull(), F.concat_ws(">", F.concat_ws(".", c["reactants"]), F.concat_ws(".", c["agents"]), F.concat_ws(".", c["products"])))


def reaction_parts(frame: EntityFrame, side: str = "reactants") -> EntityFrame:
    """One molecule row for each part of a side, with the reaction's position [N9]."""
    if side not in ("reactants", "agents", "products"):
        raise ValueError(f"unknown side {side!r}")
    long = frame.df.select(F.col(POS).alias("reaction_index"), F.posexplode(f"{OBJECT}.{side}").alias("part_index", OBJECT))
    return EntityFrame(dense(long.withColumn(POS, F.lit(0).cast("bigint")), F.col("reaction_index"), F.col("part_index")), "molecule", frame.history, layout=Layout())


for _ext, _reader in {"smi": read_smiles, "smiles": read_smiles, "csv": read_csv, "tsv": read_csv, "sdf": read_sdf, "sd": read_sdf, "mol": read_mol, "rxn": read_rxn}.items():
    register_format(_ext, reader=_reader)
assert READERS
