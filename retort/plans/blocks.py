"""Blocks: filters, featurizers, preparations, sources and the sampler [J*, N*, A21, A22, G1].

A block is a plain value that extends a frame's plan.  Blocks that are pure row
predicates say so (``pure``) and whether they stay in the JVM (``native``), which
lets a pipeline run cheap ones first.  Kernels parse a distinct SMILES
once per worker, and Spark puts neighbouring ones into one Arrow stage.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import os
import re
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..frame import OBJECT, EntityFrame, HistoryEntry, feature_column, spread
from ..index import POS
from ..functions import chem
from ..functions.chem import props
from ..functions.chem.smarts import compile_pattern
from ..operators import setops
from ..storage import scratch

#: Numbers of the elements of drug-like molecules.
ORGANIC = tuple(chem.M.NUMBER[s] for s in "H C N O F P S Cl Br I".split())


class Block:
    """Table to table; subclasses give ``process`` [N5]."""

    pure = False
    native = True
    required_features: tuple[str, ...] = ()
    required_metadata: tuple[str, ...] = ()

    def config(self) -> dict[str, Any]:
        """Constructor arguments, as JSON-able values [X15]."""
        names = [p for p in inspect.signature(type(self).__init__).parameters if p not in ("self", "args", "kwargs")]
        return {n: v if isinstance(v, (int, float, str, bool, list, tuple, type(None))) else str(v) for n in names if (v := getattr(self, n, None)) is not None or hasattr(self, n)}

    @property
    def name(self) -> str:
        return type(self).__name__

    def process(self, frame: EntityFrame) -> EntityFrame:
        raise NotImplementedError

    def run(self, frame: EntityFrame, audit: bool = False) -> EntityFrame:
        """The block applied, with a history entry; ``audit`` counts rows before and after."""
        if not isinstance(frame, EntityFrame):
            raise TypeError("a block needs a frame")
        for n in self.required_features:
            frame._need_feature(n)
        frame._need_metadata(*self.required_metadata)
        rows_in = frame.count() if audit else None
        out = self.process(frame)
        if not isinstance(out, EntityFrame):
            raise TypeError(f"{self.name} must give a frame")
        return out._same_rows(out.df, HistoryEntry.now(self.name, self.config(), rows_in, out.count() if audit else None))


# -- filters ---------------------------------------------------------------


class Filter(Block):
    """Keeps rows whose condition is true; null means false [C10]."""

    pure = True
    native = False

    def condition(self, frame: EntityFrame) -> Column:
        raise NotImplementedError

    def process(self, frame: EntityFrame) -> EntityFrame:
        return frame._new(frame.df.where(F.coalesce(self.condition(frame), F.lit(False))))


class ValidityFilter(Filter):
    """Molecules with an atom [J10]."""

    def condition(self, frame: EntityFrame) -> Column:
        return chem.n_atoms(F.col(OBJECT)) > 0


class ElementFilter(Filter):
    """Every explicit atom's number is allowed; no atoms pass [J9]."""

    def __init__(self, allowed_elements: Sequence[int] = ORGANIC):
        self.allowed_elements = tuple(allowed_elements)

    def condition(self, frame: EntityFrame) -> Column:
        return F.size(F.array_except(chem.elements(F.col(OBJECT)), F.array(*[F.lit(z) for z in self.allowed_elements]))) == 0


class MWFilter(Filter):
    """Average mass up to ``max_mw`` [J5]."""

    def __init__(self, max_mw: float = 5e2):
        self.max_mw = max_mw

    def condition(self, frame: EntityFrame) -> Column:
        return chem.descriptors(F.col(OBJECT), ["MolWt"])["MolWt"] <= F.lit(self.max_mw)


class PropertyFilter(Filter):
    """Inclusive bounds of average mass and logP; only bounded ones are computed [J6]."""

    def __init__(self, min_mw: float | None = None, max_mw: float | None = None, min_logp: float | None = None, max_logp: float | None = None):
        self.min_mw, self.max_mw, self.min_logp, self.max_logp = min_mw, max_mw, min_logp, max_logp

    def condition(self, frame: EntityFrame) -> Column:
        bounds = {"MolWt": (self.min_mw, self.max_mw), "MolLogP": (self.min_logp, self.max_logp)}
        names = [n for n, b in bounds.items() if b != (None, None)]
        out = chem.is_readable(F.col(OBJECT))
        if names:
            d = chem.descriptors(F.col(OBJECT), names)
            for n in names:
                lo, hi = bounds[n]
                out = out & (d[n] >= F.lit(lo) if lo is not None else F.lit(True)) & (d[n] <= F.lit(hi) if hi is not None else F.lit(True))
        return out


class SMARTSFilter(Filter):
    """Rows in which at least ``min_matches`` (default: all) patterns occur, or with ``exclude`` the others [J7]."""

    def __init__(self, smarts: str | Sequence[str], exclude: bool = True, min_matches: int | None = None):
        self.smarts = [smarts] if isinstance(smarts, str) else list(smarts)
        if not self.smarts:
            raise ValueError("no patterns")
        for s in self.smarts:
            compile_pattern(s)
        self.exclude = exclude
        total = len(self.smarts)
        self.min_matches = total if min_matches is None else min_matches
        if not 1 <= self.min_matches <= total:
            raise ValueError(f"min_matches must be between 1 and {len(self.smarts)}")

    def condition(self, frame: EntityFrame) -> Column:
        hits = chem.substructure_hits(F.col(OBJECT), self.smarts)
        enough = F.size(F.filter(hits, lambda x: x)) >= self.min_matches
        return hits.isNotNull() & (~enough if self.exclude else enough)


class RuleOfFiveFilter(Filter):
    """At most ``max_violations`` of: exact mass > 500, logP > 5, donors > 5, acceptors > 10 [J11]."""

    def __init__(self, max_violations: int = 0):
        if max_violations < 0:
            raise ValueError("max_violations can't be negative")
        self.max_violations = max_violations

    def condition(self, frame: EntityFrame) -> Column:
        d = chem.descriptors(F.col(OBJECT), ["ExactMolWt", "MolLogP", "NumHDonors", "NumHAcceptors", "HeavyAtomCount"])
        broken = sum(((d[n] > F.lit(float(top))).cast("int") for n, top in (("ExactMolWt", 500), ("MolLogP", 5), ("NumHDonors", 5), ("NumHAcceptors", 10))), F.lit(0))
        return chem.is_readable(F.col(OBJECT)) & (d["HeavyAtomCount"] > 0) & (broken <= self.max_violations)


CATALOGS: dict[str, list[tuple[str, str]]] = {}
CATALOG_NAMES = ("PAINS", "PAINS_A", "PAINS_B", "PAINS_C", "BRENK", "NIH", "ZINC", "CHEMBL", "CHEMBL_BMS", "CHEMBL_DUNDEE", "CHEMBL_GLAXO", "CHEMBL_INPHARMATICA", "CHEMBL_LINT", "CHEMBL_MLSMR", "CHEMBL_SURECHEMBL", "ALL")


def register_catalog(name: str, patterns: Sequence[tuple[str, str]] | str) -> None:
    """Alert patterns (name, SMARTS), or a file of lines ``SMARTS name``."""
    if isinstance(patterns, str):
        lines = [x.split(None, 1) for x in open(patterns) if x.strip() and not x.startswith("#")]
        patterns = [(x[1].strip() if len(x) > 1 else x[0], x[0]) for x in lines]
    for _, s in patterns:
        compile_pattern(s)
    CATALOGS[name.upper()] = list(patterns)


class CatalogFilter(Filter):
    """Structural alerts of registered catalogs [J12]; the pattern files aren't shipped."""

    def __init__(self, catalogs: Sequence[str] = ("PAINS",), exclude: bool = True):
        self.catalogs, self.exclude = [c.upper() for c in catalogs], exclude

    def condition(self, frame: EntityFrame) -> Column:
        smarts = []
        for c in self.catalogs:
            if c in CATALOGS:
                smarts += [s for _, s in CATALOGS[c]]
            elif c in CATALOG_NAMES:
                raise NotImplementedError(f"load the patterns of {c} with register_catalog first")
            else:
                raise ValueError(f"unknown catalog {c!r}")
        hits = chem.substructure_hits(F.col(OBJECT), list(dict.fromkeys(smarts)))
        some = F.exists(hits, lambda x: x)
        return hits.isNotNull() & (~some if self.exclude else some)


class UniqueFilter(Block):
    """First row of each canonical SMILES (or InChI key, with RDKit) [J8, M4].

    The dedup is global, not one per batch.  With ``auto_reset=False`` keys of
    earlier runs are dropped as well until :meth:`reset`.
    """

    native = False

    def __init__(self, key="smiles", auto_reset=True):
        if key not in {"inchikey", "smiles"}:
            raise ValueError(f"unknown key {key!r}")
        self.key, self.auto_reset, self._seen = key, auto_reset, None

    def reset(self) -> None:
        self._seen = None

    def process(self, frame: EntityFrame) -> EntityFrame:
        if self.key == "inchikey":
            c = chem.rdkit()
            key = chem.kernel(lambda m: c.MolToInchiKey(c.MolFromSmiles(chem.M.write(m))), "string", chem.pa.string())(F.col(OBJECT))
        else:
            key = chem.canonical_smiles(F.col(OBJECT))
        out = setops.unique(frame, key, self._seen)
        if not self.auto_reset:  # keys are stored, so that a later run doesn't repeat this one
            path = scratch(frame.spark, "seen")
            out.df.select(key.alias("key")).write.parquet(path)
            own = frame.spark.read.schema("key string").parquet(path)
            self._seen = own if self._seen is None else self._seen.unionAll(own)
        return out


class FunctionFilter(Filter):
    """A predicate over a pandas Series of objects, or a Column function [N2]."""

    def __init__(self, func: Callable, name: str | None = None, column: str = OBJECT):
        self.func, self.label, self.column = func, name, column
        self.native = _of_columns(func)

    @property
    def name(self) -> str:
        return self.label or _valid_name(self.func)

    def condition(self, frame: EntityFrame) -> Column:
        return _apply(self.func, self.column, "boolean")


class BatchFunction(Block):
    """A function of whole batches: pandas DataFrame to pandas DataFrame of the columns in ``returns`` [M2, M3, N5].

    It sees all rows of a batch in order and may add, change or drop rows; which
    rows those are, :meth:`Pipeline.run_batches` or ``batch_size`` says.  Columns are
    ``_pos``, the object, metadata and features.  A batch is one task's.
    """

    def __init__(self, func: Callable[[pd.DataFrame], pd.DataFrame], returns: str, batch_size: int = 1000, name: str | None = None):
        if isinstance(batch_size, bool) or not isinstance(batch_size, int) or batch_size < 1:
            raise ValueError("batch_size must be a positive integer")
        self.func, self.returns, self.batch_size, self.label = func, returns, batch_size, name

    @property
    def name(self) -> str:
        return self.label or _valid_name(self.func)

    def process(self, frame: EntityFrame) -> EntityFrame:
        from ..operators.aggregate import batch_ids

        func = self.func

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            return func(rows.sort_values(POS, ignore_index=True).drop(columns="batch_id"))

        rows = batch_ids(frame.reindexed().df, self.batch_size)
        return frame._new(rows.groupBy("batch_id").applyInPandas(run, self.returns))


# -- featurizers -----------------------------------------------------------


class Featurizer(Block):
    """Adds one feature named after the block and its settings [I9]."""

    native = False
    dtype = "int8"

    def vector(self, c: Column) -> Column:
        raise NotImplementedError

    def width(self) -> int:
        raise NotImplementedError

    @property
    def feature_name(self) -> str:
        parts = ["=".join((setting, str(v))) for setting, v in self.config().items() if v is not None]
        return re.sub(r"[^A-Za-z0-9_=]+", "_", "_".join([self.name, *parts]))

    def process(self, frame: EntityFrame) -> EntityFrame:
        c = feature_column(self.feature_name)
        column = self.vector(F.col(OBJECT)).alias(c, metadata={"dtype": self.dtype, "shape": [self.width()]})
        return frame._same_rows(spread(frame.df).withColumn(c, column).withMetadata(c, {"dtype": self.dtype, "shape": [self.width()]}))


class MACCSFeaturizer(Featurizer):
    """167 structural keys [J1]."""

    def vector(self, c: Column) -> Column:
        return chem.maccs(c)

    def width(self) -> int:
        return 167


class MorganFeaturizer(Featurizer):
    """Circular fingerprint [J2]."""

    def __init__(self, radius=2, n_bits=2048):
        self.radius, self.n_bits = radius, n_bits

    def vector(self, c: Column) -> Column:
        return chem.morgan(c, self.radius, self.n_bits)

    def width(self) -> int:
        return self.n_bits


class DescriptorFeaturizer(Featurizer):
    """float32 vector of descriptors, all known ones by default [J3]."""

    dtype = "float32"

    def __init__(self, descriptor_names: Sequence[str] | None = None):
        self.descriptor_names = None if descriptor_names is None else list(descriptor_names)

    def vector(self, c: Column) -> Column:
        return chem.descriptor_vector(c, self.descriptor_names or list(props.DESCRIPTORS))

    def width(self) -> int:
        return len(self.descriptor_names or props.DESCRIPTORS)


class GobbiFeaturizer(Featurizer):
    """Pharmacophore vector, folded by xor or or, or native with ``n_bits=None`` [J4]."""

    def __init__(self, n_bits: int | None = 2048, fold_method: str = "xor"):
        if fold_method not in ("xor", "or"):
            raise ValueError(f"unknown fold method {fold_method!r}")
        self.n_bits, self.fold_method = n_bits, fold_method

    def vector(self, c: Column) -> Column:
        return chem.gobbi(c, self.n_bits, self.fold_method)

    def width(self) -> int:
        return self.n_bits or chem.fp.native_length()


class FunctionFeaturizer(Featurizer):
    """A vector from a function of a pandas Series, or of a Column [N1]; ``returns`` is the array's DDL type."""

    def __init__(self, func: Callable, name: str | None = None, returns: str = "array<double>", column: str = OBJECT, size: int | None = None):
        self.func, self.label, self.returns, self.column, self.size = func, name, returns, column, size

    @property
    def name(self) -> str:
        return self.label or _valid_name(self.func)

    @property
    def feature_name(self) -> str:
        return re.sub(r"[^A-Za-z0-9_=]+", "_", self.name)

    def process(self, frame: EntityFrame) -> EntityFrame:
        c = feature_column(self.feature_name)
        return frame._same_rows(frame.df.withColumn(c, _apply(self.func, self.column, self.returns)))


# -- preparations ----------------------------------------------------------


class Preparation(Block):
    """Replaces the object; null stays null."""

    native = False

    def prepared(self, c: Column) -> Column:
        raise NotImplementedError

    def process(self, frame: EntityFrame) -> EntityFrame:
        return frame._same_rows(frame.df.withColumn(OBJECT, self.prepared(F.col(OBJECT))))


class Kekulizer(Preparation):
    def prepared(self, c: Column) -> Column:
        return chem.kekulized(c)


class Desalter(Preparation):
    def prepared(self, c: Column) -> Column:
        return chem.desalted(c)


class HydrogenModifier(Preparation):
    def __init__(self, add_hs: bool = True):
        self.add_hs = add_hs

    def prepared(self, c: Column) -> Column:
        return chem.with_hydrogens(c, self.add_hs)


class Sanitizer(Preparation):
    def prepared(self, c: Column) -> Column:
        return chem.sanitized(c)


class TautomerCanonicalizer(Preparation):
    """Canonical tautomer; needs RDKit [J15]."""

    def prepared(self, c: Column) -> Column:
        chem.rdkit()
        from rdkit.Chem.MolStandardize import rdMolStandardize

        def f(m: chem.M.Mol) -> str:
            from rdkit import Chem

            return Chem.MolToSmiles(rdMolStandardize.TautomerEnumerator().Canonicalize(Chem.MolFromSmiles(chem.M.write(m))))

        return F.coalesce(chem.kernel(f, "string", chem.pa.string())(c), c)


class ConformerGenerator(Preparation):
    """Embedded and minimised conformers as struct<smiles, coords>, lowest energy first; needs RDKit [J18]."""

    FORCE_FIELDS = ("UFF", "MMFF94s", "MMFF94")

    def __init__(self, n_confs=10, ff="MMFF94s", max_iters=2000, random_seed=42, add_hs=True, keep_all=False):
        if ff not in self.FORCE_FIELDS:
            raise ValueError(f"unsupported force field {ff!r}")
        self.n_confs, self.ff, self.max_iters, self.random_seed, self.add_hs, self.keep_all = n_confs, ff, max_iters, random_seed, add_hs, keep_all

    def prepared(self, c: Column) -> Column:
        chem.rdkit()
        n, ff, iters, seed, hs, keep = self.n_confs, self.ff, self.max_iters, self.random_seed, self.add_hs, self.keep_all

        def f(m: chem.M.Mol) -> dict:
            from rdkit import Chem
            from rdkit.Chem import AllChem

            mol = Chem.MolFromSmiles(chem.M.write(m))
            work = Chem.AddHs(mol) if hs else mol
            ids = list(AllChem.EmbedMultipleConfs(work, numConfs=n, randomSeed=seed))
            results = AllChem.UFFOptimizeMoleculeConfs(work, maxIters=iters) if ff == "UFF" else AllChem.MMFFOptimizeMoleculeConfs(work, maxIters=iters, mmffVariant=ff)
            order = sorted(ids, key=lambda i: results[i][1] if results[i][1] is not None else float("inf"))
            return {"smiles": Chem.MolToSmiles(mol), "coords": [work.GetConformer(i).GetPositions().tolist() for i in (order if keep else order[:1])]}

        kind = chem.pa.struct([("smiles", chem.pa.string()), ("coords", chem.pa.list_(chem.pa.list_(chem.pa.list_(chem.pa.float64()))))])
        return chem.kernel(f, "struct<smiles:string,coords:array<array<array<double>>>>", kind)(c)


class FunctionPreparation(Preparation):
    """A function of a pandas Series of objects, or of a Column [N3]."""

    def __init__(self, func: Callable, name: str | None = None, returns: str = "string"):
        self.func, self.label, self.returns = func, name, returns

    @property
    def name(self) -> str:
        return self.label or _valid_name(self.func)

    def prepared(self, c: Column) -> Column:
        return _apply(self.func, OBJECT, self.returns)


# -- sources and sampling --------------------------------------------------


class Source(Block):
    """Makes a frame; a table given to it is ignored with a warning [N6]."""

    def load(self) -> EntityFrame:
        raise NotImplementedError

    def process(self, frame: EntityFrame | None) -> EntityFrame:
        return self.load()


class MemorySource(Source):
    """An existing frame [A22]."""

    def __init__(self, table: EntityFrame, batch_size: int = 1000):
        if isinstance(batch_size, bool) or not isinstance(batch_size, int) or batch_size < 1:
            raise ValueError("batch_size must be a positive integer")
        self.table, self.batch_size = table, batch_size

    def load(self) -> EntityFrame:
        return self.table


class FileSource(Source):
    """Files of any mix of formats [A21]."""

    def __init__(self, spark: SparkSession, paths: str | Sequence[str], batch_size: int | None = None, on_error: str = "raise"):
        self.spark, self.paths, self.batch_size, self.on_error = spark, [paths] if isinstance(paths, (str, os.PathLike)) else list(paths), batch_size, on_error

    def load(self) -> EntityFrame:
        from ..sources.readers import read_file

        return read_file(self.spark, self.paths, self.on_error)


class Sampler(Block):
    """A uniform sample of exactly min(n, max_size) rows [G1]."""

    def __init__(self, max_size: int, random_seed: int | None = None):
        if isinstance(max_size, bool) or not isinstance(max_size, int) or max_size < 1:
            raise ValueError("max_size must be a positive integer")
        self.max_size, self.random_seed = max_size, random_seed

    def process(self, frame: EntityFrame) -> EntityFrame:
        return setops.sample(frame, self.max_size, self.random_seed)


def _valid_name(func: Callable) -> str:
    """The function's name, or one from its code's hash for a lambda."""
    name = getattr(func, "__name__", "function")
    if name == "<lambda>":
        code = json.dumps([func.__code__.co_code.hex(), [repr(c) for c in func.__code__.co_consts if not inspect.iscode(c)], func.__code__.co_names])
        return "lambda_" + hashlib.blake2b(code.encode(), digest_size=5).hexdigest()
    return name


def _of_columns(func: Callable) -> bool:
    """Whether a function says that it takes a Column."""
    first = next(iter(inspect.signature(func).parameters.values()), None)
    return first is not None and first.annotation in (Column, "Column")


def _apply(func: Callable, column: str, returns: str) -> Column:
    """A native expression if ``func`` makes a Column of a Column, else an Arrow-batched pandas UDF."""
    if _of_columns(func):
        return func(F.col(column))

    def run(s: pd.Series) -> pd.Series:
        return func(s)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, returns)(F.col(column))
