"""Chemistry as Spark columns.

Each function is an Arrow UDF over SMILES that parses a distinct text once per
worker (a bounded memo) and gives null for null and unreadable texts.  What
needs embedding, force fields, tautomers or InChI uses RDKit where it is
installed and says so where it isn't.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fingerprints as fp
from . import mol as M
from . import props as P
from .smarts import compile_pattern

MEMO = 50_000
#: Fingerprints that a worker keeps, packed: 256 bytes each at 2,048 bits.
MEMO_BITS = 8_192


@lru_cache(maxsize=MEMO)
def read(smiles: str) -> M.Mol | None:
    """The graph with aromaticity perceived, or None if it can't be read."""
    try:
        return M.perceive(M.parse(smiles))
    except (ValueError, RecursionError):
        return None


@lru_cache(maxsize=MEMO)
def read_plain(smiles: str) -> M.Mol | None:
    try:
        return M.parse(smiles)
    except (ValueError, RecursionError):
        return None


def kernel(f: Callable[[M.Mol], object], returns: str, arrow: pa.DataType, plain: bool = False, null: object = None) -> Callable[[Column], Column]:
    """A column function from a function of one graph; each distinct text of a batch is computed once."""
    source = read_plain if plain else read

    def one(text: str | None) -> object:
        mol = None if text is None else source(text)
        if mol is None:
            return null
        try:
            return f(mol)
        except ValueError:
            return null

    @F.arrow_udf(returns)
    def run(column: pa.Array) -> pa.Array:
        coded = column.dictionary_encode()
        values = pa.array([one(t) for t in coded.dictionary.to_pylist()] + [null], arrow)
        at = coded.indices.fill_null(len(values) - 1)
        return values.take(at)

    return run


def n_atoms(c: Column) -> Column:
    return kernel(len, "int", pa.int32())(c)


def is_readable(c: Column) -> Column:
    return kernel(lambda m: True, "boolean", pa.bool_(), null=False)(c)


def _written(mol: M.Mol) -> str:
    """Canonical text, kept with a graph that :func:`read` keeps."""
    if mol._text is None:
        mol._text = M.write(mol)
    return mol._text


def canonical_smiles(c: Column) -> Column:
    """Canonical SMILES [I1]."""
    return kernel(_written, "string", pa.string())(c)


def read_smiles(c: Column, sanitize: bool = True) -> Column:
    """SMILES as a reader keeps them: checked, aromatic and without plain hydrogen atoms, or with ``sanitize=False`` as they stand."""
    f = (lambda m: M.write(M.remove_hydrogens(M.sanitize(m)))) if sanitize else M.write
    return kernel(f, "string", pa.string(), plain=True)(c)


def formula(c: Column) -> Column:
    return kernel(P.formula, "string", pa.string())(c)


def elements(c: Column) -> Column:
    """Distinct atomic numbers of explicit atoms."""
    return kernel(lambda m: sorted({a.z for a in m.atoms}), "array<int>", pa.list_(pa.int32()))(c)


def descriptors(c: Column, names: Sequence[str] = P.DEFAULT) -> Column:
    """Struct of descriptors, one pass for all of them [I4, J3]; NaN where one fails."""
    for n in names:
        if n not in P.DESCRIPTORS:
            raise ValueError(f"unknown descriptor {n!r}")

    def values(m: M.Mol) -> dict:
        out = {}
        for n in names:
            try:
                out[n] = float(P.DESCRIPTORS[n](m))
            except (ValueError, ArithmeticError):
                out[n] = float("nan")
        return out

    nan = {n: float("nan") for n in names}
    return kernel(values, "struct<" + ",".join(f"`{n}`:double" for n in names) + ">", pa.struct([(n, pa.float64()) for n in names]), null=nan)(c)


def descriptor_vector(c: Column, names: Sequence[str]) -> Column:
    """array<float> of descriptors; zeros for null and for molecules without atoms [J3]."""
    s = descriptors(c, names)
    vector = F.array(*[s[n].cast("float") for n in names])
    return F.when(F.coalesce(n_atoms(c), F.lit(0)) > 0, vector).otherwise(F.array_repeat(F.lit(0.0).cast("float"), len(names)))


def substructure_hits(c: Column, smarts: Sequence[str]) -> Column:
    """array<boolean>: which patterns occur; null for null [J7]."""
    patterns = [compile_pattern(s).text for s in smarts]
    return kernel(lambda m: [compile_pattern(s).hits(m) for s in patterns], "array<boolean>", pa.list_(pa.bool_()))(c)


_BITS: dict[str, Callable[..., np.ndarray]] = {
    "morgan": fp.circular,
    "maccs": fp.structural_keys,
    "gobbi": lambda m, n_bits, how: fp.fold(fp.pharmacophore(m), n_bits, how),
    "gobbi_native": fp.pharmacophore,
}


@lru_cache(maxsize=MEMO_BITS)
def _packed(kind: str, settings: tuple, text: str) -> bytes | None:
    """The fingerprint of a text, 8 bits a byte, or None where there is none; kept by the worker over batches and tasks."""
    mol = read(text)
    try:
        return None if mol is None else np.packbits(_BITS[kind](mol, *settings)).tobytes()
    except ValueError:
        return None


def _bits(kind: str, width: int, *settings: object, packed: bool = False) -> Callable[[Column], Column]:
    """A fingerprint as array<tinyint> of 0 and 1, or packed as binary (first bit highest); zeros for null."""
    blank = bytes(-(-width // 8))

    @F.arrow_udf(T.BinaryType() if packed else T.ArrayType(T.ByteType(), containsNull=False))
    def run(column: pa.Array) -> pa.Array:
        coded = column.dictionary_encode()
        found = [_packed(kind, settings, t) or blank for t in coded.dictionary.to_pylist()] + [blank]
        at = coded.indices.fill_null(len(found) - 1)
        if packed:
            return pa.array(found, pa.binary()).take(at)
        rows = np.unpackbits(np.frombuffer(b"".join(found), np.uint8).reshape(len(found), -1), axis=1, count=width).view(np.int8)
        flat = rows[at.to_numpy(zero_copy_only=False)].ravel()  # Arrow's take of lists goes element by element
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * np.int32(width)), pa.array(flat))

    return run


def morgan(c: Column, radius: int = 2, n_bits: int = 2048, packed: bool = False) -> Column:
    """Circular fingerprint; zeros for null [J2]."""
    return _bits("morgan", n_bits, radius, n_bits, packed=packed)(c)


def maccs(c: Column, packed: bool = False) -> Column:
    """167 structural keys; zeros for null [J1]."""
    return _bits("maccs", 167, packed=packed)(c)


def gobbi(c: Column, n_bits: int | None = 2048, fold_method: str = "xor", packed: bool = False) -> Column:
    """Pharmacophore vector, folded or native; zeros for null and failures [J4]."""
    if fold_method not in ("xor", "or"):
        raise ValueError(f"unknown fold method {fold_method!r}")
    if n_bits is None:
        return _bits("gobbi_native", fp.native_length(), packed=packed)(c)
    return _bits("gobbi", n_bits, n_bits, fold_method, packed=packed)(c)


def fold_bits(bits: Column, length: int, n_bits: int, method: str = "xor") -> Column:
    """Fold of a 0/1 array column without Python [I12]."""
    if method not in ("xor", "or"):
        raise ValueError(f"unknown fold method {method!r}")
    def at(j: Column) -> Column:
        strided = F.filter(bits, lambda _, i: i % n_bits == j)
        total = F.aggregate(strided, F.lit(0), lambda a, v: a + v.cast("int"))
        return (total % 2 if method == "xor" else F.least(total, F.lit(1))).cast("tinyint")
    return F.transform(F.sequence(F.lit(0), F.lit(n_bits - 1)), at)


def kekulized(c: Column) -> Column:
    """Explicit single and double bonds; null if there are none [J13]."""
    return kernel(lambda m: M.write(M.kekulize(m)), "string", pa.string())(c)


def sanitized(c: Column) -> Column:
    """Checked and canonical; null if impossible [J17]."""
    return kernel(lambda m: M.write(M.sanitize(m)), "string", pa.string(), plain=True)(c)


def desalted(c: Column) -> Column:
    """Largest fragment, organic first; unchanged if unreadable [J14]."""
    return F.coalesce(kernel(lambda m: M.write(M.largest_fragment(m)), "string", pa.string())(c), c)


def with_hydrogens(c: Column, add: bool = True) -> Column:
    """Hydrogens as atoms, or as counts; unchanged if unreadable [J16]."""
    f = M.add_hydrogens if add else M.remove_hydrogens
    return F.coalesce(kernel(lambda m: M.write(f(m)), "string", pa.string())(c), c)


def rdkit():
    """RDKit's ``Chem`` or an error that says what needs it."""
    try:
        from rdkit import Chem
    except ImportError as e:
        raise NotImplementedError("tautomers, 3-D embedding and InChI keys need RDKit, which isn't installed") from e
    return Chem
