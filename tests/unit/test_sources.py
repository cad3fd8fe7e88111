import warnings

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retort import OBJ, EntityFrame
from retort.functions.chem import mol as M
from retort.index import POS
from retort.operators.overlay import Overlay, write_back
from retort.sources import Bundle, ConflictError, UnsupportedFormatError, batches, detect_format, from_smiles, iter_batches, load, read_file, read_records, readers, save, write_file, writers
from retort.sources.molblock import read_block, write_block
from retort.sources.readers import from_smarts, n_products, n_reactants, reaction_parts, reaction_text
from retort.sources.writers import to_records


def objs(frame, *cols):
    return [tuple(r[c] for c in ("object", *cols)) for r in frame.df.orderBy(POS).collect()]


def test_formats():
    assert detect_format("x/A.SDF") == "sdf" and detect_format("file:/a/b.smi.gz") == "smi"
    for bad in ("a.xyz", "noext"):
        with pytest.raises(UnsupportedFormatError):
            detect_format(bad)


def test_smiles(spark, tmp_path):
    p = tmp_path / "a.smi"
    p.write_text("CCCCCC hexane\n# c\n\nCO methanol\nOCC\n")
    assert objs(read_file(spark, str(p)), "name", "index") == [("CCCCCC", "hexane", 0), ("CO", "methanol", 3), ("CCO", None, 4)]
    q = tmp_path / "b.smi"
    q.write_text("id1|CO\nid2|bad(\n")
    opts = {"delimiter": "|", "smiles_col": "1", "name_col": 0}
    assert objs(read_file(spark, str(q), "skip", **opts), "name") == [("CO", "id1")]
    with pytest.warns(UserWarning):
        read_file(spark, str(q), "warn", **opts)
    with pytest.raises(Exception, match="record 1"):
        read_records(spark, str(q), **opts).collect()
    with pytest.raises(ValueError):
        read_records(spark, str(q), "ignore")


def test_csv_and_mixed_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('SMILES,Name,x\nOCC,"a, b",1\nC,m,2\n')
    (tmp_path / "b.tsv").write_text("Name\tSMILES\nz\tCC\n")
    f = read_file(spark, [str(tmp_path / "b.tsv"), str(tmp_path / "a.csv")], name_col="Name")
    assert objs(f, "name", "index") == [("CC", "z", 0), ("CCO", "a, b", 0), ("C", "m", 1)] and "x" in f.metadata_columns
    rows, n = batches(read_records(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.tsv")]), 2)
    assert n == 2 and sorted(r.batch_id for r in rows.collect()) == [0, 0, 1]
    with pytest.raises(IOError):
        read_records(spark, str(tmp_path / "a.csv"), smiles_col="none")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_sdf_round_trip(spark, tmp_path, end):
    f = EntityFrame.from_rows(spark, ["CCO", "c1ccncc1", None, "C[N+](C)(C)C.[Cl-]", "c1cc[nH]c1"], {"name": list("abcde"), "score": [1.5, float("nan"), 3.0, 4.0, 5.0]}, kind="molecule")
    path = tmp_path / "m.sdf"
    assert write_file(f, str(path), single=True) == 5
    path.write_bytes(path.read_bytes().replace(b"\n", end.encode()))
    got = objs(read_file(spark, str(path)), "name", "score")
    assert got == [("CCO", "a", "1.5"), ("c1ccncc1", "b", None), ("C[N+](C)(C)C.[Cl-]", "d", "4.0"), ("c1cc[nH]c1", "e", "5.0")]
    with pytest.raises(FileExistsError):
        write_file(f, str(path))
    assert len(read_file(spark, str(path), max_records=2)) == 2


def test_mol_rxn_and_folders(spark, tmp_path):
    f = EntityFrame.from_rows(spark, ["CCO", "CC"], {"name": ["x", "y"]}, kind="molecule")
    write_file(f, str(tmp_path / "one.mol"))
    assert objs(read_file(spark, str(tmp_path / "one.mol")), "name") == [("CCO", "x")]
    r = EntityFrame.from_rows(spark, ["CCO>>CC=O", "CO.C>>COC"], kind="reaction")
    write_file(r, str(tmp_path / "r.rxn"))
    assert [objs(read_file(spark, str(tmp_path / n)))[0][0] for n in ("r.rxn", "r_1.rxn")] == ["CCO>>CC=O", "CO.C>>COC"]
    assert write_file(f, str(tmp_path / "folder.smi")) == 2 and (tmp_path / "folder.smi").is_dir()


def test_constructors(spark):
    df = spark.createDataFrame([(0, "OCC"), (1, "bad("), (2, None)], "k bigint, smiles string")
    assert objs(from_smiles(df, order="k"), "smiles") == [("CCO", "OCC"), (None, "bad("), (None, None)]
    rx = from_smarts(spark.createDataFrame([(0, "(A.B).C>cat>D"), (1, "x"), (2, None)], "k bigint, reaction_smarts string"), order="k")
    got = rx.df.orderBy(POS).select(n_reactants(F.col("object")).alias("a"), n_products(F.col("object")).alias("b"), reaction_text(F.col("object")).alias("t")).collect()
    assert [(r.a, r.b) for r in got] == [(2, 1), (0, 0), (0, 0)] and got[0].t == "(A.B).C>cat>D"
    assert objs(reaction_parts(rx), "reaction_index") == [("(A.B)", 0), ("C", 0)]


@pytest.fixture
def base(spark, tmp_path):
    f = EntityFrame.from_rows(spark, [f"o{i}" for i in range(5)], {"v": list(range(5))})
    save(f.with_metadata("w", "x"), str(tmp_path / "b"))
    return str(tmp_path / "b")


def test_bundle(spark, base):
    f = load(spark, base)
    assert [h.block_name for h in f.history] == ["add_metadata_column"] and len(f) == 5
    with pytest.raises(FileExistsError):
        save(f, base)
    assert save(f[0:2], base, overwrite=True) == 1 and len(load(spark, base)) == 2 and len(load(spark, base, 0)) == 5
    with pytest.raises(FileNotFoundError):
        load(spark, base + "none")


def test_overlay_commit_and_conflict(spark, base):
    bundle = Bundle(spark, base)
    one = Overlay(bundle).edit(lambda f: f[1:3].update_metadata({"v": F.col("v") * 10}))
    two = Overlay(bundle).edit(lambda f: f.drop_metadata("w"))
    assert one.commit_rows() == 1
    assert [r.v for r in bundle.load().df.orderBy(POS).collect()] == [0, 10, 20, 3, 4]
    with pytest.raises(ConflictError):
        two.commit()


def test_failed_commit_leaves_the_base(spark, base):
    bundle = Bundle(spark, base)
    bad = Overlay(bundle).edit(lambda f: f.with_metadata("v", F.raise_error(F.lit("poison")).cast("bigint")))
    with pytest.raises(Exception, match="poison"):
        bad.commit()
    assert bundle.versions() == [0] and len(bundle.load()) == 5
    (bundle.load().df).write.parquet(f"{base}/data/v=9-orphan")
    assert bundle.vacuum() == 1 and len(bundle.load()) == 5


def test_write_back_appends_new_rows(spark):
    a = EntityFrame.from_rows(spark, ["a", "b"], {"v": [1, 2]})
    d = EntityFrame(spark.createDataFrame([(1, "B", 20, 7), (2, "C", 30, 8)], "_pos bigint, object string, v bigint, extra int"))
    assert objs(write_back(a, d), "v", "extra") == [("a", 1, None), ("B", 20, 7), ("C", 30, 8)]


def test_coordinates_follow_their_atoms(spark, tmp_path):
    text = "CC(=O)Oc1ccccc1C(=O)O"
    mol = M.parse(text)
    at = [[float(i), float(a.z), 0.25] for i, a in enumerate(mol.atoms)]
    df = spark.createDataFrame([(0, (text, [at]), "x")], "_pos bigint, object struct<smiles:string,coords:array<array<array<double>>>>, name string")
    write_file(EntityFrame(df, "conformer"), str(tmp_path / "a.sdf"), single=True)
    for hs in (True, False):
        got = read_file(spark, str(tmp_path / "a.sdf"), coords=True, remove_hs=hs)[OBJ, 0]
        assert [c[1] for c in got.coords[0]] == [a.z for a in M.parse(got.smiles).atoms] and sorted(c[0] for c in got.coords[0]) == [c[0] for c in at]
    with pytest.raises(Exception, match="coordinates"):
        write_file(EntityFrame(spark.createDataFrame([(0, ("CCO", [[[0.0, 0.0, 0.0]]]))], df.drop("name").schema), "conformer"), str(tmp_path / "b.sdf"))


def test_hydrogens_and_checks_are_options(spark, tmp_path):
    full = M.add_hydrogens(M.parse("CO"))
    (tmp_path / "h.mol").write_text(write_block(full, "m"))
    assert objs(read_file(spark, str(tmp_path / "h.mol"))) == [("CO",)]
    assert objs(read_file(spark, str(tmp_path / "h.mol"), remove_hs=False))[0][0].count("[H]") == 4
    (tmp_path / "v.smi").write_text("C(C)(C)(C)(C)C five\nCO ok\n")
    assert objs(read_file(spark, str(tmp_path / "v.smi"), "skip"), "name") == [("CO", "ok")]
    assert len(objs(read_file(spark, str(tmp_path / "v.smi"), sanitize=False))) == 2
    for options in ({"sanitise": False}, {"remove_hs": False}):
        with pytest.raises(TypeError, match="options"):
            read_file(spark, str(tmp_path / "v.smi"), **options)
    with pytest.raises(TypeError):
        write_file(read_file(spark, str(tmp_path / "h.mol")), str(tmp_path / "o.smi"), bogus=1)


def test_warnings_count_bad_records(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CO\nbad(\nC\nC1C\n")
    with pytest.warns(UserWarning, match="2 records.*a.smi, record 1"):
        assert [o for o, in objs(read_file(spark, str(tmp_path / "a.smi"), "warn"))] == ["CO", "C"]
    (tmp_path / "b.smi").write_text("CO\n")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        read_file(spark, str(tmp_path / "b.smi"), "warn")


@pytest.mark.parametrize("size", ["64", "4k", "1m"])
def test_records_end_at_lines_of_dollars_only(spark, tmp_path, size):
    one = write_block(M.parse("CO"), "price") + "\n> <note>\ncosts $$$$ 5\n  $$$$ more\n\n$$$$\n"
    for end in ("\n", "\r\n"):
        (tmp_path / "a.sdf").write_bytes((one * 40).replace("\n", end).encode())
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = objs(read_file(spark, str(tmp_path / "a.sdf")), "name", "index", "note")
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == [("CO", "price", k, "costs $$$$ 5\n  $$$$ more") for k in range(40)]


def test_blocks_of_many_atoms(spark, tmp_path):
    for text in ("C" * 1500, "C" * 999 + "[NH3+]", "[13CH3]" + "C" * 5):
        block = write_block(M.parse(text), "long")
        assert block.split("\n")[3].endswith("V3000" if len(text) > 900 else "V2000")
        mol, coords, name = read_block(block)
        assert M.write(mol) == M.write(M.parse(text)) and len(coords) == len(mol) and name == "long"


def test_iterated_batches_cross_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.smi").write_text("".join(f"{'C' * (j + 1)} m{k}{j}\n# no\n" for j in range(4)))
    records = read_records(spark, [str(tmp_path / f"{k}.smi") for k in range(3)])
    got = [b.column("name").to_pylist() for b in iter_batches(records, 5)]
    assert [len(b) for b in got] == [5, 5, 2] and sum(got, []) == [f"m{k}{j}" for k in range(3) for j in range(4)]


def test_text_that_says_nan_is_kept(spark, tmp_path):
    f = EntityFrame.from_rows(spark, ["C", "O"], {"note": ["NaN", "x"], "v": [float("nan"), 1.0]}, kind="molecule")
    props = {r.object: r.properties for r in to_records(f).collect()}
    assert props == {"C": {"note": "NaN"}, "O": {"note": "x", "v": "1.0"}}


def test_commit_checks_types(spark, tmp_path):
    save(EntityFrame.from_rows(spark, ["a"], {"v": [1]}), str(tmp_path / "b"))
    o = Overlay(Bundle(spark, str(tmp_path / "b")))
    o.base = o.base._new(o.base.df.withColumn("v", F.col("v").cast("string")))
    with pytest.raises(ConflictError, match="type of v: bigint"):
        o.commit()


def test_positions_and_properties_come_without_molecules(spark, tmp_path, monkeypatch):
    """Files with blank blocks between and after records are numbered without gaps, by plans that parse no molecule."""
    one = write_block(M.parse("CO"), "a") + "\n> <note>\nx\n\n$$$$\n"
    (tmp_path / "m.sdf").mkdir()
    (tmp_path / "m.sdf" / "part-0.sdf").write_text(one * 3 + "$$$$\n" + one)
    (tmp_path / "m.sdf" / "part-1.sdf").write_text("\n" + one.partition("\n")[2] + one)
    (tmp_path / "s.smi").write_text("# head\nCC\n\nCCC x\n")
    f = read_file(spark, [str(tmp_path / "s.smi"), str(tmp_path / "m.sdf")])
    plan = f.df.select(POS)._jdf.queryExecution().optimizedPlan().toString()
    assert "molecule" not in plan and "Arrow" not in plan and "items" not in plan
    assert [(r[POS], r["index"], r.object, r.note) for r in f.df.orderBy(POS).collect()] == [
        (0, 1, "CC", None), (1, 3, "CCC", None), (2, 0, "CO", "x"), (3, 1, "CO", "x"), (4, 2, "CO", "x"), (5, 4, "CO", "x"), (6, 0, "CO", "x"), (7, 1, "CO", "x")]
    assert objs(f[1:4], "index") == [("CCC", 3), ("CO", 0), ("CO", 1)] and f._ranked is None
    whole = f.df._jdf.queryExecution().executedPlan().toString()
    assert whole.count("molecule(value") <= 1


def test_blocks_of_one_molecule_share_their_text(spark, tmp_path, monkeypatch):
    """Conformers of a molecule differ in coordinates only; the rest of their blocks is made once by a worker."""
    rng = np.random.default_rng(1)
    at = [None if k == 7 else (1e3 * rng.normal(size=(6, 3))).tolist() for k in range(50)]
    kind = pa.list_(pa.list_(pa.float64()))
    calls, whole = [], M.kekulize
    monkeypatch.setattr(M, "kekulize", lambda mol: calls.append(1) or whole(mol))
    batch = lambda rows: pa.record_batch([pa.array(range(len(rows))), pa.array(["c1ccccc1"] * len(rows)), pa.array(["x"] * len(rows)), pa.array(["\n> <a>\n{}\n"] * len(rows)), pa.array(rows, kind)], [POS, "object", "name", "_tail", "coords"])
    out = [t for b in writers._blocks(True)([batch(at).slice(0, 20), batch(at).slice(20)]) for t in b.column("value").to_pylist()]
    assert len(calls) <= 2  # with coordinates and without
    assert out == [write_block(M.parse("c1ccccc1"), "x", a) + "\n> <a>\n{}\n\n$$$$" for a in at]
    assert "".join(f"{v:10.4f}" for v in at[3][5]) in out[3]
    for wrong in ([[0.0] * 3] * 5, [[0.0] * 3] * 5 + [[0.0] * 2], [[0.0] * 3] * 5 + [None]):
        with pytest.raises(M.ChemError):
            list(writers._blocks(True)([batch([at[0], wrong])]))


def test_blocks_of_many_atoms_are_read_in_one_go(spark, monkeypatch):
    """Hydrogens of a block are looked for a fixed number of times, not once for each atom."""
    mol = M.add_hydrogens(M.parse("C" * 60 + "O"))
    at = [[float(i), 0.0, 0.5] for i in range(len(mol))]
    calls, whole = [], M.plain_hydrogens
    monkeypatch.setattr(M, "plain_hydrogens", lambda m: calls.append(1) or whole(m))
    got = readers._parser("sdf", coords=True)(pa.array([write_block(mol, "long", at) + "\n> <a>\nx\n"]))
    assert len(calls) <= 2
    assert got["_error"].to_pylist() == [None] and got["object"][0]["smiles"].as_py() == M.write(M.parse("C" * 60 + "O"))
    assert len(got["object"][0]["coords"].as_py()[0]) == 61


def test_data_items(spark):
    tails = ["", "\n> <a>\nx\n\n> <b> (7)\ny\nz\n\n", "\r\n> 25 <a>\r\nx\r\n\r\n>b\n>  <c>\n\n\n> <a>\nlast\n", "\n> no name\n", " > <a>\nx\n"]
    want = [{}, {"a": "x", "b": "y\nz"}, {"a": "last", "b": "", "c": ""}, {"no name": ""}, {}]
    assert [readers._data_items(t) for t in tails] == want
    maps = readers._item_map(pa.array([f"M  END{t}" for t in tails]))
    assert maps.type == readers.ITEMS and [dict(m) for m in maps.to_pylist()] == want
