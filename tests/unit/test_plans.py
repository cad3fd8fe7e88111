import os
import subprocess
import sys
import warnings

import pandas as pd
import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from retort import EntityFrame
from retort.index import POS
from retort.plans import (
    BatchFunction, CatalogFilter, ConformerGenerator, Desalter, DescriptorFeaturizer, ElementFilter, FileSource, FunctionFeaturizer, FunctionFilter, FunctionPreparation, GobbiFeaturizer, HydrogenModifier, Kekulizer, MACCSFeaturizer,
    MemorySource, MorganFeaturizer, MWFilter, Pipeline, PropertyFilter, RuleOfFiveFilter, Sampler, Sanitizer, SMARTSFilter, TautomerCanonicalizer, UniqueFilter, ValidityFilter,
)
from retort.plans.blocks import register_catalog
from retort.plans.pipeline import ordered


@pytest.fixture
def mols(spark):
    aspirin = "CC(=O)Oc1ccccc1C(=O)O"
    s = [aspirin, "c1ccccc1.Cl", "OC1=CCCC1", "C", "[Na+].[Cl-]", "", None, "C1=CC=CC=C1"]
    return EntityFrame.from_rows(spark, s, {"name": list("abcdefgh")}, kind="molecule")


def left(frame):
    return [r[0] for r in frame.df.select(POS).orderBy(POS).collect()]


def test_filters(mols):
    run = lambda b: left(b.run(mols))
    assert run(ValidityFilter()) == [0, 1, 2, 3, 4, 7]
    assert run(ElementFilter()) == [0, 1, 2, 3, 5, 7] and run(MWFilter(100)) == [2, 3, 4, 5, 7]
    assert run(PropertyFilter()) == [0, 1, 2, 3, 4, 5, 7] and run(PropertyFilter(min_mw=78, max_mw=120)) == [1, 2, 7]
    assert run(RuleOfFiveFilter()) == [0, 1, 2, 3, 4, 7]
    assert run(SMARTSFilter("c1ccccc1", exclude=False)) == [0, 1, 7] and run(SMARTSFilter("c1ccccc1")) == [2, 3, 4, 5]
    assert run(UniqueFilter()) == [0, 1, 2, 3, 4, 5, 7]
    register_catalog("acids", [("acid", "C(=O)[OH]")])
    assert run(CatalogFilter(["acids"])) == [1, 2, 3, 4, 5, 7]


def test_unique_state(mols):
    block = UniqueFilter(auto_reset=False)
    assert left(block.run(mols[0:4])) == [0, 1, 2, 3] and left(block.run(mols)) == [4, 5, 7]
    block.reset()
    assert left(block.run(mols)) == [0, 1, 2, 3, 4, 5, 7]


def test_errors(mols):
    for make in (lambda: SMARTSFilter([]), lambda: SMARTSFilter("C("), lambda: SMARTSFilter("C", min_matches=2), lambda: RuleOfFiveFilter(-1), lambda: GobbiFeaturizer(fold_method="x"), lambda: Sampler(0), lambda: MemorySource(None, True), lambda: ConformerGenerator(ff="X"), lambda: UniqueFilter("x")):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(ValueError):
        CatalogFilter(["nothing"]).run(mols)
    with pytest.raises(NotImplementedError):
        CatalogFilter(["PAINS"]).run(mols)
    for b in (TautomerCanonicalizer(), ConformerGenerator()):
        with pytest.raises(NotImplementedError):
            b.run(mols)
    with pytest.raises(TypeError):
        Pipeline(["x"])
    with pytest.raises(ValueError):
        Pipeline([ValidityFilter()]).run()


def test_featurizers(mols):
    out = Pipeline([MorganFeaturizer(n_bits=128), MACCSFeaturizer(), DescriptorFeaturizer(["MolWt", "TPSA"]), GobbiFeaturizer(256)]).run(mols)
    assert out.feature_names[0] == "MorganFeaturizer_radius=2_n_bits=128" and [out.feature_shape(n)[1] for n in out.feature_names] == [128, 167, 2, 256]
    row = out.df.orderBy(POS).collect()
    assert row[6]["f__MACCSFeaturizer"] == [0] * 167 and row[5][f"f__{out.feature_names[2]}"] == [0.0, 0.0]


def test_preparations(mols):
    texts = lambda b: [r[0] for r in b.run(mols).df.orderBy(POS).select("object").collect()]
    assert texts(Desalter())[1] == "c1ccccc1" and texts(Kekulizer())[7].count("=") == 3 and texts(Sanitizer())[7] == "c1ccccc1"
    assert texts(HydrogenModifier())[3].count("[H]") == 4 and texts(Desalter())[6] is None


def test_functions(mols):
    def long(s):
        return s.str.len() > 5

    def native(c: Column) -> Column:
        return F.length(c) > 5

    assert left(FunctionFilter(long).run(mols)) == left(FunctionFilter(native).run(mols)) == [0, 1, 2, 4, 7]
    f = FunctionFeaturizer(lambda s: pd.Series([[1.0, 2.0]] * len(s))).run(mols)
    assert len(f.feature_names) == 1 and f.feature_names[0].startswith("lambda_")
    assert FunctionPreparation(lambda s: s + "C", "add").run(mols).df.orderBy(POS).first()["object"].endswith("C")


def test_pipeline_keeps_pending_edits_and_audits(mols):
    out = Pipeline([ValidityFilter(), MorganFeaturizer(n_bits=16), MWFilter(120.0)]).run(mols, audit=True)
    assert out.feature_names and [(h.block_name, h.rows_in, h.rows_out) for h in out.history] == [("ValidityFilter", 8, 6), ("MorganFeaturizer", 6, 6), ("MWFilter", 6, 5)]
    assert Pipeline().run(mols) is mols
    whole, parts = Pipeline([ValidityFilter()]).run(mols), Pipeline([ValidityFilter()]).run_batches(mols, 3)
    assert sorted(r.name for r in whole.df.collect()) == sorted(r.name for r in parts.df.collect())
    assert Pipeline([MWFilter(0.5), ValidityFilter()]).run_batches(mols, 3).df.columns == mols.df.columns


def test_sources(spark, mols, tmp_path):
    (tmp_path / "a.smi").write_text("CCCCCC hexane\nCO methanol\n# note\n\nCCN ethylamine\nC=C ethene\n")
    out = Pipeline([FileSource(spark, str(tmp_path / "a.smi")), MWFilter(50.0)]).run()
    assert sorted(r.name for r in out.df.collect()) == ["ethene", "ethylamine", "methanol"]
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert len(Pipeline([MemorySource(mols), Sampler(3, 1)]).run(mols)) == 3
        assert any("ignores" in str(x.message) for x in w)


def test_native_filters_go_first():
    def native(c: Column) -> Column:
        return F.length(c) > 5

    slow, fast = MWFilter(1.0), FunctionFilter(native)
    assert fast.native and not slow.native and not FunctionFilter(lambda s: s.str.len() > 5).native
    assert ordered([slow, fast, UniqueFilter(), slow, fast])[:2] == [fast, slow]


def test_lambda_names_are_those_of_every_process():
    code = "from retort.plans import FunctionFeaturizer as F; print(F(lambda s: s.str.len() + 7).feature_name)"
    names = {subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env={**os.environ, "PYTHONHASHSEED": seed}).stdout.strip() for seed in ("1", "2")}
    assert len(names) == 1 and names.pop().startswith("lambda_")


def test_batch_functions_see_whole_batches(mols):
    def sized(rows):
        return rows.assign(size=len(rows))

    out = Pipeline([ValidityFilter(), BatchFunction(sized, "_pos bigint, object string, name string, size bigint")]).run_batches(mols, 4)
    assert [(r.name, r["size"]) for r in out.df.orderBy(POS).collect()] == [("a", 4), ("b", 4), ("c", 4), ("d", 4), ("e", 2), ("h", 2)]
    with pytest.raises(ValueError):
        BatchFunction(sized, "x int", 0)


@pytest.mark.parametrize("block, kernel", [(GobbiFeaturizer(64), ("gobbi", 64, "xor")), (MorganFeaturizer(n_bits=64), ("morgan", 2, 64))])
def test_featurizers_deal_rows_of_few_splits_to_tasks(spark, tmp_path, block, kernel):
    from retort.functions import chem

    smiles = ["C" * (k % 5 + 1) for k in range(40)]
    EntityFrame.from_rows(spark, smiles, kind="molecule").df.coalesce(1).write.parquet(str(tmp_path / "one"))
    scan = EntityFrame(spark.read.parquet(str(tmp_path / "one")), "molecule")
    out = block.run(scan)
    assert out.df._jdf.queryExecution().analyzed().toString().count("RepartitionByExpression") == 1
    again = block.run(out).df._jdf.queryExecution().analyzed().toString()
    assert again.count("RepartitionByExpression") == 1  # dealt once
    assert {r._pos: (r.object, r[-1]) for r in out.df.collect()} == {k: (s, chem._BITS[kernel[0]](chem.read(s), *kernel[1:]).tolist()) for k, s in enumerate(smiles)}
