import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.functions import chem
from retort.functions.chem import fingerprints as fp
from retort.functions.chem import mol as M
from retort.functions.chem import props as P
from retort.functions.chem.smarts import Pattern

KNOWN = [
    "c1ccccc1", "CCO", "O=C(O)c1ccccc1OC(C)=O", "c1ccc2ccccc2c1", "[nH]1cccc1", "n1ccccc1", "C[N+](C)(C)C", "[Na+].[Cl-]", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "c1ccc2[nH]ccc2c1",
    "CC(C)Cc1ccc(cc1)C(C)C(=O)O", "C1CC1", "C#N", "c1ccsc1", "C1=CC2=CC=CC2=CC=C1", "CCCCCCCCCCCCCCCC(=O)O", "[13CH4]", "F/C=C/F", "N[C@@H](C)C(=O)O", "C%12CCCC%12", "O=S(=O)(N)c1ccc(N)cc1", "F/C=C\\F", "C/C=C/C=C\\C", "O[C@H](C(=O)O)[C@@H](O)C(=O)O",
    "C[C@@](F)(Cl)Br", "OC[C@H]1O[C@@H](O)[C@H](O)[C@@H](O)[C@@H]1O", "CC/C(C)=C(/C)CC", "N/C(C)=C\\C(=O)O", "C[C@H](N)C(=O)N[C@@H](CO)C(=O)O", "C[S@](=O)CC", "[2H][C@H](C)O", "CC(/C=C/Cl)=C(F)\\C=C\\Br",
]


@pytest.mark.parametrize("smiles", KNOWN)
def test_canonical_form_ignores_the_order_of_atoms(smiles):
    mol = M.perceive(M.parse(smiles))
    want = M.write(mol)
    assert M.canonical(want) == want
    rng = random.Random(smiles)
    for _ in range(6):
        p = list(range(len(mol)))
        rng.shuffle(p)
        assert M.write(mol.part(p)) == want
        assert M.canonical(M.write(mol, p)) == want


def test_equal_molecules_have_one_form():
    for group in (["C1=CC=CC=C1", "c1ccccc1"], ["OCC", "CCO", "C(O)C"], ["C1=CC=CN1", "c1cc[nH]c1"], ["c1ccc2c(c1)cccc2", "C1=CC=C2C=CC=CC2=C1"]):
        assert len({M.canonical(s) for s in group}) == 1


def test_stereochemistry_tells_molecules_apart():
    alike = [
        ["N[C@@H](C)C(=O)O", "C[C@H](N)C(=O)O", "OC(=O)[C@@H](N)C", "[C@H](N)(C)C(=O)O", "[H][C@](N)(C)C(=O)O"], ["N[C@H](C)C(=O)O", "C[C@@H](N)C(=O)O"], ["NC(C)C(=O)O"], ["F/C=C/F", "F\\C=C\\F", "C(\\F)=C/F"],
        ["F/C=C\\F", "F\\C=C/F"], ["FC=CF"], ["O[C@H](C(=O)O)[C@@H](O)C(=O)O", "O[C@@H](C(=O)O)[C@H](O)C(=O)O"], ["O[C@H](C(=O)O)[C@H](O)C(=O)O"], ["O[C@@H](C(=O)O)[C@@H](O)C(=O)O"],
        ["CC(C)O", "C[C@H](C)O"], ["CC(C)=CC", "C/C(C)=C/C"], ["C1C[C@H](O)OC1", "O1CCC[C@@H]1O"],
    ]
    forms = [{M.write(M.remove_hydrogens(M.perceive(M.parse(s)))) for s in group} for group in alike]
    assert all(len(f) == 1 for f in forms) and len(set().union(*forms)) == len(alike)
    for s in ("N[C@@H](C)C(=O)O", "C[C@@](F)(Cl)Br", "F/C=C\\F"):
        m = M.parse(s)
        assert M.write(M.remove_hydrogens(M.add_hydrogens(m))) == M.write(m)


@pytest.mark.parametrize("bad", ["C1CC", "C(", "C)", "[Xx]", "c1cccc1", "xyz", "C==", "1CC"])
def test_unreadable(bad):
    with pytest.raises(ValueError):
        M.perceive(M.parse(bad))


def test_sanity():
    for bad in ("C(C)(C)(C)(C)C", "O(C)(C)C", "F(C)C"):
        with pytest.raises(M.ChemError):
            M.sanitize(M.parse(bad))
    assert M.write(M.sanitize(M.parse("C[N+](C)(C)C"))) == "C[N+](C)(C)C"


def of(smiles, f):
    return f(M.perceive(M.parse(smiles)))


def test_masses_and_counts():
    aspirin = "CC(=O)Oc1ccccc1C(=O)O"
    assert of(aspirin, P.formula) == "C9H8O4" and of(aspirin, P.average_mass) == pytest.approx(180.16, abs=0.01)
    assert of(aspirin, P.exact_mass) == pytest.approx(180.0423, abs=1e-3) and of(aspirin, P.tpsa) == pytest.approx(63.6)
    assert (of(aspirin, P.donors), of(aspirin, P.acceptors), of(aspirin, P.rotatable)) == (1, 3, 3)
    assert of("Cc1ccccc1", P.logp) == pytest.approx(1.995, abs=0.01) and of("c1ccccc1", P.logp) == pytest.approx(1.687, abs=0.01)
    assert of("CCCCCCCCCCCCCCCC(=O)O", P.lipinski_violations) == 1
    assert len(M.add_hydrogens(M.parse("C"))) == 5 and M.write(M.remove_hydrogens(M.add_hydrogens(M.parse("CCO")))) == "CCO"
    assert of("c1ccccc1.Cl", lambda m: M.write(M.largest_fragment(m))) == "c1ccccc1"


@pytest.mark.parametrize(
    "smiles,value",
    [("CC(=O)Oc1ccccc1C(=O)O", 1.3101), ("c1ccccc1", 1.6866), ("CCO", -0.0014), ("CN1C=NC2=C1C(=O)N(C(=O)N2C)C", -1.0293), ("CC(C)Cc1ccc(cc1)C(C)C(=O)O", 3.0732), ("CC(=O)O", 0.0909), ("CC(=O)Nc1ccc(O)cc1", 1.3506),
     ("Oc1ccccc1", 1.3922), ("Nc1ccccc1", 1.2688), ("c1ccncc1", 1.0816), ("O=[N+]([O-])c1ccccc1", 1.5948), ("c1ccc2ccccc2c1", 2.8398), ("C", 0.6361), ("O", -0.8247), ("COc1ccccc1", 1.6952), ("Clc1ccccc1", 2.34)],
)
def test_logp_equals_published_values(smiles, value):
    assert of(smiles, P.logp) == pytest.approx(value, abs=6e-4)


@pytest.mark.parametrize(
    "name,smiles,value",
    [("MolMR", "c1ccccc1", 26.442), ("Chi0", "CCCC", 3.4142), ("Chi1", "CCCC", 1.9142), ("Chi1v", "CCO", 1.0233), ("Chi0v", "c1ccccc1", 3.4641), ("Kappa1", "CCCCCC", 6.0), ("Kappa2", "CCCCCC", 5.0), ("HallKierAlpha", "c1ccccc1", -0.78),
     ("BalabanJ", "CCCC", 1.9747), ("NumValenceElectrons", "CCO", 20), ("NumSpiroAtoms", "C1CCC2(C1)CCCC2", 1), ("NumBridgeheadAtoms", "C1CC2CCC1C2", 2), ("FractionCSP3", "CC=O", 0.5), ("fr_benzene", "c1ccc2ccccc2c1", 2), ("fr_amide", "CC(=O)NC", 1),
     ("fr_ester", "CC(=O)OC", 1), ("fr_nitro", "C[N+](=O)[O-]", 1), ("NumSaturatedHeterocycles", "C1CCOC1", 1), ("NumAliphaticCarbocycles", "C1CCCC1", 1), ("NumAromaticHeterocycles", "c1ccncc1", 1)],
)
def test_descriptors_equal_known_values(name, smiles, value):
    assert of(smiles, P.DESCRIPTORS[name]) == pytest.approx(value, abs=2e-3)


@pytest.mark.parametrize("smiles", [*KNOWN, "", "[H][H]", "*"])
def test_every_descriptor_has_a_value(smiles):
    assert len(P.DESCRIPTORS) > 100 and all(math.isfinite(f(M.perceive(M.parse(smiles)))) for f in P.DESCRIPTORS.values())


@pytest.mark.parametrize(
    "smarts,smiles,n",
    [("[OX2H]", "CCO", 1), ("[OX2H]", "COC", 0), ("C(=O)[OH]", "CC(=O)O", 1), ("c1ccccc1", "c1ccc2ccccc2c1", 2), ("[#6]-!@[#6]", "CC1CC1", 1), ("[$(C=O)]", "CC(=O)C", 1), ("[NX3;H2]", "CCN", 1), ("[!#6]", "CCO", 1),
     ("[C,N]", "CN", 2), ("[R]", "C1CC1C", 3), ("[r3]", "C1CC1C", 3), ("C~O", "C=O", 1), ("[+1]", "[NH4+]", 1), ("a", "c1ccccc1", 6), ("[CH3]", "CCC", 2), ("[Cl,Br]", "CCl", 1), ("[D1]", "CC(C)C", 3), ("C.C", "CC", 1)],
)
def test_patterns(smarts, smiles, n):
    assert Pattern(smarts).count(M.perceive(M.parse(smiles))) == n


def test_fingerprints():
    a, b = (M.perceive(M.parse(s)) for s in ("CCO", "OCC"))
    assert np.array_equal(fp.circular(a), fp.circular(b)) and len(fp.circular(a)) == 2048
    big = M.perceive(M.parse(KNOWN[2]))
    assert all(fp.circular(big, 2, 4096)[np.flatnonzero(fp.circular(big, 1, 4096))])
    keys = fp.structural_keys(big)
    assert len(keys) == 167 and keys[0] == 0 and keys[162] and keys[163] and keys[164] and not keys[161]
    assert len(fp.pharmacophore(big)) == fp.native_length()
    bits = np.array([1, 0, 1, 1, 0], np.int8)
    assert fp.fold(bits, 2, "xor").tolist() == [0, 1] and fp.fold(bits, 2, "or").tolist() == [1, 1]
    with pytest.raises(ValueError):
        fp.fold(bits, 2, "and")


@pytest.mark.parametrize("smiles", KNOWN)
def test_fingerprints_ignore_the_order_of_atoms(smiles):
    mol = M.perceive(M.parse(smiles))
    rng = random.Random(smiles)
    for _ in range(4):
        p = list(range(len(mol)))
        rng.shuffle(p)
        other = mol.part(p)
        assert all(np.array_equal(f(mol), f(other)) for f in (fp.circular, fp.structural_keys, fp.pharmacophore))


def test_columns(spark):
    df = spark.createDataFrame([(0, "OCC"), (1, None), (2, "bad("), (3, ""), (4, "OCC")], "k int, s string")
    c = F.col("s")
    got = df.select("k", chem.n_atoms(c).alias("n"), chem.canonical_smiles(c).alias("c"), chem.descriptors(c)["MolWt"].alias("w"), chem.morgan(c, 2, 64).alias("f"), chem.desalted(c).alias("d"), chem.substructure_hits(c, ["[OX2H]"]).alias("h")).orderBy("k").collect()
    assert [r.n for r in got] == [3, None, None, 0, 3] and [r.c for r in got] == ["CCO", None, None, "", "CCO"]
    assert got[0].w == pytest.approx(46.07, abs=0.01) and got[1].w != got[1].w and got[0].f == got[4].f and got[1].f == [0] * 64
    assert got[2].d == "bad(" and got[0].h == [True] and got[1].h is None
    with pytest.raises(ValueError):
        chem.descriptors(c, ["None"])
    bits = spark.createDataFrame([([1, 0, 1, 1, 0],)], "b array<int>")
    assert bits.select(chem.fold_bits(F.col("b"), 5, 2, "xor"), chem.fold_bits(F.col("b"), 5, 2, "or")).first()[:] == ([0, 1], [1, 1])


def _plain_pharmacophore(m):
    """Pairs and triples of all points by plain loops."""
    from itertools import combinations, combinations_with_replacement, permutations

    names, k = sorted(fp.FEATURES), len(fp.BINS)
    points = sorted({(f, x[0]) for f, n in enumerate(names) for x in Pattern(fp.FEATURES[n]).matches(m)})
    far = {}
    for a in {a for _, a in points}:
        far[a], todo = {a: 0}, [a]
        for x in todo:
            todo += [y for y in m.near[x] if y not in far[a] and not far[a].update({y: far[a][x] + 1})]
    at = lambda a, b: next((i for i, (lo, hi) in enumerate(fp.BINS) if lo <= far[a].get(b, -1) < hi), None)
    twos, threes = (list(combinations_with_replacement(range(len(names)), r)) for r in (2, 3))
    twos, threes = ({p: i for i, p in enumerate(t)} for t in (twos, threes))
    out = np.zeros(fp.native_length(), np.int8)
    for (f, a), (g, b) in combinations(points, 2):
        if (x := at(a, b)) is not None:
            out[twos[f, g] * k + x] = 1
    for triple in combinations(points, 3):
        (f, a), (g, b), (h, c) = min(permutations(triple), key=lambda t: ([p[0] for p in t], [at(t[i][1], t[j][1]) or 0 for i, j in ((0, 1), (0, 2), (1, 2))]))
        x = (at(a, b), at(a, c), at(b, c))
        if None not in x:
            out[len(twos) * k + threes[f, g, h] * k**3 + x[0] * k * k + x[1] * k + x[2]] = 1
    return out, len(points)


@pytest.mark.parametrize("block", [2, 256])
def test_triples_are_of_all_points(block, monkeypatch):
    monkeypatch.setattr(fp, "POINT_BLOCK", block)
    large = "c1ccc(cc1)c1ccc(cc1)c1ccc(nc1)CCCC(C)CCc1ccc(cc1)C(=O)NCCc1ccccc1Cl"
    sizes = []
    for s in (*KNOWN[:12], "C", large):
        m = M.perceive(M.parse(s))
        want, n = _plain_pharmacophore(m)
        assert np.array_equal(fp.pharmacophore(m), want), s
        sizes.append(n)
    assert max(sizes) > 60


def test_fingerprints_are_kept_by_the_worker_and_packed(spark, monkeypatch):
    calls = []
    monkeypatch.setitem(chem._BITS, "gobbi", lambda m, n_bits, how: calls.append(n_bits) or fp.fold(fp.pharmacophore(m), n_bits, how))
    chem._packed.cache_clear()
    assert len({chem._packed("gobbi", (256, "xor"), "c1ccccc1CO") for _ in range(3)}) == 1 and calls == [256]
    chem._packed.cache_clear()
    df = spark.createDataFrame([(0, "c1ccccc1CO"), (1, None), (2, "bad("), (3, "c1ccccc1CO")], "k int, s string")
    for kind, width in ((chem.morgan, 2048), (chem.maccs, 167), (chem.gobbi, 2048)):
        out = df.select("k", kind(F.col("s")).alias("bits"), kind(F.col("s"), packed=True).alias("packed")).orderBy("k")
        assert not out.schema["bits"].dataType.containsNull
        rows = out.collect()
        assert all(len(r.bits) == width and np.unpackbits(np.frombuffer(r.packed, np.uint8), count=width).tolist() == r.bits for r in rows)
        assert [any(r.bits) for r in rows] == [True, False, False, True] and rows[0].bits == rows[3].bits
