import random
import sys
import types

import pytest
from pyspark.sql import functions as F

from loomwright.functions import chemistry, fingerprints, smiles
from tests.test_fingerprints import molblock

GOOD = [
    "C", "CCO", "C=C-C#N", "c1ccccc1", "c1ccc(cc1)-c1ccccc1", "C1CC1(F)Cl", "[NH4+].[Cl-]", "[13CH3]C(=O)[O-]", "N[C@@H](C)C(=O)O", "F/C=C/F", "[Fe+++]", "c1cc2[nH]ccc2cc1", "C%12CCCC%12",
    "CC(C)(C(N)=O)c1ncc(s1)Br", "C1CC2CCC1C2", "[H][H]", "*C", "C12C3C4C1C5C2C3C45", "O=S(=O)(O)c1ccccc1", "[Cu+2]", "C1=CC=CC=C1", "B1OC1", "[se]1cccc1", "C(C)(C)(C)C", "c1ccc2c(c1)cccc2", "CC(=O)Oc1ccccc1C(=O)O",
]
BAD = ["", "C(", "C)", "C1CC", "=C", "C=", "C==C", "C1C1", "CX", "[C", "C11", "(C)", "C=1CC#1", ".=C", "1CC1", "C=(C)"]


def shape(atoms, bonds):
    """What does not change when atoms are numbered anew: every atom with all that is around it, as far as the molecule goes."""
    near = {i: [] for i in range(len(atoms))}
    for a, b, k in bonds:
        near[a].append((b, k))
        near[b].append((a, k))
    now = {i: str(a) for i, a in enumerate(atoms)}
    for _ in atoms:
        now = {i: str(hash((now[i], tuple(sorted((k, now[j]) for j, k in near[i]))))) for i in near}
    return sorted(now.values()), len(bonds)


@pytest.mark.parametrize("text", GOOD)
def test_any_order_of_the_atoms_is_the_same_molecule(text):
    mol = smiles.parse(text)
    rng = random.Random(text)
    written = {smiles.write(*mol)}
    for _ in range(20):
        order = rng.sample(range(len(mol[0])), len(mol[0]))
        written.add(smiles.write(*mol, order))
    assert all(shape(*smiles.parse(w)) == shape(*mol) for w in written)
    assert all(chemistry.is_well_formed(w) for w in written)


def test_what_is_read():
    assert smiles.parse("C[N+](=O)[O-]") == ([("C", 0, False, None, None), ("N", 1, False, 0, None), ("O", 0, False, None, None), ("O", -1, False, 0, None)], [(0, 1, 1), (1, 2, 2), (1, 3, 1)])
    assert smiles.write(*smiles.parse("OCC")) == "OCC" and smiles.write(*smiles.parse("c1ccccc1-c1ccccc1")) == "c1ccccc1-c1ccccc1"
    assert shape(*smiles.parse("c1ccccc1")) != shape(*smiles.parse("C1=CC=CC=C1")) and shape(*smiles.parse("CCO")) != shape(*smiles.parse("COC"))
    for text in BAD:
        with pytest.raises(ValueError):
            smiles.parse(text)
    ring = "C1" + "C" * 150 + "1"
    assert shape(*smiles.parse(smiles.write(*smiles.parse(ring)))) == shape(*smiles.parse(ring))


def test_columns(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*GOOD, "C(", None, ""])], "k int, s string")
    read = df.select("k", "s", smiles.read("s").alias("m"))
    assert read.where("m.atoms is null").count() == 3
    got = read.select("s", smiles.written(F.col("m")).alias("own"), smiles.written(F.col("m"), F.col("k"), 1).alias("drawn"), smiles.written(F.col("m"), F.col("k"), 1).alias("again"), smiles.written(F.col("m"), F.col("k"), 2).alias("other")).collect()
    for r in got[:-3]:
        assert shape(*smiles.parse(r.own)) == shape(*smiles.parse(r.drawn)) == shape(*smiles.parse(r.s))
    assert all(r.drawn == r.again for r in got) and any(r.drawn != r.other for r in got) and [r.own for r in got[-3:]] == [None] * 3
    prints = fingerprints.with_fingerprint(read.where("m.atoms is not null"), "m")
    anew = fingerprints.with_fingerprint(read.where("m.atoms is not null").select("k", smiles.read(smiles.written(F.col("m"), F.col("k"), 5)).alias("m")), "m")
    assert prints.select("k", "fingerprint").exceptAll(anew.select("k", "fingerprint")).count() == 0


def test_molfiles_and_toolkit_functions(spark):
    if chemistry.Chem is not None:
        pytest.skip("the toolkit is installed")
    blocks = [molblock([("C", 0), ("C", 0), ("O", 5)], [(1, 2, 1), (2, 3, 1)]), "no molfile", molblock([("C", 0)] * 6, [(i + 1, (i + 1) % 6 + 1, 4) for i in range(6)])]
    df = spark.createDataFrame(list(enumerate(blocks)), "row_idx int, molblock string")
    assert sorted(map(tuple, chemistry.sdf_to_smiles(df, "m").collect())) == [("m0", "CC[O-]"), ("m2", "c1ccccc1")]
    two = spark.createDataFrame([("N[C@@H](C)O", 1), ("C(", 2)], "s string, k int")
    assert [r[0] for r in two.select(chemistry.plain_smiles(F.col("s"))).collect()] == ["N[CH](C)O", None]
    drawn = [r[0] for r in two.select(chemistry.shuffled_smiles(F.col("s"), F.col("k"))).collect()]
    assert shape(*smiles.parse(drawn[0])) == shape(*smiles.parse("N[CH](C)O")) and drawn[1] is None


class _Stand(types.ModuleType):
    """Stands in for the toolkits: a molecule is its SMILES in capitals, an order turns it round."""

    @staticmethod
    def MolFromSmiles(s, sanitize=True):
        return None if "!" in s and sanitize else list(s)

    @staticmethod
    def MolToSmiles(m, canonical=True):
        return "".join(sorted(m) if canonical else m)

    @staticmethod
    def RenumberAtoms(m, order):
        return [m[i] for i in order]

    @staticmethod
    def MolFromMolBlock(s):
        return None if s == "bad" else list(s)

    @staticmethod
    def encoder(s):
        return f"[{s}]"

    @staticmethod
    def decoder(s):
        return s[1:-1]


class _Mol(list):
    def GetNumAtoms(self):
        return len(self)


def test_toolkits_are_called(spark, monkeypatch):
    """The paths that need a package, with stand-ins, as neither package is installed here."""
    stand = _Stand("stand")
    stand.MolFromSmiles = lambda s, sanitize=True: None if "!" in s and sanitize else _Mol(s)
    monkeypatch.setitem(sys.modules, "stand", stand)
    monkeypatch.setattr(chemistry, "Chem", stand)
    monkeypatch.setattr(chemistry, "selfies", stand)
    made = {}
    monkeypatch.setattr(chemistry.F, "pandas_udf", lambda kind: lambda f: lambda *c: made.setdefault(f.__name__, f) and F.lit(None))
    import pandas as pd

    values = pd.Series(["ba", "x!", None])
    chemistry.plain_smiles(F.lit("s"), canonical=True)
    assert made.pop("convert")(values).tolist() == ["ab", None, None]
    chemistry.plain_smiles(F.lit("s"), sanitize=False)
    assert made.pop("convert")(values).tolist() == ["ba", "x!", None]
    chemistry.shuffled_smiles(F.lit("s"), F.lit("k"))
    drawn = made.pop("convert")(pd.Series(["abcdef", "x!"]), pd.Series([7, 7])).tolist()
    assert sorted(drawn[0]) == list("abcdef") and drawn[1] is None
    chemistry.to_selfies(F.lit("s"))
    assert made.pop("convert")(values).tolist() == ["[ba]", "[x!]", None]
    chemistry.from_selfies(F.lit("s"))
    assert made.pop("convert")(pd.Series(["[ba]", None])).tolist() == ["ba", None]
