import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import chemistry, sequences as Q, tables, tokenizers
from loomwright.operators import clusters, geometry, metrics
from loomwright.sources import structures, text
from tests.test_sources import FASTA, atom, put

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def test_smiles(spark):
    good, bad = ["CCO", "c1ccccc1", "C(C)(C)O", "[NH4+]", "C%12CC%12", "C1CC1C1CC1"], ["C(C", "c1ccccc", "C)", "[NH4", "C]", "", "C C"]
    assert [chemistry.is_well_formed(s) for s in good + bad] == [True] * len(good) + [False] * len(bad)
    df = spark.createDataFrame([(s,) for s in [*good, *bad, None]], "s string")
    assert chemistry.sanitizable_lines(df, "s").count() == len(good)
    if chemistry.Chem is None:
        with pytest.raises(ImportError):
            chemistry.canonical_smiles(F.col("s"))


def test_tokenizer_files(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("a " * 40,)], "t string")
    rows = df.select(tokenizers.json_tokenizer(VOCABULARY, 16)("t").alias("e")).collect()
    assert all(len(r.e.ids) == len(r.e.mask) == 16 for r in rows) and sum(rows[0].e.mask) == 2 and rows[2].e.overflow > 0
    pieces = {"[UNK]": 0, "play": 1, "##ing": 2, "un": 3}
    got = spark.createDataFrame([("playing un xyz",)], "t string").select(tokenizers.wordpiece_tokenizer(pieces)("t").alias("e")).first().e
    assert got.ids == [1, 2, 3, 0]
    assert tokenizers.top_token(pieces) == ("un", 3) and tokenizers.sentinel_range({"<SENTINEL_ID_5>": 1, "<SENTINEL_ID_9>": 2, "x": 3}) == (5, 9)
    with pytest.raises(ValueError):
        tokenizers.sentinel_range(pieces)


def test_weight_and_vectors(spark):
    df = spark.createDataFrame([("GG",), ("GZ",), (None,)], "s string")
    got = [r.w for r in df.select(Q.molecular_weight(F.col("s"), False).alias("w")).collect()]
    assert abs(got[0] - 132.119) < 0.01 and got[1:] == [None, None]
    mixed = spark.range(1).select(Q.mix_vectors(F.array(F.array(F.lit(1.0))), F.array(F.array(F.lit(3.0))), F.col("id"), 1.0, 0.5).alias("v")).first().v
    assert mixed == [[2.0]]


def test_flexible_superposition(spark):
    rng = np.random.default_rng(2)
    seq = "".join(rng.choice(list(Q.RESIDUES), 40))
    xyz = rng.normal(size=(40, 3)) * 5
    a = spark.createDataFrame([(1, i, c, *map(float, p)) for i, (c, p) in enumerate(zip(seq, xyz, strict=True))], "c int, i int, l string, x double, y double, z double")
    cut = spark.createDataFrame([(1, i, seq[i + 10], *map(float, xyz[i + 10] + 7)) for i in range(30)], "c int, i int, l string, x double, y double, z double")
    fit = geometry.flexible_superpose(a, cut, "c", "i", "l", gap=-1.0, mismatch=-1.0).first()
    assert fit.n >= 25 and fit.rmsd < 1e-6 and np.allclose(fit["shift"], 7)


def test_index_and_labels(spark, tmp_path):
    path = put(tmp_path / "p.fasta", FASTA + ">P1 again\nWWW\n")
    index = text.write_index(text.read_fasta(spark, path), str(tmp_path / "index"))
    assert text.read_key(index, "P1").first().sequence == "MKVLLA" and text.read_key(index, "P9").count() == 0
    both = text.read_labelled_fasta(spark, {path: {"amp": 1}, put(tmp_path / "q.fasta", ">Z\nAA\n"): {"toxic": 0}})
    assert {(r.amp, r.toxic) for r in both.collect()} == {(1, None), (None, 0)}


def test_structure_extras(spark, tmp_path):
    lines = [atom(1, " CA", "GLY", "A", 1, 1.0), atom(2, " CA", "ALA", "A", 2, 2.0), atom(3, " CB", "ALA", "A", 2, 3.0), atom(4, " O5'", "HOH", "B", 1, 4.0, "HETATM")]
    atoms = structures.read_pdb(spark, put(tmp_path / "e1.pdb", "\n".join(lines)))
    assert {r.serial for r in structures.pseudo_beta(atoms).collect()} == {1, 3}
    structures.write_mmcif(atoms, str(tmp_path / "cif"))
    import glob
    import shutil

    shutil.copy(glob.glob(f"{tmp_path}/cif/entry=e1/*.txt")[0], tmp_path / "e1.cif")
    again = structures.read_mmcif(spark, str(tmp_path / "e1.cif"))
    keep = ["serial", "model", "chain_id", "res_seq", "res_name", "atom_name", "x", "y", "z", "hetero"]
    assert sorted(map(tuple, again.select(keep).collect())) == sorted(map(tuple, atoms.select(keep).collect()))
    put(tmp_path / "n.txt", "# c\nH 1 E\nH 2 -\nH 3 V\nL 1 D\n")
    got = structures.numbered_domains(text.read_lines(spark, str(tmp_path / "n.txt")).withColumn("file", F.lit("n"))).first()
    assert (got.heavy, got.light) == ("EV", "D")


def test_toolkits_are_optional():
    for module, make in ((chemistry.Chem, lambda: chemistry.canonical_smiles("s")), (chemistry.Chem, lambda: chemistry.plain_smiles("s", canonical=True)), (chemistry.selfies, lambda: chemistry.to_selfies("s")), (chemistry.selfies, lambda: chemistry.from_selfies("s"))):
        if module is None:
            with pytest.raises(ImportError):
                make()


def test_tokenizer_components(spark):
    def lower():
        from tokenizers.normalizers import Lowercase

        return Lowercase()

    df = spark.createDataFrame([("Hello",), ("hello",)], "t string")
    encode = lambda **c: [r.e.ids for r in df.select(tokenizers.json_tokenizer(VOCABULARY, **c)("t").alias("e")).collect()]
    plain, lowered = encode(), encode(normalizer=lower)
    assert plain[0] != plain[1] and lowered[0] == lowered[1] == plain[1]
    with pytest.raises(ValueError):
        tokenizers.json_tokenizer(VOCABULARY, model=lower)


def test_kmer_table_function(spark):
    tables.register(spark)
    spark.createDataFrame([("abcd",), ("ab",), ("",), (None,)], "s string").createOrReplaceTempView("words_of_kmers")
    rows = spark.sql("SELECT place, kmer FROM words_of_kmers, LATERAL kmers(s, 3)").collect()
    assert sorted(map(tuple, rows)) == [(0, "abc"), (1, "bcd")]


def test_identity_against_every_shift():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("ACé𝒟"), rng.integers(0, 9))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        want = max(sum(x == y for x, y in zip(short, long[i:])) for i in range(len(long) - len(short) + 1)) / len(short) if short else 0.0
        assert clusters._same_letters(a, b) == want


def test_mean_discrepancy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(300, 4)), rng.normal(3, 1, (200, 4))
    make = lambda x: spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "z array<double>")
    got = metrics.mean_discrepancy(make(a), make(b), "z", 4, sigma=2.0, features=4000).first().mmd
    kernel = lambda x, y: np.exp(-((x[:, None] - y) ** 2).sum(axis=2) / 8).mean()
    assert abs(got - (kernel(a, a) + kernel(b, b) - 2 * kernel(a, b))) < 0.05
    assert metrics.mean_discrepancy(make(a), make(a), "z", 4).first().mmd == 0
    assert metrics.mean_discrepancy(make(a), make(a[:0]), "z", 4).first().mmd is None
