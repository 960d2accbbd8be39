import hashlib
import random

from pyspark.sql import functions as F

from loomwright.functions import fingerprints as fp
from loomwright.sources import text


def molblock(atoms, bonds, charges=()):
    """atoms of (element, code of its charge), bonds of (a, b, kind) from 1."""
    lines = ["title", "  prog", "", f"{len(atoms):3d}{len(bonds):3d}  0  0  0  0  0  0  0  0999 V2000"]
    lines += [f"{0:10.4f}{0:10.4f}{0:10.4f} {e:<3}{0:2d}{c:3d}" for e, c in atoms]
    lines += [f"{a:3d}{b:3d}{k:3d}  0" for a, b, k in bonds]
    if charges:
        lines.append(f"M  CHG{len(charges):3d}" + "".join(f"{a:4d}{c:4d}" for a, c in charges))
    return "\n".join([*lines, "M  END"])


def digest(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def plain(atoms, bonds, radius, width):
    """atoms of (element, charge)."""
    near = [[(b - 1 if a - 1 == i else a - 1, k) for a, b, k in bonds if i in (a - 1, b - 1)] for i in range(len(atoms))]
    now = [digest(0, e, len(n), sum(k for _, k in n), c) for (e, c), n in zip(atoms, near, strict=True)]
    every = set(now)
    for r in range(1, radius + 1):
        now = [digest(r, h, ",".join(f"{k}-{x}" for k, x in sorted((k, now[j]) for j, k in n))) for h, n in zip(now, near, strict=True)]
        every |= set(now)
    return sorted({h % width for h in every})


def drawn(rng, n):
    atoms = [(rng.choice("CCCNO"), rng.choice([0, 0, 0, 3, 5])) for _ in range(n)]
    bonds = [(rng.randrange(1, i), i, rng.choice([1, 1, 2, 4])) for i in range(2, n + 1)]
    return atoms, bonds + [(1, n, 1)] * (n > 4)


def prints(spark, blocks, **kw):
    df = spark.createDataFrame(list(enumerate(blocks)), "row_idx int, molblock string").withColumn("title", F.lit("t"))
    return {r.row_idx: None if r.fingerprint is None else list(r.fingerprint) for r in fp.sdf_fingerprints(df, **kw).collect()}


def test_equal_to_the_plain_version(spark):
    rng = random.Random(1)
    mols = [drawn(rng, rng.randrange(1, 25)) for _ in range(30)]
    signed = [([(e, fp.CHARGES.get(c, 0)) for e, c in atoms], bonds) for atoms, bonds in mols]
    for radius, width in ((0, 64), (2, 2048), (3, 512)):
        got = prints(spark, [molblock(*m) for m in mols], radius=radius, width=width)
        assert got == {i: plain(*m, radius, width) for i, m in enumerate(signed)}


def test_renumbered_atoms_give_the_same_bits(spark):
    rng = random.Random(2)
    blocks = []
    for _ in range(10):
        atoms, bonds = drawn(rng, 15)
        order = rng.sample(range(15), 15)
        place = {old: new + 1 for new, old in enumerate(order)}
        turned = [(place[b - 1], place[a - 1], k) for a, b, k in rng.sample(bonds, len(bonds))]
        blocks += [molblock(atoms, bonds), molblock([atoms[o] for o in order], turned)]
    got = prints(spark, blocks)
    assert all(got[2 * i] == got[2 * i + 1] for i in range(10)) and len({str(v) for v in got.values()}) == 10


def test_odd_records(spark):
    atoms, bonds = [("C", 0), ("N", 3)], [(1, 2, 1)]
    blocks = [None, "", "a\nb\nc\n  0  0\nM  END", "a\nb\nc\n  0  0  0     0  0            999 V3000\nM  END", molblock(atoms, bonds)[:80], molblock(atoms, bonds), molblock([("C", 0), ("N", 5)], bonds, [(2, 1)]), molblock(atoms, bonds, [(1, -1)])]
    got = prints(spark, blocks)
    assert [got[i] for i in range(5)] == [None, None, [], None, None] and got[5] == got[6] != got[7]
    assert got[7] == plain([("C", -1), ("N", 0)], bonds, 2, 2048)


def test_similarity_and_vectors(spark):
    df = spark.createDataFrame([([1, 3], [3, 5]), ([], []), (None, [1]), ([2], [2])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(fp.tanimoto(F.col("a"), F.col("b"))).collect()] == [1 / 3, 1.0, None, 1.0]
    assert df.select(fp.bit_vector(F.col("a"), 5)).first()[0] == [0.0, 1.0, 0.0, 1.0, 0.0]


def test_records_of_a_file(spark, tmp_path):
    atoms, bonds = [("C", 0), ("O", 0)], [(1, 2, 2)]
    path = tmp_path / "m.sdf"
    path.write_text(f"{molblock(atoms, bonds)}\n> <ID>\nA\n\n$$$$\n{molblock(atoms, bonds)}\n$$$$\n")
    got = fp.sdf_fingerprints(text.read_sdf(spark, str(path)))
    assert [list(r.fingerprint) for r in got.collect()] == [plain(atoms, bonds, 2, 2048)] * 2
    plan = fp.with_fingerprint(spark.createDataFrame([(molblock(atoms, bonds),)], "b string").select(fp.read_molblock(F.col("b")).alias("m")), "m")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
