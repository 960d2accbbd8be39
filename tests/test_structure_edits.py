import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.sources import structures

ROW = "file string, serial int, model int, chain_id string, res_seq int, i_code string, res_name string, atom_name string, x double, y double, z double, occupancy double, b_factor double, element string, hetero boolean"
LETTER = {v: k for k, v in structures.THREE_TO_ONE.items()}
HEAVY, LIGHT, LINK = "EVQLVESGGG", "DIQMTQSPSS", "GGGGSGGGGS"
CIF = """data_1ABC
_entry.id 1ABC
_struct.title
;a title of
loop_
_atom_site.id
1 2 3
;
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.B_iso_or_equiv
ATOM   1 N     GLY A 1  1.000   2.000   -3.250 20.00
ATOM   2 CA    GLY A 1  100.125 2.000   3.000  7.50
HETATM 3 "O5'" HOH B .  9.000   9.000   9.000  1.00
#
loop_
_other.id
_other.Cartn_x
1 5.000
2 'a b'
"""


def atoms(spark, chains, model=0, file="f"):
    rows, n = [], 0
    for chain, text in chains.items():
        for i, c in enumerate(text):
            for name in ("N", "CA"):
                n += 1
                rows.append((file, n, model, chain, i + 1, "", LETTER[c], name, float(n), 0.0, 0.0, 1.0, 5.0, name[0], False))
    return spark.createDataFrame(rows, ROW)


def chains_of(df):
    return {(r.model, r.chain_id): r.sequence for r in structures.sequences(df).collect()}


def test_heavy_and_light_of_one_chain(spark):
    one = atoms(spark, {"A": "MK" + HEAVY + LINK + LIGHT + "AA", "P": "GWG"}).union(atoms(spark, {"A": HEAVY + LIGHT}, model=1))
    numbering = spark.createDataFrame([("f", HEAVY, LIGHT)], "file string, heavy string, light string")
    got = structures.split_scfv(one, numbering, "A", keep=["P"])
    assert chains_of(got) == {(0, "H"): HEAVY, (0, "L"): LIGHT, (0, "P"): "GWG", (1, "H"): HEAVY, (1, "L"): LIGHT}
    assert got.where("chain_id = 'L' and model = 0").agg(F.min("res_seq")).first()[0] == 23 and got.columns == one.columns
    with pytest.raises(Exception, match="no heavy or no light"):
        structures.split_scfv(one, numbering.withColumn("light", F.lit("WWW")), "A").collect()
    with pytest.raises(Exception, match="no heavy or no light"):
        structures.split_scfv(one, numbering.withColumn("heavy", F.lit("")), "A").collect()


def test_places_against_brute_force(spark):
    rng = random.Random(4)
    texts = [(i % 2, i, "".join(rng.choice("AC") for _ in range(rng.randrange(30)))) for i in range(40)] + [(0, 90, None), (0, 91, "")]
    parts = [(i % 2, 100 + i, "".join(rng.choice("AC") for _ in range(rng.randrange(12)))) for i in range(40)] + [(0, 190, None), (1, 191, texts[1][2])]
    a, b = spark.createDataFrame(texts, "g int, text_id int, text string"), spark.createDataFrame(parts, "g int, part_id int, part string")
    got = {(r.text_id, r.part_id): (r["at"], r.length) for r in structures.locate(a, b, ["g"], k=4).collect()}
    assert got == {(t, p): (x.find(y), len(y)) for g, t, x in texts for h, p, y in parts if g == h and x and y and y in x}
    assert structures.locate(a, b.limit(0), ["g"]).count() == structures.locate(a.limit(0), b, ["g"]).count() == 0


def test_updated_mmcif_changes_coordinates_only(spark, tmp_path):
    path = tmp_path / "1abc.cif"
    path.write_text(CIF, newline="")
    old = structures.read_mmcif(spark, str(path), author_ids=False)
    out = str(tmp_path / "out")
    written = lambda: (next((tmp_path / "out" / "entry=1abc").glob("part-*"))).read_text()
    structures.update_mmcif(spark, str(path), old.withColumn("b_factor", F.round("b_factor", 2)), out)
    assert written() == CIF
    moved = old.where("serial <> 3").withColumns({"x": F.col("x") + 1000.5, "y": -F.col("y"), "z": F.lit(0.0)})
    structures.update_mmcif(spark, str(path), moved.drop("b_factor", "occupancy"), out)
    text = written()
    text = written()
    assert "ATOM   1 N     GLY A 1  1001.500 -2.000  0.000  20.00\n" in text and "ATOM   2 CA    GLY A 1  1100.625 -2.000 " in text
    assert [x for x in text.splitlines() if "GLY" not in x] == [x for x in CIF.splitlines() if "GLY" not in x]
    new = tmp_path / "again.cif"
    new.write_text(text)
    again = structures.read_mmcif(spark, str(new), author_ids=False)
    cols = ["serial", "x", "y", "z", "b_factor"]
    assert sorted(map(tuple, again.where("serial <> 3").select(cols).collect())) == sorted(map(tuple, moved.select(cols).collect()))
    assert [tuple(r) for r in again.where("serial = 3").select(cols).collect()] == [(3, 9.0, 9.0, 9.0, 1.0)]


def test_rewriting_keeps_quotes_and_text():
    text = "loop_\n_c.id\n_c.v\n1 'it''s a b'   x\n#\n"
    assert structures.rewrite_loop("loop_\n_c.id\n_c.v\n_c.w\n1 'a b'   x\n", "_c", "id", {"1": {"v": "longer"}}) == "loop_\n_c.id\n_c.v\n_c.w\n1 longer  x\n"
    assert structures.rewrite_loop(text, "_d", "id", {"1": {"v": "2"}}) == text
    with pytest.raises(ValueError):
        structures.rewrite_loop(text, "_c", "id", {"1": {"none": "2"}})


def test_main_features(spark):
    names = {"GLY": ["N", "CA", "C", ""], "ALA": ["N", "CA", "C", "CB"]}
    got = {r.chain_id: r for r in structures.main_features(atoms(spark, {"A": "GAW", "B": "A"}), names, list("AG")).collect()}
    a = got["A"]
    assert (a.sequence, list(a.aa_types)) == ("GAW", [1, 0, 2])
    assert [list(map(tuple, r)) for r in a.atom_positions][0] == [(1.0, 0.0, 0.0), (2.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    assert [list(r) for r in a.atom_exists] == [[True, True, False, False]] * 2 + [[False] * 4]
    assert [list(r) for r in a.b_factors][1] == [5.0, 5.0, 0.0, 0.0] and got["B"].sequence == "A"


def test_trajectories(spark, tmp_path):
    step = lambda s: [("t", s, 7, "GLY", [[float(s), 0.0, 0.0], [1.0, 1.0, 1.0], None, [2.0, 2.0, 2.0]], None), ("t", s, 8, "ALA", None, 3.0), ("t", s, 9, "ALA", [[5.0, 5.0, 5.0]], 9.0)]
    steps = spark.createDataFrame(step(0) + step(1), "file string, step int, res_seq int, res_name string, positions array<array<double>>, b_factor double")
    got = structures.trajectory_atoms(steps)
    rows = sorted((r.model, r.serial, r.res_seq, r.atom_name, r.x, r.b_factor, r.element) for r in got.collect())
    assert rows[:4] == [(0, 1, 7, "N", 0.0, 100.0, "N"), (0, 2, 7, "CA", 1.0, 100.0, "C"), (0, 3, 7, "O", 2.0, 100.0, "O"), (0, 4, 9, "N", 5.0, 9.0, "N")] and len(rows) == 8
    structures.write_pdb(got, str(tmp_path / "out"))
    back = structures.read_pdb(spark, [str(p) for p in (tmp_path / "out" / "entry=t").glob("part-*")])
    assert back.select("model", "serial", "x").distinct().count() == 8
    named = structures.trajectory_atoms(steps, "B", {"GLY": ["CA", "", "N", "O"], "ALA": ["CB"]})
    assert {(r.res_name, r.atom_name) for r in named.collect()} == {("GLY", "CA"), ("GLY", "O"), ("ALA", "CB")}


def test_paths_of_ids(spark):
    df = spark.createDataFrame([("1abc",), ("other",), (None,)], "id string")
    assert [r[0] for r in df.select(structures.native_path(F.col("id"), "/pdb")).collect()] == ["/pdb/mmCIF/ab/1abc.cif.gz", "other", None]


def test_atoms_and_reasons_of_one_pass(spark, tmp_path):
    (tmp_path / "a.cif").write_text(CIF)
    (tmp_path / "b.cif").write_text(CIF.replace("1.000   2.000", "one 2.000"))
    (tmp_path / "c.cif").write_text(CIF + "#" * 5000)
    path = str(tmp_path / "*.cif")
    atoms_, unread = structures.read_all_mmcif(spark, path, author_ids=False, max_bytes=3000)
    assert atoms_.count() == 3 and {r.file[-5:] for r in atoms_.collect()} == {"a.cif"}
    assert {r.file[-5:]: r.reason.split(":")[0] for r in unread.collect()} == {"b.cif": "ValueError", "c.cif": f"{len(CIF) + 5000} bytes"}
    assert atoms_.exceptAll(structures.read_mmcif(spark, path, author_ids=False, max_bytes=3000)).count() == 0
    assert unread.exceptAll(structures.unread_mmcif(spark, path, author_ids=False, max_bytes=3000)).count() == 0


def test_backbone_frames(spark):
    rng = np.random.default_rng(3)
    own = {i: rng.normal(size=(3, 3)) for i in range(8)}
    own[6][2] = own[6][1] + 2 * (own[6][0] - own[6][1])  # on a line
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    rows = [(m, 0, m, "A", i, "", "GLY", name, *map(float, p @ q.T + 5 if m else p), 1.0, 1.0, "C", False) for m in (0, 1) for i, ps in own.items() for name, p in zip(("N", "CA", "C"), ps, strict=True) if (i, name) != (7, "N")]
    df = spark.createDataFrame([("f", *r[1:]) for r in rows], ROW)
    got = {(r.model, r.res_seq): r for r in structures.backbone_frames(df).collect()}
    assert len(got) == 14 and got[0, 6].rotation is None
    for i in range(6):
        r, t = np.array(got[0, i].rotation), np.array(got[0, i].translation)
        n, ca, c = own[i]
        assert np.allclose(r.T @ r, np.eye(3)) and np.linalg.det(r) > 0 and np.allclose(t, ca)
        assert np.allclose(r.T @ (c - ca), [np.linalg.norm(c - ca), 0, 0]) and abs((r.T @ (n - ca))[2]) < 1e-9 < (r.T @ (n - ca))[1]
        assert np.allclose(q @ r, got[1, i].rotation) and np.allclose(q @ t + 5, got[1, i].translation)
