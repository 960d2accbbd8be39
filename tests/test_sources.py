import gzip
import os

import pytest
from pyspark.sql import functions as F

from loomwright.sources import datasources, structures, tables, text

FASTA = ">P1 first protein\nMKV\nLLA\n>P2\nACD\r\n>sp|Q197F8|002R_IIV3 Uncharacterized OS=x\nMA SN\n"
SDF = "mol one\n  prog\n\n  0  0\nM  END\n> <ID>\nA1\n\n> <NAME>\nfirst\nsecond\n\n$$$$\nmol two\n  prog\n\n  0  0\nM  END\n$$$$\n"


def put(path, content):
    path.write_text(content, newline="") if isinstance(content, str) else path.write_bytes(content)
    return str(path)


def test_lines_and_tables(spark, tmp_path):
    many = put(tmp_path / "many.txt", "\n".join(f"line {i}" for i in range(5000)) + "\n")
    got = {r.row_idx: r.line for r in text.read_lines(spark, many).collect()}
    assert got == {i: f"line {i}" for i in range(5000)}
    crlf = put(tmp_path / "t.tsv", 'a\tid x\r\n1\t"q, 1\r\n2\t\r\n')
    rows = text.read_table(spark, crlf).orderBy("row_idx").collect()
    assert [tuple(r) for r in rows] == [(0, "1", '"q, 1'), (1, "2", "")]
    named = text.read_table(spark, crlf, ["p", "q"], rename={"q": "name"}, prefix="data_")
    assert named.columns == ["row_idx", "data_p", "data_name"] and named.count() == 3
    with pytest.raises(ValueError):
        text.read_table(spark, crlf, ["p", "p"])
    with pytest.raises(ValueError):
        text.read_table(spark, crlf, expected=3)
    with pytest.raises(Exception, match="wrong number of fields"):
        text.read_table(spark, put(tmp_path / "bad.tsv", "a\tb\n1\n")).collect()
    assert text.read_smiles(spark, put(tmp_path / "m.smi", "CCO\tid 1::x\nC\tid, 2\n")).orderBy("row_idx").select("smiles_id").collect()[1][0] == "id, 2"


def test_numbering_over_files(spark, tmp_path):
    for i in range(5):
        put(tmp_path / f"f{i}.txt", "".join(f"{i}:{j}\n" for j in range(i)))
    rows = text.read_lines(spark, str(tmp_path)).collect()
    assert sorted(r.row_idx for r in rows) == list(range(10))
    for i in range(5):
        own = sorted((int(r.line.split(":")[1]), r.row_idx) for r in rows if r.line.startswith(f"{i}:"))
        assert [b - own[0][1] for _, b in own] == list(range(len(own)))


def test_fasta_and_sdf(spark, tmp_path):
    got = text.read_fasta(spark, put(tmp_path / "p.fasta", FASTA)).orderBy("row_idx").collect()
    assert [(r.id, r.comment, r.sequence) for r in got] == [("P1", "first protein", "MKVLLA"), ("P2", None, "ACD"), ("sp|Q197F8|002R_IIV3", "Uncharacterized OS=x", "MASN")]
    ids = text.read_fasta(spark, str(tmp_path / "p.fasta"), text.uniprot_accession(F.col("header"))).orderBy("row_idx").collect()
    assert ids[2].id == "Q197F8"
    mols = text.read_sdf(spark, put(tmp_path / "m.sdf", SDF)).orderBy("row_idx").collect()
    assert [(m.title, m.props) for m in mols] == [("mol one", {"ID": "A1", "NAME": "first\nsecond"}), ("mol two", {})]
    assert mols[0].molblock.endswith("M  END")
    chains = spark.createDataFrame([("1ABC_1|Chains A[auth H], B", ), ("x Chain C",)], "d string").select(text.author_chain(F.col("d"))).collect()
    assert [c[0] for c in chains] == ["H", "C"]


def test_nested_and_names(spark, tmp_path):
    path = put(tmp_path / "d.json", '{"peptides": [{"id": 1, "a": [{"c": "5", "unit": {"name": "µM"}}]}, {"id": 2, "a": [{"c": "1"}]}]}')
    got = text.read_nested(spark, path, "peptides array<struct<id: long, a: array<struct<c: string, unit: struct<name: string>>>>>", "peptides").collect()
    assert [r.id for r in got] == [1, 2] and got[1].a[0].unit is None
    named = spark.createDataFrame([("/x/pos_1",), ("/pos/neg_2",), ("/pos/other",)], "p string").select(text.label_from_name(F.col("p"))).collect()
    assert [r[0] for r in named] == [1, 0, None]


def atom(serial, name, res, chain, seq, x, tag="ATOM"):
    return f"{tag:<6}{serial:5d} {name:<4} {res:>3} {chain}{seq:4d}    {x:8.3f}{2 * x:8.3f}{-x:8.3f}{1:6.2f}{20:6.2f}          {name.strip()[0]:>2}"


def test_pdb_round_trip(spark, tmp_path):
    one = [atom(1, " N", "ALA", "A", 1, 1.5), atom(2, " CA", "ALA", "A", 1, 2.5), atom(3, " CA", "GLY", "A", 2, 3.5), atom(4, " CA", "MSE", "B", 1, 4.5), atom(5, " O", "HOH", "B", 9, 5.5, "HETATM")]
    two = [atom(1, " CA", "TRP", "A", 1, 9.0)]
    file = put(tmp_path / "x1.pdb", "HEADER\nMODEL        1\n" + "\n".join(one) + "\nENDMDL\nMODEL        2\n" + "\n".join(two) + "\nENDMDL\nEND\n")
    atoms = structures.read_pdb(spark, file)
    assert atoms.count() == 6
    assert {(r.model, r.chain_id, r.length, r.sequence) for r in structures.sequences(atoms).collect()} == {(0, "A", 2, "AG"), (0, "B", 1, "X"), (1, "A", 1, "W")}
    assert structures.last_model(atoms).count() == 1
    assert {r.chain_id for r in structures.select_chains(atoms, {"B": "Z"}).collect()} == {"Z"}
    out = str(tmp_path / "out")
    structures.write_pdb(atoms, out)
    again = structures.read_pdb(spark, f"{out}/entry=x1").drop("file")
    assert sorted(map(str, again.collect())) == sorted(map(str, atoms.drop("file").collect()))
    packed = tmp_path / "y.pdb.gz"
    packed.write_bytes(gzip.compress("\n".join(one).encode()))
    assert structures.read_pdb(spark, str(packed)).count() == 5


def test_mmcif_and_summary(spark, tmp_path):
    cif = "data_x\nloop_\n_other.a\n1\n#\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in "group_PDB id type_symbol label_atom_id label_comp_id label_asym_id label_seq_id Cartn_x Cartn_y Cartn_z occupancy B_iso_or_equiv auth_seq_id auth_comp_id auth_asym_id pdbx_PDB_model_num".split()) + "ATOM 1 C CA ALA A 1 1.0 2.0 3.0 1.0 9.5 7 ALA H 1\nHETATM 2 O \"O5'\" HOH B . 1.0 2.0 3.0 1.0 9.5 8 HOH H 1\n#\n"
    put(tmp_path / "a.cif", cif)
    put(tmp_path / "bad.cif", cif.replace("1.0 2.0", "x y"))
    rows = structures.read_mmcif(spark, str(tmp_path)).orderBy("serial").collect()
    assert [(r.chain_id, r.res_seq, r.atom_name, r.hetero) for r in rows] == [("H", 7, "CA", False), ("H", 8, "O5'", True)]
    assert structures.read_mmcif(spark, str(tmp_path), author_ids=False).where("res_seq is null").count() == 1
    assert structures.read_mmcif(spark, str(tmp_path), max_bytes=10).count() == 0
    summary = spark.createDataFrame([(0, "1abc", None, "L", 0, "X"), (1, "1abc", "H", "L", 0, "X"), (2, "1abc", "H", "L", 1, None)], "row_idx long, pdb string, Hchain string, Lchain string, model int, antigen_chain string")
    assert [tuple(r) for r in structures.antibodies(summary).collect()] == [("1abc", 1, "L", "H", "X")]


def test_data_sources(spark, tmp_path):
    datasources.register(spark)
    parts = [b"a\nb", b"", b"c"]
    blob, index, at = b"", b"", 0
    for i, p in enumerate(parts):
        blob += p + b"\0"
        index += b"%d\t%d\t%d\n" % (10 + i, at, len(p) + 1)
        at = len(blob)
    put(tmp_path / "d.ffindex", index)
    path = put(tmp_path / "d.ffdata", blob)
    got = spark.read.format("ffdata").option("path", path).option("index_bytes", "2").load().orderBy("name").collect()
    assert [(r.name, r["lines"]) for r in got] == [(10, ["a", "b"]), (11, [""]), (12, ["c"])]
    ttl = put(tmp_path / "t.ttl", '@prefix e: <http://e/> .\n# c\ne:a a e:T ; e:p "x \\"y\\""@en , 3 .\n_:b e:q <http://z>, """l\nm"""^^e:d, true .\n')
    rows = spark.read.format("turtle").option("path", ttl).load().collect()
    assert {(r.subject, r.object, r.object_kind, r.lang) for r in rows} == {("http://e/a", "http://e/T", "iri", None), ("http://e/a", 'x "y"', "literal", "en"), ("http://e/a", "3", "literal", None), ("_:b", "http://z", "iri", None), ("_:b", "l\nm", "literal", None), ("_:b", "true", "literal", None)}


def test_sql_tables_and_export(spark, tmp_path):
    path = put(tmp_path / "in.tsv", "Text Column\tInt Column\r\nx\t1\r\ny\t2\r\n")
    tables.csv_to_table(spark, path, "small")
    assert tables.run_sql(spark, "SELECT sum(`Int Column`) FROM small").first()[0] == 3
    tables.csv_to_table(spark, path, "named", columns=["a", "b"])
    assert tables.run_sql(spark, "SELECT count(*) FROM named").first()[0] == 3
    out = str(tmp_path / "out")
    df = spark.range(10)
    assert tables.export(df, out, rows_per_file=3) and not tables.export(df, out)
    assert spark.read.csv(out, sep="\t", header=True).count() == 10
    assert tables.export(df.limit(2), out, single=True, force=True) and spark.read.csv(out, sep="\t", header=True).count() == 2
    calls = []

    def make(n):
        calls.append(n)
        return spark.range(n)

    assert [tables.cached(spark, f"t{os.getpid()}", make, n=n).count() for n in (3, 3, 4)] == [3, 3, 4] and calls == [3, 4]


def test_cached_refuses_tables_and_tells_versions_apart(spark):
    make = lambda n: spark.range(n)
    name = f"v{os.getpid()}"
    assert tables.cached(spark, name, make, n=2).count() == 2
    assert tables.cached(spark, name, lambda n: spark.range(n + 1), version="b", n=2).count() == 3
    with pytest.raises(TypeError):
        tables.cached(spark, name, lambda df: df, df=spark.range(3))


def test_guarded_result_belongs_to_its_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, s string")
    path = f"file://{tmp_path}/g"
    assert tables.guarded(df, path, lambda x: x.distinct()).count() == 2
    assert tables.guarded(df.orderBy("s").repartition(3), path, None).count() == 2
    for other in (df.distinct(), df.where("id = 1"), df.withColumnRenamed("s", "t")):
        with pytest.raises(ValueError):
            tables.guarded(other, path, lambda x: x)
    assert tables.guarded(df.where("id = 1"), path, lambda x: x, rebuild=True).count() == 1


def test_ordinals_over_several_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("3\n4\n")
    (tmp_path / "a.txt").write_text("0\n1\n2\n")
    (tmp_path / "c.txt").write_text("".join(f"{i}\n" for i in range(5, 900)))
    got = text.read_lines(spark, f"file://{tmp_path}").collect()
    assert sorted((r.row_idx, r.line) for r in got) == [(i, str(i)) for i in range(900)]


@pytest.mark.parametrize("index_bytes", [1, 3, 7, 64, 10_000])
def test_blob_index_by_ranges_of_bytes(spark, tmp_path, index_bytes):
    datasources.register(spark)
    blob, index = b"", b""
    for i in range(60):
        part = b"x" * (i % 7) + b"\n%d" % i
        index += b"%d\t%d\t%d\n" % (i, len(blob), len(part) + 1)
        blob += part + b"\0"
    put(tmp_path / "d.ffindex", index[:-1] if index_bytes == 7 else index)
    path = put(tmp_path / "d.ffdata", blob)
    reader = datasources.FFDataReader({"path": path, "index_bytes": str(index_bytes)})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(rows) == [(i, ["x" * (i % 7), str(i)]) for i in range(60)]
    put(tmp_path / "d.ffindex", b"")
    assert spark.read.format("ffdata").option("path", path).load().count() == 0


def test_turtle_nodes_and_collections():
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    got = list(datasources.triples('@base <http://e/x/> .\nPREFIX p: <ns#>\n<a> p:of [ p:n 1 ; p:m [ p:k "v" ] ] , () ; p:l ( 2e3 <b> [ p:z true ] ) .\n[ p:q <../c> ] p:r <d> .'))
    plain = [(s.removeprefix("http://e/x/"), p.removeprefix("http://e/x/ns#").removeprefix(rdf), o.removeprefix(rdf)) for s, p, o, *_ in got]
    assert plain == [
        ("_:anon0", "n", "1"), ("_:anon1", "k", "v"), ("_:anon0", "m", "_:anon1"), ("a", "of", "_:anon0"), ("a", "of", "nil"),
        ("_:anon2", "z", "true"), ("_:anon3", "first", "2e3"), ("_:anon3", "rest", "_:anon4"), ("_:anon4", "first", "http://e/x/b"), ("_:anon4", "rest", "_:anon5"),
        ("_:anon5", "first", "_:anon2"), ("_:anon5", "rest", "nil"), ("a", "l", "_:anon3"), ("_:anon6", "q", "http://e/c"), ("_:anon6", "r", "http://e/x/d"),
    ]
    for bad in ("<a> <b> [ <c> <d> .", "<a> <b> ( 1 ] .", "<a> <b> ] .", "<a> <b> !"):
        with pytest.raises(ValueError):
            list(datasources.triples(bad))


def test_malformed_lines_are_skipped(spark, tmp_path):
    path = put(tmp_path / "in.tsv", "a\tb\n1\tx\n2\n3\ty\tz\nq\tw\n4\tv\n")
    df = text.read_typed(spark, path, "a int, b string", skip_malformed=True)
    assert sorted(map(tuple, df.collect())) == [(1, "x"), (4, "v")] and df.count() == df.select("b").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        text.read_typed(spark, path, "a int, b string").select("b").collect()


def test_chains_and_unread_files(spark, tmp_path):
    rows = [("f", "B", 1), ("f", "A", 2), ("f", "C", 3), ("g", "C", 4), ("g", None, 5)]
    atoms = spark.createDataFrame(rows, "file string, chain_id string, serial int")
    pick = lambda c: sorted(r.serial for r in structures.pick_chains(atoms, c).collect())
    assert pick(None) == [1, 2, 3, 4, 5] and pick("C") == [3, 4] and pick(0) == [2, 4] and pick(["A", 1]) == [1, 2] and pick([]) == [] and pick(9) == []
    put(tmp_path / "bad.cif", "loop_\n_atom_site.id\n_atom_site.Cartn_x\n1 x\n#\n")
    put(tmp_path / "cut.cif.gz", b"\x1f\x8b\x08")
    put(tmp_path / "long.cif", "#" * 2000)
    put(tmp_path / "empty.cif", "")
    got = {r.file.split("/")[-1]: r.reason for r in structures.unread_mmcif(spark, str(tmp_path), max_bytes=1000).collect()}
    assert set(got) == {"bad.cif", "cut.cif.gz", "long.cif"} and got["long.cif"] == "2000 bytes"
    assert structures.read_mmcif(spark, str(tmp_path), max_bytes=1000).count() == 0
