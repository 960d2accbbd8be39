"""Atom tables from PDB and mmCIF files, and PDB files from atom tables."""

from __future__ import annotations

import gzip
import re
import shlex
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.sequences import lookup
from ..staging import stage

ATOM = "file string, serial int, model int, chain_id string, res_seq int, i_code string, res_name string, atom_name string, x double, y double, z double, occupancy double, b_factor double, element string, hetero boolean"
#: Residue names and letters.
THREE_TO_ONE = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}


def file_type(path: Column) -> Column:
    """pdb or cif by the suffix, .gz aside; null for others."""
    name = F.regexp_replace(F.lower(path), r"\.gz$", "")
    return F.when(name.endswith(".pdb") | name.endswith(".ent"), "pdb").when(name.endswith(".cif") | name.endswith(".mmcif"), "cif")


def is_pdb_id(s: Column) -> Column:
    return F.length(s) == 4


def read_pdb(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The atom table of PDB files, plain or .gz. Models count from 0, in files with MODEL records by their order."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    field = lambda start, size: F.trim(F.substring("line", start, size))
    tag = F.rtrim(F.substring("line", 1, 6))
    records = lines.select("file", "at", "line", tag.alias("tag")).where("tag in ('ATOM', 'HETATM', 'MODEL')")
    models = records.where("tag = 'MODEL'").groupBy("file").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    atoms = records.where("tag <> 'MODEL'").join(models, "file", "left")
    model = F.greatest(F.size(F.filter(F.coalesce("starts", F.array().cast("array<int>")), lambda s: s < F.col("at"))) - 1, F.lit(0))
    number = lambda start, size, kind: field(start, size).try_cast(kind)
    return atoms.select("file", number(7, 5, "int").alias("serial"), model.alias("model"), field(22, 1).alias("chain_id"), number(23, 4, "int").alias("res_seq"), field(27, 1).alias("i_code"), field(18, 3).alias("res_name"), field(13, 4).alias("atom_name"), *[number(31 + 8 * i, 8, "double").alias(c) for i, c in enumerate("xyz")], number(55, 6, "double").alias("occupancy"), number(61, 6, "double").alias("b_factor"), field(77, 2).alias("element"), (F.col("tag") == "HETATM").alias("hetero"))


def last_model(atoms: DataFrame) -> DataFrame:
    """The atoms of each file's last model."""
    last = atoms.groupBy("file").agg(F.max("model").alias("model"))
    return atoms.join(last, ["file", "model"], "left_semi")


def residues(atoms: DataFrame) -> DataFrame:
    """(file, model, chain_id, res_seq, i_code, letter, x, y, z): one row a residue, at its CA; X for unknown names."""
    letter = F.coalesce(F.element_at(lookup(THREE_TO_ONE), F.col("res_name")), F.lit("X"))
    return atoms.where("atom_name = 'CA' and not hetero").dropDuplicates(["file", "model", "chain_id", "res_seq", "i_code"]).select("file", "model", "chain_id", "res_seq", "i_code", letter.alias("letter"), "x", "y", "z")


def sequences(atoms: DataFrame) -> DataFrame:
    """(file, model, chain_id, length, sequence) of each chain."""
    one = F.array_sort(F.collect_list(F.struct("res_seq", "i_code", "letter")))
    return residues(atoms).groupBy("file", "model", "chain_id").agg(F.count("*").alias("length"), F.array_join(F.transform(one, lambda r: r["letter"]), "").alias("sequence"))


def select_chains(atoms: DataFrame, chains: dict[str, str]) -> DataFrame:
    """The atoms of the chains, under their new names."""
    return atoms.where(F.col("chain_id").isin(list(chains))).withColumn("chain_id", F.element_at(lookup(chains), F.col("chain_id")))


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """(file, model, serial, line) of fixed width."""
    name = F.when(F.length("atom_name") < 4, F.concat(F.lit(" "), F.rpad("atom_name", 3, " "))).otherwise(F.col("atom_name"))
    text = F.format_string("%-6s%5d %s %3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.when(F.col("hetero"), "HETATM").otherwise("ATOM"), "serial", name, "res_name", "chain_id", "res_seq", F.rpad("i_code", 1, " "), "x", "y", "z", F.coalesce("occupancy", F.lit(1.0)), F.coalesce("b_factor", F.lit(0.0)), F.coalesce("element", F.lit("")))
    return atoms.select("file", "model", "serial", text.alias("line"))


def write_pdb(atoms: DataFrame, path: str) -> None:
    """A folder entry=<name>/ of text for each file, its models in order, between MODEL and ENDMDL. A file's atoms fit one row."""
    of_model = pdb_lines(atoms).groupBy("file", "model").agg(F.array_sort(F.collect_list(F.struct("serial", "line"))).alias("rows"))
    block = F.concat(F.format_string("MODEL     %4d\n", F.col("model") + 1), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\nENDMDL\n"))
    whole = of_model.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("model", block.alias("text")))).alias("models"))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    whole.select(name.alias("entry"), F.concat(F.array_join(F.transform("models", lambda m: m["text"]), ""), F.lit("END")).alias("value")).write.mode("overwrite").partitionBy("entry").text(path)


def _cif_rows(text: str) -> Iterator[dict]:
    """Rows of the atom_site loop."""
    lines = iter(text.splitlines())
    in_text = False
    for line in lines:
        if line.startswith(";") or in_text:  # a text of several lines
            in_text ^= line.startswith(";")
            continue
        if line.strip() != "loop_":
            continue
        names = []
        for line in lines:
            if not line.startswith("_"):
                break
            names.append(line.strip())
        if not names or not names[0].startswith("_atom_site."):
            continue
        names = [n.removeprefix("_atom_site.") for n in names]
        while line is not None and line.strip() and line[0] not in "#_" and line.strip() != "loop_":
            fields = shlex.split(line, posix=True) if '"' in line or "'" in line else line.split()
            yield dict(zip(names, (None if f in ".?" else f for f in fields), strict=True))
            line = next(lines, None)
        return


def _cif_atoms(file: str, content: bytes, kind: str) -> list[tuple]:
    found = _cif_rows((gzip.decompress(content) if file.endswith(".gz") else content).decode())
    return [(file, int(r["id"]), int(r.get("pdbx_PDB_model_num") or 1) - 1, r.get(f"{kind}_asym_id"), int(r[f"{kind}_seq_id"]) if r.get(f"{kind}_seq_id") else None, r.get("pdbx_PDB_ins_code") or "", r[f"{kind}_comp_id"] if r.get(f"{kind}_comp_id") else r.get("label_comp_id"), r.get("label_atom_id"), *(float(r[f"Cartn_{c}"]) for c in "xyz"), float(r.get("occupancy") or 1), float(r.get("B_iso_or_equiv") or 0), r.get("type_symbol"), r.get("group_PDB") == "HETATM") for r in found]


_UNREADABLE = (ValueError, KeyError, TypeError, OSError, EOFError)


def _parsed_mmcif(spark: SparkSession, path: str | list[str], author_ids: bool, max_bytes: int) -> DataFrame:
    """The atom table with reason: a row with file and reason alone for each file that is too large or cannot be parsed."""
    kind = "auth" if author_ids else "label"
    columns = [c.split()[0] for c in ATOM.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = pd.DataFrame(_cif_atoms(file, content, kind), columns=columns).assign(reason=None)
                except _UNREADABLE as e:
                    found = pd.DataFrame([[file, *[None] * (len(columns) - 1), f"{type(e).__name__}: {e}"]], columns=[*columns, "reason"], dtype=object).astype(dict.fromkeys(("x", "y", "z", "occupancy", "b_factor"), float))
                yield found.astype({"res_seq": "Int32", "serial": "Int32", "model": "Int32", "hetero": "boolean"})

    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > max_bytes).select(F.col("path").alias("file"), F.format_string("%d bytes", "length").alias("reason"))
    parsed = files.where(F.col("length") <= max_bytes).select("path", "content").mapInPandas(parse, f"{ATOM}, reason string")
    return parsed.unionByName(large, allowMissingColumns=True)


def read_mmcif(spark: SparkSession, path: str | list[str], author_ids: bool = True, max_bytes: int = 256 << 20) -> DataFrame:
    """The atom table of mmCIF files, plain or .gz, with the author's ids or those of the data bank.

    Files above max_bytes and files that cannot be parsed have no rows; see unread_mmcif, or read_all_mmcif for both at once.
    """
    return _parsed_mmcif(spark, path, author_ids, max_bytes).where("reason is null").drop("reason")


def unread_mmcif(spark: SparkSession, path: str | list[str], author_ids: bool = True, max_bytes: int = 256 << 20) -> DataFrame:
    """(file, reason) of the files that read_mmcif leaves out: too large, or not to be parsed."""
    return _parsed_mmcif(spark, path, author_ids, max_bytes).where("reason is not null").select("file", "reason")


def read_all_mmcif(spark: SparkSession, path: str | list[str], author_ids: bool = True, max_bytes: int = 256 << 20) -> tuple[DataFrame, DataFrame]:
    """What read_mmcif and unread_mmcif give, of one pass over the files, whose rows are staged."""
    held = stage(_parsed_mmcif(spark, path, author_ids, max_bytes), "mmcif")
    return held.where("reason is null").drop("reason"), held.where("reason is not null").select("file", "reason")


def pick_chains(atoms: DataFrame, chosen: str | int | list[str | int] | None = None) -> DataFrame:
    """The atoms of chosen chains: names, or places from 0 in a file's sorted names, or a list of both; all for None."""
    if chosen is None:
        return atoms
    chosen = chosen if isinstance(chosen, list) else [chosen]
    names = atoms.where("chain_id is not null").groupBy("file").agg(F.sort_array(F.collect_set("chain_id")).alias("names"))
    at = F.array_position("names", F.col("chain_id")) - 1
    wanted = F.col("chain_id").isin([c for c in chosen if isinstance(c, str)]) | at.isin([c for c in chosen if isinstance(c, int)])
    return atoms.join(names, "file").where(wanted).select(*atoms.columns)


def antibodies(summary: DataFrame, order: str = "row_idx") -> DataFrame:
    """(pdb_id, index_within_pdb, light, heavy, antigen) of the entries of a structure summary with both chains, in model 0; ordinals count all entries of a structure."""
    at = F.row_number().over(Window.partitionBy("pdb").orderBy(order)) - 1
    known = summary.withColumn("index_within_pdb", at).where("model = 0 and Hchain is not null and Lchain is not null")
    return known.select(F.col("pdb").alias("pdb_id"), "index_within_pdb", F.col("Lchain").alias("light"), F.col("Hchain").alias("heavy"), F.col("antigen_chain").alias("antigen"))


def pseudo_beta(atoms: DataFrame) -> DataFrame:
    """The CB atom of each residue, the CA atom of glycine."""
    return atoms.where(((F.col("res_name") == "GLY") & (F.col("atom_name") == "CA")) | ((F.col("res_name") != "GLY") & (F.col("atom_name") == "CB")))


def numbered_domains(lines: DataFrame) -> DataFrame:
    """(file, heavy, light) of antibody numbering output, rows of (file, row_idx, line): the residues of lines that start with H or L, gaps and comments aside."""
    part = lambda k: F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("row_idx", "kind", "residue")), lambda r: r["kind"] == k)), lambda r: r["residue"]), "")
    known = lines.where("trim(line) <> '' and not line like '#%'").select("file", "row_idx", F.substring("line", 1, 1).alias("kind"), F.element_at(F.split(F.trim("line"), r"\s+"), -1).alias("residue"))
    return known.where("residue <> '-'").groupBy("file").agg(part("H").alias("heavy"), part("L").alias("light"))


def cif_lines(atoms: DataFrame) -> DataFrame:
    """(file, model, serial, line): rows of an atom_site loop with the columns of CIF_COLUMNS."""
    bare = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("."))
    name = F.when(F.col("atom_name").contains("'"), F.concat(F.lit('"'), "atom_name", F.lit('"'))).otherwise(bare("atom_name"))
    fields = [F.when(F.col("hetero"), "HETATM").otherwise("ATOM"), F.col("serial").cast("string"), bare("element"), name, bare("res_name"), bare("chain_id"), bare("res_seq"), bare("i_code"), *[F.format_string("%.3f", c) for c in "xyz"], F.format_string("%.2f", F.coalesce("occupancy", F.lit(1.0))), F.format_string("%.2f", F.coalesce("b_factor", F.lit(0.0))), bare("res_seq"), bare("res_name"), bare("chain_id"), (F.col("model") + 1).cast("string")]
    return atoms.select("file", "model", "serial", F.concat_ws(" ", *fields).alias("line"))


#: Columns of an atom_site loop, in the order of cif_lines.
CIF_COLUMNS = ("group_PDB", "id", "type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv", "auth_seq_id", "auth_comp_id", "auth_asym_id", "pdbx_PDB_model_num")


def write_mmcif(atoms: DataFrame, path: str) -> None:
    """A folder entry=<name>/ of mmCIF text for each file. A file's atoms fit one row."""
    head = "loop_\n" + "".join(f"_atom_site.{c}\n" for c in CIF_COLUMNS)
    whole = cif_lines(atoms).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("model", "serial", "line"))).alias("rows"))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    text = F.concat(F.lit("data_"), name, F.lit("\n" + head), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n#"))
    whole.select(name.alias("entry"), text.alias("value")).write.mode("overwrite").partitionBy("entry").text(path)


def native_path(pdb_id: Column, folder: str | Column) -> Column:
    """Where a mirror keeps the mmCIF file of an id of four letters; other ids as they are."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return F.when(is_pdb_id(pdb_id), F.concat(folder, F.lit("/mmCIF/"), F.substring(pdb_id, 2, 2), F.lit("/"), pdb_id, F.lit(".cif.gz"))).otherwise(pdb_id)


def _in_order(atoms: DataFrame, name: str) -> DataFrame:
    """(file, model, chain_id, res_seq, i_code) of the residues with a CA atom, with their number from 0 in the chain. A chain fits one task."""
    at = F.row_number().over(Window.partitionBy("file", "model", "chain_id").orderBy("res_seq", "i_code")) - 1
    return residues(atoms).select("file", "model", "chain_id", "res_seq", "i_code", at.alias(name))


def locate(texts: DataFrame, parts: DataFrame, within: Sequence[str] = (), k: int = 6) -> DataFrame:
    """(text_id, part_id, at, length): the first place, from 0, at which each part stands in each text, if it does.

    texts is (text_id, text), parts (part_id, part), both with the columns within, which must be equal. Each part is looked up by one of its k-mers, the one
    that the texts have least often, so that common stretches do not meet; parts shorter than k by all their letters. Null and
    empty parts stand nowhere.
    """
    keys = list(within)
    cut = parts.where(F.length("part") > 0).select(*keys, "part_id", "part").distinct().withColumn("_k", F.least(F.length("part"), F.lit(k)))
    cut = stage(cut, "parts")
    sizes = [r._k for r in cut.select("_k").distinct().collect()]  # k of them at most
    if not sizes:
        return texts.select(*keys, "text_id").limit(0).crossJoin(cut.select("part_id").limit(0)).select(*keys, "text_id", "part_id", F.lit(0).alias("at"), F.lit(0).alias("length"))

    def grams(text: str, size) -> Column:
        last = F.length(text) - size
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.substring(F.col(text), i + 1, F.lit(size) if isinstance(size, int) else size).alias("g"))))

    of_texts = [texts.where(F.length("text") >= n).select(*keys, "text_id", F.explode(grams("text", n)).alias("x")) for n in sizes]
    held = of_texts[0]
    for more in of_texts[1:]:
        held = held.union(more)
    held = stage(held.select(*keys, "text_id", F.col("x.i").alias("_i"), F.col("x.g").alias("_g")), "grams")
    often = held.groupBy(*keys, "_g").agg(F.count("*").alias("_n"))
    own = cut.select(*keys, "part_id", "part", F.explode(grams("part", F.col("_k"))).alias("x")).select(*keys, "part_id", "part", F.col("x.i").alias("_j"), F.col("x.g").alias("_g"))
    best = own.join(often, [*keys, "_g"]).groupBy(*keys, "part_id", "part").agg(F.min_by(F.struct("_g", "_j"), F.struct("_n", "_j")).alias("a")).select(*keys, "part_id", "part", "a._g", "a._j")
    met = held.join(best, [*keys, "_g"]).where("_i >= _j").select(*keys, "text_id", "part_id", "part", (F.col("_i") - F.col("_j")).alias("at"))
    whole = texts.select(*keys, "text_id", "text").join(met.distinct(), [*keys, "text_id"]).where(F.expr("substring(text, at + 1, length(part)) = part"))
    return whole.groupBy(*keys, "text_id", "part_id").agg(F.min("at").alias("at"), F.first(F.length("part")).alias("length"))


def split_chains(atoms: DataFrame, domains: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The atoms of the domains found in chains, under the domains' names as chains; those of the chains of keep as they are.

    domains is (file, chain_id, name, sequence): stretches of residues of a chain of a file, as a heavy and a light domain of one chain; the first
    place counts, and a domain that is nowhere in its chain has no atoms. Atoms of residues without a CA atom go.
    """
    chains = sequences(atoms).select("file", "chain_id", "model", F.struct("model").alias("text_id"), F.col("sequence").alias("text"))
    wanted = domains.select("file", "chain_id", F.col("name").alias("part_id"), F.col("sequence").alias("part"))
    found = locate(chains.drop("model"), wanted, ["file", "chain_id"])
    found = found.select("file", "chain_id", F.col("text_id.model").alias("model"), F.col("part_id").alias("_name"), F.col("at").alias("_at"), F.col("length").alias("_length"))
    numbered = _in_order(atoms, "_n").join(found, ["file", "chain_id", "model"]).where("_n >= _at and _n < _at + _length")
    key = ["file", "model", "chain_id", "res_seq", "i_code"]
    moved = atoms.join(numbered.select(*key, "_name"), key).withColumn("chain_id", F.col("_name")).select(*atoms.columns)
    return moved.union(atoms.where(F.col("chain_id").isin(list(keep)))) if keep else moved


def split_scfv(atoms: DataFrame, numbering: DataFrame, chain: str, heavy: str = "H", light: str = "L", keep: Sequence[str] = ()) -> DataFrame:
    """The atoms of the heavy and the light domain of a chain that has both, as chains of their own.

    numbering is (file, heavy, light), as of numbered_domains. A file whose numbering lacks one of the two, or has one
    that is not in the chain, fails.
    """
    named = [numbering.select("file", F.lit(chain).alias("chain_id"), F.lit(new).alias("name"), F.col(c).alias("sequence")) for c, new in (("heavy", heavy), ("light", light))]
    out = split_chains(atoms, named[0].union(named[1]), keep)
    there = out.groupBy("file").agg(F.collect_set("chain_id").alias("_there"))
    whole = F.array_contains("_there", heavy) & F.array_contains("_there", light)
    known = numbering.select("file").join(there, "file", "left").select("file", F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("no heavy or no light domain in "), "file")).cast("boolean")).alias("_whole"))
    return out.join(known, "file").where("_whole").select(*out.columns)


def main_features(atoms: DataFrame, names: dict[str, Sequence[str]], types: Sequence[str]) -> DataFrame:
    """(file, model, chain_id, sequence, aa_types, atom_positions, atom_exists, b_factors): one row a chain, in the order of its residues.

    names has, for each residue name, its atoms in their places, all lists of one length with "" for no atom; types the letters whose places are aa_types,
    unknown ones after the last. A place without an atom has zeros. Residues without a CA atom go.
    """
    size = max(map(len, names.values()))
    order = lookup({r: "\t".join(a) for r, a in names.items()})
    place = F.split(F.element_at(order, F.col("res_name")), "\t")
    key = ["file", "model", "chain_id", "res_seq", "i_code"]
    held = F.map_from_entries(F.collect_list(F.struct("atom_name", F.struct("x", "y", "z", F.coalesce("b_factor", F.lit(0.0)).alias("b")))))
    one = atoms.where("not hetero").dropDuplicates([*key, "atom_name"]).groupBy(*key).agg(F.first("res_name").alias("res_name"), held.alias("held"))
    names_of = F.coalesce(place, F.array_repeat(F.lit(""), size))
    found = F.transform(names_of, lambda a: F.element_at("held", a))
    letter = F.coalesce(F.element_at(lookup(THREE_TO_ONE), F.col("res_name")), F.lit("X"))
    number = F.array_position(F.array(*map(F.lit, types)), letter).cast("int") - 1
    each = one.where(F.element_at("held", F.lit("CA")).isNotNull()).select(*key, F.struct(
        "res_seq", "i_code", letter.alias("letter"), F.when(number < 0, len(types)).otherwise(number).alias("type"),
        F.transform(found, lambda p: F.when(p.isNull(), F.array(*[F.lit(0.0)] * 3)).otherwise(F.array(p["x"], p["y"], p["z"]))).alias("xyz"),
        F.transform(found, lambda p: p.isNotNull()).alias("there"), F.transform(found, lambda p: F.coalesce(p["b"], F.lit(0.0))).alias("b"),
    ).alias("r"))
    rows = each.groupBy("file", "model", "chain_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))  # a chain's residues
    of = lambda field: F.transform("rows", lambda r: r[field])
    return rows.select("file", "model", "chain_id", F.array_join(of("letter"), "").alias("sequence"), of("type").alias("aa_types"), of("xyz").alias("atom_positions"), of("there").alias("atom_exists"), of("b").alias("b_factors"))


def backbone_frames(atoms: DataFrame) -> DataFrame:
    """(file, model, chain_id, res_seq, i_code, rotation, translation) of the residues with N, CA and C atoms.

    The frame stands at the CA atom, its first axis toward C, the second in the plane of N on N's side, the third across both. rotation has the axes as
    columns, so that rotation * local + translation are the coordinates. Null where the three lie on a line.
    """
    key = ["file", "model", "chain_id", "res_seq", "i_code"]
    point = lambda name: F.max(F.when(F.col("atom_name") == name, F.array("x", "y", "z"))).alias(name)
    points = atoms.where("not hetero and atom_name in ('N', 'CA', 'C')").dropDuplicates([*key, "atom_name"]).groupBy(*key).agg(point("N"), point("CA"), point("C")).where("N is not null and CA is not null and C is not null")
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    unit = lambda a: F.when(dot(a, a) > 1e-16, F.transform(a, lambda x: x / F.sqrt(dot(a, a))))
    col, get = F.col, lambda c, i: F.get(F.col(c), i % 3)
    out = points.withColumn("_x", unit(less(col("C"), col("CA")))).withColumn("_n", less(col("N"), col("CA"))).withColumn("_along", dot(col("_n"), col("_x")))
    out = out.withColumn("_y", unit(F.zip_with("_n", "_x", lambda n, x: n - x * F.col("_along"))))
    out = out.withColumn("_z", F.array(*[get("_x", i + 1) * get("_y", i + 2) - get("_x", i + 2) * get("_y", i + 1) for i in range(3)]))
    rotation = F.when(col("_x").isNotNull() & col("_y").isNotNull(), F.array(*[F.array(get("_x", i), get("_y", i), get("_z", i)) for i in range(3)]))
    return out.select(*key, rotation.alias("rotation"), col("CA").alias("translation"))


#: The atoms of a residue's backbone.
BACKBONE = ("N", "CA", "C", "O")


def trajectory_atoms(steps: DataFrame, chain: str = "A", names: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The atom table of a trajectory, a model for each step: steps is (file, step, res_seq, res_name, positions, b_factor).

    positions is an array of coordinates in the order of the residue's atoms of names, or of the backbone's; places with the name "" and null ones have
    no atom, and rows with null positions are residues left out. A null b_factor counts as 100.
    """
    atoms_of = F.element_at(lookup({r: "\t".join(a) for r, a in names.items()}), F.col("res_name")) if names else F.lit("\t".join(BACKBONE))
    each = steps.where("positions is not null").select("file", F.col("step").alias("model"), "res_seq", "res_name", F.coalesce("b_factor", F.lit(100.0)).alias("b_factor"), F.posexplode(F.arrays_zip(F.split(atoms_of, "\t").alias("name"), F.col("positions").alias("p"))).alias("at", "a"))
    known = each.where("a.p is not null and a.name <> ''")
    serial = F.row_number().over(Window.partitionBy("file", "model").orderBy("res_seq", "at"))  # a step's atoms
    position = [F.get(F.col("a.p"), i).cast("double").alias(c) for i, c in enumerate("xyz")]
    return known.select("file", serial.alias("serial"), F.col("model").cast("int").alias("model"), F.lit(chain).alias("chain_id"), F.col("res_seq").cast("int").alias("res_seq"), F.lit("").alias("i_code"), "res_name", F.col("a.name").alias("atom_name"), *position, F.lit(1.0).alias("occupancy"), F.col("b_factor").cast("double").alias("b_factor"), F.substring("a.name", 1, 1).alias("element"), F.lit(False).alias("hetero"))


_FIELD = re.compile(r"""'(?:[^']|'(?=\S))*'|"(?:[^"]|"(?=\S))*"|\S+""")


def rewrite_loop(text: str, category: str, key: str, changes: dict[str, dict[str, str]]) -> str:
    """A CIF text with other values in some fields of one loop; every other byte stays.

    changes has, for the value of a row's field key, the new values of fields. A value is put into the room of the old one and the
    blanks behind it, if it fits. A field that the loop lacks fails.
    """
    out, columns, inside, in_text = [], None, False, False
    for line in text.splitlines(keepends=True):
        word = line.strip()
        if line.startswith(";") or in_text:  # a text of several lines
            in_text ^= line.startswith(";")
        elif word == "loop_":
            columns, inside = [], False
        elif columns is not None and word.startswith("_") and not inside:
            columns = [*columns, word.split()[0]]
        elif columns and columns[0].startswith(category + ".") and word and word[0] not in "#_":
            inside = True
            fields = list(_FIELD.finditer(line))
            new = changes.get(fields[columns.index(f"{category}.{key}")].group(), {})
            for at, value in sorted(((columns.index(f"{category}.{c}"), v) for c, v in new.items()), reverse=True):
                line = _replaced(line, *fields[at].span(), value)
        else:
            columns, inside = None, False
        out.append(line)
    return "".join(out)


def _replaced(line: str, start: int, end: int, value: str) -> str:
    """The line with a field's value replaced: padded to the old width, or grown into the blanks behind it but for one."""
    more = len(value) - (end - start)
    blanks = len(line[end:]) - len(line[end:].lstrip(" "))
    return line[:start] + value + " " * -more + line[end + min(max(more, 0), max(blanks - 1, 0)) :]


def update_mmcif(spark: SparkSession, path: str | list[str], atoms: DataFrame, out: str, places: int = 3) -> None:
    """The mmCIF files with the coordinates of an atom table, matched by file and serial: a folder entry=<name>/ of text for each file.

    Every other category, and every other field of the atoms, is carried through as it is; atoms that the table lacks keep their
    coordinates. b_factor and occupancy follow too, if the table has them and the file has the fields. A file and its atoms fit one row.
    """
    texts = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    extra = [c for c in ("occupancy", "b_factor") if c in atoms.columns]
    new = atoms.select("file", F.struct(F.col("serial").cast("string").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", *extra)]).alias("a"))
    both = texts.join(new.groupBy("file").agg(F.collect_list("a").alias("rows")), "file", "left")

    def rewritten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for r in batch.itertuples():
                text = (gzip.decompress(r.content) if r.file.endswith(".gz") else r.content).decode()
                fields = {"x": "Cartn_x", "y": "Cartn_y", "z": "Cartn_z"} | {c: f for c, f in (("occupancy", "occupancy"), ("b_factor", "B_iso_or_equiv")) if c in extra and f"_atom_site.{f}" in text}
                changes = {a["id"]: {f: f"{a[c]:.{places if c in 'xyz' else 2}f}" for c, f in fields.items() if a[c] is not None} for a in (r.rows if r.rows is not None else ())}
                name = re.sub(r"\.(cif|mmcif)(\.gz)?$", "", r.file.rsplit("/", 1)[-1])
                done.append((name, rewrite_loop(text, "_atom_site", "id", changes).removesuffix("\n")))  # the writer ends it
            yield pd.DataFrame(done, columns=["entry", "value"])

    both.mapInPandas(rewritten, "entry string, value string").write.mode("overwrite").partitionBy("entry").text(out)
