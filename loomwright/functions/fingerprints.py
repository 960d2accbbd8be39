"""Circular fingerprints of molecules, from the tables of their molfile records.

Every atom starts with a hash of itself: element, neighbours, bond orders and charge. A round hashes each atom's number with those of its neighbours
and the bonds to them, in sorted order, so that after r rounds a number stands for all that is at most r bonds away, however the atoms
are numbered. The numbers of all rounds, folded to a width, are the fingerprint. A molecule is one row, and the rounds are expressions on its
arrays: nothing is shuffled, and no toolkit is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .random import hash_number

#: Charges by their code in an atom line; other codes are none.
CHARGES = {1: 3, 2: 2, 3: 1, 5: -1, 6: -2, 7: -3}


def _number(line: Column, start: int, size: int) -> Column:
    return F.coalesce(F.trim(F.substring(line, start, size)).try_cast("int"), F.lit(0))


def _range(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def read_molblock(molblock: Column) -> Column:
    """struct(atoms, bonds) of a V2000 molfile record: atoms of (element, charge), bonds of (a, b, kind) with places from 0.

    Null for null and for records of another version, or with fewer lines than they announce. Charges are those of the M  CHG lines if there are any.
    """
    lines = F.split(molblock, "\r?\n")
    head = F.get(lines, 3)
    atoms, bonds = _number(head, 1, 3), _number(head, 4, 3)
    charge = F.create_map(*[F.lit(x) for pair in CHARGES.items() for x in pair])
    listed = F.flatten(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("M  CHG"))), lambda x: F.transform(_range(_number(x, 7, 3)), lambda i: F.struct((F.trim(F.substring(x, 10 + 8 * i, F.lit(4))).try_cast("int") - 1).alias("at"), F.trim(F.substring(x, 14 + 8 * i, F.lit(4))).try_cast("int").alias("charge")))))

    def atom(i: Column) -> Column:
        line = F.get(lines, 4 + i)
        own = F.get(F.filter(listed, lambda c: c["at"] == i), 0)["charge"]
        return F.struct(F.trim(F.substring(line, 32, 3)).alias("element"), F.when(F.size(listed) > 0, F.coalesce(own, F.lit(0))).otherwise(F.coalesce(F.element_at(charge, _number(line, 37, 3)), F.lit(0))).alias("charge"))

    def bond(i: Column) -> Column:
        line = F.get(lines, 4 + atoms + i)
        return F.struct((_number(line, 1, 3) - 1).alias("a"), (_number(line, 4, 3) - 1).alias("b"), _number(line, 7, 3).alias("kind"))

    whole = head.isNotNull() & ~F.contains(head, F.lit("V3000")) & (F.size(lines) >= 4 + atoms + bonds)
    return F.when(whole, F.struct(F.transform(_range(atoms), atom).alias("atoms"), F.transform(_range(bonds), bond).alias("bonds")))


def _neighbours(molecule: Column) -> Column:
    """For each atom, the (place, kind) of its neighbours."""
    toward = lambda i: F.filter(F.transform(molecule["bonds"], lambda b: F.struct(F.when(b["a"] == i, b["b"]).when(b["b"] == i, b["a"]).alias("to"), b["kind"].alias("kind"))), lambda x: x["to"].isNotNull())
    return F.transform(_range(F.size(molecule["atoms"])), toward)


def _next_round(r: int, old: Column, neighbours: Column) -> Column:
    def around(of: Column) -> Column:
        sided = F.array_sort(F.transform(of, lambda n: F.struct(n["kind"].alias("kind"), F.get(old, n["to"]).alias("h"))))
        return F.array_join(F.transform(sided, lambda n: F.concat_ws("-", n["kind"].cast("string"), n["h"].cast("string"))), ",")

    return F.transform(F.arrays_zip(old.alias("own"), neighbours.alias("next")), lambda x: hash_number(str(r), x["own"], around(x["next"])))


def with_fingerprint(df: DataFrame, molecule: str, radius: int = 2, width: int = 2048, name: str = "fingerprint") -> DataFrame:
    """df with the sorted places, from 0 to width - 1, of a molecule's set bits; molecule is a column as of read_molblock, null gives null.

    A molecule without atoms has no bits. Repeated environments count once.
    """
    m = F.col(molecule)
    out = df.withColumn("_next", _neighbours(m))
    start = F.transform(F.arrays_zip(m["atoms"].alias("atom"), F.col("_next").alias("next")), lambda x: hash_number("0", x["atom"]["element"], F.size(x["next"]), F.aggregate(x["next"], F.lit(0), lambda s, n: s + n["kind"]), x["atom"]["charge"]))
    out = out.withColumn("_h0", start)
    for r in range(1, radius + 1):
        out = out.withColumn(f"_h{r}", _next_round(r, F.col(f"_h{r - 1}"), F.col("_next")))
    every = F.flatten(F.array(*[F.col(f"_h{r}") for r in range(radius + 1)]))
    bits = F.array_sort(F.array_distinct(F.transform(every, lambda h: F.pmod(h, F.lit(width)).cast("int"))))
    return out.withColumn(name, bits).drop("_next", *[f"_h{r}" for r in range(radius + 1)])


def bit_vector(places: Column, width: int = 2048) -> Column:
    """1.0 at the places of set bits, 0.0 elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.array_contains(places, j).cast("double"))


def tanimoto(a: Column, b: Column) -> Column:
    """Common set bits over all set bits; 1 for two fingerprints without any, null for null."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(1.0)))


def sdf_fingerprints(records: DataFrame, radius: int = 2, width: int = 2048) -> DataFrame:
    """(row_idx, title, fingerprint) of the records of an SDF file, each distinct record hashed once; null where it is no V2000 table."""
    distinct = records.select("molblock").distinct().withColumn("_molecule", read_molblock(F.col("molblock")))
    known = with_fingerprint(distinct, "_molecule", radius, width).select("molblock", "fingerprint")
    return records.join(known, "molblock", "left").select("row_idx", "title", "fingerprint")
