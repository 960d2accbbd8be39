"""Molecules of SMILES as tables of atoms and bonds, and back, without a toolkit.

A molecule is struct(atoms, bonds): atoms of (element, charge, aromatic, hydrogens, isotope), bonds of (a, b, kind) with places from 0, kind 1 to 3 or
4 for aromatic and 5 for quadruple; hydrogens are those told in brackets. Marks of handedness and of directions at double bonds are read over and not kept. Valences are
not checked.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .random import hash_number

MOLECULE = "atoms array<struct<element: string, charge: int, aromatic: boolean, hydrogens: int, isotope: int>>, bonds array<struct<a: int, b: int, kind: int>>"
#: Elements written without brackets, those that can be aromatic, and the signs of bonds.
ORGANIC, AROMATIC = ("B", "C", "N", "O", "P", "S", "F", "Cl", "Br", "I"), ("b", "c", "n", "o", "p", "s", "se", "as", "te")
KINDS = {"-": 1, "=": 2, "#": 3, ":": 4, "$": 5, "/": 1, "\\": 1}
_SIGNS = {1: "-", 2: "=", 3: "#", 4: ":", 5: "$"}
_TOKEN = re.compile(
    r"""\[(?P<isotope>\d+)?(?P<inside>[A-Z][a-z]?|se|as|te|[bcnops]|\*)(?:@{1,2}(?:[A-Z]{2}\d+)?)?(?P<hydrogens>H\d*)?(?P<charge>\+{2,}|-{2,}|[+-]\d*)?(?::\d+)?\]
    |(?P<bare>Cl|Br|[BCNOPSFIbcnops*])
    |(?P<bond>[-=\#:$/\\])
    |%(?P<two>\d\d)|(?P<one>\d)
    |(?P<mark>[().])""",
    re.VERBOSE,
)


def _charge(text: str | None) -> int:
    if not text:
        return 0
    size = int(text[1:]) if text[1:].isdigit() else len(text)
    return size if text[0] == "+" else -size


def parse(text: str) -> tuple[list[tuple], list[tuple]]:
    """(atoms, bonds) of a SMILES; ValueError if it is none."""
    atoms: list[tuple] = []
    bonds: dict[tuple[int, int], int] = {}
    open_rings: dict[int, tuple[int, int | None]] = {}
    branches: list[int] = []
    last, kind, at = None, None, 0

    def bind(a: int, b: int, told: int | None) -> None:
        pair = (min(a, b), max(a, b))
        if a == b or pair in bonds:
            raise ValueError("an atom is bound to itself, or twice to another")
        bonds[pair] = told or (4 if atoms[a][2] and atoms[b][2] else 1)

    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"cannot read {text[at : at + 10]!r}")
        at = m.end()
        element = m["inside"] or m["bare"]
        if element:
            aromatic = element in AROMATIC
            hydrogens = int(m["hydrogens"][1:] or 1) if m["hydrogens"] else 0
            atoms.append((element.capitalize() if aromatic else element, _charge(m["charge"]), aromatic, hydrogens if m["inside"] else None, int(m["isotope"]) if m["isotope"] else None))
            if last is not None:
                bind(last, len(atoms) - 1, kind)
            elif kind:
                raise ValueError("a bond without a first atom")
            last, kind = len(atoms) - 1, None
        elif m["bond"]:
            if kind or last is None:
                raise ValueError("a bond in a wrong place")
            kind = KINDS[m["bond"]]
        elif m["two"] or m["one"]:
            ring = int(m["two"] or m["one"])
            if last is None:
                raise ValueError("a ring without an atom")
            if ring in open_rings:
                other, told = open_rings.pop(ring)
                if told and kind and told != kind:
                    raise ValueError("two kinds of one bond")
                bind(other, last, told or kind)
            else:
                open_rings[ring] = (last, kind)
            kind = None
        elif kind:
            raise ValueError("a bond without a second atom")
        elif m["mark"] == "(":
            if last is None:
                raise ValueError("a branch without an atom")
            branches.append(last)
        elif m["mark"] == ")":
            last = branches.pop() if branches else None
            if last is None:
                raise ValueError("a branch is closed that was not open")
        else:
            last = None
    if not atoms or open_rings or branches or kind:
        raise ValueError("an open ring, branch or bond")
    return atoms, [(a, b, k) for (a, b), k in bonds.items()]


def _atom(atom: tuple) -> str:
    element, charge, aromatic, hydrogens, isotope = atom
    name = element.lower() if aromatic else element
    if not charge and hydrogens is None and isotope is None and (element in ORGANIC or element == "*"):
        return name
    count = "" if not hydrogens else "H" if hydrogens == 1 else f"H{hydrogens}"
    sign = "" if not charge else ("+" if charge > 0 else "-") + (str(abs(charge)) if abs(charge) > 1 else "")
    return f"[{isotope or ''}{name}{count}{sign}]"


def write(atoms: list[tuple], bonds: list[tuple], order: list[int] | None = None) -> str:
    """A SMILES of a molecule, whose walk begins at the first atoms of the order, and prefers them; the atoms' own order if none is given."""
    rank = {a: i for i, a in enumerate(order if order is not None else range(len(atoms)))}
    near: list[dict[int, int]] = [{} for _ in atoms]
    for a, b, kind in bonds:
        near[a][b] = near[b][a] = kind

    def sign(a: int, b: int) -> str:
        kind, both = near[a][b], atoms[a][2] and atoms[b][2]
        return "" if kind == (4 if both else 1) else _SIGNS[kind]

    seen: set[int] = set()
    parent: dict[int, int | None] = {}
    children: dict[int, list[int]] = {a: [] for a in rank}
    closes: dict[int, list[tuple[int, int]]] = {a: [] for a in rank}  # of an atom, rings to those before and after it
    roots = []
    for root in sorted(rank, key=rank.get):
        if root in seen:
            continue
        roots.append(root)
        todo: list[tuple[int, int | None]] = [(root, None)]
        while todo:
            a, came = todo.pop()
            if a in seen:
                continue
            seen.add(a)
            parent[a] = came
            if came is not None:
                children[came].append(a)
            todo += [(b, a) for b in sorted(near[a], key=rank.get, reverse=True) if b not in seen]
    rings = sorted((rank[a], rank[b], a, b) for a, b, _ in bonds if parent[a] != b and parent[b] != a)
    for _, _, a, b in rings:
        closes[a].append((b, 0))
        closes[b].append((a, 0))
    free, numbers = list(range(99, 0, -1)), {}

    def digits(a: int) -> str:
        out = ""
        closed = []
        for b, _ in closes[a]:
            pair = (min(a, b), max(a, b))
            if pair in numbers:
                number = numbers.pop(pair)
                closed.append(number)
                out += (str(number) if number < 10 else f"%{number}")
            else:
                numbers[pair] = number = free.pop()
                out += sign(a, b) + (str(number) if number < 10 else f"%{number}")
        free.extend(sorted(closed, reverse=True))
        free.sort(reverse=True)
        return out

    parts: list[str] = []
    for i, root in enumerate(roots):
        if i:
            parts.append(".")
        stack: list = [root]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(item)
                continue
            if parent[item] is not None:
                parts.append(sign(parent[item], item))
            parts.append(_atom(atoms[item]) + digits(item))
            own = children[item]
            if own:
                stack.append(own[-1])
                for child in reversed(own[:-1]):
                    stack += [")", child, "("]
    return "".join(parts)


def _molecules(values: pd.Series) -> pd.DataFrame:
    rows = []
    for text in values:
        try:
            atoms, bonds = parse(text)
        except (ValueError, TypeError):
            atoms = bonds = None
        rows.append((atoms, bonds))
    keys, ends = ("element", "charge", "aromatic", "hydrogens", "isotope"), ("a", "b", "kind")
    of = lambda names, found: None if found is None else [dict(zip(names, x, strict=True)) for x in found]
    return pd.DataFrame({"atoms": [of(keys, a) for a, _ in rows], "bonds": [of(ends, b) for _, b in rows]}, dtype=object)


def read(smiles: Column | str) -> Column:
    """The molecule; its atoms and bonds are null where the SMILES cannot be read."""
    return F.pandas_udf(_molecules, MOLECULE)(smiles)


def _tables(molecule) -> tuple[list[tuple], list[tuple]]:
    """Lists of atoms and bonds of a row; molfile atoms have no more than element and charge, and are aromatic by their bonds."""
    bonds = [(b["a"], b["b"], b["kind"]) for b in molecule["bonds"]]
    ringed = {x for a, b, kind in bonds if kind == 4 for x in (a, b)}
    told = lambda a, c: None if a.get(c) is None or a[c] != a[c] else int(a[c])
    return [(a["element"], a["charge"], bool(a.get("aromatic", i in ringed)), told(a, "hydrogens"), told(a, "isotope")) for i, a in enumerate(molecule["atoms"])], bonds


def _written(rows, orders=None) -> pd.Series:
    out = []
    for i, m in enumerate(rows):
        if m is None or m["atoms"] is None or not len(m["atoms"]):
            out.append(None)
            continue
        atoms, bonds = _tables(m)
        out.append(write(atoms, bonds, None if orders is None else np.random.default_rng(int(orders[i])).permutation(len(atoms)).tolist()))
    return pd.Series(out, dtype="object")


def written(molecule: Column, key: Column | None = None, seed: int = 0) -> Column:
    """A SMILES of a molecule of read() or of a molfile record, in its atoms' own order, or in one drawn from a key and the seed; null for none.

    molecule is a column of a table: Spark takes no expression with lambda functions, as read_molblock is, for an argument of a Python function.
    """

    @F.pandas_udf("string")
    def plain(molecules: pd.DataFrame) -> pd.Series:
        return _written(molecules.to_dict("records"))

    @F.pandas_udf("string")
    def drawn(molecules: pd.DataFrame, draws: pd.Series) -> pd.Series:
        return _written(molecules.to_dict("records"), draws.tolist())

    # not taken apart or evaluated twice by the optimizer, as where the result is also filtered
    return plain.asNondeterministic()(molecule) if key is None else drawn.asNondeterministic()(molecule, hash_number(F.lit(str(seed)), key.cast("string")))
