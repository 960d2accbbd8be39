"""SMILES columns. What needs a chemistry toolkit uses one if it is installed; the plain check needs none."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import smiles
from .fingerprints import read_molblock
from .random import hash_number

try:
    from rdkit import Chem
except ImportError:  # optional
    Chem = None
try:
    import selfies
except ImportError:  # optional
    selfies = None


@F.pandas_udf(T.BooleanType())
def _well_formed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else is_well_formed(x)).astype("object")


def is_well_formed(smiles: str) -> bool:
    """Whether parentheses and brackets are balanced and every ring number is closed: a necessary condition only."""
    depth, rings, i, inside = 0, set(), 0, False
    while i < len(smiles):
        c = smiles[i]
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "]" or c.isspace():
            return False
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                return False
        elif c == "%" or c.isdigit():
            number = smiles[i + 1 : i + 3] if c == "%" else c
            rings ^= {number}
            i += 2 * (c == "%")
        i += 1
    return bool(smiles) and depth == 0 and not inside and not rings


@F.pandas_udf(T.StringType())
def _canonical(s: pd.Series) -> pd.Series:
    def one(x):
        mol = None if x is None else Chem.MolFromSmiles(x)
        return None if mol is None else Chem.MolToSmiles(mol)

    return s.map(one)


def canonical_smiles(s: Column) -> Column:
    """Canonical form, null where the molecule cannot be read; needs the toolkit."""
    if Chem is None:
        raise ImportError("canonical SMILES need rdkit")
    return _canonical(s)


def plain_smiles(s: Column, sanitize: bool = True, canonical: bool = False) -> Column:
    """SMILES read and written again, in the atoms' own order unless canonical; null where the molecule cannot be read.

    Without the toolkit by smiles.py, which keeps no handedness and does not sanitize; canonical needs the toolkit.
    """
    if Chem is None:
        if canonical:
            raise ImportError("canonical SMILES need rdkit")
        return smiles.written(smiles.read(s))

    @F.pandas_udf(T.StringType())
    def convert(values: pd.Series) -> pd.Series:
        read = values.map(lambda x: None if x is None else Chem.MolFromSmiles(x, sanitize=sanitize))
        return read.map(lambda m: None if m is None else Chem.MolToSmiles(m, canonical=canonical))

    return convert(s)


def shuffled_smiles(s: Column, key: Column, seed: int = 0) -> Column:
    """The molecule with its atoms in an order drawn from key and seed, null where it cannot be read; see plain_smiles."""
    if Chem is None:
        return smiles.written(smiles.read(s), key, seed)

    @F.pandas_udf(T.StringType())
    def convert(values: pd.Series, draws: pd.Series) -> pd.Series:
        out = []
        for x, draw in zip(values, draws, strict=True):
            mol = None if x is None else Chem.MolFromSmiles(x)
            order = None if mol is None else np.random.default_rng(draw).permutation(mol.GetNumAtoms()).tolist()
            out.append(None if mol is None else Chem.MolToSmiles(Chem.RenumberAtoms(mol, order), canonical=False))
        return pd.Series(out, dtype="object")

    return convert(s, hash_number(F.lit(str(seed)), key.cast("string")))


def to_selfies(s: Column) -> Column:
    """SELFIES of SMILES; needs the selfies package."""
    return _by_package(s, "encoder")


def from_selfies(s: Column) -> Column:
    """SMILES of SELFIES; needs the selfies package."""
    return _by_package(s, "decoder")


def _by_package(s: Column, name: str) -> Column:
    if selfies is None:
        raise ImportError("SELFIES need the selfies package")

    @F.pandas_udf(T.StringType())
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else getattr(selfies, name)(x))

    return convert(s)


def is_sanitizable(s: Column) -> Column:
    """Whether the toolkit takes the molecule; without it, the weaker check of is_well_formed."""
    return _well_formed(s) if Chem is None else _canonical(s).isNotNull()


def sanitizable_lines(df: DataFrame, smiles: str) -> DataFrame:
    """The rows, unchanged, whose SMILES can be sanitized."""
    return df.where(is_sanitizable(F.col(smiles)))


def sdf_to_smiles(molecules: DataFrame, prefix: str = "") -> DataFrame:
    """(id, smiles) of the readable records of read_sdf; ordinals count all records. Without the toolkit, records of the V2000 tables in their own order."""
    name = F.concat(F.lit(prefix), F.col("row_idx").cast("string")).alias("id")
    if Chem is None:
        read = molecules.select(name, F.explode(F.array(read_molblock(F.col("molblock")))).alias("_molecule"))  # a column of its own, see written()
        return read.select("id", smiles.written(F.col("_molecule")).alias("smiles")).where("smiles is not null")

    @F.pandas_udf(T.StringType())
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if (mol := Chem.MolFromMolBlock(x)) is None else Chem.MolToSmiles(mol))

    return molecules.select(name, convert("molblock").alias("smiles")).where("smiles is not null")
