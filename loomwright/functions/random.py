"""Reproducible pseudorandom columns, from hashes that other engines can compute too."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_number(*parts: Column | str | int) -> Column:
    """A number from 0 to 2^32 - 1: the first 8 hex digits of the MD5 of the parts joined by a colon."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_unit(*parts: Column | str | int) -> Column:
    """A double in [0, 1); see hash_number. Null parts are left out."""
    return hash_number(*parts) / F.lit(float(1 << 32))
