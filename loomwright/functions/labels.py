"""Labels derived from measurements."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_measure(s: Column) -> Column:
    """A concentration as a double: NA is null; <, > and = go; what follows ± or a hyphen goes; null if no number is left."""
    bare = F.regexp_replace(s, "[<>=]", "")
    cut = F.trim(F.substring_index(F.substring_index(bare, "±", 1), "-", 1))
    return F.when((F.trim(s) != "NA") & (F.trim(bare) != "NA"), cut.try_cast("double"))


def normalise_unit(value: Column, unit: Column, weight: Column) -> Column:
    """µg/ml as it is, µM times the molecular weight over 1000; null for other units."""
    return F.when(unit == "µg/ml", value).when(unit == "µM", value * weight / 1000)


def threshold_label(least: Column, low: float, high: float) -> Column:
    """1 up to low, 0 from high, -1 between or for null."""
    return F.when(least <= low, 1).when(least >= high, 0).otherwise(-1)


def activity_label(activities: Column, weight: Column, low: float = 25.0, high: float = 100.0) -> Column:
    """Struct of (least, most, label) over an array of struct<concentration, unit struct<name>>."""
    values = F.filter(F.transform(activities, lambda a: normalise_unit(parse_measure(a["concentration"]), a["unit"]["name"], weight)), lambda v: v.isNotNull())
    least = F.array_min(values)
    return F.struct(least.alias("least"), F.array_max(values).alias("most"), threshold_label(least, low, high).alias("label"))


def affinity(s: Column, most: float = 1e7) -> Column:
    """-log10 of nanomolars as text, with < and > stripped; null above most or where there is no positive number."""
    v = F.regexp_replace(s, "[<>]", "").try_cast("double")
    return F.when((v > 0) & (v <= most), -F.log10(v * 1e-9))
