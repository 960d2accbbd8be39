"""Joins by distance, classes of chain pairs, crops and superposition."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.random import hash_number
from ..staging import stage
from .alignment import place_aligner


def distance(axes: Sequence[str] = ("x", "y", "z")) -> Column:
    """Distance of the points a_ and b_."""
    return F.sqrt(sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in axes), F.lit(0.0)))


def grid_join(left: DataFrame, right: DataFrame, radius: float, within: Sequence[str] = (), axes: Sequence[str] = ("x", "y", "z"), condition: Column | None = None) -> DataFrame:
    """The pairs of points at most radius apart with equal columns of within: columns of left and right prefixed a_ and b_, and d.

    Points are put into cells as wide as the radius; those of the right side also into the neighbouring
    cells, so that each pair meets in exactly one. The join is on cells, with the distance as its condition.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns], *[cell(c).alias(f"_ga{i}") for i, c in enumerate(axes)])
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns], *[cell(c).alias(f"_c{i}") for i, c in enumerate(axes)])
    for i in range(len(axes)):
        b = b.withColumn(f"_gb{i}", F.explode(F.array(*[F.col(f"_c{i}") + k for k in (-1, 0, 1)])))
    match = distance(axes) <= radius
    for x, y in [*((f"a_{w}", f"b_{w}") for w in within), *((f"_ga{i}", f"_gb{i}") for i in range(len(axes)))]:
        match = match & (F.col(x) == F.col(y))
    if condition is not None:
        match = match & condition
    return a.join(b, match).withColumn("d", distance(axes)).select(*[f"a_{c}" for c in left.columns], *[f"b_{c}" for c in right.columns], "d")


def pair_combinations(df: DataFrame, key: str, within: Sequence[str] = ()) -> DataFrame:
    """(within, key_a, key_b): unordered pairs of the distinct keys of each group. For groups of few keys, as of chains."""
    keys = df.select(*within, F.col(key).alias("key_a")).distinct()
    other = keys.withColumnRenamed("key_a", "key_b")
    joined = keys.join(other, list(within)) if within else keys.join(other, F.col("key_a") < F.col("key_b"))
    return joined.where("key_a < key_b")


def chain_sequences(points: DataFrame, complex_col: str, chain: str, order: str, letter: str) -> DataFrame:
    """(complex, chain, length, sequence); a chain is one row, as long as its residues."""
    one = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(letter).alias("l"))))
    return points.groupBy(complex_col, chain).agg(F.count("*").alias("length"), F.array_join(F.transform(one, lambda r: r["l"]), "").alias("sequence"))


def interaction_classes(points: DataFrame, chains: DataFrame, complex_col: str, chain: str, radius: float = 10.0, least_pairs: int = 4, least_length: int = 10) -> DataFrame:
    """(complex, chain_a, chain_b, pairs, class) of the pairs of long enough chains of a complex.

    interacting from least_pairs pairs of residues at most radius apart, too_few below, non_interacting for none;
    the last two are left out of a complex in which two chains have equal sequences. points has x, y, z;
    chains has complex, chain, length, sequence.
    """
    long = chains.where(F.col("length") >= least_length)
    twins = chains.groupBy(complex_col, "sequence").count().where("count > 1").select(complex_col).distinct().withColumn("_twins", F.lit(True))
    pairs = pair_combinations(long, chain, [complex_col])
    near = grid_join(points, points, radius, [complex_col], condition=F.col(f"a_{chain}") < F.col(f"b_{chain}"))
    counts = near.groupBy(F.col(f"a_{complex_col}").alias(complex_col), F.col(f"a_{chain}").alias("key_a"), F.col(f"b_{chain}").alias("key_b")).agg(F.count("*").alias("pairs"))
    joined = pairs.join(counts, [complex_col, "key_a", "key_b"], "left").join(twins, complex_col, "left").fillna({"pairs": 0})
    kind = F.when(F.col("pairs") >= least_pairs, "interacting").when(F.col("pairs") > 0, "too_few").otherwise("non_interacting")
    return joined.withColumn("class", kind).where((F.col("class") == "interacting") | F.col("_twins").isNull()).select(complex_col, F.col("key_a").alias("chain_a"), F.col("key_b").alias("chain_b"), "pairs", "class")


def nearest(points: DataFrame, anchor: Sequence[float], size: int, order: str, eps: float = 1e-6, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The size points nearest to the anchor, equal distances by order."""
    d = F.sqrt(sum(((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(axes, anchor, strict=True)), F.lit(0.0)))
    return points.withColumn("d", d).orderBy(F.col("d") + F.col(order) * eps, order).limit(size)


def running_offsets(chains: DataFrame, complex_col: str, order: str, length: str, gap: int = 0) -> DataFrame:
    """chains with offset: the lengths before in the complex, each with a gap."""
    before = Window.partitionBy(complex_col).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chains.withColumn("offset", F.coalesce(F.sum(F.col(length) + gap).over(before), F.lit(0)))


def rigid_fit(moving: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, translation and RMSD that lay moving on fixed (Kabsch)."""
    a, b = moving.mean(axis=0), fixed.mean(axis=0)
    u, _, vt = np.linalg.svd((moving - a).T @ (fixed - b))
    flip = np.diag([1.0] * (moving.shape[1] - 1) + [np.sign(np.linalg.det(u @ vt)) or 1.0])
    turn = u @ flip @ vt
    shift = b - a @ turn
    return turn, shift, float(np.sqrt(((moving @ turn + shift - fixed) ** 2).sum(axis=1).mean()))


def superpose(moving: DataFrame, fixed: DataFrame, complex_col: str, order: str) -> DataFrame:
    """(complex, turn, shift, rmsd, n) that lays the moving points of each complex on the fixed ones with equal order.

    A complex's points fit one task. Without three common points all but n is null.
    """

    def fit(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        both = a.merge(b, on="at").sort_values("at")
        if len(both) < 3:
            return pd.DataFrame({"complex": [key[0]], "turn": [None], "shift": [None], "rmsd": [None], "n": [len(both)]})
        turn, shift, rmsd = rigid_fit(both[["x", "y", "z"]].to_numpy(), both[["fx", "fy", "fz"]].to_numpy())
        return pd.DataFrame({"complex": [key[0]], "turn": [turn.ravel().tolist()], "shift": [shift.tolist()], "rmsd": [rmsd], "n": [len(both)]})

    kind = moving.schema[complex_col].dataType.simpleString()
    first = moving.select(F.col(complex_col).alias("complex"), F.col(order).alias("at"), *[F.col(c).alias(c) for c in "xyz"])
    second = fixed.select(F.col(complex_col).alias("complex_fixed"), F.col(order).alias("at"), *[F.col(c).alias(f"f{c}") for c in "xyz"])
    grouped = first.groupBy("complex").cogroup(second.groupBy("complex_fixed"))
    return grouped.applyInPandas(fit, f"complex {kind}, turn array<double>, shift array<double>, rmsd double, n long")


def apply_rigid(points: DataFrame, fits: DataFrame, complex_col: str) -> DataFrame:
    """points with x, y, z turned and shifted by their complex's fit; those without one stay."""
    joined = points.join(fits.select(F.col("complex").alias("_complex"), "turn", "shift"), F.col(complex_col) == F.col("_complex"), "left")
    moved = {c: F.coalesce(sum((F.col(a) * F.col("turn")[3 * i + j] for i, a in enumerate("xyz")), F.lit(0.0)) + F.col("shift")[j], F.col(c)) for j, c in enumerate("xyz")}
    return joined.withColumns(moved).select(*points.columns)


def spatial_crop(points: DataFrame, complex_col: str, chain: str, order: str, size: int, radius: float, seed: int = 0) -> DataFrame:
    """The size points of each complex nearest to a drawn point that is less than radius from another chain's; those at the start of the order for a complex without one."""
    near = grid_join(points, points, radius, [complex_col], condition=F.col(f"a_{chain}") != F.col(f"b_{chain}")).where(F.col("d") < radius)
    drawn = F.struct(*[F.col(f"a_{c}").alias(c) for c in "xyz"])
    first = F.min_by(drawn, F.struct(hash_number(seed, F.col(f"a_{chain}"), F.col(f"a_{order}")), F.col(f"a_{order}"))).alias("at")
    anchors = stage(near.groupBy(F.col(f"a_{complex_col}").alias("_complex")).agg(first), "anchors")
    joined = points.join(anchors, F.col(complex_col) == F.col("_complex"), "left")
    d = F.sqrt(sum(((F.col(c) - F.col(f"at.{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy(complex_col).orderBy(F.coalesce(d, F.lit(0.0)), order, chain))
    return joined.withColumn("_rank", rank).where(F.col("_rank") <= size).select(*points.columns)


def flexible_superpose(moving: DataFrame, fixed: DataFrame, complex_col: str, order: str, letter: str, least_run: int = 8, **scores) -> DataFrame:
    """superpose() of the residues that an alignment of the sequences puts together, in runs of at least least_run.

    order numbers a chain's residues from 0; complexes are paired by name. A complex without such a run has no fit.
    """
    text = lambda df, name: df.groupBy(F.col(complex_col).alias("_c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, letter))), lambda r: r[letter]), "").alias(name))
    both = text(moving, "_a").join(text(fixed, "_b"), "_c")
    places = stage(both.select("_c", F.explode(place_aligner(least_run, **scores)("_a", "_b")).alias("p")).select("_c", "p.a", "p.b"), "places")
    numbered = lambda df, at: df.select(F.col(complex_col).alias("_c"), F.col(order).alias(at), "x", "y", "z").join(places, ["_c", at]).select(F.col("_c").alias(complex_col), F.col("a").alias("_at"), "x", "y", "z")
    return superpose(numbered(moving, "a"), numbered(fixed, "b"), complex_col, "_at")
