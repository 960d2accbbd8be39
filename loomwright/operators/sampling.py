"""Splits, weights and minibatches. All draws come from hashes of keys, so reruns agree."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.random import hash_number, hash_unit
from .ordinals import number_in_groups, number_rows


def pick_set(u: Column, sets: Mapping[str, float]) -> Column:
    """The first set whose cumulative share is at least u; the last set is the fallback."""
    *first, last = sets
    total, out = 0.0, None
    for name in first:
        total += sets[name]
        out = (F.when if out is None else out.when)(u <= total, name)
    return F.lit(last) if out is None else out.otherwise(last)


def cluster_split(df: DataFrame, center: str, sets: Mapping[str, float], seed: int | str = 0, out: str = "set") -> DataFrame:
    """df with the set of its cluster: rows of one center are never parted."""
    return df.withColumn(out, pick_set(hash_unit(seed, F.col(center)), sets))


def temporal_split(df: DataFrame, date: str, bounds: Mapping[str, str], last: str, out: str = "set") -> DataFrame:
    """df with the first set whose bound is after the date; last for later dates, null for null."""
    chosen = None
    for name, bound in bounds.items():
        chosen = (F.when if chosen is None else chosen.when)(F.col(date) < F.lit(bound).cast("timestamp_ntz"), name)
    return df.withColumn(out, chosen.when(F.col(date).isNotNull(), last))


def split_summary(df: DataFrame, center: str, split: str = "set") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("members"), F.count_distinct(center).alias("centers"))


def inverse_cluster_weights(df: DataFrame, center: str, out: str = "inverse_balance_proportion") -> DataFrame:
    """df with its cluster's weight: inverse to the cluster's size, adding up to one over the clusters."""
    sizes = df.groupBy(center).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum(1 / F.col("_n")).alias("_total"))
    weights = sizes.select(F.col(center).alias("_center"), (1 / F.col("_n")).alias("_inverse"))
    joined = df.join(weights, F.col(center).eqNullSafe(F.col("_center")))
    return joined.withColumn(out, F.col("_inverse") / total.scalar()).drop("_center", "_inverse")


def fold_of_rows(df: DataFrame, key: str, folds: int, seed: int | str = 2580, out: str = "fold") -> DataFrame:
    """df in folds whose sizes differ by one at most, in an order drawn from the key, which is unique."""
    numbered = number_rows(df.withColumn("_u", hash_number(seed, F.col(key))), ["_u", key], "_n")
    return numbered.withColumn(out, F.pmod("_n", F.lit(folds)).cast("int")).drop("_u", "_n")


def concat_batches(spark, lengths: Sequence[int], pattern: Sequence[int], batches: int | None = None, see_all: int | None = None, exact: bool = True) -> DataFrame:
    """(minibatch_id, slot, dataset, sample_id) of concatenated datasets, pattern[d] samples of each in every minibatch.

    A dataset starts again when it is used up. Without batches, there are as many as show all of every dataset, or
    of the one numbered see_all. With exact=False the count of a dataset is the quotient plus the remainder.
    """
    if batches is None:
        need = lambda n, k: math.ceil(n / k) if exact else n // k + n % k
        counts = [need(n, k) for n, k in zip(lengths, pattern, strict=True)]
        batches = max(counts) if see_all is None else counts[see_all]
    slots, offset, at = [], 0, 0
    for d, (n, k) in enumerate(zip(lengths, pattern, strict=True)):
        slots += [(at + s, d, s, k, n, offset) for s in range(k)]
        offset, at = offset + n, at + k
    each = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(("slot", "dataset", "s", "k", "n", "offset"), row, strict=True)]) for row in slots])).alias("x")
    drawn = spark.range(batches).select(F.col("id").alias("minibatch_id"), each)
    turn = F.col("minibatch_id") * F.col("x.k") + F.col("x.s")
    return drawn.select("minibatch_id", "x.slot", "x.dataset", (F.col("x.offset") + F.pmod(turn, F.col("x.n"))).alias("sample_id"))


def class_batches(df: DataFrame, label: str, key: str, counts: Mapping, batches: int | None = None) -> DataFrame:
    """(minibatch_id, slot, label, key): counts[c] rows of each class in every minibatch, each class in order of key, again from its start when used up.

    Without batches, there are as many as show all of the class that lasts shortest. A class without rows fails.
    """
    known = df.where(F.col(label).isin(list(counts))).select(label, key)
    sizes = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row a class
    if missing := [c for c in counts if c not in sizes]:
        raise ValueError(f"no rows of {missing}")
    rarest = min(sizes, key=lambda c: (sizes[c], c))
    batches = batches or math.ceil(sizes[rarest] / counts[rarest])
    at, slots = 0, []
    for c, k in counts.items():
        slots += [(c, at + s, s, k, sizes[c]) for s in range(k)]
        at += k
    spark = df.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), *[F.lit(v).cast("long").alias(n) for n, v in zip(("slot", "s", "k", "n"), row, strict=True)]) for c, *row in slots])).alias("x")
    drawn = spark.range(batches).select(F.col("id").alias("minibatch_id"), each)
    drawn = drawn.select("minibatch_id", "x.slot", F.col("x.label").alias("_label"), F.pmod(F.col("minibatch_id") * F.col("x.k") + F.col("x.s"), F.col("x.n")).alias("_n"))
    numbered = number_in_groups(known, label, [key], "_ordinal")
    return drawn.join(numbered, (F.col("_label") == F.col(label)) & (F.col("_n") == F.col("_ordinal"))).select("minibatch_id", "slot", label, key)


def subset_window(df: DataFrame, key: str, size: int, epoch: int, mode: str = "fixed") -> DataFrame:
    """The rows of an epoch: consecutive windows of size rows in order of key, in cycles.

    A cycle has ceil(N / size) windows; in mode "reference" one less, but one at least.
    """
    rows = df.count()
    cycle = math.ceil(rows / size) if mode == "fixed" else max(1, math.ceil(rows / size) - 1)
    start = (epoch % max(cycle, 1)) * size
    return number_rows(df, [key], "_n").where((F.col("_n") >= start) & (F.col("_n") < start + size)).drop("_n")


def weighted_classes(df: DataFrame, label: str, weights: Mapping, key: str, seed: int = 0) -> DataFrame:
    """A sample in which classes stand in proportion to their weights, as large as the rows allow; rows are drawn by a hash of their key."""
    counts = {r[label]: r["count"] for r in df.where(F.col(label).isin(list(weights))).groupBy(label).count().collect()}
    scale = min((counts[c] / w for c, w in weights.items() if w and counts.get(c)), default=0)
    share = F.lit(0.0)
    for c, w in weights.items():
        if counts.get(c):
            share = F.when(F.col(label) == c, min(1.0, scale * w / counts[c])).otherwise(share)
    return df.where(hash_unit(seed, F.col(key)) < share)
