"""Clusters of sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.random import hash_number
from ..staging import stage
from . import alignment
from .relational import first_wins


def exact_clusters(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """(center, id): equal sequences, with the smallest key as center. Rows without a sequence are left out."""
    known = df.where(F.col(sequence).isNotNull()).select(F.col(key).alias("id"), F.col(sequence).alias("s"))
    centers = stage(known.groupBy("s").agg(F.min("id").alias("center")), "centers")
    return known.join(centers, "s").select("center", "id")


def _same_letters(a: str, b: str) -> float:
    """Share of the shorter sequence's letters that an alignment without gaps, at the best of all shifts, has equal."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    at = long.find(short)
    if at >= 0:
        return 1.0
    s, t = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (short, long))
    windows = np.lib.stride_tricks.sliding_window_view(t, len(s))
    step = max(1, (1 << 20) // len(s))  # windows compared at once
    best = max(int((windows[i : i + step] == s).sum(axis=1).max()) for i in range(0, len(windows), step))
    return best / len(short)


@F.pandas_udf(T.DoubleType())
def identity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_same_letters(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def gapped(k: int, band: int, least: float):
    """A column function of two sequences: struct(identity, cover of the first, cover of the second); see alignment.gapped_identity."""

    @F.pandas_udf("identity double, cover_a double, cover_b double")
    def compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(alignment.gapped_identity(list(a), list(b), k, band=band, least=least), columns=["identity", "cover_a", "cover_b"])

    return compared


def kmer_clusters(df: DataFrame, key: str, sequence: str, k: int = 5, per_sequence: int = 20, least_identity: float = 0.9, coverage: float = 0.0, band: int | None = None) -> DataFrame:
    """(center, id), in the manner of linear-time clustering: each sequence's smallest k-mer hashes group it with others; the longest of a group is the candidate center, of equal lengths one drawn by a hash.

    Equal sequences are one. A sequence joins the longest candidate that covers enough of it and shares enough
    letters, of those that are centers. Centers are at most one hop away. Every sequence has one row.
    Without a band, identity is the share of equal letters at the best shift, and coverage bounds the ratio of the lengths. With one, it is that of an
    alignment with gaps within so many diagonals of the seed, and both sequences must have that share covered by it.
    """
    known = df.where(F.length(sequence) > 0).select(F.col(key).alias("id"), F.col(sequence).alias("s"))
    copies = stage(known.groupBy("s").agg(F.min("id").alias("rep")), "representatives").withColumn("n", F.length("s"))
    kmers = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - k + 1, F.lit(1))), lambda i: F.xxhash64(F.substring(F.col("s"), i, F.lit(k))))
    hashed = copies.select("rep", "n", F.explode(F.slice(F.array_sort(F.array_distinct(kmers)), 1, per_sequence)).alias("h"))
    longest = hashed.groupBy("h").agg(F.min_by(F.struct("rep", "n"), F.struct(-F.col("n"), hash_number(F.col("rep")), "rep")).alias("top"))
    longest = stage(longest.select("h", F.col("top.rep").alias("center"), F.col("top.n").alias("center_n")), "longest")
    candidates = hashed.join(longest, "h").where("rep <> center").select("rep", "n", "center", "center_n").distinct()
    covered = candidates.where(F.col("n") >= coverage * F.col("center_n"))
    text = copies.select("rep", "s")
    sided = covered.join(text, "rep").join(text.select(F.col("rep").alias("center"), F.col("s").alias("t")), "center")
    if band is None:
        good = sided.where(identity("s", "t") >= least_identity)
    else:
        compared = sided.withColumn("c", gapped(k, band, least_identity)("s", "t"))
        good = compared.where((F.col("c.identity") >= least_identity) & (F.least("c.cover_a", "c.cover_b") >= coverage))
    good = stage(good.select("rep", "center", "center_n"), "links")
    placed = copies.select("rep", "s").join(_joined(good), "rep", "left").select("s", F.coalesce("center", "rep").alias("center"))
    return known.join(stage(placed, "placed"), "s").select("center", "id")


def _joined(links: DataFrame) -> DataFrame:
    """(rep, center) of the sequences that join one, of links to longer ones, or as long ones with a smaller hash.

    A sequence without a link to a center is a center; each other joins the longest that it has a link to. Each round
    settles those whose candidates are all settled, until nothing is left, so that no verified link to a center is lost.
    Inside one length the hashes are random ranks, so that a chain of links runs through falling ranks for a few steps only, the
    logarithm of its sequences at most; the rounds are these for each of the different lengths that a chain goes through.
    """
    open_ = links
    settled = None
    while not open_.isEmpty():
        waiting = open_.select(F.col("rep").alias("center")).distinct()
        # candidates that wait for nothing, and have not joined another, are centers
        free = open_.select("center").distinct().join(waiting, "center", "left_anti")
        won = stage(open_.join(free, "center").groupBy("rep").agg(F.min_by("center", F.struct(-F.col("center_n"), "center")).alias("center")), "won")
        settled = won if settled is None else settled.union(won)
        # who has joined is no candidate any more, and links to settled sequences are of no more use
        gone = won.select(F.col("rep").alias("center"))
        open_ = stage(open_.join(won.select("rep"), "rep", "left_anti").join(gone, "center", "left_anti"), "open_links")
    return links.select("rep", "center").limit(0) if settled is None else settled


def representatives(clusters: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Rows of df that are centers."""
    return df.join(clusters.select(F.col("center").alias(key)).distinct(), key, "left_semi")


def kmer_features(df: DataFrame, sequence: str, k: int = 3, width: int = 64) -> DataFrame:
    """df with vector: counts of k-mers hashed (MD5) to a width, computed once for each distinct sequence; null for null."""
    values = df.where(F.col(sequence).isNotNull()).select(F.col(sequence).alias("_s")).distinct()
    places = F.transform(F.sequence(F.lit(1), F.length("_s") - k + 1), lambda i: F.pmod(hash_number(F.substring(F.col("_s"), i, F.lit(k))), F.lit(width)))
    held = values.withColumn("_at", F.when(F.length("_s") >= k, places).otherwise(F.array().cast("array<bigint>")))
    counted = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.size(F.filter("_at", lambda x: x == j)).cast("double"))
    return df.join(held.select("_s", counted.alias("vector")), F.col(sequence) == F.col("_s"), "left").drop("_s")


def dedup(df: DataFrame, sequence: str, order: list[str]) -> DataFrame:
    """The first row by order of each sequence."""
    return first_wins(df, [sequence], order)
