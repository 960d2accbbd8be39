"""Metrics of classifiers and of sequences."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.sequences import characters
from . import alignment
from .ordinals import running_sums


def score_steps(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg, tp, fp) of each distinct score, from the highest: labels 1 and 0 at it, and at it or above."""
    steps = df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(score).alias("score"))
    steps = steps.agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    out = running_sums(steps, [F.col("score").desc()], {"above_pos": "pos", "above_neg": "neg"})
    return out.select("score", "pos", "neg", (F.col("above_pos") + F.col("pos")).alias("tp"), (F.col("above_neg") + F.col("neg")).alias("fp"))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under the ROC curve by ranks, ties half; null without both labels."""
    steps = score_steps(df, score, label)
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    size = F.sum("pos") * F.sum("neg")
    return steps.agg(F.when(size > 0, wins / size).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: precision at each distinct score, weighted by the recall it adds; null without label 1."""
    steps = score_steps(df, score, label)
    gain = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return steps.agg(F.when(F.sum("pos") > 0, gain / F.sum("pos")).alias("aupr"))


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, tpr, fpr) at each distinct score."""
    steps = score_steps(df, score, label)
    sums = steps.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("s")).scalar()
    return steps.select(F.col("score").alias("threshold"), (F.col("tp") / sums["p"]).alias("tpr"), (F.col("fp") / sums["n"]).alias("fpr"))


def matches(a: Column, b: Column) -> Column:
    """Places at which two sequences agree, up to the shorter one's end."""
    return F.size(F.filter(F.zip_with(characters(a), characters(b), lambda x, y: x.eqNullSafe(y)), lambda v: v))


def recovery(a: Column, b: Column) -> Column:
    """Share of equal places of sequences of one length; fails for other lengths, null for empty ones."""
    share = F.when(F.length(a) > 0, matches(a, b) / F.length(a))
    return F.when(F.length(a) == F.length(b), share).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("lengths differ")).cast("double")))


def accuracy(pred: Column, target: Column) -> Column:
    """Equal places over the target's length; null for an empty target."""
    return F.when(F.length(target) > 0, matches(pred, target) / F.length(target))


def edit_counts(a: str, b: str, autojunk: bool = True) -> dict[str, int]:
    """Characters inserted, deleted, replaced and equal between two strings; the longer side of a replacement counts as inserted or deleted."""
    out = {"insert": 0, "delete": 0, "replace": 0, "equal": 0}
    for kind, a0, a1, b0, b1 in difflib.SequenceMatcher(None, a, b, autojunk).get_opcodes():
        short = min(a1 - a0, b1 - b0)
        if kind in ("equal", "replace"):
            out[kind] += short
        out["delete"] += a1 - a0 - short if kind != "insert" else 0
        out["insert"] += b1 - b0 - short if kind != "delete" else 0
    return out


@F.pandas_udf(T.StructType([T.StructField(k, T.LongType()) for k in ("insert", "delete", "replace", "equal")]))
def edit_opcodes(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edit_counts(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["insert", "delete", "replace", "equal"])


def aligned_score(counts: Column) -> Column:
    """Equal characters over all; 0 for none."""
    total = sum((counts[k] for k in ("insert", "delete", "replace", "equal")), F.lit(0))
    return F.when(total > 0, counts["equal"] / total).otherwise(0.0)


def parse_matrix(text: str) -> dict[tuple[str, str], float]:
    """A substitution matrix in the usual text form: a line of letters, then a line for each letter with its scores; # starts a comment."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    return {(r[0], c): float(v) for r in lines[1:] for c, v in zip(lines[0], r[1:], strict=True)}


def alignment_score(a: str, b: str, matrix: dict | None = None, match: float = 1.0, mismatch: float = 0.0, gap: float = 0.0) -> float:
    """Best score of a global alignment of one pair; by the matrix if there is one, KeyError for letters it lacks."""
    score = float(alignment.align([a], [b], alignment.Scoring(match, mismatch, gap, matrix))[0][0])
    if np.isnan(score):
        raise KeyError(f"letters of {a!r} and {b!r} that the matrix lacks")
    return score


#: A column function of two sequences: the score of a best global alignment, or a penalty.
alignment_scorer = alignment.scorer


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn by a hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def random_feature_mean(df: DataFrame, column: str, width: int, sigma: float = 7.0, features: int = 500, seed: int = 0) -> DataFrame:
    """(feature, mean): the mean over df of random cosine features of a Gaussian kernel, drawn from the seed. Null vectors take no part.

    Sums are made where the rows are; features rows a partition are shuffled.
    """
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(width, features)) / sigma, rng.uniform(0, 2 * np.pi, features)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(features), 0
        for batch in batches:
            if len(batch):
                total += np.cos(np.stack(batch["z"]).astype(float) @ w + b).sum(axis=0)
                n += len(batch)
        yield pd.DataFrame({"feature": np.arange(features), "total": total, "n": n})

    known = df.where(F.col(column).isNotNull()).select(F.col(column).alias("z"))
    parts = known.mapInPandas(sums, "feature int, total double, n long")
    mean = F.sum("total") / F.nullif(F.sum("n"), F.lit(0)) * F.lit(float(np.sqrt(2 / features)))
    return parts.groupBy("feature").agg(mean.alias("mean"))


def mean_discrepancy(a: DataFrame, b: DataFrame, column: str, width: int, sigma: float = 7.0, features: int = 500, seed: int = 0) -> DataFrame:
    """One row: the squared maximum mean discrepancy of two tables' vectors by random features; null if either has none."""
    means = [random_feature_mean(df, column, width, sigma, features, seed) for df in (a, b)]
    both = means[0].alias("a").join(means[1].alias("b"), "feature")
    return both.agg(F.sum((F.col("a.mean") - F.col("b.mean")) ** 2).alias("mmd"))
