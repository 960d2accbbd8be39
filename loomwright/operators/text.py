"""Character statistics and byte-pair merges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.sequences import characters
from ..staging import stage


def character_histogram(df: DataFrame, column: str) -> DataFrame:
    """(character, n) over all rows, trailing blanks aside: pieces between blanks are counted first, and then their characters."""
    pieces = df.select(F.split(F.rtrim(column), " ").alias("pieces"))
    counted = pieces.select(F.explode("pieces").alias("piece")).where("piece <> ''").groupBy("piece").agg(F.count("*").alias("n"))
    of_pieces = counted.select(F.explode(characters(F.col("piece"))).alias("character"), "n").groupBy("character").agg(F.sum("n").alias("n"))
    blanks = pieces.agg(F.sum(F.size("pieces") - 1).alias("n")).where("n > 0").select(F.lit(" ").alias("character"), "n")
    return of_pieces.union(blanks)


def word_counts(df: DataFrame, column: str) -> DataFrame:
    """(word, n): words split at white space."""
    return df.select(F.explode(F.split(column, r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, n) of neighbouring symbols, over rows of (symbols, n)."""
    at = F.sequence(F.lit(0), F.size("symbols") - 2)
    pairs = F.transform(F.when(F.size("symbols") > 1, at).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.get("symbols", i).alias("left"), F.get("symbols", i + 1).alias("right")))
    return words.select(F.explode(pairs).alias("p"), "n").groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def merge(symbols: list[str], left: str, right: str) -> list[str]:
    out: list[str] = []
    for s in symbols:
        if out and out[-1] == left and s == right:
            out[-1] = left + right
        else:
            out.append(s)
    return out


def learn_merges(df: DataFrame, column: str, rounds: int, least_count: int = 2) -> list[tuple[str, str, int]]:
    """(left, right, count) of successive byte-pair merges: words are counted once, then each round counts pairs and joins the most frequent."""
    words = stage(word_counts(df, column).select(characters(F.col("word")).alias("symbols"), "n"), "words")
    out = []
    for _ in range(rounds):
        best = pair_counts(words).where(F.col("n") >= least_count).orderBy(F.col("n").desc(), "left", "right").first()
        if best is None:
            break
        out.append((best.left, best.right, best.n))

        def apply(batches: Iterator[pd.DataFrame], left=best.left, right=best.right) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(symbols=[merge(list(s), left, right) for s in batch["symbols"]])

        words = stage(words.mapInPandas(apply, words.schema), "words")
    return out
