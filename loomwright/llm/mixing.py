"""Mixing sources to target weights.

The words of a source, its documents one after the other in a pseudorandom order, are packed into blocks of
a fixed number of words. The mix has output shards of a fixed number of slots. How many slots of a shard each
source gets is a multinomial draw, given what each source has in all: one pseudorandom permutation deals the slots of
all sources out to the shards. (Draws of every shard for itself leave a small source far from its target.) A
source's n-th slot overall is mapped to one of its blocks through a pseudorandom permutation of the block
numbers, one for every pass, and slots and blocks are joined by block number. All draws depend on a seed and
on numbers alone, so reruns and retries agree. Sources are rows of a table like any other: there may be any number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ordinals import number_rows, running_sums
from ..staging import stage
from .arrow import sized

_FAN = 4096  # groups of the middle level of the running sums
_RUN = 1 << 16  # equal rows that are written out at once


def water_fill(sources: DataFrame, limit: float) -> DataFrame:
    """sources, which has size and weight, with target: shares of all sizes by weight.

    No share is above limit times its size; the excess goes to the others by weight. Each round is an aggregation.
    """
    unit, full = None, -1
    while True:
        cut = F.lit(False) if unit is None else limit * F.col("size") < unit * F.col("weight")
        sums = sources.agg(F.sum("size").alias("all"), F.sum(F.when(cut, F.col("size")).otherwise(0)).alias("cut"), F.sum(F.when(cut, 0.0).otherwise(F.col("weight"))).alias("free"), F.count_if(cut).alias("n")).first()
        if sums.n == full or not sums.free:
            return sources.withColumn("target", F.when(cut, limit * F.col("size")).otherwise(F.lit(unit or 0.0) * F.col("weight")).cast("double"))
        unit, full = (sums["all"] - limit * sums.cut) / sums.free, sums.n


def _feistel(x: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    half = np.uint64(bits // 2)
    mask = np.uint64((1 << (bits // 2)) - 1)
    lo, hi = x & mask, x >> half
    for k in keys:
        f = (lo + k) * np.uint64(0x9E3779B97F4A7C15)
        f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        lo, hi = hi ^ (f >> np.uint64(32)) & mask, lo
    return hi << half | lo


def permuted(x: np.ndarray, n: int, key: tuple[int, ...]) -> np.ndarray:
    """The images of numbers below n under the key's permutation of 0 to n - 1: a Feistel network, walked until it is below n."""
    if n <= 1:
        return np.zeros(len(x), np.int64)
    bits = max(2, (n - 1).bit_length())
    bits += bits % 2
    keys = np.random.default_rng([*key]).integers(0, 2**63, 6).astype(np.uint64)
    out = _feistel(x.astype(np.uint64), bits, keys)
    while (high := out >= n).any():
        out[high] = _feistel(out[high], bits, keys)
    return out.astype(np.int64)


def _place(slots: int, shard_slots: int, seed: int):
    """(shard, slot, s, pass, block) of the slots of each row (s, blocks, above, lo, hi): a source's slots from lo to hi."""

    def run(batches):
        for batch in batches:
            for s, blocks, above, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("s", "blocks", "above", "lo", "hi")), strict=True):
                at = np.arange(lo, hi)
                place = permuted(at + above, slots, (seed,))
                turn, block = at // blocks, np.empty(len(at), np.int64)
                for t in np.unique(turn).tolist():
                    block[turn == t] = permuted(at[turn == t] % blocks, blocks, (seed, s, t))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (place // shard_slots, place % shard_slots, np.full(len(at), s), turn, block)], ["shard", "slot", "s", "pass", "block"])

    return run


class Mix:
    """A mix of documents.

    sources: (s, source, weight, size, target) of each source, numbered in order of code points, null last.
    counts: (shard, s, slots): the drawn number of slots of a source in a shard. Shards are full but for the last.
    documents: (id, th, source, size, s, at) of every row: XXH64 of the text, size in words, number of the source, first word in the source.
    pieces: (shard, slot, s, pass, block, at, id, th, first, n) of what fills the slots: n words of a document from its word first.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), limit: int = 3, block_words: int = 128, shard_slots: int = 4096, seed: int = 11, batch_slots: int = 1 << 16):
        """Sources weigh as the numbers of weights, repeating, and share the size of all documents.

        A word is a run of other than space and U+0009 to U+000D; null and empty texts have none, and nothing is taken
        of them. Null sources are one source. Rows that share an id are documents of their own. An empty table gives
        an empty mix. Other columns are not read.
        """
        spark = docs.sparkSession
        parts = F.array_remove(F.split(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+"), "")  # much faster than counting matches of what is between
        words = F.size(parts).cast("long")
        sized_docs = stage(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(source_col).cast("string").alias("source"), words.alias("size")), "sizes")
        totals = sized_docs.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
        numbered = number_rows(totals, [F.col("source").asc_nulls_last()], "s")
        weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights)).cast("int"))
        filled = water_fill(stage(numbered.withColumn("weight", weight), "sources"), limit)
        blocks = F.ceil(F.col("size") / block_words)
        slots = F.when(F.col("size") > 0, F.round(F.col("target") * blocks / F.col("size"))).otherwise(0).cast("long")  # the last block may be short
        known = stage(running_sums(filled.withColumn("blocks", blocks).withColumn("slots", slots), ["s"], {"above": "slots"}), "shares")
        self.sources = known.select("s", "source", "weight", "size", "target")
        all_slots, rows_ = known.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
        own = sized(known.select("s", F.col("source").alias("name"), F.col("size").alias("source_size"), "target"))
        named = sized_docs.join(own, F.col("source").eqNullSafe(F.col("name"))).select("id", "th", "source", "size", "s", "source_size", "target")
        self.documents = stage(_running_sums(named, rows_), "offsets")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(all_slots / (1 << 20)))  # by the slots, not by the few rows they come from
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(batch_slots).cast("long")))
        parts = known.where("slots > 0").select("s", "blocks", "above", "slots", part.alias("lo")).withColumn("hi", F.least(F.col("lo") + batch_slots, "slots"))
        placed = parts.repartition(tasks, "s", "lo").mapInArrow(_place(all_slots, shard_slots, seed), "shard long, slot long, s long, pass long, block long")
        self.counts = placed.groupBy("shard", "s").agg(F.count("*").alias("slots"))
        first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
        cut = self.documents.where("size > 0").select("s", "at", "id", "th", "size", F.explode(F.sequence(first, last)).alias("block"))
        lo = F.greatest(F.col("at"), F.col("block") * block_words)
        hi = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
        held = cut.select("s", "block", "at", "id", "th", (lo - F.col("at")).alias("first"), (hi - lo).alias("n"))
        # the slots come from few rows, from which Spark would take them for small and broadcast them
        self.pieces = placed.join(held.hint("merge"), ["s", "block"]).select("shard", "slot", "s", "pass", "block", "at", "id", "th", "first", "n")

    def taken(self) -> DataFrame:
        """documents with taken: words of the document that the mix has, repeats counted."""
        sums = self.pieces.groupBy("s", "at").agg(F.sum("n").alias("taken"))  # where a document with words starts is its own
        known = self.documents.alias("d").join(sums.alias("t").hint("merge"), (F.col("d.s") == F.col("t.s")) & (F.col("d.at") == F.col("t.at")), "left")
        return known.select("d.*", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))

    def texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(shard, slot, source number, text) of the slots, the words of a slot joined by one space; docs as given."""
        own = docs.select(F.col(id_col).cast("long").alias("key"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("own_text")).dropDuplicates(["key", "own"])
        part = self.pieces.join(own, F.col("id").eqNullSafe(F.col("key")) & (F.col("th") == F.col("own"))).withColumn("words", F.filter(F.split("own_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        cut = part.select("shard", "slot", "s", "at", F.array_join(F.slice("words", F.col("first") + 1, F.col("n")), " ").alias("part"))
        joined = cut.groupBy("shard", "slot", "s").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
        return joined.select("shard", "slot", "s", F.array_join(F.transform("parts", lambda p: p["part"]), " ").alias("text"))


def _running_sums(docs: DataFrame, rows: int, group_rows: int = 256) -> DataFrame:
    """docs with at: the sum of the sizes that come before in its source.

    The order is by a hash bucket of the id and the text. Sums run inside buckets of about group_rows different rows,
    over the buckets of a group of them, and over these groups, so that no window sees a large source whole. Equal rows
    go through the windows as one.
    """
    buckets = max(1, math.ceil(rows / group_rows))
    bucket = F.pmod(F.xxhash64("id", "th", F.lit(5)), F.lit(buckets))
    keyed = docs.groupBy(*docs.columns).agg(F.count("*").alias("copies")).withColumn("b", bucket).withColumn("g", F.floor(F.col("b") / _FAN)).withColumn("total", F.col("size") * F.col("copies"))

    def before(parts: tuple[str, ...], order: tuple[str, ...]):
        return F.coalesce(F.sum("total").over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    fine = keyed.groupBy("s", "g", "b").agg(F.sum("total").alias("total"))
    coarse = fine.groupBy("s", "g").agg(F.sum("total").alias("total")).withColumn("above", before(("s",), ("g",))).select("s", "g", "above")
    middle = fine.withColumn("inside", before(("s", "g"), ("b",))).join(coarse, ["s", "g"]).select("s", "b", (F.col("inside") + F.col("above")).alias("base"))
    local = keyed.withColumn("own", before(("s", "b"), ("id", "th", "size"))).join(stage(middle, "bases"), ["s", "b"])
    runs = local.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(_RUN).cast("long"))))  # no array grows with the copies of a row
    each = runs.withColumn("copy", F.explode(F.sequence("run", F.least(F.col("run") + _RUN, F.col("copies")) - 1))).drop("run")
    return each.withColumn("at", F.col("own") + F.col("base") + F.col("copy") * F.col("size")).drop("b", "g", "own", "base", "copies", "total", "copy")


def op7(spark, sf_dir: str) -> DataFrame:
    out = Mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mix_targets(spark, sf_dir: str) -> DataFrame:
    """What of op7 no draw takes part in: (doc_id, size, source_size, target) of every document."""
    held = Mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents
    return held.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 3).alias("target"))


#: With the sources by how soon they are full, the level is that at the first that is not, if all before are.
MIX_TARGETS_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source
), o AS (
  SELECT *, 3.0 * size / weight AS full_at, sum(size) OVER () AS whole, coalesce(sum(size) OVER before, 0) AS cut, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free
  FROM s WINDOW before AS (ORDER BY 3.0 * size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT coalesce(arg_min((whole - 3.0 * cut) / free, full_at) FILTER ((whole - 3.0 * cut) / free <= full_at), 0) AS unit FROM o
)
SELECT doc_id, d.size, s.size AS source_size, round(least(3.0 * s.size, unit * weight), 3)::DOUBLE AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, level
"""
