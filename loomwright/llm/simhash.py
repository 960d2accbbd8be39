"""SimHash near-duplicates: 64-bit fingerprints, linked at a few differing bits, grouped into components.

Links between distinct fingerprints are found by pigeonring filtering. The 64 bits are cut into m segments
on a ring. If two fingerprints differ in at most t bits, then from some segment on, every chain of l
consecutive segments differs in at most l * t / m bits. Chains with l * t < m are equal on both sides, so an
equi-join on (first segment, values of the longest such chain) finds every candidate; the longer chains are
checked in the join's condition, before the full Hamming distance. With t = 2 and m = 5, two segments, 25 bits
or more, are equal, three differ in one bit at most, and so on.

Chains that very many distinct fingerprints share would make that join quadratic. Fingerprints in such a
bucket take an exact linear way instead: each is emitted under itself and its 64 one-bit
neighbours. Two fingerprints differ in at most two bits exactly if they meet under a common key, and no key
can have more than 65 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage
from .arrow import rows
from .components import components

SEED = 42
MAX_BITS = 2
NULL_ID = -(2**63)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE_OF = np.arange(8) * 256


def digests(text: bytes, shingle: int = 3) -> np.ndarray:
    """The XXH64 digests, 8 bytes each, of a UTF-8 text's word shingles, repeats included; a text of fewer words is one shingle, one of none has none.

    Words are runs of other than space and U+0009 to U+000D; only A-Z is lower-cased.
    """
    words = text.lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)


def of_digests(packed: np.ndarray) -> int:
    """The signed 64-bit fingerprint: a bit is set if it is set in over half of the digests; 0 if there are none."""
    if not len(packed):
        return 0
    counts = np.bincount((packed + _BYTE_OF).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(2 * counts.ravel() > len(packed)).view(">i8")[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; 0 if it has no words."""
    return of_digests(digests(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every row."""

    def run(batches):
        for batch in batches:
            got = [(k, fingerprint(t, shingle)) for k, t in rows(batch, "id", "text")]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([f for _, f in got], pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _masks(segments: int) -> list[int]:
    edges = [64 * i // segments for i in range(segments + 1)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, segments: int = 5, bucket_limit: int = 64) -> DataFrame:
    """(u, v) pairs of linked nodes, enough to connect every component; nodes has (fp, node), fp distinct.

    bucket_limit is no cap on partners: buckets with more fingerprints take the exact linear way.
    """
    masks = _masks(segments)

    def chain(start: int, length: int) -> int:
        return _signed(sum(masks[(start + j) % segments] for j in range(length)))

    equal = (segments - 1) // MAX_BITS  # a chain of so many segments must not differ at all
    keys = [F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(chain(i, equal))).alias("val")) for i in range(segments)]
    keyed = nodes.withColumn("k", F.explode(F.array(*keys))).select("k.seg", "k.val", "fp", "node")
    large = stage(keyed.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > bucket_limit).select("seg", "val"), "large_buckets")
    a = keyed.join(large, ["seg", "val"], "left_anti")
    b = a.select("seg", "val", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    a, b = a.alias("a"), b.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp2"))
    condition = (F.col("a.seg") == F.col("b.seg")) & (F.col("a.val") == F.col("b.val")) & (F.col("a.fp") < F.col("b.fp2"))

    def viable(length: int) -> Column:
        mask = F.get(F.array(*[F.lit(chain(i, length)) for i in range(segments)]), F.col("a.seg"))
        return F.bit_count(differ.bitwiseAND(mask)) <= length * MAX_BITS // segments

    for length in range(equal + 1, segments):
        condition = condition & viable(length)
    condition = condition & (F.bit_count(differ) <= MAX_BITS)
    near = a.join(b, condition).select(F.col("node").alias("u"), F.col("node2").alias("v"))
    crowded = keyed.join(large, ["seg", "val"], "left_semi").select("fp", "node").distinct()
    keys = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)]))
    meet = crowded.select(keys.alias("key"), "fp", "node").groupBy("key").agg(F.collect_set(F.struct("fp", "node")).alias("at"))  # at most 65 a key
    star = meet.where(F.size("at") > 1).select(F.array_min(F.transform("at", lambda x: x["node"])).alias("u"), F.explode("at").alias("y")).select("u", F.col("y.node").alias("v"))
    return near.union(star.where("u <> v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component) of every row of docs: component is the smallest id in the row's component.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows and exact copies
    share a fingerprint, so they share a component. Rows with a null id keep a null id and count as smallest.
    Columns other than id_col and text_col are not read. An empty table gives no rows.
    """
    signed = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    by_fp = signed.groupBy("fp").agg(F.min(F.coalesce("id", F.lit(NULL_ID))).alias("least"))
    nodes = stage(by_fp.select("fp", F.struct("least", "fp").alias("node")), "nodes")
    found = components(links(nodes))
    joined = nodes.join(found, "node", "left").select("fp", F.coalesce("label", "node")["least"].alias("component"))
    classes = stage(joined, "classes")
    return signed.join(classes, "fp").select("id", "fp", F.nullif("component", F.lit(NULL_ID)).alias("component"))


def op6(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
