"""The verified form of SimHash near-dedup: links at a Jaccard similarity of word shingles, grouped into components.

Fingerprints say too little about pairs at 0.8: five-word fingerprints of such pairs differ in up to 14 of 64
bits. So the links of the SimHash operator are candidates here, beside those of MinHash bands, and every candidate
is verified on the hashed shingles of both sides.

Rows with the same set of shingles are one class. Two sets of similarity s agree in a band of 5 MinHash values with
probability s ** 5, so at 0.8 all 40 bands miss a pair once in 8 million, and less often above it. The work is done
in two rounds:

1. Each class is verified against its nearest fingerprints and against one end of its buckets, that with which it
   shares most bands. This is linear, and joins large groups of copies.
2. Where a bucket still holds several components, every member of another component than the largest is compared
   with all members of the bucket. These comparisons run inside tasks, on bitmaps of the sets, which bound the overlap
   from above: only pairs that may reach the threshold leave the tasks and are verified. A bucket of any size is
   cut into cells of bounded size. First each member sends the likeliest of its pairs in each cell alone, which joins most of
   what belongs together; then, with these components, all that is left. No pair of a bucket stays unseen, and no
   group is emitted as pairs.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from . import simhash
from .arrow import rows, sized, small
from .components import components

SEED = 42
SHINGLE = 5
BANDS, ROWS = 40, 5
CELL = 1024  # rows of one side of a cell
_DRAWS = np.random.default_rng(SEED).integers(0, 2**63, (3, BANDS * ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def grams(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles; a text of fewer words is one shingle, one of none has none.

    Words are as in simhash.fingerprint.
    """
    return np.unique(simhash.digests(text or b"", shingle).view(">u8").ravel().astype(np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; keys of different bands differ."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 512):
        mixed = (hashes[i : i + 512, None] ^ _DRAWS[0]) * _DRAWS[1]
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    mixed = ((least ^ (least >> np.uint64(29))) * _DRAWS[2]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _DRAWS[1, :BANDS] + _DRAWS[0, :BANDS]
    return mixed.view(np.int64)


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each hash, in the smallest power of two of at least 4 bits a hash, 64 at least; halves fold onto one another."""
    size = max(64, 1 << (4 * len(hashes) - 1).bit_length())
    held = np.zeros(size, np.uint8)
    held[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(held, bitorder="little").tobytes()


def _class(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - 2**63


def _sketch(batches):
    for batch in small(batches):
        out = []
        for key, text in rows(batch, "key", "text"):
            found = grams(text)
            out.append((key, _class(found), len(found), simhash.of_digests(found.astype(">u8").view(np.uint8).reshape(-1, 8)), band_keys(found).tolist() if len(found) else []))
        types = (batch.schema.field("key").type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["key", "cls", "n", "fp", "bands"])


def _grams(batches):
    for batch in small(batches):
        out = [grams(text) for _, text in rows(batch, "key", "text")]
        ends = np.cumsum([0, *map(len, out)])
        held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([_class(g) for g in out], pa.int64()), held, pa.array([bitmap(g) for g in out], pa.binary())], ["cls", "grams", "bits"])


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(u, v) of the pairs (u, v) whose shingles are similar enough: 0.8 or more, in whole numbers."""
    left = pairs.join(held.select(F.col("cls").alias("u"), F.col("grams").alias("gu")), "u")
    both = left.join(held.select(F.col("cls").alias("v"), F.col("grams").alias("gv")), "v")
    return both.where("5 * size(gu) >= 4 * size(gv) and 5 * size(gv) >= 4 * size(gu)").where(9 * F.size(F.array_intersect("gu", "gv")) >= 4 * (F.size("gu") + F.size("gv"))).select("u", "v")


def _folded(bits: list[bytes], words: int) -> np.ndarray:
    """Bitmaps of words or twice as many 64-bit words, folded to words."""
    held = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)
    while held.shape[1] > words:
        held = held[:, : held.shape[1] // 2] | held[:, held.shape[1] // 2 :]
    return held


def near_pairs(probe: np.ndarray, cls: np.ndarray, label: np.ndarray, n: np.ndarray, odd: np.ndarray, bits: list[bytes], best: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of a cell, a of the probes and b of the others, of different labels, that may be similar.

    odd marks what is a probe in some cell: of two odd classes, that with the smaller number is a. With best, only the
    row b that may have the largest similarity is kept for each a.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    size = np.fromiter(map(len, bits), np.int64, len(bits))
    for sa in np.unique(size[probe]).tolist():
        a = np.flatnonzero(probe & (size == sa))
        for sb in (sa // 2, sa, 2 * sa):
            b = np.flatnonzero(~probe & (size == sb))
            if not len(b):
                continue
            words = min(sa, sb) // 8
            left, right = _folded([bits[i] for i in a.tolist()], words), _folded([bits[i] for i in b.tolist()], words)
            for lo in range(0, len(a), 256):
                part = a[lo : lo + 256, None]
                fits = (label[part] != label[b]) & (5 * n[part] >= 4 * n[b]) & (5 * n[b] >= 4 * n[part]) & (best | ~odd[b] | (cls[part] < cls[b]))
                for_a, for_b = np.nonzero(fits)
                step = max(1, (1 << 20) // words)
                for at in range(0, len(for_a), step):
                    x, y = for_a[at : at + step] + lo, for_b[at : at + step]
                    only_x = np.bitwise_count(left[x] & ~right[y]).sum(axis=1, dtype=np.int64)
                    only_y = np.bitwise_count(right[y] & ~left[x]).sum(axis=1, dtype=np.int64)
                    most, both = np.minimum(n[a[x]] - only_x, n[b[y]] - only_y), n[a[x]] + n[b[y]]
                    ok = 9 * most >= 4 * both
                    out.append((a[x[ok]], b[y[ok]], most[ok] / both[ok]))
    a, b, share = (np.concatenate(z) for z in zip(*out, strict=True))
    if best:
        order = np.lexsort((cls[b], -share, a))
        order = order[np.diff(a[order], prepend=-1) != 0]
        a, b = a[order], b[order]
    return a, b


def _cells(batches, best: bool):
    """(u, v) of the pairs of each cell that may be similar, see near_pairs; rows come sorted by cell."""

    def pairs_of(table: pa.Table, cuts: np.ndarray):
        cls, label, n, probe, odd = (table.column(c).to_numpy() for c in ("cls", "label", "n", "probe", "odd"))
        bits = table.column("bits").to_pylist()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            s = slice(lo, hi)
            a, b = near_pairs(probe[s], cls[s], label[s], n[s], odd[s], bits[lo:hi], best)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(cls[s][a]), pa.array(cls[s][b])], ["u", "v"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        key = np.stack([held.column(c).to_numpy() for c in ("h", "i", "j")])
        cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
        yield from pairs_of(held, cuts)
        held = held.slice(cuts[-1])  # more of its cell may come
    if held is not None:
        yield from pairs_of(held, np.array([0, held.num_rows]))


def _remaining(met: DataFrame, labels: DataFrame, held: DataFrame, best: bool) -> DataFrame:
    """Pairs (u, v) that share a bucket, are in different components and may be similar; with best, the likeliest of each class in each cell."""
    at = stage(met.select("h", "cls").join(labels, "cls"), "labelled")
    by_label = at.groupBy("h", "label").agg(F.count("*").alias("c"))
    several = by_label.groupBy("h").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"), F.sum("c").alias("total"), F.max("c").alias("most")).where("labels > 1")
    blocks = lambda c: F.ceil(c / CELL).cast("int")
    open_ = stage(several.select("h", "main", blocks(F.col("total") - F.col("most")).alias("ni"), blocks(F.col("total")).alias("nj")), "open")
    sets = held.select("cls", F.size("grams").cast("long").alias("n"), "bits")
    members = stage(at.join(open_, "h").join(sets, "cls").select("h", "ni", "nj", "cls", "label", "n", "bits", (F.col("label") != F.col("main")).alias("odd")), "members")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    probes = members.where("odd").select("h", one_of("ni").alias("i"), all_of("nj").alias("j"), "cls", "label", "n", F.lit(True).alias("probe"), "odd", "bits")
    others = members.select("h", all_of("ni").alias("i"), one_of("nj").alias("j"), "cls", "label", "n", F.lit(False).alias("probe"), "odd", "bits")
    cells = probes.union(others).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return cells.mapInArrow(partial(_cells, best=best), "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, label) with components joined by links (u, v) of classes."""
    if links.isEmpty():
        return labels
    end = lambda c: labels.select(F.col("cls").alias(c), F.col("label").alias(f"l{c}"))
    joined = links.join(end("u"), "u").join(end("v"), "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
    above = components(joined).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return stage(labels.join(above, "label", "left").select("cls", F.coalesce("top", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, component) of every row of docs: rows of one component have one number.

    Null and empty texts are one class. text_hash is xxhash64 of the text. Repeated rows get equal results; rows with
    a null id keep it. An empty table gives no rows. Columns other than id_col and text_col are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    keyed = source.select(F.struct("id", "text_hash").alias("key"), "text")
    sketch = keyed.mapInArrow(_sketch, "key struct<id: long, text_hash: long>, cls long, n long, fp long, bands array<long>")
    signed = stage(sketch.select("key.*", "cls", "n", "fp", "bands"), "sketches")
    classes = stage(signed.where("n > 0").groupBy("cls").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("cls", F.explode("bands").alias("h"))
    shared = stage(banded.groupBy("h").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi"), "shared")
    met = stage(banded.join(sized(shared), "h"), "met")

    near = stage(met.select("cls").distinct(), "near")
    texts = signed.join(sized(near), "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("id", "text_hash")).alias("k")).select(F.col("k.id").alias("i"), F.col("k.text_hash").alias("h"))
    needed = source.join(sized(stage(texts, "needed")), F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left_semi")
    held = stage(needed.select(F.lit(0).alias("key"), "text").mapInArrow(_grams, "cls long, grams array<long>, bits binary").dropDuplicates(["cls"]), "grams")

    by_print = stage(classes.select("cls", "fp").join(sized(near), "cls", "left_semi"), "prints")
    nodes = stage(by_print.groupBy("fp").agg(F.min("cls").alias("node")), "nodes")
    prints = simhash.links(nodes).select("u", "v").union(by_print.join(nodes, "fp").where("cls <> node").select(F.col("node").alias("u"), F.col("cls").alias("v")))
    ends = met.select(F.col("cls").alias("u"), F.explode(F.array("lo", "hi")).alias("v")).where("u <> v").groupBy("u", "v").agg(F.count("*").alias("c"))
    nearest = ends.groupBy("u").agg(F.max_by("v", F.struct("c", "v")).alias("v"))
    pairs = prints.union(nearest).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    labels = _merged(near.withColumn("label", F.col("cls")), stage(_verified(pairs, held), "near_links"))
    for best in (True, False):
        labels = _merged(labels, stage(_verified(_remaining(met, labels, held, best), held), "more_links"))
    return signed.select("id", "text_hash", "cls").join(labels, "cls", "left").select("id", "text_hash", F.coalesce("label", "cls").alias("component"))
