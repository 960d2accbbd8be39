"""Hard-negative mining by search over one-dimensional distance keys.

Vectors get one more coordinate that makes them all equally long, so that a higher inner product with an anchor is a smaller distance.
Each is stored under its nearest pivot, sorted by (pivot, distance), in blocks: a block is a key interval of one pivot. By the triangle
inequality all vectors of a block lie in an annulus about its pivot, so the interval bounds their distance to an anchor from below and above.
An anchor's search takes the blocks outward from its own keys, and goes on until no block left can hold a vector nearer than its k-th best:
then the top k is certain. A window on scores is a shell of distances, which bounds the search from inside as well.

Anchors are searched in batches of neighbours against shards of the blocks, so that a task reads a bounded number of blocks
whatever the size of the table. Pivots are fitted on a bounded sample; they decide how much is read, never what is found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..staging import stage
from .blocks import Store, best, deal, dense, lloyd, read_index, usable, write_blocks

_EXACT = 2.0**52
_FOUND = "file string, at long, place int, ask int, anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def labelled_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(vec_id, label, v): components floor(scale * x); without rows whose id, label or vector is null, or that hold null or non-finite components."""
    whole = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(df, vector_col))
    v = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale).cast("double"))
    return whole.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))


class _Space:
    """Distances of lengthened vectors to pivots. slack is more than any error of rounding."""

    def __init__(self, longest: float, pivots: np.ndarray):
        self.longest, self.pivots, self.slack = longest, pivots, 1e-6 * (longest + 1)

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        p = self.pivots
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ p.T) + (p * p).sum(axis=1), 0))


def _keyed(space: _Space, width: int):
    def run(batches):
        for batch in batches:
            for part in (batch.slice(lo, 2048) for lo in range(0, batch.num_rows, 2048)):
                d = space.distances(space.lengthened(dense(part.column("v"), width)))
                pivot = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pivot, pa.int32()), pa.array(d[np.arange(len(d)), pivot])], [*part.schema.names, "pivot", "key"])

    return run


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, as Python's integers, held to 64 bits, where doubles cannot hold them."""
    most = [float(np.abs(a).max()) if a.size else 0.0 for a in (x, q)]
    if x.shape[1] * most[0] * most[1] < _EXACT:
        return x @ q.T
    a, b = (np.frompyfunc(int, 1, 1)(y) for y in (x, q))
    return np.frompyfunc(lambda s: max(-(2**63) + 1, min(2**63 - 1, s)), 1, 1)((a[:, None, :] * b[None]).sum(axis=2)).astype(object)


def _numbers(values: list) -> np.ndarray:
    """As doubles where these hold them."""
    return np.array(values, np.float64 if all(abs(v) < _EXACT or math.isinf(v) for v in values) else object)


class _Search:
    """Batches of anchors against a shard of the store: asks are (place of the anchor, least score, highest score)."""

    def __init__(self, space: _Space, store: Store, anchors: Store, shards: int, k: int, same_label: bool):
        self.space, self.index_path, self.shards, self.k, self.same = space, store.index_path, shards, k, same_label
        self.store, self.anchors = store.reader(), anchors.reader()

    def run(self, batches):
        index, store, anchors = read_index(self.index_path, "lo_pivot", "lo_key"), self.store(), self.anchors()
        for batch in batches:
            for row in batch.to_pylist():
                columns, q = anchors.read(row["file"], row["at"])
                asks = row["asks"]
                if asks is None:
                    asks = [{"place": i, "no": 0, "positive_id": None, "score": None} for i in range(len(q))]
                    low, high = [-math.inf] * len(q), [math.inf] * len(q)
                else:
                    low, high = ([f(a["score"]) for a in asks] for f in (lambda s: -(-row["low"] * s // 100), lambda s: row["high"] * s // 100))
                open_ = [i for i in range(len(asks)) if low[i] <= high[i]]
                if not open_:
                    continue
                asks = [asks[i] for i in open_]
                shard = {c: v[row["shard"] :: self.shards] for c, v in index.items()}
                place = np.array([a["place"] for a in asks])
                who, ids, score = self._scan(q, columns, place, _numbers([low[i] for i in open_]), _numbers([high[i] for i in open_]), shard, store)
                own = columns.column("vec_id").to_numpy()
                out = {"file": [row["file"]] * len(who), "at": [row["at"]] * len(who), "place": place[who].tolist(), "ask": [asks[i]["no"] for i in who], "anchor_id": own[place[who]].tolist()}
                out |= {"positive_id": [asks[i]["positive_id"] for i in who], "positive_score": [asks[i]["score"] for i in who], "vec_id": ids.tolist(), "score": [int(s) for s in score]}
                yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in _ARROW}, schema=_ARROW)

    def _scan(self, q, columns, place, low, high, shard, store):
        """(asks, ids, scores): the k best of the shard for each ask, with scores from low to high."""
        space, ids, labels = self.space, columns.column("vec_id").to_numpy(), columns.column("label").to_numpy()
        square = (q * q).sum(axis=1)[place] + space.longest**2
        near = space.distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1))[:, shard["lo_pivot"]]
        least = np.maximum(np.maximum(shard["lo_key"] - near, near - shard["hi_key"]), 0) - space.slack
        most = near + shard["hi_key"] + space.slack
        inner = np.sqrt(np.maximum(square - 2 * high.astype(np.float64), 0)) - space.slack
        owner, found, scores, need = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), low.copy()
        if need.dtype == object:
            scores = scores.astype(object)
        for g in np.argsort(least.min(axis=0)):
            outer = np.sqrt(np.maximum(square - 2 * need.astype(np.float64), 0)) + space.slack
            live = np.flatnonzero((least[place, g] <= outer) & (most[place, g] >= inner))
            if not len(live):
                continue
            block, x = store.read(shard["file"][g], shard["at"][g])
            x_ids, x_labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
            asked, at = np.unique(place[live], return_inverse=True)
            s = _products(x, q[asked])
            rows = [np.zeros(0, np.int64)] * 2
            for lo in range(0, len(live), 256):
                part = slice(lo, lo + 256)
                mine = s[:, at[part]]
                right = (x_labels[:, None] == labels[place[live[part]]]) == self.same
                ok = (mine >= need[live[part]]).astype(bool) & (mine <= high[live[part]]).astype(bool) & right & (x_ids[:, None] != ids[place[live[part]]])
                r, a = np.nonzero(ok)
                rows = [np.concatenate(z) for z in zip(rows, (r, a + lo), strict=True)]
            r, a = rows
            owner, found, scores = np.concatenate([owner, live[a]]), np.concatenate([found, x_ids[r]]), np.concatenate([scores, s[r, at[a]]])
            kept = best(-scores if scores.dtype != object else np.array([-int(v) for v in scores]), found, owner, self.k)
            owner, found, scores = owner[kept], found[kept], scores[kept]
            full = np.flatnonzero(np.bincount(owner, minlength=len(need)) >= self.k)
            last = dict(zip(owner.tolist(), scores.tolist(), strict=True))  # owners are sorted, each by falling scores
            for i in full:
                need[i] = max(need[i], last[i])
        return owner, found, scores


_ARROW = pa.schema([
    ("file", pa.string()), ("at", pa.int64()), ("place", pa.int32()), ("ask", pa.int32()), ("anchor_id", pa.int64()),
    ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()),
])


class Annuli:
    """The store of all vectors, sorted by (pivot, distance). vectors is as of labelled_vectors; shorter ones are padded with zeros."""

    def __init__(self, vectors: DataFrame, pivots: int = 64, sample_rows: int = 8192, block_rows: int = 4096, shard_blocks: int = 256):
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
        self.rows, width, longest = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
        self.width, self.vectors = max(width or 0, 1), vectors
        if not self.rows:
            return
        sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample_rows).select("v").toArrow()
        self.space = _Space(longest * (1 + 1e-9), np.zeros((1, self.width + 1)))
        self.space.pivots = lloyd(self.space.lengthened(dense(sample.column("v").combine_chunks(), self.width)), pivots)
        self._number = "<f4" if longest < 2**24 else "<f8"
        keys = f"vec_id long, label long, v array<double>, pivot int, key double"
        self.keyed = stage(vectors.mapInArrow(_keyed(self.space, self.width), keys), "keyed")
        self.store = self._write(self.keyed, block_rows, self.rows)
        self.shards = max(1, math.ceil(self.store.index.count() / shard_blocks))

    def _write(self, keyed: DataFrame, block_rows: int, rows: int, spans=("pivot", "key"), within: str | None = "pivot") -> Store:
        order = ["pivot", "key", "vec_id"]
        ordered = keyed.repartitionByRange(max(1, math.ceil(rows / block_rows)), *order).sortWithinPartitions(*order)
        return write_blocks(ordered, self.width, block_rows, spans, within, self._number)

    def _search(self, asks: DataFrame, anchors: Store, k: int, same_label: bool) -> DataFrame:
        found = deal(asks, self.shards).mapInArrow(_Search(self.space, self.store, anchors, self.shards, k, same_label).run, _FOUND)
        order = Window.partitionBy("file", "at", "place", "ask").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def mine(self, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, batch_rows: int = 128) -> DataFrame:
        """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors, rows for which is_anchor holds.

        An anchor's positives are its best rows of the same label; a positive's negatives are the best rows of other labels whose score is from low to
        high percent of the positive's. Ties go to the smaller id. Rows with the anchor's own id are never found for it. Equal anchor rows count
        once, others that share an id each; repeated rows are candidates each. An empty table, or one without anchors, gives no rows.
        """
        out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        spark = self.vectors.sparkSession
        if not self.rows:
            return spark.createDataFrame([], out)
        anchors = stage(self.keyed.where(is_anchor).dropDuplicates(["vec_id", "label", "v"]), "anchors")
        n = anchors.count()
        if not n:
            return spark.createDataFrame([], out)
        batches = self._write(anchors, batch_rows, n, (), None)
        ask = "array<struct<place:int,no:int,positive_id:long,score:long>>"
        first = batches.index.select("file", "at", F.lit(None).cast(ask).alias("asks"), F.lit(low).alias("low"), F.lit(high).alias("high"))
        own = self._search(first, batches, positives, True)
        asks = F.collect_list(F.struct("place", F.col("rank").alias("no"), F.col("vec_id").alias("positive_id"), "score"))
        wanted = stage(own.groupBy("file", "at").agg(asks.alias("asks")).select("file", "at", "asks", F.lit(low).alias("low"), F.lit(high).alias("high")), "asks")  # positives x batch_rows a row at most
        found = self._search(wanted, batches, negatives, False)
        return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, after each seventh has been given the next of ten labels."""
    vectors = labelled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return Annuli(vectors.withColumn("label", moved)).mine(F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, c.label = q.label AS same, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
