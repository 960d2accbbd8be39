"""Exact top-k search by inner product over integer vectors.

Vectors are processed by descending length. The longest vectors give each query a first k-th best score. Every other vector is compared through rotated coordinates, those of the singular vectors of a
sample, in which the first few carry most of the length: the partial sum over these plus the product of the
residual lengths is a bound (Cauchy-Schwarz), and only pairs whose bound reaches the query's k-th best
score so far are multiplied out. The rotation only decides how much is pruned; results are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, Window, functions as F

from ..staging import fresh_dir, stage
from .arrow import open_fs

_EXACT = 2.0**53
_OUT = "query_id long, query_no long, vec_id long, score long"


def _dense(column, width: int) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros."""
    out = np.zeros((len(column), width))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v, norm): components floor(scale * x); without vectors that are null or hold null or non-finite components, and without null ids; of an empty table none."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = df.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    out = whole.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)))


class _Rotated:
    """Vectors in rotated coordinates: the first ones, and the length of the rest, rounded up."""

    def __init__(self, x: np.ndarray, turn: np.ndarray, head: int):
        self.x, self.norm = x, np.sqrt((x * x).sum(axis=1))
        self.part = x @ turn[:, :head]
        self.rest = np.sqrt(np.maximum(self.norm**2 - (self.part**2).sum(axis=1), 0)) + 1e-6 * self.norm


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, row by row; saturated at 64 bits."""
    if len(q) and np.sqrt((q * q).sum(axis=1)).max() * np.sqrt((x * x).sum(axis=1)).max() < _EXACT:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q, x, strict=True)]
    return np.array([max(-(2**63), min(2**63 - 1, w)) for w in whole], np.int64)


def _best(score: np.ndarray, ids: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each owner, ties to the smaller id."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(first, np.diff([*first, len(own)]))
    return order[rank < k]


def _search(block: _Rotated, ids: np.ndarray, q: _Rotated, q_ids: np.ndarray, theta: np.ndarray, k: int, step: int = 1024):
    """(query places, ids, scores): the k best of the block for each query, of those that reach theta; theta rises on the way."""
    theta = theta.copy()
    kept = [np.zeros(0, np.int64)] * 3
    for lo in range(0, len(ids), step):
        part = slice(lo, lo + step)
        alive = np.flatnonzero(q.norm * block.norm[part].max() * (1 + 1e-9) + 1 >= theta)
        if not len(alive):
            continue
        bound = q.part[alive] @ block.part[part].T + q.rest[alive, None] * block.rest[part] + 1
        at_q, at_x = np.nonzero((bound >= theta[alive, None]) & (q_ids[alive, None] != ids[part]))
        at_q = alive[at_q]
        for a in range(0, len(at_q), 1 << 16):
            qs, xs = at_q[a : a + (1 << 16)], at_x[a : a + (1 << 16)] + lo
            new = _scores(q.x[qs], block.x[xs])
            ok = new >= theta[qs]
            kept = [np.concatenate(z) for z in zip(kept, (qs[ok], ids[xs[ok]], new[ok]), strict=True)]
            kept = [z[best] for best in [_best(kept[2], kept[1], kept[0], k)] for z in kept]
            n = np.bincount(kept[0], minlength=len(theta))
            low = np.full(len(theta), np.inf)
            np.minimum.at(low, kept[0], kept[2])
            theta = np.where(n >= k, np.maximum(theta, low), theta)
    return kept


def _seed(head_ids: np.ndarray, head: np.ndarray, turn: np.ndarray, dims: int, k: int):
    """Queries with theta, their k-th best score among the head."""

    def run(batches):
        block = _Rotated(head, turn, dims)
        for batch in batches:
            q = _Rotated(_dense(batch.column("v"), head.shape[1]), turn, dims)
            ids = batch.column("query_id").to_numpy()
            theta = np.full(len(ids), -np.inf)
            for lo in range(0, len(ids), 512):
                part = slice(lo, lo + 512)
                own = _Rotated(q.x[part], turn, dims)
                at, _, score = _search(block, head_ids, own, ids[part], theta[part], k)
                full = np.bincount(at, minlength=len(own.x)) >= k
                low = np.full(len(own.x), np.inf)
                np.minimum.at(low, at, score)
                theta[part] = np.where(full, low, -np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(theta)], [*batch.schema.names, "theta"])

    return run


def _compare(path: str, width: int, turn: np.ndarray, dims: int, k: int, block_rows: int):
    def run(batches):
        fs, at = open_fs(path)
        queries = ds.dataset(at, filesystem=fs, format="parquet")

        def against(ids: list, vectors: list):
            order_ids, x = np.concatenate(ids), np.concatenate(vectors)
            block = _Rotated(x, turn, dims)
            for rows in queries.to_batches(batch_size=512, batch_readahead=1, fragment_readahead=1, use_threads=False):
                if rows.num_rows:
                    q = _Rotated(_dense(rows.column("v"), width), turn, dims)
                    q_ids, q_no = rows.column("query_id").to_numpy(), rows.column("query_no").to_numpy()
                    places, found, score = _search(block, order_ids, q, q_ids, rows.column("theta").to_numpy(), k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q_ids[places], q_no[places], found, score)], ["query_id", "query_no", "vec_id", "score"])

        ids, vectors, held = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, block_rows):
                part = batch.slice(lo, block_rows)
                ids.append(part.column("vec_id").to_numpy())
                vectors.append(_dense(part.column("v"), width))
                held += part.num_rows
                if held >= block_rows:
                    yield from against(ids, vectors)
                    ids, vectors, held = [], [], 0
        if held:
            yield from against(ids, vectors)

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, head_rows: int = 2048, head_dims: int = 16, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the highest inner product for each query, ties to the smaller id.

    vectors is as of integer_vectors; is_query is a condition on its rows. Vectors of different lengths are
    padded with zeros. Rows with a query's own id are no candidates for it; equal query rows count once, others
    that share an id are ranked each for itself, all under that id. Repeated candidate rows are candidates each.
    The rotation is fitted on head_rows rows, those of the smallest hash of the id, and the first thresholds
    come from as many of the longest; the search itself takes every row.
    """
    spark = vectors.sparkSession
    vectors = stage(vectors, "vectors")
    rows, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 0, 1)
    schema = "query_id long, rank int, vec_id long, score long"
    if not rows:
        return spark.createDataFrame([], schema)

    def collect(order):
        got = vectors.orderBy(*order, "vec_id").limit(head_rows).select("vec_id", "v").toArrow()
        return got.column("vec_id").to_numpy(), _dense(got.column("v").combine_chunks(), width)

    _, sample = collect([F.xxhash64("vec_id")])
    turn = np.linalg.svd(sample, full_matrices=True)[2].T
    head_ids, head = collect([F.col("norm").desc()])
    dims = min(head_dims, width)
    asked = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct().withColumn("query_no", F.xxhash64("v"))
    path = fresh_dir(spark, "queries")
    asked.mapInArrow(_seed(head_ids, head, turn, dims, k), "query_id long, v array<double>, query_no long, theta double").write.parquet(path)
    ordered = vectors.repartitionByRange(math.ceil(rows / block_rows), F.col("norm").desc(), "vec_id").sortWithinPartitions(F.col("norm").desc(), "vec_id").select("vec_id", "v")
    found = ordered.mapInArrow(_compare(path, width, turn, dims, k, block_rows), _OUT)
    best = Window.partitionBy("query_id", "query_no").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
) WHERE rank <= 5
"""
