"""Approximate nearest neighbours with an inverted multi-index.

Both halves of a vector are quantised by a codebook of their own; the two entries name the cell in which the vector is stored. A query
goes through the cells by rising sum of its halves' squared distances to the cell's centroids, with a heap over the two sorted
lists, until it has met a certain number of different vectors. What stands in the cells it has met is reranked by
exact distance.

How many vectors a query must meet is not guessed: a bounded sample of rows is compared with all rows, and the number is that which
reaches the wanted share of their true neighbours. Copies of one vector count once there, so that a hot cell does not use up a query's
number, and cells are always searched whole. As the cells met are exactly those whose sum is at most that of the last one, each query is sent with this one number to the shards of the
store, whose tasks read the blocks with such cells.
"""

from __future__ import annotations

import math
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..staging import stage
from .blocks import best, deal, dense, lloyd, read_index, usable, write_blocks

_FOUND = "file string, at long, place int, query_id long, vec_id long, score double"


def real_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): without rows whose id or vector is null, or whose vector is zero (or empty) or holds null or non-finite components."""
    x = F.col(vector_col)
    whole = df.where(F.col(id_col).isNotNull() & usable(df, vector_col) & F.exists(x, lambda c: c != 0))
    kind = "array<float>" if df.schema[vector_col].dataType.elementType.typeName() == "float" else "array<double>"
    return whole.select(F.col(id_col).cast("long").alias("vec_id"), x.cast(kind).alias("v"))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs of rows, summed in order of the components."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        step = q[:, j] - x[:, j]
        total += step * step
    return np.sqrt(total)


def near_rows(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, held, k: int, met: np.ndarray | None = None):
    """(queries, ids, distances, rows): the k nearest of held and the rows x; met says which rows count for which query."""
    owner, found, score, row = held
    far = np.full(len(q), np.inf)
    counted = np.bincount(owner, minlength=len(q)) >= k
    np.maximum.at(top := np.zeros(len(q)), owner, score)
    far[counted] = top[counted]
    square = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)
    rough = square - 2 * (q @ x.T)
    ok = q_ids[:, None] != ids
    if met is not None:
        ok &= met
    rough[~ok] = np.inf
    slack = 1e-9 * (square.max(initial=0) + 1)
    most = np.minimum(far**2, np.partition(rough, min(k, rough.shape[1]) - 1, axis=1)[:, min(k, rough.shape[1]) - 1] if rough.shape[1] else np.inf) + 2 * slack
    at_q, at_x = np.nonzero(ok & (rough <= most[:, None]))
    for lo in range(0, len(at_q), 1 << 16):
        a, b = at_q[lo : lo + (1 << 16)], at_x[lo : lo + (1 << 16)]
        owner, found, score, row = (np.concatenate(z) for z in zip((owner, found, score, row), (a, ids[b], distances(q[a], x[b]), b), strict=True))
        kept = best(score, found, owner, k)
        owner, found, score, row = owner[kept], found[kept], score[kept], row[kept]
    return owner, found, score, row


def _nothing():
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)


class Quantiser:
    """Two codebooks; a cell is (entry of the first half) * n + (entry of the second half), n being the second codebook's length."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books, self.cut = (first, second), first.shape[1]

    @property
    def cells(self) -> int:
        return len(self.books[0]) * len(self.books[1])

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to the entries of their codebooks."""
        return tuple(np.maximum((h * h).sum(axis=1)[:, None] - 2 * (h @ b.T) + (b * b).sum(axis=1), 0) for h, b in zip((x[:, : self.cut], x[:, self.cut :]), self.books, strict=True))

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = (d.argmin(axis=1) for d in self.halves(x))
        return a * len(self.books[1]) + b


def reach(first: np.ndarray, second: np.ndarray, filled: np.ndarray, number: float) -> float:
    """The sum at which a query has met so many vectors: cells by rising sum, from a heap with one cell of each row begun."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    heap, met = [(first[a[0]] + second[b[0]], 0, 0)], 0
    while heap:
        total, i, j = heappop(heap)
        met += filled[a[i], b[j]]
        if met >= number:
            return total * (1 + 1e-9) + 1e-12
        if j + 1 < len(b):
            heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))
    return math.inf


def _in_cells(quantiser: Quantiser, width: int):
    def run(batches):
        for batch in batches:
            for part in (batch.slice(lo, 2048) for lo in range(0, batch.num_rows, 2048)):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(quantiser.cell(dense(part.column("v"), width)))], [*part.schema.names, "cell"])

    return run


def _compare_all(q: np.ndarray, q_ids: np.ndarray, width: int, k: int):
    """Nearest rows, and their cells, of a few queries among all rows of a partition."""

    def run(batches):
        held, cells = _nothing(), np.zeros(0, np.int64)
        for batch in batches:
            for part in (batch.slice(lo, 4096) for lo in range(0, batch.num_rows, 4096)):
                n = len(cells)
                old = (*held[:3], np.arange(n))
                owner, found, score, row = near_rows(q, q_ids, dense(part.column("v"), width), part.column("vec_id").to_numpy(), (*old[:3], -1 - old[3]), k)
                new = part.column("cell").to_numpy()
                cells = np.concatenate([new, cells])[np.where(row < 0, len(new) - 1 - row, row)]
                held = (owner, found, score, row)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*held[:3], cells)], ["query", "vec_id", "score", "cell"])

    return run


class _Search:
    def __init__(self, quantiser: Quantiser, store, queries, shards: int, k: int):
        self.quantiser, self.index_path, self.shards, self.k = quantiser, store.index_path, shards, k
        self.store, self.queries = store.reader(), queries.reader()

    def run(self, batches):
        index, store, queries = read_index(self.index_path, "lo_cell"), self.store(), self.queries()
        for batch in batches:
            for row in batch.to_pylist():
                columns, q = queries.read(row["file"], row["at"])
                shard = {c: v[row["shard"] :: self.shards] for c, v in index.items()}
                owner, found, score = self._scan(q, columns.column("vec_id").to_numpy(), np.array(row["limits"]), shard, store)
                ids = columns.column("vec_id").to_numpy()[owner]
                first = [pa.array([row["file"]] * len(owner), pa.string()), pa.array([row["at"]] * len(owner), pa.int64()), pa.array(owner, pa.int32())]
                yield pa.RecordBatch.from_arrays([*first, *[pa.array(c) for c in (ids, found, score)]], ["file", "at", "place", "query_id", "vec_id", "score"])

    def _scan(self, q, q_ids, limits, shard, store):
        first, second = self.quantiser.halves(q)
        n = second.shape[1]
        nearest = np.array([self._least(first, second, n, limits, lo, hi) for lo, hi in zip(shard["lo_cell"], shard["hi_cell"], strict=True)])
        held = _nothing()
        for g in np.argsort(nearest, kind="stable"):
            if nearest[g] == np.inf:
                break
            block, x = store.read(shard["file"][g], shard["at"][g])
            cell = block.column("cell").to_numpy()
            met = first[:, cell // n] + second[:, cell % n] <= limits[:, None]
            held = near_rows(q, q_ids, x, block.column("vec_id").to_numpy(), held, self.k, met)
        return held[:3]

    @staticmethod
    def _least(first, second, n, limits, lo, hi, step: int = 4096) -> float:
        """The smallest sum of a cell from lo to hi that a query meets."""
        low = np.inf
        for at in range(int(lo), int(hi) + 1, step):
            cell = np.arange(at, min(at + step, int(hi) + 1))
            total = first[:, cell // n] + second[:, cell % n]
            low = min(low, total[total <= limits[:, None]].min(initial=np.inf))
        return low


class MultiIndex:
    """All vectors by cell. vectors is as of real_vectors; shorter ones are padded with zeros.

    entries: length of each codebook, some 8 vectors a cell and at most 1,024 if not given. The codebooks are fitted on sample_rows rows, and the number of
    vectors that a query must meet on tuning_rows, for the wanted share of their k nearest: both drawn by a hash of the id.
    """

    def __init__(self, vectors: DataFrame, k: int = 10, share: float = 0.97, entries: int | None = None, sample_rows: int = 32768, tuning_rows: int = 256, block_rows: int = 4096, shard_blocks: int = 256):
        self.vectors, self.k = vectors, k
        self.rows, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
        self.width = max(width or 0, 1)
        if not self.rows:
            return

        def drawn(seed: int, rows: int):
            got = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id", "v").limit(rows).toArrow()
            return got.column("vec_id").to_numpy(), dense(got.column("v").combine_chunks(), self.width)

        entries = entries or max(4, min(1024, round(math.sqrt(self.rows / 8))))
        _, sample = drawn(1, sample_rows)
        cut = (self.width + 1) // 2
        self.quantiser = Quantiser(lloyd(sample[:, :cut], entries), lloyd(sample[:, cut:], entries))
        self._kind = f"vec_id long, v {vectors.schema['v'].dataType.simpleString()}, cell long"
        self.number = "<f4" if "float" in self._kind else "<f8"
        self.placed = stage(vectors.mapInArrow(_in_cells(self.quantiser, self.width), self._kind), "placed")
        self.store = self._write(self.placed, block_rows, self.rows, ("cell",))
        self.shards = max(1, math.ceil(self.store.index.count() / shard_blocks))
        sizes = self.placed.groupBy("cell").agg(F.countDistinct(F.xxhash64("v")).alias("n")).toArrow()  # a number a cell, of at most 1,024 x 1,024
        filled = np.zeros(self.quantiser.cells, np.int64)
        filled[sizes.column("cell").to_numpy()] = sizes.column("n").to_numpy()
        self.filled = filled.reshape(len(self.quantiser.books[0]), -1)
        self.number_to_meet = self._tune(*drawn(2, tuning_rows), share)

    def _write(self, placed: DataFrame, block_rows: int, rows: int, spans):
        ordered = placed.repartitionByRange(max(1, math.ceil(rows / block_rows)), "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
        return write_blocks(ordered, self.width, block_rows, spans, None, self.number)

    def _tune(self, ids: np.ndarray, q: np.ndarray, share: float) -> int:
        """How many vectors the sampled rows must meet to find that share of their true neighbours."""
        found = self.placed.mapInArrow(_compare_all(q, ids, self.width, self.k), "query long, vec_id long, score double, cell long")
        order = Window.partitionBy("query").orderBy("score", "vec_id")
        true = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k).select("query", "cell").toArrow()  # k x tuning_rows at most
        first, second = self.quantiser.halves(q)
        needs = []
        for query, cell in zip(true.column("query").to_pylist(), true.column("cell").to_pylist(), strict=True):
            a, b = divmod(cell, second.shape[1])
            sums = first[query][:, None] + second[query][None]
            needs.append(int(self.filled[sums <= sums[a, b] * (1 + 1e-9)].sum()))
        return int(np.quantile(needs, share, method="higher")) if needs else 0

    def search(self, is_query, batch_rows: int = 128) -> DataFrame:
        """(query_id, rank, vec_id, score): the nearest rows found of each row for which is_query holds, by Euclidean distance, ties to the smaller id.

        Rows with a query's own id are no candidates for it. Equal query rows count once, others that share an id are ranked each for itself; repeated rows
        are candidates each. Where fewer than k rows stand in the cells that a query meets, it is searched in all cells. An empty table gives no rows.
        """
        out = "query_id long, rank int, vec_id long, score double"
        spark = self.vectors.sparkSession
        if not self.rows:
            return spark.createDataFrame([], out)
        asked = stage(self.placed.where(is_query).dropDuplicates(["vec_id", "v"]), "asked")
        n = asked.count()
        if not n:
            return spark.createDataFrame([], out)
        queries = self._write(asked, batch_rows, n, ())
        quantiser, reader, number, filled = self.quantiser, queries.reader(), self.number_to_meet, spark.sparkContext.broadcast(self.filled)

        def limits(batches):
            opened = reader()
            for batch in batches:
                for row in batch.to_pylist():
                    _, q = opened.read(row["file"], row["at"])
                    found = [reach(a, b, filled.value, number) for a, b in zip(*quantiser.halves(q), strict=True)]
                    yield pa.RecordBatch.from_pydict({"file": [row["file"]], "at": [row["at"]], "limits": pa.array([found])})

        def found_by(batches: DataFrame) -> DataFrame:
            found = deal(batches, self.shards).mapInArrow(_Search(quantiser, self.store, queries, self.shards, self.k).run, _FOUND)
            order = Window.partitionBy("file", "at", "place").orderBy("score", "vec_id")
            return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)

        tasks = max(1, min(queries.index.count(), 4096))
        wanted = stage(queries.index.select("file", "at", "n").repartition(tasks).mapInArrow(limits, "file string, at long, limits array<double>"), "limits")
        found = stage(found_by(wanted), "found")
        short = found.groupBy("file", "at", "place").count().where(F.col("count") < self.k).select("file", "at", "place")
        everywhere = queries.index.select("file", "at", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("place"))
        short = stage(everywhere.join(found.select("file", "at", "place").distinct(), ["file", "at", "place"], "left_anti").union(short), "short")
        if not short.isEmpty():
            again = short.groupBy("file", "at").agg(F.collect_set("place").alias("places")).join(queries.index.select("file", "at", "n"), ["file", "at"])
            whole = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.when(F.array_contains("places", i), F.lit(math.inf)).otherwise(F.lit(-1.0)))
            more = found_by(stage(again.select("file", "at", whole.alias("limits")), "again"))
            found = found.join(short, ["file", "at", "place"], "left_anti").unionByName(more.select(*found.columns))
        return found.select("query_id", "rank", "vec_id", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth embedding."""
    return MultiIndex(real_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))).search(F.col("vec_id") % 100 == 0)
