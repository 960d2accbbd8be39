"""Vectors in blocks that a task reads one at a time.

The rows of a partition are cut, in their order, into blocks. The blocks of a task are one Arrow file in the shared folder, of
which each can be read alone; the index has a row for each block. A file has a name of its own, and only those of tasks
that ended are in the index, so that tasks can be lost and run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, functions as F

from ..staging import fresh_dir
from .arrow import open_fs


def usable(df: DataFrame, vector: str) -> Column:
    """Whether a row's vector is there and has finite components only."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(False))


def dense(column, width: int) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros."""
    out = np.zeros((len(column), width))
    sizes = np.diff(column.offsets.to_numpy())
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _cut(batches: Iterator[pa.RecordBatch], rows: int, within: str | None) -> Iterator[pa.RecordBatch]:
    """Blocks of at most so many rows, in order; none has two values of the column within."""
    held, n, last = [], 0, None

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        key = batch.column(within).to_numpy() if within else np.zeros(batch.num_rows)
        edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if n and lo < hi and key[lo] != last:
                yield whole()
                held, n = [], 0
            while lo < hi:
                last, take = key[lo], min(hi - lo, rows - n)
                held.append(batch.slice(lo, take))
                n, lo = n + take, lo + take
                if n == rows:
                    yield whole()
                    held, n = [], 0
    if n:
        yield whole()


@dataclass(frozen=True)
class Store:
    """Blocks: path of their files, index (a table staged at index_path), width of the vectors and the kind of their numbers."""

    path: str
    index_path: str
    index: DataFrame
    width: int
    number: str

    def reader(self) -> Callable[[], Blocks]:
        """What opens the store inside a task."""
        return partial(Blocks, self.path, self.width, self.number)


def write_blocks(ordered: DataFrame, width: int, rows: int, spans: tuple[str, ...] = (), within: str | None = None, number: str = "<f8") -> Store:
    """The table's rows in blocks, its list column v as width numbers; no null in the columns spans.

    The index has file, at (the block's number in its file), n (its rows), and lo_ and hi_ of each column of spans.
    """
    path = fresh_dir(ordered.sparkSession, "blocks")
    kinds = dict(ordered.dtypes)

    def run(batches):
        fs, folder = open_fs(path)
        fs.create_dir(folder, recursive=True)
        file, sink, at = f"{folder}/{uuid.uuid4().hex}.arrow", None, 0
        for block in _cut(batches, rows, within):
            names = [c for c in block.schema.names if c != "v"]
            x = dense(block.column("v"), width)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(int(number[-1]) * width), len(x), [None, pa.py_buffer(x.astype(number).tobytes())])
            block = pa.RecordBatch.from_arrays([*[block.column(c) for c in names], flat], [*names, "v"])
            if sink is None:
                stream = fs.open_output_stream(file)
                sink = pa.ipc.new_file(stream, block.schema)
            sink.write_batch(block)
            ends = [f(block.column(c).to_numpy()) for c in spans for f in (np.min, np.max)]
            yield pa.RecordBatch.from_arrays([pa.array([y]) for y in (file, at, len(x), *ends)], ["file", "at", "n", *[f"{e}_{c}" for c in spans for e in ("lo", "hi")]])
            at += 1
        if sink is not None:
            sink.close()
            stream.close()

    kind = ", ".join(["file string, at long, n long", *[f"{e}_{c} {kinds[c]}" for c in spans for e in ("lo", "hi")]])
    index_path = fresh_dir(ordered.sparkSession, "index")
    ordered.mapInArrow(run, kind).write.parquet(index_path)
    return Store(path, index_path, ordered.sparkSession.read.schema(kind).parquet(index_path), width, number)


class Blocks:
    """Reads blocks of a path inside a task."""

    def __init__(self, path: str, width: int, number: str):
        self.fs, self.width, self.number = open_fs(path)[0], width, number
        self._open = lru_cache(8)(lambda file: pa.ipc.open_file(self.fs.open_input_file(file)))

    def read(self, file: str, at: int) -> tuple[pa.RecordBatch, np.ndarray]:
        """(columns, vectors as doubles) of a block."""
        batch = self._open(file).get_batch(int(at))
        column, size = batch.column("v"), int(self.number[-1]) * self.width
        flat = np.frombuffer(column.buffers()[1], self.number, count=len(column) * self.width, offset=size * column.offset)
        return batch, flat.reshape(len(column), self.width).astype(np.float64)


def read_index(path: str, *order: str) -> dict[str, np.ndarray]:
    """The columns of a store's index, in order; a row a block."""
    fs, at = open_fs(path)
    table = ds.dataset(at, filesystem=fs, format="parquet").to_table().sort_by([(c, "ascending") for c in (*order, "file", "at")])
    return {c: table.column(c).to_numpy() for c in table.column_names}


def deal(batches: DataFrame, shards: int, tasks: int = 4096) -> DataFrame:
    """Each row of batches once for each shard of a store, dealt evenly to tasks."""
    n = batches.count() * shards
    return batches.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(max(1, min(n, tasks)))


def best(score: np.ndarray, ids: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores of each owner, ties to the smaller id."""
    order = np.lexsort((ids, score, owner))
    own = owner[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(first, np.diff([*first, len(own)]))
    return order[rank < k]


def lloyd(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k centers of a sample, by plain k-means from its first distinct rows; at least one row of zeros."""
    _, first = np.unique(x, axis=0, return_index=True)
    centers = x[np.sort(first)[:k]].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        nearest = np.concatenate([((centers * centers).sum(axis=1) - 2 * (x[lo : lo + 8192] @ centers.T)).argmin(axis=1) for lo in range(0, len(x), 8192)])
        n = np.bincount(nearest, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, nearest, x)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
    return centers
