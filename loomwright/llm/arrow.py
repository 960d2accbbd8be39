"""Small helpers: rows of Arrow batches, and joins with tables of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Keys of at most so many rows and bytes are sent to where the texts are read; texts are shuffled to more.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def rows(batch: pa.RecordBatch, key: str, text: str) -> Iterator[tuple[int | None, bytes]]:
    """(key, UTF-8 bytes) of each row; a null text is empty."""
    keys = batch.column(key).to_pylist()
    texts = batch.column(text).cast(pa.large_binary())
    for i, k in enumerate(keys):
        yield k, texts[i].as_py() or b""


def small(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about limit bytes of text, one row at least, so that what is made from a slice stays small."""
    for batch in batches:
        if batch.num_rows:
            part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)) // limit
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cut, cut[1:], strict=False):
                yield batch.slice(lo, hi - lo)


def open_fs(uri: str):
    """(file system, path) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def sized(df: DataFrame) -> DataFrame:
    """A staged table of keys, to be broadcast if it is within BROADCAST_ROWS and BROADCAST_BYTES, and else as it is."""

    def width(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.octet_length(name)
        return 8 + 8 * F.size(name) if kind.startswith("array") else F.lit(8)

    each = F.lit(0)
    for name, kind in df.dtypes:
        each = each + F.greatest(F.coalesce(width(name, kind), F.lit(0)), F.lit(8))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df
