"""Rows of a table over and over, range after range, from where the last run stopped.

The table is written once, in order and with row numbers, into a folder of its own, beside the position. Each range is a DataFrame
that reads the files and row groups with its numbers alone, so that a consumer may run jobs on it, or take its rows: never more
than a range is held. The position moves on when the consumer asks for more; a range whose consumer fails is given again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from .ordinals import number_rows


@dataclass(frozen=True)
class StopRule:
    """When a run ends: after so many cycles, rows or minutes (one of them), or as soon as a file is there."""

    cycles: int | None = None
    rows: int | None = None
    minutes: float | None = None
    stop_file: str | None = None

    def __post_init__(self):
        if sum(x is not None for x in (self.cycles, self.rows, self.minutes)) != 1:
            raise ValueError("one of cycles, rows and minutes is needed")


class Folder:
    """Small files of a folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name if "/" in name else f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replace a file: the new one is whole before the old one goes."""
        held = f"{self.path}/{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(held), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.delete(self._at(name), False)
        self._fs.rename(self._at(held), self._at(name))


class RowFeed:
    """A table's rows in order, again and again; see StopRule. path is a folder in storage that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, range_rows: int = 100_000, clock: Callable[[], float] = time.monotonic):
        self.spark, self.range_rows, self.clock = spark, range_rows, clock
        self.folder = Folder(spark, path)
        self.size = json.loads(self.folder.read("size.json"))["rows"]
        self.table = spark.read.parquet(f"{path}/rows")

    @classmethod
    def create(cls, df: DataFrame, order: Sequence[str], path: str, **options) -> RowFeed:
        """Write df in an order that should be total. A folder that has a feed is used as it is, with its position."""
        folder = Folder(df.sparkSession, path)
        if not folder.exists("size.json"):
            number_rows(df, order).write.mode("overwrite").parquet(f"{path}/rows")
            folder.write("size.json", json.dumps({"rows": df.sparkSession.read.parquet(f"{path}/rows").count()}))
        return cls(df.sparkSession, path, **options)

    @property
    def position(self) -> tuple[int, int]:
        """(cycle, number of the next row)."""
        for name in ("position.json", "position.old"):
            if self.folder.exists(name):
                held = json.loads(self.folder.read(name))
                return held["cycle"], held["row"]
        return 0, 0

    def _move(self, cycle: int, row: int) -> None:
        text = json.dumps({"cycle": cycle, "row": row})
        self.folder.write("position.json", text)
        self.folder.write("position.old", text)  # what counts while the other is replaced

    def frames(self, rule: StopRule) -> Iterator[DataFrame]:
        """The ranges from the position on, with a column ordinal; a cycle is as many rows as the table has, from wherever it starts."""
        began, left = self.clock(), {True: self.size * (rule.cycles or 0), False: rule.rows}[rule.cycles is not None]
        while self.size and (left is None or left > 0):
            if rule.minutes is not None and self.clock() - began >= 60 * rule.minutes:
                return
            if rule.stop_file is not None and self.folder.exists(rule.stop_file):
                return
            cycle, row = self.position
            end = min(row + self.range_rows, self.size, row + left if left is not None else self.size)
            yield self.table.where(F.col("ordinal").between(row, end - 1))
            left = None if left is None else left - (end - row)
            self._move(*((cycle + 1, 0) if end == self.size else (cycle, end)))

    def rows(self, rule: StopRule) -> Iterator[Row]:
        """The rows one by one, a range in the driver at a time; the position moves on with the last of a range."""
        for frame in self.frames(rule):
            yield from frame.orderBy("ordinal").drop("ordinal").collect()
