"""Streams: ingest in steps, windows, sessions and deduplication under a watermark.

Each function takes a batch or a streaming DataFrame. Times without a zone are taken as UTC instants, as
watermarks need.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def event_time(df: DataFrame, column: str = "ts", delay: str | None = None) -> DataFrame:
    """df with the column as a timestamp, and a watermark if a delay is given."""
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, delay) if delay else out


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_step: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that a stream has now to a Parquet table; what an earlier call has taken is not taken again."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(df: DataFrame, length: str, aggregates: Sequence[Column], slide: str | None = None, by: Sequence[str] = (), column: str = "ts") -> DataFrame:
    """(start, end, by, aggregates) of tumbling windows, or sliding ones with slide."""
    grouped = df.groupBy(F.window(column, length, slide or length), *by).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *[c for c in grouped.columns if c != "window" and c not in by])


def sessions(df: DataFrame, gap: str, aggregates: Sequence[Column], by: Sequence[str], column: str = "ts") -> DataFrame:
    """(start, end, by, aggregates) of sessions: runs of rows of a key less than a gap apart; the end is the last row's time plus the gap."""
    grouped = df.groupBy(F.session_window(column, gap), *by).agg(*aggregates)
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, *[c for c in grouped.columns if c != "session_window" and c not in by])


def drop_repeats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row of each key; a stream keeps keys as long as its watermark asks for."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


class Resumed:
    """A stream whose state lives in a folder: each call of run takes what has arrived since, under the same watermark and state.

    files is where files arrive; build makes the result of the stream of them; rows of the result are appended to out. A file is
    taken once, whatever stops in between.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, build: Callable[[DataFrame], DataFrame]):
        self.spark, self.schema, self.build = spark, schema, build
        self.files, self.out, self.progress = (f"{folder}/{n}" for n in ("files", "out", "progress"))

    def arrive(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.files)

    def run(self) -> None:
        ingest(self.build(read_stream(self.spark, self.files, self.schema, 1000)), self.out, self.progress)

    def result(self) -> DataFrame:
        return self.spark.read.schema(self.build(self.spark.createDataFrame([], self.schema)).schema).parquet(self.out)
