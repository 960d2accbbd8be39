"""Tables for SQL: delimited files as views or tables, queries, exports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..staging import shared_dir


def csv_to_table(spark: SparkSession, path: str | list[str], name: str, separator: str = "\t", schema: str | None = None, columns: Sequence[str] | None = None, persist: bool = False, override: bool = True) -> DataFrame:
    """Register a delimited file under a name: a view, or a saved table with persist.

    The first line has the names unless columns are given. Types are those of schema, or inferred over the
    whole file. A saved table is replaced, or with override=False extended.
    """
    df = spark.read.csv(path, sep=separator, header=columns is None, schema=schema, inferSchema=schema is None)
    if columns is not None:
        df = df.toDF(*columns)
    if persist:
        df.write.mode("overwrite" if override else "append").saveAsTable(name)
        return spark.table(name)
    df.createOrReplaceTempView(name)
    return df


def register_tables(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def run_sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """A query's rows; frames can be named in it in braces."""
    return spark.sql(query, **frames)


def jdbc_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query that an external database runs."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def export(df: DataFrame, path: str, separator: str = "\t", rows_per_file: int | None = None, single: bool = False, force: bool = False) -> bool:
    """Write df as delimited text with a header, unless path has a finished export already; whether it was written."""
    spark = df.sparkSession
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not force and marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        return False
    writer = (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("sep", separator)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.csv(path)
    return True


def _finished(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def cached(spark: SparkSession, name: str, function, /, rebuild: bool = False, version: str = "", **arguments) -> DataFrame:
    """function(**arguments), kept as Parquet in the shared folder under a hash of its name, a version and its arguments.

    Arguments must be plain values, as JSON has them: others, DataFrames among them, are refused with a TypeError, as two
    of them cannot be told apart by their names. What a function reads besides its arguments belongs into version, such
    as a content_hash of a table.
    """
    key = hashlib.sha256(json.dumps([name, version, arguments], sort_keys=True).encode()).hexdigest()[:24]
    path = f"{shared_dir(spark)}/loomwright/cached/{name}-{key}"
    if rebuild or not _finished(spark, path):
        function(**arguments).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def content_hash(df: DataFrame) -> str:
    """A hash of all rows of a table, repeats counted, whatever their order: two sums of row hashes, and the number of rows."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    sums = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")), F.lit(0)).alias(f"s{seed}") for seed in (1, 2)]).first()
    return hashlib.sha256(f"{df.columns}:{sums.n}:{sums.s1}:{sums.s2}".encode()).hexdigest()


def guarded(df: DataFrame, path: str, function, rebuild: bool = False) -> DataFrame:
    """function(df), kept at path beside the content hash of df; a ValueError if path was made from other rows."""
    spark, content = df.sparkSession, content_hash(df)
    if rebuild or not _finished(spark, f"{path}/content"):
        function(df).write.mode("overwrite").parquet(f"{path}/result")
        spark.createDataFrame([(content,)], "hash string").write.mode("overwrite").parquet(f"{path}/content")
    elif spark.read.parquet(f"{path}/content").first().hash != content:
        raise ValueError(f"{path} was made from other rows")
    return spark.read.parquet(f"{path}/result")
