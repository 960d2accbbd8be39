"""Intermediate tables in the folder that the driver and all executors share.

A staged table cuts lineage the way a reliable checkpoint does: it is written once, survives the loss of
any executor, and is read back through the ordinary Parquet scan, so that the joins above it start from
plain scans of a known size (which lets Spark broadcast small ones and split skewed ones at run time).
"""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder below /tmp only where that is unset on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = f"/tmp/checkpoints/loomwright-{spark.sparkContext.applicationId}"
        if own not in _OWN:
            _OWN.add(own)
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that no other call uses."""
    return f"{_session_dir(spark)}/{uuid.uuid4().hex}/{tag}"


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loomwright/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all that this session has staged; tables and results that depend on it can be read no more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and return the table read from there."""
    path = fresh_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
