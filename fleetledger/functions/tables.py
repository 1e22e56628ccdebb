"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to how many hashes are broadcast to the rows that may have them; beyond it they meet by a shuffle.
FEW = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for intermediate tables; a local one only where none is named and the session is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_fleetledger_tables", None)
    if made is None:
        made = spark._fleetledger_tables = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back: cuts lineage where several models read the same node."""
    path = f"{shared_dir(df.sparkSession)}/fleetledger/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def unsorted_writes(spark: SparkSession, most: int = 16) -> Iterator[None]:
    """Writes into a folder for each value keep that many files of a task open, and don't sort its rows by folder: a large task would do
    that on disk. Where there are more folders, the rest of the task is sorted."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def beside_hashes(df: DataFrame, key: Column, hashes: DataFrame, name: str) -> DataFrame:
    """df with the row's key, a 64-bit hash, as `name` where it is among the hashes (_h, each once), else null."""
    hashes = stored(hashes.select(F.col("_h").alias(name)), "hashes")
    return df.join(F.broadcast(hashes) if hashes.count() <= FEW else hashes, key == F.col(name), "left")
