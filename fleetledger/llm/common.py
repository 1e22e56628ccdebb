"""Shared helpers: where intermediate tables go, and how code reaches the Python workers."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import shared_dir

ROOT = str(Path(__file__).resolve().parents[2])

#: Runs of these become one space wherever texts are compared (fixed by the contracts).
WHITESPACE_RUN = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package when it is run from a checkout."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fleetledger/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id="doc_id", text="text"):
    """One value per distinct (doc_id, text): what identifies a row where ids may be null or repeat."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.col(text))


def whole_row(docs):
    """A row with all columns of docs, whatever their names, as one struct."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
