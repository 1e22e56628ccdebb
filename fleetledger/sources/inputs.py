"""Inputs that may be missing, the snapshot and the window of a run, and tables that leave the engine."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import ratio, rounded
from ..functions.tables import unsorted_writes
from ..operators.stock import snapshot_at
from .extract import roll_back

MEASUREMENTS = "defecto string, nivel string, tipo string, medida string, valor double, casos long, detectados long"


def log_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none. Only Spark looks for it, so that any store will do."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def input_table(spark: SparkSession, path: str, schema: str, required: bool = True) -> DataFrame:
    """A Parquet input with a given schema; where it is missing, an error if it is required, else an empty table."""
    found = log_if_any(spark, path)
    if found is not None:
        return spark.read.schema(schema).parquet(path)
    if required:
        raise FileNotFoundError(f"required input {path} is missing")
    return spark.createDataFrame([], schema)


def plant_files(spark: SparkSession, path: str) -> DataFrame:
    """Movements from a glob of files, or from folders planta=..., with the file of each row as `archivo` (the folder's name where there
    are folders); a filter on planta opens only its folders."""
    rows = spark.read.parquet(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(planta=[^/]+)/", 1)
    return rows.select("*", F.when(folder != "", folder).otherwise(F.col("_metadata.file_name")).alias("archivo"))


def with_plant(raw: DataFrame, column: str = "WERKS") -> DataFrame:
    """An extract whose rows all name a plant; rows that don't stop the job."""
    if missing := raw.where(F.coalesce(F.trim(F.col(column)), F.lit("")) == "").count():
        raise ValueError(f"{missing} rows without {column}")
    return raw


def snapshot_for(photo: DataFrame, moves: DataFrame, places: DataFrame) -> DataFrame:
    """The opening snapshot that a photo of stock gives: a photo before the first movement is one; one at the last movement
    or later is rolled back to the day before the first; one inside the window is an error."""
    first, last = moves.agg(F.min("fecha_contab"), F.max("fecha_contab")).first()
    taken = photo.agg(F.max("fecha")).first()[0]
    if first is None or taken is None or taken < first:
        return photo
    if taken < last:
        raise ValueError(f"the photo of {taken} lies inside the movements, {first} to {last}")
    return roll_back(photo, moves, places, first - dt.timedelta(days=1))


def trim(moves: DataFrame, snapshot: DataFrame, places: DataFrame, since: dt.date) -> tuple[DataFrame, DataFrame]:
    """Movements from a day on, and the snapshot of the day before. The day must lie inside the movements."""
    first, last = moves.agg(F.min("fecha_contab"), F.max("fecha_contab")).first()
    if first is None or not first < since <= last:
        raise ValueError(f"{since} is not inside the movements, {first} to {last}")
    return moves.where(F.col("fecha_contab") >= F.lit(since)), snapshot_at(moves, snapshot, places, since)


def write_by_plant(moves: DataFrame, path: str) -> None:
    """Movements in a folder for each plant, sorted by day, document and line; what was there is replaced. A plant with very
    many movements takes several files, each a range of days."""
    order = ("planta", "fecha_contab", "doc_material", "posicion")
    moves.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("planta").parquet(path)


def write_as_they_come(moves: DataFrame, path: str) -> None:
    """Movements in a folder for each plant, neither shuffled nor sorted."""
    with unsorted_writes(moves.sparkSession):
        moves.write.partitionBy("planta").option("compression", "zstd").parquet(path)


def write_measurements(measured: DataFrame, path: str) -> None:
    """Measurements as CSV with two decimals."""
    floats = {f.name: F.format_string("%.2f", f.name) for f in measured.schema if f.dataType.typeName() == "double"}
    measured.withColumns(floats).write.mode("overwrite").option("header", True).csv(path)


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """The same read as text, every column cast from its text; empty text is null."""
    text = spark.read.option("header", True).option("inferSchema", False).csv(path)
    columns = [c.split() for c in MEASUREMENTS.split(", ")]
    return text.select(*[F.nullif(F.col(c), F.lit("")).cast(t).alias(c) for c, t in columns])


def blind_detection(before: DataFrame, after: DataFrame) -> DataFrame:
    """Faults that no rule saw, before and after rules for them: cases, how many are reported, and the figure that each run
    moves most against its own clean run (nivel `limpio`); a figure that vanished moves most of all."""
    every = before.withColumn("fuente", F.lit("antes")).unionByName(after.withColumn("fuente", F.lit("despues")))
    blind = before.where("defecto is not null").select("defecto").distinct()
    mine = every.join(F.broadcast(blind), "defecto", "left_semi")
    clean = every.where("nivel = 'limpio' and tipo = 'cifra'").select("fuente", "medida", F.col("valor").alias("limpio"))
    moved = mine.where("tipo = 'cifra'").join(F.broadcast(clean), ["fuente", "medida"]).withColumn("delta_pct", rounded((ratio("valor", "limpio") - 1) * 100, 4))
    w = Window.partitionBy("fuente", "defecto", "nivel").orderBy(F.desc_nulls_first(F.abs("delta_pct")), "medida")
    most = moved.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("fuente", "defecto", "nivel", "medida", "delta_pct")
    runs = mine.groupBy("fuente", "defecto", "nivel").agg(F.max("casos").alias("casos"), F.max("detectados").alias("detectados"))
    met = runs.join(most, ["fuente", "defecto", "nivel"], "left")
    side = lambda s: [F.max(F.when(F.col("fuente") == s, F.col(c))).alias(f"{c}_{s}") for c in ("casos", "detectados", "medida", "delta_pct")]
    return met.groupBy("defecto", "nivel").agg(*side("antes"), *side("despues"))
