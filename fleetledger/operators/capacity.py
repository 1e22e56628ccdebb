"""Stations with limited capacity: what they release day by day, which lots leave when, and empties that cannot go below zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import interval_match, running_sums
from ..functions.kernels import capped_release, dense_days, floored_balance, ratio, rounded

STATION = ("planta", "tipo_material", "estacion")


def capacity_calendar(calendar: DataFrame) -> DataFrame:
    """Every day with whether it is a weekday, in the stable period, and a Monday on which a stop may begin."""
    days = calendar.select(F.explode(F.sequence("apertura", "corte")).alias("fecha"), "inicio_estable", "fin_base")
    day = F.col("fecha")
    return days.select(
        "fecha", (F.weekday(day) < 5).alias("habil"), day.between(F.col("inicio_estable"), F.col("fin_base")).alias("estable"),
        ((F.weekday(day) == 0) & day.between(F.col("inicio_estable"), F.date_sub("fin_base", 28))).alias("inicio_paro"),
    )


def station_lots(moves: DataFrame, places: DataFrame, classes: DataFrame) -> DataFrame:
    """What left washing and repair each day, and whether its document put it among the empties."""
    doc = ["planta", "anio_contable", "doc_material", "material"]
    known = moves.join(F.broadcast(places), "almacen").join(F.broadcast(classes), "mov_type").where(F.col("evento").isin("traslado", "traslado_bloqueado"))
    gone = known.where((F.col("cantidad") < 0) & F.col("estado").isin("sucios", "reparacion"))
    come = known.where("cantidad > 0").select(*doc, F.col("estado").alias("destino"))
    met = gone.join(come, doc, "left").withColumn("estacion", F.when(F.col("estado") == "sucios", "lavado").otherwise("reparacion"))
    keys = ["planta", "tipo_material", "material", "estacion", F.coalesce(F.col("destino") == "vacios", F.lit(False)).alias("a_vacios"), F.col("fecha_contab").alias("fecha")]
    return met.groupBy(*keys).agg((-F.sum("cantidad")).cast("long").alias("cantidad"))


def empties_delta(daily: DataFrame) -> DataFrame:
    return daily.where("estado = 'vacios'").groupBy("planta", "tipo_material", "material", "fecha").agg(F.sum("delta").cast("long").alias("delta"))


def daily_capacity(lots: DataFrame, days: DataFrame, utilisation: float) -> DataFrame:
    """Each station on each day: what is ready, and its capacity, that is its mean output on stable weekdays over the
    utilisation, on weekdays, and none on other days."""
    ready = lots.groupBy(*STATION, "fecha").agg(F.sum("cantidad").alias("listo"))
    dense = ready.select(*STATION).distinct().crossJoin(F.broadcast(days.select("fecha", "habil", "estable"))).join(ready, [*STATION, "fecha"], "left")
    dense = dense.withColumn("listo", F.coalesce("listo", F.lit(0)).cast("double"))
    stable = Window.partitionBy(*STATION)
    mean = ratio(F.sum(F.when(F.col("estable"), F.col("listo"))).over(stable), F.count(F.when(F.col("estable") & F.col("habil"), 1)).over(stable))
    return dense.withColumn("capacidad", F.when(F.col("habil"), rounded(mean / utilisation, 4)).otherwise(0.0))


def limited_release(dense: DataFrame) -> DataFrame:
    """A station's queue: ready, released and waiting at the close of each day."""
    return capped_release(dense, STATION, "fecha", "listo", "capacidad").select(*STATION, "fecha", "listo", "capacidad", "liberado", "liberado_acum", "cola")


def lot_release(lots: DataFrame, released: DataFrame) -> DataFrame:
    """Which lot leaves on which day: lots wait by day and, within the day, by material; a day releases an interval of the
    same line. One interval match a station."""
    order = ["fecha", "material", "a_vacios"]
    line = running_sums(lots, STATION, order, {"acum_fin": F.col("cantidad")}).withColumn("acum_fin", F.col("acum_fin").cast("double"))
    waiting = line.select(*STATION, "acum_fin", F.struct("material", "a_vacios", F.col("fecha").alias("fecha_lista")).alias("lote"))
    days = released.where("liberado > 0").select(*STATION, F.col("liberado_acum").alias("acum_fin"), F.struct(F.col("fecha").alias("fecha_salida")).alias("dia"))
    met = interval_match(waiting, days, STATION, "lote", "dia").where("lote is not null and cantidad > 1e-6")
    return met.select(*STATION, "lote.*", "dia.*", F.col("cantidad"))


def capped_empties(delta: DataFrame, calendar: DataFrame) -> DataFrame:
    """Empties by day when they stop at zero: balance, and what went out one-way instead."""
    keys = ("planta", "tipo_material", "material")
    dense = dense_days(delta.select(*keys).distinct(), calendar, "apertura", "corte").join(delta, [*keys, "fecha"], "left").withColumn("delta", F.coalesce("delta", F.lit(0)))
    return floored_balance(dense, keys, "fecha", "delta")
