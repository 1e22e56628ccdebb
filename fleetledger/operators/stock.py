"""Stock by place: a ledger of changes, weekly fleet views, flows between places, and opening stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import FIRST, beside, filtered_sum, running_sum, overall
from ..sources.ledger import VARS, Vars

STATES = ("recepcion", "vacios", "linea", "llenos", "sucios", "reparacion", "scrap", "cliente")
WITH_CUSTOMER = ("salida_cliente", "recogida_cliente", "faltante_cliente")
PLACE = ("planta", "material", "estado", "tipo_stock")


def stock_moves(moves: DataFrame, places: DataFrame, classes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Every change of stock at a place. A movement touches its warehouse with its own sign, and the customer with the sign
    of its class; the snapshot opens places."""
    base = ("planta", "material", "tipo_material")
    known = moves.join(F.broadcast(classes), "mov_type").join(F.broadcast(places), "almacen", "left")
    n, kind = F.col("cantidad").cast("long"), F.col("evento")
    blocked = kind.isin("traslado_bloqueado", "baja") | ((kind == "bloqueo") & (n > 0)) | ((kind == "desbloqueo") & (n < 0))
    here = F.when(F.col("estado") != "fuera_ciclo", F.struct("estado", F.when(blocked, "bloqueado").otherwise("libre").alias("tipo_stock"), n.alias("delta")))
    there = F.when(kind.isin(*WITH_CUSTOMER), F.struct(F.lit("cliente").alias("estado"), F.lit("libre").alias("tipo_stock"), F.when(kind == "salida_cliente", F.abs(n)).otherwise(-F.abs(n)).alias("delta")))
    legs = known.select(*base, "evento", F.col("fecha_contab").alias("fecha"), F.explode(F.array(here, there)).alias("x")).where("x is not null")
    opened = snapshot.join(F.broadcast(places), "almacen", "left").withColumn("estado", F.when(F.col("cliente").isNotNull(), "cliente").otherwise(F.col("estado"))).where("estado is not null")
    opened = opened.select(*base, "estado", F.when(F.col("estado").isin("reparacion", "scrap"), "bloqueado").otherwise("libre").alias("tipo_stock"), F.lit("apertura").alias("evento"), "fecha", F.col("cantidad").alias("delta"))
    return legs.select(*base, "x.estado", "x.tipo_stock", "evento", "fecha", "x.delta").unionByName(opened)


def daily_stock(changes: DataFrame) -> DataFrame:
    """Balance of each place at the close of every day on which it changed."""
    daily = changes.groupBy(*PLACE, "tipo_material", "fecha").agg(F.sum("delta").cast("long").alias("delta")).where("delta <> 0")
    return daily.withColumn("saldo", running_sum("delta", PLACE, "fecha"))


def week(day):
    return F.trunc(day, "week")


def weekly_fleet(daily: DataFrame, v: Vars = VARS, world: Column | None = None) -> DataFrame:
    """Dense weeks from opening to cutoff: stock of each material by state, in the plant and in the whole fleet."""
    sums = {s: filtered_sum(F.col("delta"), F.col("estado") == s).alias(s) for s in STATES} | {"bloqueado": filtered_sum(F.col("delta"), F.col("tipo_stock") == "bloqueado").alias("bloqueado")}
    weekly = daily.groupBy("planta", "material", week("fecha").alias("semana")).agg(*sums.values())
    own = [] if world is None else ["mundo"]
    first = overall(daily, world, week(F.min("fecha")).alias("a"))
    weeks = first.select(*own, F.explode(F.sequence(F.col("a"), week(F.lit(v.fecha_extraccion)), F.expr("interval 7 day"))).alias("semana"))
    keys = daily.select("planta", "material", "tipo_material").distinct()
    dense = beside(keys, weeks, world).join(weekly, ["planta", "material", "semana"], "left")
    upto = [running_sum(F.coalesce(s, F.lit(0)), ("planta", "material"), "semana").cast("long").alias(s) for s in sums]
    made = dense.select("planta", "material", "tipo_material", "semana", F.least(F.date_add("semana", 6), F.lit(v.fecha_extraccion)).alias("fecha_cierre"), *upto)
    inside = sum((F.col(s) for s in STATES[1:-1]), F.col(STATES[0]))
    return made.withColumn("en_planta", inside).withColumn("flota", inside + F.col("cliente"))


def weekly_flows(moves: DataFrame, places: DataFrame, classes: DataFrame) -> DataFrame:
    """Weekly edges between places: transfers by their document's two legs, and exchanges with customers and scrap."""
    known = moves.where(F.col("tipo_material").isin("KLT", "RACK")).join(F.broadcast(classes), "mov_type").join(F.broadcast(places), "almacen", "left").withColumn("semana", week("fecha_contab"))
    doc = ["planta", "anio_contable", "doc_material", "material"]
    legs = known.where("cantidad <> 0")
    gone = legs.where((F.col("cantidad") < 0) & F.col("evento").isin("traslado", "traslado_bloqueado")).select(*doc, "tipo_material", "semana", F.col("estado").alias("origen"), (-F.col("cantidad")).alias("n"))
    come = legs.where("cantidad > 0").select(*doc, F.col("estado").alias("destino"))
    moved = gone.join(come, doc).where("origen <> destino")
    edge = lambda **by: F.coalesce(*[F.when(F.col("evento") == k, x) for k, x in by.items()])
    outer = known.where(F.col("evento").isin(*WITH_CUSTOMER, "baja")).select(
        "planta", "tipo_material", "semana", edge(salida_cliente="llenos", baja="scrap", recogida_cliente="cliente", faltante_cliente="cliente").alias("origen"),
        edge(salida_cliente="cliente", recogida_cliente="sucios", faltante_cliente="faltante", baja="baja").alias("destino"), F.abs("cantidad").alias("n"),
    )
    keys = ["planta", "tipo_material", "semana", "origen", "destino"]
    return moved.select(*keys, "n").unionByName(outer).groupBy(*keys).agg(F.sum("n").cast("long").alias("contenedores"))


def weekly_network(moves: DataFrame, classes: DataFrame) -> DataFrame:
    """Weekly outflows, pickups and recognised losses of each route and type."""
    known = moves.where(F.col("tipo_material").isin("KLT", "RACK")).join(F.broadcast(classes), "mov_type").where(F.col("evento").isin(*WITH_CUSTOMER))
    flow = lambda kind, name: F.coalesce(filtered_sum(F.abs("cantidad"), F.col("evento") == kind), F.lit(0)).cast("long").alias(name)
    return known.groupBy("planta", "cliente", "tipo_material", week("fecha_contab").alias("semana")).agg(flow("salida_cliente", "salidas"), flow("recogida_cliente", "recogidas"), flow("faltante_cliente", "faltante"))


def minimum_opening(moves: DataFrame, place: str) -> DataFrame:
    """The least opening stock with which a place never runs out, were each day's outflow to come before its inflow."""
    mine = moves.where(F.col("almacen") == place)
    n = F.col("cantidad").cast("long")
    daily = mine.groupBy("planta", "material", "tipo_material", F.col("fecha_contab").alias("fecha")).agg(F.sum(n).alias("neto"), F.sum(F.greatest(-n, F.lit(0))).alias("salida"))
    w = Window.partitionBy("planta", "material").orderBy("fecha").rowsBetween(FIRST, -1)
    low = F.coalesce(F.sum("neto").over(w), F.lit(0)) - F.col("salida")
    return daily.withColumn("bajo", low).groupBy("planta", "material", "tipo_material").agg(F.greatest(F.lit(0), -F.min("bajo")).cast("long").alias("minimo"))


def opening_snapshot(moves: DataFrame, margin: int = 10) -> DataFrame:
    """A snapshot the day before the first movement: empties at their minimum and a margin."""
    day = moves.agg(F.date_sub(F.min("fecha_contab"), 1).alias("fecha"))
    least = minimum_opening(moves, "VACI").where(F.col("tipo_material") != "CARTON")
    return least.crossJoin(F.broadcast(day)).select(
        "planta", F.lit("VACI").alias("almacen"), "material", "tipo_material", F.lit(None).cast("string").alias("cliente"), (F.col("minimo") + margin).alias("cantidad"), "fecha"
    )


def snapshot_at(moves: DataFrame, snapshot: DataFrame, places: DataFrame, day) -> DataFrame:
    """The snapshot rolled forward to a day: what was there, and all earlier movements, by warehouse and by customer."""
    n = F.col("cantidad").cast("long")
    before = moves.where(F.col("fecha_contab") < F.lit(day))
    cycle = F.broadcast(places.where("estado <> 'fuera_ciclo'").select("almacen"))
    base = ("planta", "material", "tipo_material")
    none = F.lit(None).cast("string")
    stored = before.join(cycle, "almacen", "left_semi").select(*base, "almacen", none.alias("cliente"), n.alias("cantidad"))
    held = before.where(F.col("mov_type").isin("621", "622", "702")).select(*base, none.alias("almacen"), "cliente", F.when(F.col("mov_type") == "621", F.abs(n)).otherwise(-F.abs(n)).alias("cantidad"))
    every = snapshot.select(*base, "almacen", "cliente", "cantidad").unionByName(stored).unionByName(held)
    made = every.groupBy(*base, "almacen", "cliente").agg(F.sum("cantidad").alias("cantidad")).where("cantidad <> 0")
    return made.withColumn("fecha", F.date_sub(F.lit(day), 1))


def numbered_documents(moves: DataFrame) -> DataFrame:
    """Sequential document numbers of each year, by day and old number. A day numbers its own documents, and starts where
    the days before it ended: no window holds a whole year's documents."""
    docs = moves.select("anio_contable", "fecha_contab", "doc_material").distinct()
    days = docs.groupBy("anio_contable", "fecha_contab").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("anio_contable").orderBy("fecha_contab").rowsBetween(FIRST, -1))
    days = days.select("anio_contable", "fecha_contab", F.coalesce(before, F.lit(0)).alias("antes"))
    own = F.row_number().over(Window.partitionBy("anio_contable", "fecha_contab").orderBy("doc_material"))
    made = docs.withColumn("propio", own).join(F.broadcast(days), ["anio_contable", "fecha_contab"])
    return made.select("anio_contable", "fecha_contab", "doc_material", F.concat(F.lit("49"), F.lpad((F.col("antes") + F.col("propio")).cast("string"), 8, "0")).alias("numero"))


def month_end_batch(moves: DataFrame, v: Vars = VARS) -> DataFrame:
    """Movements of a month gathered on its last weekday; batches past the cutoff are not made."""
    last = F.last_day("fecha_contab")
    day = F.date_sub(last, F.greatest(F.lit(0), F.weekday(last) - 4))
    made = moves.groupBy("planta", "material", "tipo_material", day.alias("fecha_contab")).agg(F.sum(F.abs("cantidad")).cast("long").alias("cantidad"))
    return made.where(F.col("fecha_contab") <= F.lit(v.fecha_extraccion))
