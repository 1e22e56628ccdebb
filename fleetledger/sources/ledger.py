"""A goods-movement ledger derived from the order lines, and the small tables beside it.

Every table has the shape of the input contract; the cutoff is an input, never the largest date in the data.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import stored


@dataclass(frozen=True)
class Vars:
    """Policy constants."""

    fecha_extraccion: dt.date = dt.date(2001, 6, 30)
    antiguedad_conciliacion_dias: int = 120
    ventana_base_semanas: int = 13
    ventana_sigma_semanas: int = 52
    semanas_arranque: int = 13
    backtest_semanas: int = 13
    semanas_minimas_estimacion: int = 26
    calidad_dias_cierre: int = 10
    calidad_banda_precio: float = 3.0
    calidad_tolerancia_precio_pct: float = 5.0
    umbral_merma_pct: float = 1.0
    umbral_ciclo_dias: float = 45.0


VARS = Vars()

#: Small dimension and policy tables.
CLASES_MOVIMIENTO = [
    ("101", "entrada_compra"), ("102", "storno_compra"), ("261", "consumo"), ("311", "traslado"), ("325", "traslado_bloqueado"), ("343", "desbloqueo"),
    ("344", "bloqueo"), ("555", "baja"), ("601", "salida_desechable"), ("621", "salida_cliente"), ("622", "recogida_cliente"), ("702", "faltante_cliente"),
]
ALMACENES = [
    ("RECF", "recepcion"), ("VACI", "vacios"), ("LINE", "linea"), ("LLEN", "llenos"), ("SUCI", "sucios"), ("REPA", "reparacion"), ("SCRP", "scrap"),
    ("RM01", "fuera_ciclo"), ("EXPE", "fuera_ciclo"),
]
PARAMETROS = [
    ("KLT", 3, 4, 2.0, 12.0, 5.0, 15.0, 150, 0.20, 4.50),
    ("RACK", 5, 12, 2.0, 12.0, 5.0, 15.0, 80, 2.50, 45.0),
]
PARAMETROS_SCHEMA = (
    "tipo_material string, dias_cobertura int, lead_time_semanas int, factor_costo_quiebre double, costo_capital_anual_pct double, "
    "flete_mismo_pais_pct double, flete_otro_pais_pct double, vida_util_ciclos int, mant_por_ciclo_usd double, desechable_equiv_usd double"
)
#: escenario, tipo_material, factor_costo_quiebre, costo_capital_anual_pct, z_fija, ajuste_ciclo_dias
ESCENARIOS_BRECHA = [
    ("base", None, None, None, None, None), ("quiebre_1", None, 1.0, None, None, None), ("quiebre_1_5", None, 1.5, None, None, None),
    ("quiebre_2_5", None, 2.5, None, None, None), ("quiebre_3", None, 3.0, None, None, None), ("capital_8", None, None, 8.0, None, None),
    ("capital_10", None, None, 10.0, None, None), ("capital_15", None, None, 15.0, None, None), ("optimista", None, 1.0, 15.0, None, None),
    ("conservador", None, 3.0, 8.0, None, None), ("z_fija_3", None, None, None, 3.0, None), ("lavado_klt_1_dia", "KLT", None, None, None, -1.4),
    ("lavado_klt_3_dias", "KLT", None, None, None, 1.4), ("reparacion_rack_baja", "RACK", None, None, None, -0.6), ("reparacion_rack_alta", "RACK", None, None, None, 0.9),
]
ESCENARIOS_SCHEMA = "escenario string, tipo_material string, factor_costo_quiebre double, costo_capital_anual_pct double, z_fija double, ajuste_ciclo_dias double"
PLANTAS = [("P0", "MX"), ("P1", "MX"), ("P2", "US"), ("P3", "US"), ("P4", "NI")]
#: Pieces in a container of the material with the number 0: more than containers in any line.
PIEZAS = 60
PRECIOS = [("KLT", 25.0), ("RACK", 180.0), ("CARTON", 8.0)]


def seed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def clases_movimiento(spark):
    return seed(spark, CLASES_MOVIMIENTO, "mov_type string, evento string")


def almacenes(spark):
    return seed(spark, ALMACENES, "almacen string, estado string")


def parametros(spark):
    return seed(spark, PARAMETROS, PARAMETROS_SCHEMA)


def plantas(spark):
    return seed(spark, PLANTAS, "planta string, pais string")


def escenarios_brecha(spark):
    return seed(spark, ESCENARIOS_BRECHA, ESCENARIOS_SCHEMA)


def production_plan(customer: DataFrame, v: Vars = VARS) -> tuple[DataFrame, DataFrame]:
    """Plan (planta, parte, semana, piezas) and packing instruction (planta, parte, material, tipo_material,
    piezas_por_contenedor): a part for each account with outflow in the base window, for the twelve weeks after the cutoff at
    the window's mean; from the sixth week on by three tenths more where the material's number divides by five."""
    weeks = v.ventana_base_semanas
    number = F.split("material", "-")[1].cast("int")
    recent = customer.where((F.col("mov_type") == "621") & (F.col("fecha_contab") > F.date_sub(F.lit(v.fecha_extraccion), 7 * weeks)))
    out = recent.groupBy("planta", "cliente", "material", "tipo_material").agg(F.sum(F.abs("cantidad")).cast("long").alias("n")).withColumn("numero", number)
    parts = out.withColumn("parte", F.concat_ws("-", "cliente", "material")).withColumn("piezas_por_contenedor", (PIEZAS + F.col("numero")).cast("long"))
    monday = F.date_add(F.trunc(F.lit(v.fecha_extraccion), "week"), 7 * F.col("k"))
    factor = F.when((F.col("numero") % 5 == 0) & (F.col("k") >= 6), 13).otherwise(10)
    plan = parts.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(12)))).select(
        "planta", "parte", monday.alias("semana"), F.floor(F.col("n") * F.col("piezas_por_contenedor") * factor / (10 * weeks)).cast("long").alias("piezas")
    )
    return plan, parts.select("planta", "parte", "material", "tipo_material", "piezas_por_contenedor")


def numbered(lines: DataFrame) -> DataFrame:
    """Order lines with their number (_n) among those of one order and line number. Only lines whose number stands twice are sorted: the
    others are the first, and are not shuffled."""
    key = ["l_orderkey", "l_linenumber"]
    twice = stored(lines.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in key]), "repeated-lines")
    same = F.col(key[0]).eqNullSafe(F.col(f"_{key[0]}")) & F.col(key[1]).eqNullSafe(F.col(f"_{key[1]}"))
    order = ("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    again = lines.join(twice, same, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return lines.join(twice, same, "left_anti").withColumn("_n", F.lit(1)).unionByName(again)


#: What movements of a day have in common where nothing tells single lines apart.
DAY = ("planta", "cliente", "material", "tipo_material", "mov_type", "almacen", "fecha_contab", "anio_contable", "doc_material")


def by_day(moves: DataFrame) -> DataFrame:
    """Movements summed up by DAY and sign, with their number (lineas): as many rows as there are accounts, places and days, however many
    lines. Sums of quantities, of their sizes and of what has one sign are the same. A document's series (the letters it begins
    with) stands for the document: one series has one class of movement, so that a day's events keep their order."""
    n = F.col("lineas") if "lineas" in moves.columns else F.lit(1)
    series = F.regexp_extract("doc_material", "^[A-Za-z]*", 0).alias("doc_material")
    rows = moves.select(*[series if c == "doc_material" else c for c in DAY], F.signum("cantidad").cast("int").alias("signo"), F.col("cantidad").cast("long").alias("cantidad"), n.cast("long").alias("lineas"))
    return day_sums(rows)


def day_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DAY, "signo").agg(F.sum("cantidad").alias("cantidad"), F.sum("lineas").alias("lineas")).withColumn("posicion", F.lit(0))


def customer_ledger(spark: SparkSession, sf_dir: str, v: Vars = VARS, lines: bool = True) -> DataFrame:
    """Movements with customers: 601/621 out, 622 back, 702 recognised loss. Without `lines` they are not told apart: positions are left
    out, which need their lines' numbers, and a document is its series."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("f", F.to_date("l_shipdate")).where(F.col("f") <= F.lit(v.fecha_extraccion))
    li = numbered(li) if lines else li.withColumn("_n", F.lit(0))
    part = F.col("l_partkey") % 20
    tipo = F.when(part < 12, "KLT").when(part < 18, "RACK").otherwise("CARTON")
    q = F.col("l_quantity").cast("int")
    loss = F.when(F.col("l_orderkey") % 7 == 0, F.floor(F.col("l_quantity") / 10)).when(((F.col("l_orderkey") + F.col("l_linenumber")) % 40 == 0) & (F.col("l_quantity") > 1), 1).otherwise(0)
    base = li.select(
        F.concat(F.lit("P"), (F.col("l_suppkey") % 5).cast("string")).alias("planta"),
        F.concat(F.lit("C"), (F.col("l_orderkey") % 7).cast("string")).alias("cliente"),
        F.concat(F.when(part < 12, "KLT-").when(part < 18, "RCK-").otherwise("CTN-"), part.cast("string")).alias("material"),
        tipo.alias("tipo_material"), "f", q.alias("q"), loss.cast("int").alias("loss"),
        (10 + (F.col("l_partkey") * 7 + F.col("l_orderkey") * 3) % 40).cast("int").alias("lag"),
        F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("doc"),
        (F.col("l_linenumber") * 100 + F.col("_n")).cast("int").alias("pos"),
    )
    keep = ("planta", "cliente", "material", "tipo_material")
    # One pass over the lines: each gives up to three movements.
    out = F.struct(F.when(F.col("tipo_material") == "CARTON", "601").otherwise("621").alias("mov_type"), F.lit("LLEN").alias("almacen"), F.col("f").alias("fecha_contab"), (-F.col("q")).alias("cantidad"), F.lit("A").alias("serie"))
    back = F.struct(F.lit("622").alias("mov_type"), F.lit("SUCI").alias("almacen"), F.date_add("f", F.col("lag")).alias("fecha_contab"), (F.col("q") - F.col("loss")).alias("cantidad"), F.lit("B").alias("serie"))
    quarter = F.last_day(F.add_months(F.trunc(F.date_add("f", 120), "quarter"), 2))
    lost = F.struct(F.lit("702").alias("mov_type"), F.lit(None).cast("string").alias("almacen"), quarter.alias("fecha_contab"), (-F.col("loss")).alias("cantidad"), F.lit("C").alias("serie"))
    returnable = F.col("tipo_material") != "CARTON"
    legs = F.array(out, F.when(returnable & (F.col("q") > F.col("loss")), back), F.when(returnable & (F.col("loss") > 0), lost))
    moved = base.select(*keep, "doc", "pos", F.explode(legs).alias("m")).where("m is not null")
    return moved.select(
        *keep, "m.mov_type", "m.almacen", "m.fecha_contab", "m.cantidad", (F.concat("m.serie", "doc") if lines else F.col("m.serie")).alias("doc_material"), F.col("pos").alias("posicion"),
        F.year("m.fecha_contab").cast("long").alias("anio_contable"),
    ).where(F.col("fecha_contab") <= F.lit(v.fecha_extraccion))


def internal_transfers(customer: DataFrame) -> DataFrame:
    """311 transfers around the customer movements: cleaned after each pickup, filled before each shipment. Each is a document
    of its own, with two legs."""
    summed = [c for c in ("lineas",) if c in customer.columns]

    def legs(kind: str, days: int, source: str, target: str, series: str) -> DataFrame:
        rows = customer.where(F.col("mov_type") == kind).withColumn("n", F.abs("cantidad"))
        pair = F.explode(F.array(F.struct(F.lit(source).alias("a"), (-F.col("n")).alias("n"), F.lit(0).alias("k")), F.struct(F.lit(target).alias("a"), F.col("n").alias("n"), F.lit(1).alias("k"))))
        rows = rows.withColumn("leg", pair).withColumn("fecha", F.date_add("fecha_contab", days))
        return rows.select(
            "planta", F.lit(None).cast("string").alias("cliente"), "material", "tipo_material", F.lit("311").alias("mov_type"), F.col("leg.a").alias("almacen"),
            F.col("fecha").alias("fecha_contab"), F.col("leg.n").alias("cantidad"), F.concat(F.lit(series), F.col("posicion").cast("string"), "doc_material").alias("doc_material"),
            (F.col("posicion") * 2 + F.col("leg.k")).cast("int").alias("posicion"), F.year("fecha").cast("long").alias("anio_contable"), *summed,
        )

    return legs("622", 3, "SUCI", "VACI", "D").unionByName(legs("621", -2, "VACI", "LLEN", "E"))


def with_transfers(customer: DataFrame, v: Vars = VARS) -> DataFrame:
    """The whole ledger: the movements with customers and those inside the plants that go with them."""
    return customer.unionByName(internal_transfers(customer)).where(F.col("fecha_contab") <= F.lit(v.fecha_extraccion))


#: What a marked pickup brings with it: who (0 and 1 by turns, None all), days later, class, place, units, series and position of each line.
WORKSHOP = [
    (None, 0, "101", "RECF", 2, "G", 1), (None, 0, "102", "RECF", -1, "H", 1), (None, 1, "311", "RECF", -1, "I", 2), (None, 1, "311", "SUCI", 1, "I", 3),
    (None, 1, "344", "SUCI", -1, "J", 1), (None, 1, "344", "REPA", 1, "J", 2), (1, 6, "343", "REPA", -1, "K", 1), (1, 6, "343", "VACI", 1, "K", 2),
    (1, 8, "261", "VACI", -1, "L", 1), (0, 6, "325", "REPA", -1, "M", 1), (0, 6, "325", "SCRP", 1, "M", 2), (0, 9, "555", "SCRP", -1, "N", 1),
]


def workshop(customer: DataFrame, v: Vars = VARS) -> DataFrame:
    """Purchases, their reversals, repairs, consumption and scrap around one pickup in ten: a container is bought and takes the place of
    one that is blocked for repair; that one comes back and is used up, or is scrapped."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "doc_material", "posicion").cast("binary")), 1, 8), 16, 10).cast("long")
    rows = customer.where("mov_type = '622'").withColumn("h", h).where("h % 10 = 0").withColumn("turno", F.floor(F.col("h") / 10) % 2)
    line = lambda w: F.struct(F.lit(w[1]).alias("dias"), F.lit(w[2]).alias("mov_type"), F.lit(w[3]).alias("almacen"), F.lit(w[4]).alias("cantidad"), F.lit(w[5]).alias("serie"), F.lit(w[6]).alias("posicion"))
    lines = F.array(*[line(w) if w[0] is None else F.when(F.col("turno") == w[0], line(w)) for w in WORKSHOP])
    made = rows.select("planta", "material", "tipo_material", "fecha_contab", "doc_material", F.col("posicion").alias("pos"), F.explode(lines).alias("x")).where("x is not null")
    made = made.withColumn("fecha_contab", F.expr("date_add(fecha_contab, x.dias)"))
    return made.select(
        "planta", F.lit(None).cast("string").alias("cliente"), "material", "tipo_material", "x.mov_type", "x.almacen", "fecha_contab", "x.cantidad",
        F.concat("x.serie", F.col("pos").cast("string"), "doc_material").alias("doc_material"), "x.posicion", F.year("fecha_contab").cast("long").alias("anio_contable"),
    ).where(F.col("fecha_contab") <= F.lit(v.fecha_extraccion))


def maestro(ledger: DataFrame) -> DataFrame:
    """Material master: planta, material, tipo_material, precio, unidad_precio, moneda, grupo."""
    price = F.element_at(F.create_map(*[F.lit(x) for p in PRECIOS for x in p]), F.col("tipo_material"))
    return ledger.select("planta", "material", "tipo_material").distinct().select(
        "planta", "material", "tipo_material", F.concat(F.lit("Contenedor "), "material").alias("material_desc"), price.alias("precio"), F.lit(1).cast("long").alias("unidad_precio"), F.lit("USD").alias("moneda"),
        F.element_at(F.create_map(*map(F.lit, ("KLT", "G1", "RACK", "G2", "CARTON", "G3"))), F.col("tipo_material")).alias("grupo_articulos"),
    )


def no_snapshot(spark: SparkSession) -> DataFrame:
    """An opening snapshot without rows."""
    return spark.createDataFrame([], "planta string, almacen string, material string, tipo_material string, cliente string, cantidad long, fecha date")


def fault_mark() -> Column:
    """Which fault a line gets, by arithmetic of its key; marks without a fault leave the line as it is."""
    return (F.col("posicion") * 31 + F.substring("doc_material", -6, 6).cast("long")) % 997


def dirty_lines(ledger: DataFrame, classes: DataFrame, v: Vars = VARS, marked: bool = False, mark: Column | None = None) -> DataFrame:
    """The ledger's lines with their event, master type and cost, and faults on a thousandth of the lines each, picked by
    arithmetic of the key: what the quality rules are checked on. Transfers get their leg (1 out, 2 in) as position. With
    `marked`, each line keeps its fault's mark as h; `mark` says which fault a line gets (-1: none), else its own arithmetic does."""
    moved = F.col("mov_type") == "311"
    base = ledger.select("*", (fault_mark() if mark is None else mark).alias("h")).select(
        "planta", "cliente", "material", "almacen", "fecha_contab", "anio_contable", "mov_type", "cantidad", "h",
        F.when(moved, F.concat("doc_material", F.lit("-"), F.floor(F.col("posicion") / 2).cast("string"))).otherwise(F.col("doc_material")).alias("doc_material"),
        F.when(moved, 1 + F.col("posicion") % 2).otherwise(F.col("posicion")).cast("int").alias("posicion"),
    )
    hit = lambda k, a, b: F.when(F.col("h") == k, a).otherwise(F.col(b)).alias(b)
    made = base.select(
        "planta", F.when(F.col("h") == 3, None).when(F.col("h") == 7, F.concat(F.lit("00"), "cliente")).otherwise(F.col("cliente")).alias("cliente"),
        hit(8, F.concat(F.lit("000"), "material"), "material"), F.when((F.col("h") == 2) & F.col("almacen").isNotNull(), "XX99").otherwise(F.col("almacen")).alias("almacen"),
        hit(6, F.date_add(F.lit(v.fecha_extraccion), 3), "fecha_contab"), "anio_contable", hit(1, F.lit("999"), "mov_type"),
        F.when(F.col("h") == 0, -F.col("cantidad")).when((F.col("h") == 9) & (F.col("mov_type") == "621"), F.col("cantidad") * (PIEZAS + F.split("material", "-")[1].cast("long"))).otherwise(F.col("cantidad")).cast("long").alias("cantidad"),
        "doc_material", "posicion", "h", F.when(F.col("mov_type") == "621", F.concat(F.lit("R"), "doc_material")).alias("ref_externa"),
        F.when(F.col("h") == 5, F.date_add(F.last_day("fecha_contab"), 15)).otherwise(F.date_add("fecha_contab", F.col("posicion") % 5)).alias("fecha_registro"),
    )
    again = made.withColumn("copia", F.explode(F.when(F.col("h").isin(4, 10), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    again = again.withColumn("doc_material", F.when((F.col("h") == 10) & (F.col("copia") == 1), F.concat(F.lit("Z"), "doc_material")).otherwise(F.col("doc_material")))
    prefix = F.substring("material", 1, 4)
    tipo = F.when(prefix == "KLT-", "KLT").when(prefix == "RCK-", "RACK").when(prefix == "CTN-", "CARTON")
    price = F.element_at(F.create_map(*[F.lit(x) for p in PRECIOS for x in p]), F.col("tipo_material"))
    # Every other customer line carries its document's price, those of fault 11 a fifth too much.
    paid = F.when(F.col("mov_type").isin("621", "622", "702") & ((F.col("posicion") % 2 == 0) | (F.col("h") == 11)), F.when(F.col("h") == 11, F.col("costo_unitario_usd") * 1.2).otherwise(F.col("costo_unitario_usd")))
    made = again.withColumn("tipo_material", tipo).withColumn("costo_unitario_usd", price).withColumn("costo_documento_usd", paid)
    return made.join(F.broadcast(classes), "mov_type", "left").drop("copia", *[] if marked else ["h"])


#: Prefix of a material's code and the type it stands for; material groups.
PREFIJOS = {"KLT-": "KLT", "RCK-": "RACK", "CTN-": "CARTON"}
GRUPOS = [("G1", "KLT"), ("G2", "RACK"), ("G3", "CARTON")]


def dirty_tables(customer: DataFrame, snapshot: DataFrame, plan: DataFrame, instruction: DataFrame, only: Column | None = None) -> dict[str, DataFrame]:
    """Master, snapshot, plan, instruction and parts with faults picked by the number in a material's code: all faults, or in each
    row the one of the number `only`."""
    mine = lambda n: n if only is None else F.when(n == only, n).otherwise(-1)
    number = F.split("material", "-")[1].cast("int")
    one = lambda n: mine(number) == n
    price = F.element_at(F.create_map(*[F.lit(x) for p in PRECIOS for x in p]), F.col("tipo_material"))
    group = F.element_at(F.create_map(*[F.lit(x) for g, t in GRUPOS for x in (t, g)]), F.col("tipo_material"))
    types = F.create_map(*[F.lit(x) for p in GRUPOS for x in p])
    rows = customer.select("planta", "material", "tipo_material").distinct().where(~one(11))
    copies = F.explode(F.when(one(2) & (F.substring_index("planta", "|", -1) == "P0"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    master = rows.withColumn("copia", copies).select(
        "planta", "material", F.when(one(5), "G9").when(one(9), "G2").otherwise(group).alias("grupo_articulos"), price.alias("precio"), F.when(one(3), 100).otherwise(1).cast("long").alias("unidad_precio"),
        F.when(one(7), "MXN").otherwise("USD").alias("moneda"),
    ).withColumn("tipo_material", F.try_element_at(types, F.col("grupo_articulos"))).withColumn("costo", F.col("precio") / F.col("unidad_precio"))
    photo = snapshot.where(~one(4)).withColumn("almacen", F.when(one(1), "ZZ99").otherwise(F.col("almacen")))
    told = instruction.where(~one(6)).withColumn("piezas_por_contenedor", F.when(one(8), F.lit(0)).otherwise(F.col("piezas_por_contenedor")))
    told = told.withColumn("tipo_material", F.when(one(10), "CARTON").otherwise(F.col("tipo_material"))).withColumn("material", F.when(one(12), F.concat("material", F.lit("X"))).otherwise(F.col("material")))
    part_number = mine(F.element_at(F.split("parte", "-"), -1).cast("int"))
    parts = instruction.select("planta", "parte").where(part_number != 13)
    twice = F.explode(F.when(part_number == 14, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return {"master": master, "snapshot": photo, "plan": plan.withColumn("copia", twice).drop("copia"), "instruction": told, "parts": parts}


def material_groups(spark):
    return seed(spark, GRUPOS, "grupo_articulos string, tipo_grupo string")
