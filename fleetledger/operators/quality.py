"""Data-quality rules over the movement ledger, as one long log with a row for each violation, and the publication gate."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import ratio, rounded, running
from ..functions.tables import beside_hashes, stored
from ..sources.ledger import VARS, Vars, fault_mark

KEY = ("planta", "material", "anio_contable", "doc_material", "posicion")
OUTFLOWS = ("storno_compra", "consumo", "baja", "salida_desechable", "salida_cliente", "faltante_cliente")
INFLOWS = ("entrada_compra", "recogida_cliente")
TRANSFERS = ("traslado", "traslado_bloqueado", "bloqueo", "desbloqueo")
WITH_CUSTOMER = ("salida_cliente", "recogida_cliente", "faltante_cliente")
LOG = ("regla", *KEY, "unidades", "usd_expuesto", "detalle")

#: Regla, defecto, objeto, unidad, severidad, cifra_afectada (figures by spaces) of every rule.
REGLAS = [
    ("error_de_schema", None, "ingesta", "fila", "bloquea", "todas"),
    ("llave_duplicada", "D01", "mb51", "linea", "bloquea", "todas"),
    ("bwart_fuera_de_catalogo", "D02", "mb51", "linea", "bloquea", "brecha ocioso ciclo flota saldo_cliente capacidad"),
    ("lgort_fuera_de_catalogo", "D03", "mb51", "linea", "bloquea", "brecha ocioso flota capacidad"),
    ("cliente_vacio", "D04", "mb51", "linea", "bloquea", "ciclo saldo_cliente"),
    ("signo_invertido", "D05", "mb51", "linea", "bloquea", "brecha ocioso necesidad flota capacidad"),
    ("cantidad_en_piezas", "D06", "mb51", "linea", "bloquea", "tco brecha ocioso ciclo necesidad"),
    ("recogida_sin_saldo", "D07", "mb51", "linea", "bloquea", "ciclo saldo_cliente"),
    ("registro_despues_del_cierre", "D08", "mb51", "linea", "alerta", "serie_mensual"),
    ("precio_documento_distinto", "D16", "mb51", "material", "alerta", None),
    ("material_sin_foto", "D09", "stock_inicial", "material", "bloquea", "brecha ocioso flota capacidad"),
    ("parte_sin_instruccion", "D10", "plan", "parte", "bloquea", "brecha ocioso necesidad"),
    ("parte_sin_registro", None, "plan", "parte", "bloquea", "brecha ocioso necesidad"),
    ("piezas_en_cero", "D11", "instruccion_empaque", "parte", "bloquea", "brecha ocioso necesidad"),
    ("instruccion_a_desechable", "D12", "instruccion_empaque", "parte", "bloquea", "brecha ocioso necesidad"),
    ("instruccion_fuera_de_planta", None, "instruccion_empaque", "parte", "bloquea", "brecha ocioso necesidad"),
    ("llave_plan_duplicada", None, "plan", "parte", "bloquea", "brecha ocioso necesidad"),
    ("unidad_de_precio", "D13", "maestro", "material", "bloquea", "perdida brecha ocioso"),
    ("grupo_contradice_codigo", "D14", "maestro", "material", "bloquea", "perdida tco brecha ocioso"),
    ("material_sin_maestro", "D15", "maestro", "material", "bloquea", "todas"),
    ("grupo_fuera_de_catalogo", "D17", "maestro", "material", "bloquea", "todas"),
    ("moneda_distinta", "D18", "maestro", "material", "bloquea", "perdida tco brecha ocioso necesidad"),
    ("llave_maestro_duplicada", None, "maestro", "material", "bloquea", "todas"),
    ("budat_despues_del_corte", "B04", "mb51", "linea", "bloquea", "brecha ocioso necesidad saldo_cliente"),
    ("documento_repetido", "B03", "mb51", "linea", "bloquea", "tco brecha ocioso ciclo necesidad"),
    ("matnr_con_formato", "B01", "mb51", "linea", "bloquea", "todas"),
    ("kunnr_con_formato", "B02", "mb51", "linea", "bloquea", "ciclo saldo_cliente"),
]
REGLAS_SCHEMA = "regla string, defecto string, objeto string, unidad string, severidad string, cifra_afectada string"
CIFRAS = ("perdida", "tco", "brecha", "ocioso", "ciclo", "necesidad", "flota", "saldo_cliente", "capacidad", "serie_mensual")


def bare(code: str) -> Column:
    """A code without its leading zeros."""
    return F.regexp_replace(code, "^0+", "")


def log(rows: DataFrame, rule, units: Column, detail: Column, cost: str = "costo_unitario_usd") -> DataFrame:
    return rows.select(
        (F.lit(rule) if isinstance(rule, str) else rule).alias("regla"), *KEY, units.cast("long").alias("unidades"), (units * F.col(cost)).cast("double").alias("usd_expuesto"), detail.alias("detalle")
    )


def beside_known(lines: DataFrame, places: DataFrame, pieces: DataFrame) -> DataFrame:
    """Lines with whether their place is known (conocido), and the pieces a container of their material holds (piezas)."""
    return lines.join(F.broadcast(places.select("almacen", F.lit(True).alias("conocido"))), "almacen", "left").join(F.broadcast(pieces), ["planta", "material"], "left")


def own_faults(v: Vars = VARS) -> tuple[Column, Column, Column, Column]:
    """What a line of beside_known shows by itself: the first rule that it breaks of class, place, customer and sign (null: none), whether
    it is counted in pieces, recorded late, and past the cutoff."""
    kind, n, size = F.col("evento"), F.col("cantidad"), F.abs("cantidad")
    wrong_leg = ~F.col("posicion").isin(1, 2) | ((F.col("posicion") == 1) & (n >= 0)) | ((F.col("posicion") == 2) & (n <= 0))
    wrong_sign = (kind.isin(*OUTFLOWS) & (n >= 0)) | (kind.isin(*INFLOWS) & (n <= 0)) | (kind.isin(*TRANSFERS) & wrong_leg)
    first = (
        F.when(kind.isNull(), "bwart_fuera_de_catalogo")
        .when(F.col("almacen").isNotNull() & F.col("conocido").isNull(), "lgort_fuera_de_catalogo")
        .when(kind.isin(*WITH_CUSTOMER, "salida_desechable") & F.col("cliente").isNull(), "cliente_vacio")
        .when(wrong_sign, "signo_invertido")
    )
    in_pieces = (kind == "salida_cliente") & (size >= F.col("piezas")) & (size % F.col("piezas") == 0)
    late = F.col("fecha_registro") > F.date_add(F.last_day("fecha_contab"), v.calidad_dias_cierre)
    return first, in_pieces, late, F.col("fecha_contab") > F.lit(v.fecha_extraccion)


def line_rules(lines: DataFrame, places: DataFrame, pieces: DataFrame, v: Vars = VARS) -> DataFrame:
    """Faults that a line shows by itself, all in one pass: the first that applies of class, place, customer and sign; an
    outflow counted in pieces; a late record; a date past the cutoff. `pieces` has the pieces a container holds by planta and
    material (columns planta, material, piezas)."""
    n, size, booked = F.col("cantidad"), F.abs("cantidad"), F.col("fecha_contab")
    known = beside_known(lines, places, pieces)
    first, in_pieces, late, beyond = own_faults(v)
    fault = lambda rule, units, detail: F.struct(rule.alias("regla"), units.cast("long").alias("n"), detail.alias("detalle"))
    faults = F.array(
        F.when(first.isNotNull(), fault(first, size, F.concat_ws(" ", "mov_type", F.coalesce("almacen", F.lit("-")), n.cast("string")))),
        F.when(in_pieces, fault(F.lit("cantidad_en_piezas"), size - F.floor(size / F.col("piezas")), F.concat(size.cast("string"), F.lit(" con "), F.col("piezas").cast("string"), F.lit(" piezas por contenedor")))),
        F.when(late, fault(F.lit("registro_despues_del_cierre"), size, F.concat(F.lit("registrado "), F.col("fecha_registro").cast("string"), F.lit(", contabilizado "), booked.cast("string")))),
        F.when(beyond, fault(F.lit("budat_despues_del_corte"), size, F.concat(F.lit("contabilizado "), booked.cast("string"), F.lit(f", extracto al {v.fecha_extraccion}")))),
    )
    # Sound lines go before anything is built for them.
    bad = known.where(first.isNotNull() | in_pieces | late | beyond)
    found = bad.select(*KEY, "costo_unitario_usd", F.explode(faults).alias("x")).where("x is not null").select(*KEY, "costo_unitario_usd", "x.*")
    return log(found, F.col("regla"), F.col("n"), F.col("detalle"))


def duplicate_keys(lines: DataFrame) -> DataFrame:
    n = F.abs("cantidad")
    found = lines.groupBy(*KEY).agg((F.sum(n) - F.max(n)).alias("n"), F.max("costo_unitario_usd").alias("costo_unitario_usd"), F.count(F.lit(1)).alias("filas")).where("filas > 1")
    return log(found, "llave_duplicada", F.col("n"), F.concat(F.col("filas").cast("string"), F.lit(" filas con la misma llave")))


ACCOUNT_DAY = ("planta", "cliente", "material", "fecha_contab")


def account_days(lines: DataFrame) -> DataFrame:
    """What customers' accounts did each day: their balance's change (delta), what went out (entrada), and whether anything did (sale)."""
    n, out = F.abs("cantidad"), F.col("evento") == "salida_cliente"
    mine = lines.where(F.col("evento").isin(*WITH_CUSTOMER) & F.col("cliente").isNotNull())
    return mine.groupBy(*ACCOUNT_DAY).agg(F.sum(F.when(out, n).otherwise(-n)).alias("delta"), F.sum(F.when(out, n).otherwise(0)).alias("entrada"), F.max(out).alias("sale"))


def days_without_balance(daily: DataFrame) -> DataFrame:
    """Days on which an account first goes below zero, or before anything went out."""
    account = ACCOUNT_DAY[:-1]
    w = running(account, "fecha_contab")
    seen = daily.withColumn("saldo", F.sum("delta").over(w)).withColumn("entradas", F.sum("entrada").over(w))
    seen = seen.withColumn("antes", F.coalesce(F.lag("saldo").over(Window.partitionBy(*account).orderBy("fecha_contab")), F.lit(0)))
    return seen.where("entradas = 0 or (saldo < 0 and antes >= 0)").select(*ACCOUNT_DAY, "saldo")


def pickups_without_balance(lines: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """Pickups on the days without balance: those of the lines, where none are given."""
    bad = days_without_balance(account_days(lines)) if bad is None else bad
    met = lines.where("evento = 'recogida_cliente'").join(bad, list(ACCOUNT_DAY))
    return log(met, "recogida_sin_saldo", F.abs("cantidad"), F.concat(F.lit("saldo al cierre "), F.col("saldo").cast("string")))


#: What lines of one delivery have in common.
DELIVERY = ("planta", "ref_externa", "material", "cliente", "cantidad", "fecha_contab")
DELIVERED = "evento = 'salida_cliente' and ref_externa is not null"


def repeated_documents(lines: DataFrame) -> DataFrame:
    """One delivery posted again under another document: the lines of the later ones, by date of record (none comes first), year and
    document. Deliveries are grouped once; only those with two documents meet the lines again."""
    same = list(DELIVERY)
    out = lines.where(DELIVERED)
    doc = F.struct("anio_contable", "doc_material")
    first = F.min(F.struct("fecha_registro", "anio_contable", "doc_material")).alias("uno")
    twice = out.groupBy(*same).agg(first, F.min(doc).alias("menor"), F.max(doc).alias("mayor")).where("menor <> mayor")
    again = twice.select(*same, F.col("uno.anio_contable").alias("primer_anio"), F.col("uno.doc_material").alias("primero"))
    met = out.join(again, same).where("anio_contable <> primer_anio or doc_material <> primero")
    return log(met, "documento_repetido", F.abs("cantidad"), F.concat(F.lit("entrega "), "ref_externa", F.lit(", primero en "), "primero"))


def padded_materials(lines: DataFrame, master: DataFrame) -> DataFrame:
    """Materials that the master knows only without their leading zeros."""
    codes = master.groupBy("planta", bare("material").alias("codigo")).agg(F.min("material").alias("en_maestro"), F.max("costo").alias("costo"))
    met = lines.where("tipo_material is null").withColumn("codigo", bare("material")).join(codes, ["planta", "codigo"]).where("en_maestro <> material")
    return log(met, "matnr_con_formato", F.abs("cantidad"), F.concat(F.lit("en el maestro como "), "en_maestro"), "costo")


def misspelt_customers(daily: DataFrame) -> DataFrame:
    """Customers without outflows (planta, cliente) whose code, bare of zeros, is that of one with outflows (cuenta)."""
    customers = daily.groupBy("planta", "cliente").agg(F.max("sale").alias("sale")).withColumn("codigo", bare("cliente"))
    w = Window.partitionBy("planta", "codigo")
    return customers.withColumn("cuenta", F.min(F.when(F.col("sale"), F.col("cliente"))).over(w)).where("not sale and cuenta <> cliente").select("planta", "cliente", "cuenta")


def padded_customers(lines: DataFrame, wrong: DataFrame | None = None) -> DataFrame:
    """Lines of misspelt customers: of those among the lines, where none are given."""
    wrong = misspelt_customers(account_days(lines)) if wrong is None else wrong
    met = lines.where(F.col("evento").isin(*WITH_CUSTOMER)).join(wrong, ["planta", "cliente"])
    return log(met, "kunnr_con_formato", F.abs("cantidad"), F.concat(F.lit("cuenta "), "cuenta"))


def other_price(v: Vars = VARS) -> Column:
    """Whether a line's document has another price than the master."""
    paid, own = F.col("costo_documento_usd"), F.col("costo_unitario_usd")
    return (paid > 0) & (F.abs(paid - own) > own * v.calidad_tolerancia_precio_pct / 100)


def other_document_prices(lines: DataFrame, master: DataFrame, snapshot: DataFrame, v: Vars = VARS) -> DataFrame:
    """Materials whose documents carry another price than the master, where that is in USD: one row a material, worth the
    largest difference on the opening fleet."""
    paid, own = F.col("costo_documento_usd"), F.col("costo_unitario_usd")
    usd = master.where("moneda = 'USD'").select("planta", "material").distinct()
    far = lines.where(other_price(v)).join(usd, ["planta", "material"], "left_semi")
    found = far.groupBy("planta", "material").agg(F.max(F.abs(paid - own)).alias("lejos"), F.min(paid).alias("menor"), F.max(paid).alias("mayor"), F.max(own).alias("maestro"))
    found = found.join(stock_of(snapshot), ["planta", "material"], "left").withColumn("flota", F.coalesce("flota", F.lit(0)))
    detail = F.concat(F.lit("documento "), F.col("menor").cast("string"), F.lit(" a "), F.col("mayor").cast("string"), F.lit(", maestro "), F.col("maestro").cast("string"))
    none = {"anio_contable": F.lit(None).cast("long"), "doc_material": F.lit(None).cast("string"), "posicion": F.lit(None).cast("int")}
    return log(found.withColumns(none), "precio_documento_distinto", F.col("flota"), detail, "lejos")


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """64-bit hashes (_h) of keys that more than one row has. Only the hashes are shuffled; rows that share one by chance are told apart
    by what compares their keys."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.select(F.xxhash64(*key).alias("_h")).repartition(n, "_h").groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")


def suspects(lines: DataFrame, places: DataFrame, pieces: DataFrame, bad: DataFrame, wrong: DataFrame, v: Vars = VARS) -> DataFrame:
    """All lines that a rule of the movements may name: with a fault or an unknown material of their own, another price, a key or a
    delivery that others have, on a day without balance, or of a misspelt customer. What else there is breaks no rule. The lines
    are read three times and shuffled only as hashes."""
    hashed = lambda df, *key: df.select(F.xxhash64(*key).alias("_h")).distinct()
    marks = [
        (KEY, F.lit(True), repeated(lines, *KEY)), (DELIVERY, F.expr(DELIVERED), repeated(lines.where(DELIVERED), *DELIVERY)),
        (ACCOUNT_DAY, F.col("evento") == "recogida_cliente", hashed(bad, *ACCOUNT_DAY)), (("planta", "cliente"), F.col("evento").isin(*WITH_CUSTOMER), hashed(wrong, "planta", "cliente")),
    ]
    met, own = beside_known(lines, places, pieces), own_faults(v)
    named = own[0].isNotNull() | own[1] | own[2] | own[3] | F.col("tipo_material").isNull() | other_price(v)
    for i, (key, when, hashes) in enumerate(marks):
        met = beside_hashes(met, F.when(when, F.xxhash64(*key)), hashes, f"_m{i}")
        named = F.coalesce(named, F.lit(False)) | F.col(f"_m{i}").isNotNull()
    return met.where(named).select(*lines.columns)


def movement_rules(lines: DataFrame, places: DataFrame, known: DataFrame, pieces: DataFrame, master: DataFrame, snapshot: DataFrame, v: Vars = VARS) -> DataFrame:
    """Rules of the movement ledger. A format fault is the cause of a missing balance and is reported in its place. `known`
    has plant, material and cost of all materials. Each rule looks only at the suspects; balances and customers come from all lines."""
    daily = stored(account_days(lines), "account-days")
    bad, wrong = stored(days_without_balance(daily), "days-without-balance"), stored(misspelt_customers(daily), "misspelt")
    lines = stored(suspects(lines, places, pieces, bad, wrong, v), "suspects")
    formats = stored(padded_materials(lines, known).unionByName(padded_customers(lines, wrong)), "formats")  # read twice: reported, and taken out of the balances
    doc = ["planta", "anio_contable", "doc_material", "posicion"]
    missing = pickups_without_balance(lines, bad).join(formats.select(*doc).distinct(), doc, "left_anti").select(*LOG)
    parts = [duplicate_keys(lines), line_rules(lines, places, pieces, v), missing, repeated_documents(lines), other_document_prices(lines, master, snapshot, v), formats]
    return functools.reduce(DataFrame.unionByName, parts)


def violations(found: DataFrame, rules: DataFrame) -> DataFrame:
    """The log with each rule's severity and the figures that it touches."""
    return found.join(F.broadcast(rules), "regla", "left")


def universes(lines: DataFrame, master: DataFrame, parts: DataFrame, plan: DataFrame) -> DataFrame:
    """What each plant has of the units that rules count: lines (or sums of lines, with their number as lineas), materials and parts."""
    lines = lines if "lineas" in lines.columns else lines.withColumn("lineas", F.lit(1).cast("long"))
    materials = master.select("planta", "material").union(lines.select("planta", "material")).distinct()
    known_parts = parts.select("planta", "parte").union(plan.select("planta", "parte")).distinct()
    count = lambda df, unit: df.groupBy("planta").agg(F.count(F.lit(1)).alias("universo_planta")).withColumn("unidad", F.lit(unit))
    return lines.groupBy("planta").agg(F.sum("lineas").alias("universo_planta")).withColumn("unidad", F.lit("linea")).unionByName(count(materials, "material")).unionByName(count(known_parts, "parte"))


def board(found: DataFrame, universe: DataFrame, types: DataFrame) -> DataFrame:
    """Violations by rule, plant and material, with the material's type, beside what the plant has of the rule's unit."""
    made = found.groupBy("regla", "defecto", "objeto", "unidad", "severidad", "cifra_afectada", "planta", "material").agg(F.count(F.lit(1)).alias("violaciones"), F.sum("unidades").alias("unidades"), F.sum("usd_expuesto").alias("usd_expuesto"))
    return made.join(F.broadcast(universe), ["planta", "unidad"], "left").join(F.broadcast(types), ["planta", "material"], "left")


def schema_errors(failures: DataFrame) -> DataFrame:
    """Contract failures (tabla, columna, chequeo, valor, llave) as violations."""
    text = F.concat("tabla", F.lit("."), F.coalesce("columna", F.lit("-")), F.lit(" "), "chequeo", F.lit(": "), F.coalesce("valor", F.lit("nulo")), F.coalesce(F.concat(F.lit(" ("), "llave", F.lit(")")), F.lit("")))
    return table_log(failures, F.lit("error_de_schema"), F.lit(1), F.lit(None), text)


def blocked_figures(found: DataFrame) -> DataFrame:
    """Figures that may not be published, and the rules that block them; `todas` stands for every figure."""
    cut = F.explode(F.split("cifra_afectada", " ")).alias("cifra")
    bad = found.where("severidad = 'bloquea' and cifra_afectada is not null").select("regla", cut).distinct()
    every = F.when(F.col("cifra") == "todas", F.array(*map(F.lit, CIFRAS))).otherwise(F.array("cifra"))
    return bad.select("regla", F.explode(every).alias("cifra")).distinct().groupBy("cifra").agg(F.concat_ws(", ", F.array_sort(F.collect_set("regla"))).alias("reglas"))


def require(found: DataFrame, figures: list[str]) -> None:
    """Raises when a figure is unknown or blocked. The gate's only collect: one row a figure at most."""
    if unknown := sorted(set(figures) - set(CIFRAS)):
        raise ValueError(f"no such figures: {', '.join(unknown)}")
    bad = [f"{r['cifra']}: {r['reglas']}" for r in blocked_figures(found).where(F.col("cifra").isin(figures)).orderBy("cifra").collect()]
    if bad:
        raise ValueError("blocked figures: " + "; ".join(bad))


# --- master, plan and snapshot ------------------------------------------------------------------------------------

TABLE_LOG = ("regla", "planta", "material", "parte", "unidades", "usd_expuesto", "detalle")


def table_log(rows: DataFrame, rule: Column, units: Column, usd: Column, detail: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    have = {c: F.col(c) if c in rows.columns else none.alias(c) for c in ("planta", "material", "parte")}
    return rows.select(rule.alias("regla"), have["planta"], have["material"], have["parte"], units.cast("double").alias("unidades"), usd.cast("double").alias("usd_expuesto"), detail.alias("detalle"))


def all_violations(moves: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """The log of movement_rules and those of the master, plan and snapshot rules as one; what one kind doesn't have is null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables, moves)


def stock_of(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("planta", "material").agg(F.sum("cantidad").alias("flota"))


def master_rules(master: DataFrame, groups: DataFrame, prefixes: dict[str, str], snapshot: DataFrame, used: DataFrame, moved: DataFrame, paid: DataFrame, v: Vars = VARS) -> DataFrame:
    """Rules of the material master (planta, material, grupo_articulos, tipo_material, precio, unidad_precio, moneda, costo).
    `used` is every plant and material in any table, `moved` those with movements, `paid` the mean price of documents. A
    material without a master row that moves, and that the master knows without its zeros, is a fault of format instead."""
    band = master.groupBy("grupo_articulos", "moneda").agg(F.median("costo").alias("mediana"))
    by_type = master.where("tipo_material is not null").groupBy(F.col("tipo_material").alias("tipo_codigo"), "moneda").agg(F.median("costo").alias("mediana_codigo"))
    told = F.coalesce(*[F.when(F.col("material").startswith(p), t) for p, t in prefixes.items()])
    base = master.withColumn("tipo_codigo", told).join(F.broadcast(band), ["grupo_articulos", "moneda"], "left").join(F.broadcast(by_type), ["tipo_codigo", "moneda"], "left")
    base = base.join(stock_of(snapshot), ["planta", "material"], "left").join(F.broadcast(groups.select("grupo_articulos", F.lit(True).alias("conocido"))), "grupo_articulos", "left")
    known, stock = F.col("conocido").isNotNull(), F.coalesce("flota", F.lit(0))
    far = (F.col("costo") < F.col("mediana") / v.calidad_banda_precio) | (F.col("costo") > F.col("mediana") * v.calidad_banda_precio)
    rules = F.array(
        F.when(~known, "grupo_fuera_de_catalogo"), F.when(F.col("moneda") != "USD", "moneda_distinta"), F.when((F.col("unidad_precio") != 1) & far, "unidad_de_precio"),
        F.when(F.col("tipo_codigo").isNotNull() & ~F.col("tipo_codigo").eqNullSafe(F.col("tipo_material")) & known, "grupo_contradice_codigo"),
    )
    found = base.withColumn("regla", F.explode(rules)).where("regla is not null")
    usd = F.when(F.col("regla") == "unidad_de_precio", F.abs(F.col("costo") - F.col("mediana")) * stock).when(F.col("regla") == "grupo_contradice_codigo", F.abs(F.col("costo") - F.col("mediana_codigo")) * stock).otherwise(F.col("costo") * stock)
    detail = F.concat_ws(" ", "grupo_articulos", F.col("precio").cast("long").cast("string"), "moneda", F.lit("por"), F.col("unidad_precio").cast("string"))
    nothing = F.lit(None)
    twice = master.groupBy("planta", "material").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    codes = master.select("planta", bare("material").alias("codigo")).distinct()
    variants = moved.withColumn("codigo", bare("material")).join(codes, ["planta", "codigo"], "left_semi").select("planta", "material").distinct()
    missing = used.join(master.select("planta", "material").distinct(), ["planta", "material"], "left_anti").join(variants, ["planta", "material"], "left_anti")
    missing = missing.join(stock_of(snapshot), ["planta", "material"], "left").join(paid, ["planta", "material"], "left")
    return (
        table_log(found, F.col("regla"), stock, usd, detail)
        .unionByName(table_log(twice, F.lit("llave_maestro_duplicada"), F.col("n"), nothing, F.concat(F.col("n").cast("string"), F.lit(" filas"))))
        .unionByName(table_log(missing, F.lit("material_sin_maestro"), stock, stock * F.col("pagado"), F.lit("sin fila en el maestro")))
    )


def plan_rules(plan: DataFrame, instruction: DataFrame, parts: DataFrame, used: DataFrame) -> DataFrame:
    """Rules of the production plan and what it reads: parts and their packing instruction."""
    key = ["planta", "parte"]
    total = plan.groupBy(*key).agg(F.sum("piezas").alias("piezas"))
    told = instruction.select(*key, "material", F.lit(True).alias("con_instruccion"))
    lone = total.join(told, key, "left").join(parts.select(*key, F.lit(True).alias("con_registro")), key, "left").where("con_instruccion is null or con_registro is null")
    lone = lone.withColumn("regla", F.when(F.col("con_instruccion").isNull(), "parte_sin_instruccion").otherwise("parte_sin_registro")).withColumn("material", F.coalesce("material", F.lit("-")))
    here = used.select("planta", "material", F.lit(True).alias("en_planta")).distinct()
    bad = instruction.join(total, key, "left").join(here, ["planta", "material"], "left").withColumn("piezas", F.coalesce("piezas", F.lit(0)))
    rule = F.when(F.col("piezas_por_contenedor") <= 0, "piezas_en_cero").when(F.col("tipo_material") == "CARTON", "instruccion_a_desechable").when(F.col("en_planta").isNull(), "instruccion_fuera_de_planta")
    bad = bad.withColumn("regla", rule).where("regla is not null")
    horizon = F.concat(F.col("piezas").cast("string"), F.lit(" piezas en el horizonte"))
    made = table_log(lone, F.col("regla"), F.col("piezas"), F.lit(None), horizon).unionByName(table_log(bad, F.col("regla"), F.col("piezas"), F.lit(None), horizon))
    for name, df, own in (("stg_partes", parts, key), ("stg_instruccion_empaque", instruction, key), ("stg_plan_produccion", plan, [*key, "semana"])):
        twice = df.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, "n")
        made = made.unionByName(table_log(twice, F.lit("llave_plan_duplicada"), F.col("n"), F.lit(None), F.concat(F.col("n").cast("string"), F.lit(f" filas en {name}"))))
    return made


def snapshot_rules(snapshot: DataFrame, lines: DataFrame, places: DataFrame, master: DataFrame) -> DataFrame:
    """Unknown places in the snapshot, and returnables that move in a plant without being in its snapshot, unless a
    purchase brought them: they are short by the lowest that their stock goes."""
    cost = master.groupBy("planta", "material").agg(F.max("costo").alias("costo"))
    lost = snapshot.where("almacen is not null").join(F.broadcast(places), "almacen", "left_anti").join(F.broadcast(cost), ["planta", "material"], "left")
    made = table_log(lost, F.lit("lgort_fuera_de_catalogo"), F.col("cantidad"), F.col("cantidad") * F.col("costo"), F.concat(F.lit("foto en "), "almacen"))
    placed = lines.where("almacen is not null")
    absent = placed.where(F.col("tipo_material").isin("KLT", "RACK")).select("planta", "material").distinct().join(snapshot.select("planta", "material").distinct(), ["planta", "material"], "left_anti")
    mine = placed.join(absent, ["planta", "material"])
    daily = mine.groupBy("planta", "material", "fecha_contab").agg(F.sum("cantidad").alias("n"), F.max("costo_unitario_usd").alias("costo"), F.min("evento").alias("evento"))
    daily = daily.withColumn("stock", F.sum("n").over(running(("planta", "material"), "fecha_contab")))
    low = daily.groupBy("planta", "material").agg(F.greatest(-F.min("stock"), F.lit(0)).alias("falta"), F.max("costo").alias("costo"), F.min_by("evento", "fecha_contab").alias("primero"))
    low = low.where(~F.col("primero").eqNullSafe(F.lit("entrada_compra")))
    return made.unionByName(table_log(low, F.lit("material_sin_foto"), F.col("falta"), F.col("falta") * F.col("costo"), F.concat(F.lit("primer movimiento: "), F.coalesce("primero", F.lit("sin evento")))))


# --- detection and impact of planted faults -------------------------------------------------------------------------

#: Fault kinds of the dirty ledger by their mark: the rule that must report each, and when the fault really changes a line.
FALLAS = [
    (0, "D05", "signo_invertido", "true"), (1, "D02", "bwart_fuera_de_catalogo", "true"), (2, "D03", "lgort_fuera_de_catalogo", "almacen is not null"),
    (3, "D04", "cliente_vacio", "cliente is not null"), (4, "D01", "llave_duplicada", "true"), (5, "D08", "registro_despues_del_cierre", "true"), (6, "B04", "budat_despues_del_corte", "true"),
    (7, "B02", "kunnr_con_formato", "cliente is not null and mov_type in ('621', '622', '702')"), (8, "B01", "matnr_con_formato", "true"), (9, "D06", "cantidad_en_piezas", "mov_type = '621'"),
    (10, "B03", "documento_repetido", "mov_type = '621'"), (11, "D16", "precio_documento_distinto", "mov_type in ('621', '622', '702')"),
]


def injected(ledger: DataFrame) -> DataFrame:
    """The log of planted faults: defecto, regla, and the key under which the faulty line, or for D16 the material, stands."""
    kinds = F.array(*[F.when((fault_mark() == h) & F.expr(real), F.struct(F.lit(d).alias("defecto"), F.lit(r).alias("regla"))) for h, d, r, real in FALLAS])
    rows = ledger.where(fault_mark().isin([h for h, *_ in FALLAS])).withColumn("f", F.explode(kinds)).where("f is not null")
    moved, again, padded, line = F.col("mov_type") == "311", F.col("f.defecto") == "B03", F.col("f.defecto") == "B01", F.col("f.defecto") != "D16"
    doc = F.when(moved, F.concat("doc_material", F.lit("-"), F.floor(F.col("posicion") / 2).cast("string"))).otherwise(F.col("doc_material"))
    return rows.select(
        "f.defecto", "f.regla", "planta", F.when(padded, F.concat(F.lit("000"), "material")).otherwise(F.col("material")).alias("material"), F.when(line, F.col("anio_contable")).alias("anio_contable"),
        F.when(line, F.when(again, F.concat(F.lit("Z"), doc)).otherwise(doc)).alias("doc_material"), F.when(line, F.when(moved, 1 + F.col("posicion") % 2).otherwise(F.col("posicion"))).cast("int").alias("posicion"),
    )


def detection(log_: DataFrame, found: DataFrame) -> DataFrame:
    """For each kind of fault: how many were planted, and how many their own rule reports (null-safe by key: the line's
    where the fault is one of a line, the material's else)."""
    key = ["planta", "anio_contable", "doc_material", "posicion", "de_material"]
    keyed = lambda df: df.withColumn("de_material", F.when(F.col("doc_material").isNull(), F.col("material")))
    seen = keyed(found).select("regla", *key).distinct().select(F.col("regla").alias("r"), *[F.col(c).alias(f"r_{c}") for c in key])
    mine = keyed(log_).select("defecto", "regla", *key).distinct()
    on = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in key], F.col("regla") == F.col("r"))
    return mine.join(seen, on, "left").groupBy("defecto", "regla").agg(F.count(F.lit(1)).alias("casos"), F.count("r").alias("detectados"))


#: Fault kinds of the other tables: the number in the code that picks them, the code's kind, the rule that must report
#: each, and when the fault really changes a row. Materials of the master and of the snapshot, or parts.
FALLAS_TABLAS = [
    (5, "maestro", "D17", "grupo_fuera_de_catalogo", "true"), (9, "maestro", "D14", "grupo_contradice_codigo", "tipo_material <> 'RACK'"), (3, "maestro", "D13", "unidad_de_precio", "true"),
    (7, "maestro", "D18", "moneda_distinta", "true"), (11, "maestro", "D15", "material_sin_maestro", "true"), (2, "maestro", None, "llave_maestro_duplicada", "planta = 'P0'"),
    (4, "foto", "D09", "material_sin_foto", "true"), (1, "foto", "D03", "lgort_fuera_de_catalogo", "true"), (6, "parte", "D10", "parte_sin_instruccion", "true"), (8, "parte", "D11", "piezas_en_cero", "true"),
    (10, "parte", "D12", "instruccion_a_desechable", "true"), (12, "parte", None, "instruccion_fuera_de_planta", "true"), (13, "parte", None, "parte_sin_registro", "true"), (14, "parte", None, "llave_plan_duplicada", "true"),
]


def injected_tables(customer: DataFrame, snapshot: DataFrame, instruction: DataFrame) -> DataFrame:
    """The log of faults planted in the master, the snapshot and the plan's tables: defecto, regla, planta, and the material
    or part (llave) that is at fault."""
    number = lambda c: F.element_at(F.split(c, "-"), -1).cast("int").alias("numero")
    own = lambda df, table, c: df.select(F.lit(table).alias("tabla"), "planta", F.col(c).alias("llave"), "tipo_material", number(c)).distinct()
    rows = own(customer, "maestro", "material").unionByName(own(snapshot, "foto", "material")).unionByName(own(instruction, "parte", "parte"))
    kinds = F.array(*[F.when((F.col("numero") == n) & (F.col("tabla") == t) & F.expr(real), F.struct(F.lit(d).cast("string").alias("defecto"), F.lit(r).alias("regla"))) for n, t, d, r, real in FALLAS_TABLAS])
    return rows.withColumn("f", F.explode(kinds)).where("f is not null").select("f.defecto", "f.regla", "planta", "llave").distinct()


def detection_in_tables(log_: DataFrame, found: DataFrame) -> DataFrame:
    """For each kind of fault of the tables: how many were planted, how many their own rule reports for the same plant and
    material or part, and how many others that rule reports."""
    seen = found.select("regla", "planta", F.coalesce("parte", "material").alias("llave"), F.lit(1).alias("visto")).distinct()
    rules = log_.select("regla", "defecto").distinct()
    met = log_.withColumn("caso", F.lit(1)).join(seen.join(F.broadcast(rules.select("regla")), "regla", "left_semi"), ["regla", "planta", "llave"], "full").drop("defecto")
    sums = met.groupBy("regla").agg(F.count("caso").alias("casos"), F.count(F.when(F.col("caso") == 1, F.col("visto"))).alias("detectados"), F.count(F.when(F.col("caso").isNull(), F.col("visto"))).alias("otros"))
    return rules.join(sums, "regla")


def money() -> list[Column]:
    """Sums over the lines of a ledger: three figures."""
    n = F.abs("cantidad").cast("double")
    usd = lambda kind: F.coalesce(F.sum(F.when(F.col("mov_type") == kind, n * F.col("costo_unitario_usd"))), F.lit(0.0))
    return [usd("702").alias("perdida"), usd("621").alias("salidas_usd"), usd("622").alias("recogidas_usd")]


def surplus() -> Column:
    """The identity that no key stands twice: how many lines there are beyond the different keys."""
    return (F.count(F.lit(1)) - F.countDistinct(F.struct(*(c for c in KEY if c != "material")))).cast("double").alias("llave")


def measured(sums: DataFrame, *keys: str) -> DataFrame:
    """Sums as long measurements: tipo, medida, valor."""
    parts = F.array(*[F.struct(F.lit(t).alias("tipo"), F.lit(m).alias("medida"), F.col(m).alias("valor")) for t, m in (("cifra", "perdida"), ("cifra", "salidas_usd"), ("cifra", "recogidas_usd"), ("identidad", "llave"))])
    return sums.select(*keys, F.explode(parts).alias("x")).select(*keys, "x.*")


def figures(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """Figures of a ledger as long measurements: tipo, medida, valor. `shared` has of its lines those whose key another may have, so that
    the others' keys are not shuffled."""
    return measured(lines.agg(*money()).crossJoin(F.broadcast(shared.agg(surplus()))))


def impact(clean: DataFrame, dirty: DataFrame, materiality_pct: float = 1.0) -> DataFrame:
    """What planted faults do to each measurement: change, change in per cent, and whether it passes the materiality; a
    figure that vanishes does, and so does an identity that no longer holds."""
    met = dirty.join(clean.select("tipo", "medida", F.col("valor").alias("valor_limpio")), ["tipo", "medida"], "left")
    pct = F.when(F.col("tipo") == "cifra", rounded((ratio("valor", "valor_limpio") - 1) * 100, 4))
    past = F.when(F.col("tipo") == "cifra", F.coalesce(F.when(F.col("valor").isNull(), F.col("valor_limpio").isNotNull()).otherwise(F.abs("delta_pct") > materiality_pct), F.lit(False))).otherwise(F.col("valor") > 0)
    return met.withColumn("delta", F.col("valor") - F.col("valor_limpio")).withColumn("delta_pct", pct).withColumn("supera_materialidad", past)


def impact_by_fault(clean: DataFrame, dirty: DataFrame, shared: DataFrame, materiality_pct: float = 1.0) -> DataFrame:
    """What each kind of planted fault does alone to each measurement. All carry the marks of faults (h). A fault
    changes no line but its own and all copies of a key have one mark, so a kind's effect is the difference between its own
    lines' sums: `dirty` has the lines with a fault, `clean` all lines without, `shared` of these those whose key another may have."""
    sums = lambda lines, mine: measured(lines.groupBy("h").agg(*money()).join(mine.groupBy("h").agg(surplus()), "h", "left").fillna(0.0, ["llave"]), "h")
    before = sums(clean, shared)
    whole = before.groupBy("tipo", "medida").agg(F.sum("valor").alias("valor_limpio"))
    kinds = clean.sparkSession.createDataFrame([(h, d) for h, d, *_ in FALLAS], "h long, defecto string")
    met = sums(dirty, dirty).join(F.broadcast(kinds), "h").join(before.withColumnRenamed("valor", "antes"), ["h", "tipo", "medida"], "left").join(F.broadcast(whole), ["tipo", "medida"])
    delta = rounded(F.col("valor") - F.coalesce("antes", F.lit(0.0)), 6)
    figure = F.col("tipo") == "cifra"
    made = met.select("defecto", "tipo", "medida", rounded("valor_limpio", 6).alias("valor_limpio"), delta.alias("delta"))
    made = made.withColumn("delta_pct", F.when(figure, rounded(ratio("delta", "valor_limpio") * 100, 4)))
    past = F.when(figure, F.coalesce(F.abs("delta_pct") > materiality_pct, F.lit(False))).otherwise(F.col("delta") > 0)
    return made.withColumn("supera_materialidad", past)


def impact_matrix(impacts: DataFrame) -> DataFrame:
    """Kinds of fault by figures, in per cent of the clean value, and the identities that each kind breaks."""
    figure = lambda m: F.max(F.when(F.col("medida") == m, F.col("delta_pct"))).alias(m)
    broken = F.array_sort(F.collect_set(F.when((F.col("tipo") == "identidad") & F.col("supera_materialidad"), F.col("medida"))))
    return impacts.groupBy("defecto").agg(figure("perdida"), figure("salidas_usd"), figure("recogidas_usd"), F.concat_ws(", ", broken).alias("identidades_rotas"))
