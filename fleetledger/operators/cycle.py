"""The customer cycle: accounts, first-in first-out tranches, survival, balances, losses and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import match_points, sums_by_day
from ..functions.kernels import beside, filtered_sum, ratio, rounded, running_sum, weighted_percentiles, overall
from ..sources.ledger import VARS, Vars

ACCOUNT = ("planta", "cliente", "material")
EVENT_ORDER = ("fecha_contab", "anio_contable", "doc_material", "posicion")


def _event_order():
    return [F.asc_nulls_last(c) for c in EVENT_ORDER]


def price_of(master: DataFrame) -> DataFrame:
    """Unit cost of each planta and material; null where the price unit is zero."""
    return master.select("planta", "material", "tipo_material", ratio("precio", "unidad_precio").alias("costo_unitario_usd"))


def staged_movements(lines: DataFrame, master: DataFrame) -> DataFrame:
    """Movement lines with the master's type and unit cost by planta and material, and how late each was recorded; what the
    master lacks stays, with nulls, and no class is left out."""
    late = F.datediff("fecha_registro", "fecha_contab")
    return lines.drop("tipo_material", "costo_unitario_usd").join(F.broadcast(price_of(master)), ["planta", "material"], "left").select(
        "planta", "cliente", "material", "tipo_material", "almacen", "mov_type", "fecha_contab", "fecha_registro", "anio_contable", "doc_material", "posicion", "cantidad", "costo_unitario_usd",
        late.alias("lag_dias"), (late > 2).alias("flag_tardio"),
    )


def typed(rows: DataFrame, master: DataFrame) -> DataFrame:
    """Rows of a table by planta and material with the master's type."""
    return rows.drop("tipo_material").join(F.broadcast(master.select("planta", "material", "tipo_material")), ["planta", "material"], "left")


def account_movements(moves: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Events of customer accounts. The class gives the sign, not the quantity's own; snapshot rows open accounts."""
    size = F.abs(F.col("cantidad").cast("long"))
    events = moves.where(F.col("mov_type").isin("621", "622", "702")).select(
        *ACCOUNT, "tipo_material", "mov_type", "fecha_contab", "anio_contable", "doc_material", "posicion", size.alias("cantidad_abs"),
        F.when(F.col("mov_type") == "621", size).otherwise(-size).alias("delta_saldo"), F.lit(False).alias("en_foto"),
    )
    opening = snapshot.where(F.col("cliente").isNotNull()).select(
        *ACCOUNT, "tipo_material", F.col("fecha").alias("fecha_contab"), F.col("cantidad").alias("cantidad_abs"), F.col("cantidad").alias("delta_saldo"), F.lit(True).alias("en_foto")
    )
    return events.unionByName(opening, allowMissingColumns=True)


#: Units of an account in a block of single lines.
UNITS = 1_000_000


def fifo_tranches(account: DataFrame, lines: bool = False) -> DataFrame:
    """What closed each outflow, first in first out: one row for each slice of an outflow and its closure, with nulls for
    the closure where the slice is still out. Ages of snapshot stock are unknown. Single `lines` of accounts are shuffled twice, to
    their day and to their block of units, and what their days sum up to is small. Without `lines` the rows are sums by day: an account
    has a few a day, however many lines, and is one window."""
    numbered = account.where("cantidad_abs <> 0").drop("delta_saldo").withColumn("salida", F.coalesce(F.col("mov_type") == "621", F.lit(False)) | F.col("en_foto"))
    sums = {"_out": F.when(F.col("salida"), F.col("cantidad_abs")), "_back": F.when(~F.col("salida"), F.col("cantidad_abs"))}
    upto = {n: F.coalesce(running_sum(c, ACCOUNT, *_event_order()), F.lit(0)) for n, c in sums.items()}
    ends = sums_by_day(numbered, ACCOUNT, EVENT_ORDER[0], _event_order(), sums) if lines else numbered.withColumns(upto)
    ends = ends.withColumn("acum_fin", F.when(F.col("salida"), F.col("_out")).otherwise(F.col("_back"))).where("cantidad_abs > 0")
    s = F.struct(
        "tipo_material", F.col("fecha_contab").alias("fecha_salida"), F.col("anio_contable").alias("anio_salida"), F.col("doc_material").alias("doc_salida"),
        F.col("posicion").alias("pos_salida"), F.col("en_foto").alias("salida_en_foto"))
    c = F.struct(F.col("mov_type").alias("tipo_cierre"), F.col("fecha_contab").alias("fecha_cierre"), F.col("anio_contable").alias("anio_cierre"), F.col("doc_material").alias("doc_cierre"))
    both = ends.select(*ACCOUNT, "acum_fin", F.when(F.col("salida"), s).alias("s"), F.when(~F.col("salida"), c).alias("c"))
    met = match_points(both, ACCOUNT, "s", "c", UNITS).where("s is not null")
    return met.select(*ACCOUNT, "s.*", "c.*", "cantidad").withColumn("dias", F.when(~F.col("salida_en_foto"), F.datediff("fecha_cierre", "fecha_salida")))


def returned(tranches: DataFrame) -> DataFrame:
    """Tranches that a pickup closed and whose age is known."""
    return tranches.where((F.col("tipo_cierre") == "622") & ~F.col("salida_en_foto"))


def survival(tranches: DataFrame) -> DataFrame:
    """Share of units still with the customer at each age, by type, from returned tranches."""
    closed = returned(tranches).groupBy("tipo_material", "dias").agg(F.sum("cantidad").alias("cantidad"))
    span = closed.groupBy("tipo_material").agg(F.max("dias").alias("ultimo"), F.sum("cantidad").alias("total"))
    ages = span.select("tipo_material", "total", F.explode(F.sequence(F.lit(0), "ultimo")).alias("edad"))
    gone = running_sum(F.coalesce("cantidad", F.lit(0)), ["tipo_material"], "edad")
    dense = ages.join(closed.withColumnRenamed("dias", "edad"), ["tipo_material", "edad"], "left")
    return dense.select("tipo_material", "edad", (1 - gone.cast("double") / F.col("total").cast("double")).alias("prob_en_cliente"))


def month_calendar(account: DataFrame, v: Vars = VARS) -> DataFrame:
    """Months from the first movement to the cutoff, each with its last weekday as the close."""
    first = account.agg(F.trunc(F.min("fecha_contab"), "month").alias("a"))
    months = first.select(F.explode(F.sequence(F.col("a"), F.trunc(F.lit(v.fecha_extraccion), "month"), F.expr("interval 1 month"))).alias("mes"))
    last = F.last_day("mes")
    return months.select("mes", F.date_sub(last, F.greatest(F.lit(0), F.weekday(last) - 4)).alias("fin_mes"))


def monthly_accounts(account: DataFrame, curve: DataFrame, v: Vars = VARS) -> DataFrame:
    """Accounts by month: flows, closing balance, the balance that the survival curve expects, and the excess."""
    months = month_calendar(account, v)
    opened = account.groupBy(*ACCOUNT, "tipo_material").agg(F.min("fecha_contab").alias("desde"))
    base = opened.join(F.broadcast(months), F.col("fin_mes") >= F.col("desde")).drop("desde")
    flow = lambda kind: filtered_sum(F.col("cantidad_abs"), F.col("mov_type") == kind)
    by_month = account.groupBy(*ACCOUNT, F.trunc("fecha_contab", "month").alias("mes")).agg(
        flow("621").alias("salidas"), flow("622").alias("recogidas"), flow("702").alias("faltantes"), F.sum("delta_saldo").alias("delta")
    )
    daily = account.where("mov_type = '621'").groupBy(*ACCOUNT, "tipo_material", "fecha_contab").agg(F.sum("cantidad_abs").alias("n"))
    horizon = curve.agg(F.max("edad").alias("horizonte"))
    # Months inside the horizon of each day, by explosion; the curve then joins by equal age.
    near = daily.crossJoin(F.broadcast(horizon)).withColumn("mes", F.explode(F.sequence(F.trunc("fecha_contab", "month"), F.trunc(F.expr("date_add(fecha_contab, horizonte)"), "month"), F.expr("interval 1 month"))))
    aged = near.join(F.broadcast(months), "mes").withColumn("edad", F.datediff("fin_mes", "fecha_contab")).where("edad between 0 and horizonte")
    expected = aged.join(F.broadcast(curve), ["tipo_material", "edad"]).groupBy(*ACCOUNT, "mes").agg(F.sum(F.col("n") * F.col("prob_en_cliente")).alias("saldo_esperado"))
    full = base.join(by_month, [*ACCOUNT, "mes"], "left").join(expected, [*ACCOUNT, "mes"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    made = full.select(
        *ACCOUNT, "tipo_material", "mes", "fin_mes", zero("salidas"), zero("recogidas"), zero("faltantes"),
        running_sum(F.coalesce("delta", F.lit(0)), ACCOUNT, "mes").alias("saldo_fin_mes"), F.coalesce("saldo_esperado", F.lit(0.0)).alias("saldo_esperado"),
    )
    return made.withColumn("exceso_saldo", F.col("saldo_fin_mes") - F.col("saldo_esperado"))


def route_excess(monthly: DataFrame, account: DataFrame, curve: DataFrame) -> DataFrame:
    """Routes by month: excess over the expected balance, alone and over three closes."""
    since = account.agg(F.min("fecha_contab").alias("a")).crossJoin(curve.agg(F.max("edad").alias("e"))).select(F.expr("date_add(a, e)").alias("minima"))
    route = monthly.groupBy("planta", "cliente", "mes", "fin_mes").agg(F.sum("saldo_fin_mes").cast("long").alias("saldo"), F.sum("saldo_esperado").alias("esperado"))
    w = Window.partitionBy("planta", "cliente").orderBy("mes").rowsBetween(-2, 0)
    route = route.withColumns({
        "v_exceso": F.sum(F.col("saldo") - F.col("esperado")).over(w), "v_esperado": F.sum("esperado").over(w),
        "cierres": F.count(F.lit(1)).over(w), "primero": F.min("fin_mes").over(w),
    })
    excess = F.col("saldo") - F.col("esperado")
    return route.crossJoin(F.broadcast(since)).select(
        "planta", "cliente", "mes", F.col("saldo").alias("saldo_fin_mes"), rounded("esperado", 1).alias("saldo_esperado"), rounded(excess, 1).alias("exceso_saldo"),
        rounded(ratio(excess * 100, F.col("esperado")), 2).alias("exceso_pct"), rounded(ratio(F.col("v_exceso") * 100, F.col("v_esperado")), 2).alias("exceso_pct_ciclo"),
        ((F.col("cierres") == 3) & (F.col("primero") >= F.col("minima"))).alias("alerta_valida"),
    )


def reconcilable_loss(moves: DataFrame, snapshot: DataFrame, v: Vars = VARS, world: Column | None = None) -> DataFrame:
    """Outflows and recognised losses, with whether they count in the loss rate (`en_tasa`).

    Outflows count when the last reconciliation could see them; on routes that opened with customer stock, both count only
    from the first reconciliation that covers nothing older than the snapshot."""
    age = v.antiguedad_conciliacion_dias
    flows = moves.where(F.col("mov_type").isin("621", "702"))
    losses = flows.where("mov_type = '702'")
    latest = overall(losses, world, F.max("fecha_contab").alias("ultima"))
    seen = snapshot.groupBy("planta").agg(F.min("fecha").alias("fecha_foto"))
    stocked = snapshot.where("cliente is not null").select("planta", "cliente").distinct().join(seen, "planta")
    closes = losses.select("planta", F.col("fecha_contab").alias("cierre")).distinct()
    closes = closes.withColumn("anterior", F.lag("cierre").over(Window.partitionBy("planta").orderBy("cierre")))
    whole = closes.join(stocked.select("planta", "fecha_foto").distinct(), "planta").where(F.date_sub("anterior", age) >= F.col("fecha_foto"))
    whole = whole.groupBy("planta").agg(F.min("cierre").alias("primera"), F.min_by("anterior", "cierre").alias("anterior"))
    marked = beside(flows, latest, world).join(stocked.select("planta", "cliente", F.lit(True).alias("con_foto")), ["planta", "cliente"], "left").join(F.broadcast(whole), "planta", "left")
    fresh = F.col("con_foto").isNull()
    counted = F.when(F.col("mov_type") == "702", fresh | (F.col("fecha_contab") >= F.col("primera"))).otherwise(
        (F.col("fecha_contab") <= F.date_sub("ultima", age)) & (fresh | (F.col("fecha_contab") > F.date_sub("anterior", age)))
    )
    return marked.select(*ACCOUNT, "tipo_material", "mov_type", "fecha_contab", F.abs(F.col("cantidad").cast("long")).alias("cantidad_abs"), "costo_unitario_usd", F.coalesce(counted, F.lit(False)).alias("en_tasa"))


def routes(loss: DataFrame, tranches: DataFrame, v: Vars = VARS) -> DataFrame:
    """Routes with their loss rate and mean cycle, and whether either is past its threshold."""
    n, out, lost = F.col("cantidad_abs"), F.col("mov_type") == "621", F.col("mov_type") == "702"
    flow = loss.groupBy("planta", "cliente").agg(
        filtered_sum(n, out).alias("contenedores_salida"), filtered_sum(n, out & F.col("en_tasa")).alias("salidas_conciliadas"),
        F.coalesce(filtered_sum(n, lost & F.col("en_tasa")), F.lit(0)).alias("faltantes"),
        F.coalesce(rounded(filtered_sum(n * F.col("costo_unitario_usd"), lost), 2), F.lit(0.0)).alias("perdida_acum_usd"),
    )
    cycle = returned(tranches).groupBy("planta", "cliente").agg(rounded(F.sum(F.col("cantidad") * F.col("dias")).cast("double") / F.sum("cantidad"), 1).alias("ciclo_promedio_dias"))
    made = flow.join(cycle, ["planta", "cliente"], "left").withColumn("tasa_merma_pct", rounded(ratio(F.col("faltantes") * 100.0, F.col("salidas_conciliadas")), 3))
    by_loss = F.coalesce(F.col("tasa_merma_pct") > v.umbral_merma_pct, F.lit(False))
    by_cycle = F.coalesce(F.col("ciclo_promedio_dias") > v.umbral_ciclo_dias, F.lit(False))
    return made.select(
        "planta", "cliente", "contenedores_salida", "salidas_conciliadas", "faltantes", "tasa_merma_pct", "ciclo_promedio_dias", "perdida_acum_usd",
        by_loss.alias("rota_por_merma"), by_cycle.alias("rota_por_ciclo"), (by_loss | by_cycle).alias("ruta_rota"),
    )


def broken_routes(all_routes: DataFrame) -> DataFrame:
    return all_routes.where("ruta_rota").drop("rota_por_merma", "rota_por_ciclo", "ruta_rota")


def losses_usd(moves: DataFrame) -> DataFrame:
    """Recognised losses by plant, material and posting month."""
    n = F.abs(F.col("cantidad").cast("long"))
    return moves.where("mov_type = '702'").groupBy("planta", "material", "tipo_material", F.trunc("fecha_contab", "month").alias("mes")).agg(
        F.sum(n).alias("unidades_perdidas"), F.max("costo_unitario_usd").alias("costo_unitario_usd"), rounded(F.sum(n * F.col("costo_unitario_usd")), 2).alias("perdida_usd")
    )


P50_P90 = {"ciclo_p50_dias": 0.5, "ciclo_p90_dias": 0.9}


def plant_rotation(tranches: DataFrame, curve: DataFrame, v: Vars = VARS, world: Column | None = None) -> DataFrame:
    """Cohorts of a plant's outflows by month: how much came back, how long it took, and whether all of it could have."""
    known = tranches.where(~F.col("salida_en_foto")).withColumn("mes", F.trunc("fecha_salida", "month"))
    out = known.groupBy("planta", "mes").agg(F.sum("cantidad").cast("long").alias("contenedores_salida"))
    days = known.where("tipo_cierre = '622'").groupBy("planta", "mes", "dias").agg(F.sum("cantidad").alias("cantidad"))
    cycle = weighted_percentiles(days, ["planta", "mes"], "dias", "cantidad", P50_P90)
    horizon = overall(curve, None if world is None else F.substring_index("tipo_material", "|", 1), F.max("edad").alias("horizonte"))
    return beside(out.join(cycle, ["planta", "mes"], "left"), horizon, world).select(
        "planta", "mes", "contenedores_salida", F.coalesce("total", F.lit(0)).alias("contenedores_recogidos"), rounded("mean", 1).alias("ciclo_promedio_dias"),
        "ciclo_p50_dias", "ciclo_p90_dias", (F.expr("date_add(last_day(mes), horizonte)") <= F.lit(v.fecha_extraccion)).alias("cohorte_completa"),
    )


def cohort_cycle(rotation: DataFrame, tranches: DataFrame, world: Column | None = None) -> DataFrame:
    """Cycle of complete cohorts by plant and for the fleet (with worlds, for each one's: planta is then its name), from the whole
    distributions."""
    whole = rotation.where("cohorte_completa").select("planta", "mes")
    mine = returned(tranches).withColumn("mes", F.trunc("fecha_salida", "month")).join(F.broadcast(whole), ["planta", "mes"], "left_semi")
    by_plant = mine.groupBy("planta", "dias").agg(F.sum("cantidad").alias("cantidad")).withColumn("nivel", F.lit("planta"))
    whose = F.lit(None).cast("string") if world is None else world
    fleet = by_plant.groupBy(whose.alias("planta"), "dias").agg(F.sum("cantidad").alias("cantidad")).select(F.lit("flota").alias("nivel"), "planta", "dias", "cantidad")
    made = weighted_percentiles(by_plant.unionByName(fleet), ["nivel", "planta"], "dias", "cantidad", P50_P90)
    return made.select("nivel", "planta", F.col("total").alias("contenedores_recogidos"), rounded("mean", 1).alias("ciclo_promedio_dias"), *P50_P90)


def cost_by_material(loss: DataFrame, policy: DataFrame) -> DataFrame:
    """Trips, loss rate, trip-weighted cost and expected life in cycles by plant and type."""
    n, out, lost = F.col("cantidad_abs"), F.col("mov_type") == "621", F.col("mov_type") == "702"
    value = n * F.col("costo_unitario_usd")
    flow = loss.groupBy("planta", "tipo_material").agg(
        filtered_sum(n, out).alias("viajes"), filtered_sum(n, out & F.col("en_tasa")).alias("salidas_conciliadas"),
        F.coalesce(filtered_sum(n, lost & F.col("en_tasa")), F.lit(0)).alias("faltantes"), F.coalesce(filtered_sum(value, lost), F.lit(0.0)).alias("perdida_reconocida_usd"),
        ratio(filtered_sum(value, out), filtered_sum(n, out)).alias("costo_unitario_usd"),
    ).withColumn("p", ratio("faltantes", "salidas_conciliadas"))
    life = F.when(F.coalesce("p", F.lit(0.0)) == 0, F.col("vida_util_ciclos").cast("double")).otherwise((1 - F.pow(1 - F.col("p"), F.col("vida_util_ciclos"))) / F.col("p"))
    return flow.join(F.broadcast(policy), "tipo_material").select(
        "planta", "tipo_material", "viajes", "salidas_conciliadas", "faltantes", rounded(F.col("p") * 100, 3).alias("tasa_merma_pct"), "perdida_reconocida_usd",
        "costo_unitario_usd", "vida_util_ciclos", "mant_por_ciclo_usd", "desechable_equiv_usd", life.alias("vida_esperada_ciclos"),
    )


def cost_comparison(by_material: DataFrame) -> DataFrame:
    """Returnable against one-way packaging: cost and saving by cycle, payback and net saving."""
    amort = F.col("costo_unitario_usd") / F.col("vida_esperada_ciclos")
    cycle = amort + F.col("mant_por_ciclo_usd")
    saving = F.col("desechable_equiv_usd") - cycle
    payback = F.ceil(F.try_divide("costo_unitario_usd", F.col("desechable_equiv_usd") - F.col("mant_por_ciclo_usd")))
    return by_material.select(
        "planta", "tipo_material", "viajes", "salidas_conciliadas", "faltantes", "tasa_merma_pct", "vida_util_ciclos", rounded("vida_esperada_ciclos", 1).alias("vida_esperada_ciclos"),
        "costo_unitario_usd", "mant_por_ciclo_usd", "desechable_equiv_usd", rounded(amort, 4).alias("amortizacion_por_ciclo_usd"), rounded(cycle, 4).alias("costo_retornable_por_ciclo_usd"),
        rounded(saving, 4).alias("ahorro_por_ciclo_usd"), payback.cast("int").alias("ciclos_payback"), (payback <= F.col("vida_esperada_ciclos")).alias("recupera_inversion"),
        rounded(F.col("viajes") * saving, 2).alias("ahorro_neto_usd"), rounded("perdida_reconocida_usd", 2).alias("perdida_reconocida_usd"),
    )
