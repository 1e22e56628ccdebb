"""Fleet need: use of stock in time, Little's-law cycles, safety stock at an economic service level, projected fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import beside, dense_days, filtered_sum, ratio, rounded, running_sum, overall
from ..sources.ledger import VARS, Vars

MATERIAL = ("planta", "material")
#: The service-level grid, in hundredths.
GRID = (100, 400, 5)


def need_calendar(daily: DataFrame, changes: DataFrame, v: Vars = VARS, world: Column | None = None) -> DataFrame:
    """One row (a row a world) of dates: opening, cutoff, the last Sunday, and the windows of estimation, test and calibration."""
    own = [] if world is None else ["mundo"]
    held = overall(changes.where("estado = 'cliente' and evento = 'apertura'"), world, (F.count(F.lit(1)) > 0).alias("con_cliente"))
    corte, week = F.lit(v.fecha_extraccion), 7
    opened = overall(daily, world, F.min("fecha").alias("apertura"))
    base = opened.crossJoin(F.broadcast(held)) if world is None else opened.join(F.broadcast(held), "mundo", "left")
    base = base.select(
        *own, "apertura", corte.alias("corte"),
        F.date_add(F.trunc(F.date_add("apertura", 7), "week"), F.when(F.col("con_cliente"), 0).otherwise(week * v.semanas_arranque)).alias("inicio_estable"),
        F.date_sub(corte, (F.weekday(corte) + 1) % 7).alias("fin_base"),
    )
    back = lambda weeks, plus=0: F.date_add(F.date_sub("fin_base", week * weeks), plus)
    since = lambda weeks: F.greatest(back(weeks, 1), F.col("inicio_estable"))
    t, s = v.backtest_semanas, v.ventana_sigma_semanas
    return base.select(
        *own, "apertura", "corte", "inicio_estable", "fin_base", back(v.ventana_base_semanas, 1).alias("inicio_base"), since(s).alias("inicio_sigma"), back(t, 1).alias("inicio_prueba"),
        back(t).alias("fin_estimacion"), since(t + s).alias("inicio_estimacion"), back(2 * t, 1).alias("inicio_calibracion"), back(2 * t).alias("fin_est_calibracion"), since(2 * t + s).alias("inicio_est_calibracion"),
    )


def daily_use(daily: DataFrame, changes: DataFrame, calendar: DataFrame, world: Column | None = None) -> DataFrame:
    """Every material on every day: stock in use (all but empties) and outflow."""
    used = daily.where("estado <> 'vacios'").groupBy(*MATERIAL, "fecha").agg(F.sum("delta").alias("delta"))
    out = changes.where("estado = 'cliente' and evento = 'salida_cliente'").groupBy(*MATERIAL, "fecha").agg(F.sum("delta").alias("salidas"))
    keys = daily.select(*MATERIAL, "tipo_material").distinct()
    dense = dense_days(keys, calendar, "apertura", "corte", world).join(used, [*MATERIAL, "fecha"], "left").join(out, [*MATERIAL, "fecha"], "left")
    return dense.select(*MATERIAL, "tipo_material", "fecha", running_sum(F.coalesce("delta", F.lit(0)), MATERIAL, "fecha").cast("long").alias("en_uso"), F.coalesce("salidas", F.lit(0)).cast("long").alias("salidas"))


def use_variability(use: DataFrame, calendar: DataFrame, v: Vars = VARS, world: Column | None = None) -> DataFrame:
    """Mean and deviation of stock in use and daily demand in three windows; the cycle of a plant's type by Little's law."""
    frame = lambda name, a, b: F.struct(F.lit(name).alias("ventana"), F.col(a).alias("a"), F.col(b).alias("b"))
    three = F.array(frame("necesidad", "inicio_sigma", "fin_base"), frame("backtest", "inicio_estimacion", "fin_estimacion"), frame("calibracion", "inicio_est_calibracion", "fin_est_calibracion"))
    own = [] if world is None else ["mundo"]
    windows = calendar.select(*own, F.explode(three).alias("w")).select(*own, "w.*", F.date_sub("w.b", 7 * v.ventana_base_semanas - 1).alias("d"))
    inside, recent = F.col("fecha").between(F.col("a"), F.col("b")), F.col("fecha").between(F.col("d"), F.col("b"))
    per = beside(use, windows, world).groupBy("ventana", *MATERIAL, "tipo_material", "a", "b", "d").agg(
        F.avg(F.when(inside, F.col("en_uso"))).alias("uso_promedio"), F.stddev_pop(F.when(inside, F.col("en_uso"))).alias("sigma_uso"),
        filtered_sum(F.col("salidas"), inside).alias("s"), filtered_sum(F.col("salidas"), recent).alias("r"),
    ).select("ventana", *MATERIAL, "tipo_material", "uso_promedio", "sigma_uso", ratio("s", F.datediff("b", "a") + 1).alias("d_ventana"), ratio("r", F.datediff("b", "d") + 1).alias("d_base"))
    cycle = per.groupBy("ventana", "planta", "tipo_material").agg(ratio(F.sum("uso_promedio"), F.sum("d_ventana")).alias("ciclo_dias"))
    return per.join(F.broadcast(cycle), ["ventana", "planta", "tipo_material"]).select("ventana", *MATERIAL, "tipo_material", "uso_promedio", "sigma_uso", "d_ventana", "d_base", "ciclo_dias")


def safety_stock(d_plan: Column, sigma: Column, d_base: Column, z: Column, cover: Column) -> Column:
    """Days of cover, or z deviations scaled by the root of volume, whichever is more; cover alone without history."""
    return F.greatest(cover * d_plan, F.coalesce(z * sigma * F.sqrt(F.try_divide(d_plan, F.nullif(d_base, F.lit(0.0)))), F.lit(0.0)))


def service_curve(variability: DataFrame, use: DataFrame, calendar: DataFrame, policy: DataFrame, world: Column | None = None) -> DataFrame:
    """Share of calibration days on which the need at each service level would have been exceeded.

    A day that exceeds the need at some z exceeds it at all smaller ones: its row counts the grid's levels that it exceeds,
    and sums over these counts give the whole curve without a row for each level."""
    fitted = variability.where("ventana = 'calibracion'").join(F.broadcast(policy.select("tipo_material", "dias_cobertura")), "tipo_material")
    own = [] if world is None else ["mundo"]
    days = beside(use, calendar.select(*own, "inicio_calibracion", "inicio_prueba"), world).where("fecha between inicio_calibracion and date_sub(inicio_prueba, 1)")
    rows = days.select(*MATERIAL, "en_uso").join(F.broadcast(fitted), list(MATERIAL))
    d = F.col("d_base")
    past = F.filter(F.sequence(*map(F.lit, GRID)), lambda z: F.col("en_uso") > d * F.col("ciclo_dias") + safety_stock(d, F.col("sigma_uso"), d, z.cast("double") / 100, F.col("dias_cobertura")))
    counts = rows.groupBy("tipo_material", F.coalesce(F.size(past), F.lit(0)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("tipo_material").agg(F.sum("n").alias("total"))
    level = total.select("tipo_material", "total", F.posexplode(F.sequence(*map(F.lit, GRID))).alias("i", "z100"))
    above = level.join(counts, "tipo_material").groupBy("tipo_material", "z100", "total").agg(F.coalesce(filtered_sum(F.col("n"), F.col("k") > F.col("i")), F.lit(0)).alias("sobre"))
    return above.select("tipo_material", (F.col("z100") / 100).alias("z"), ratio("sobre", "total").alias("quiebre"))


def economic_level(variability: DataFrame, cost: DataFrame, scenarios: DataFrame, policy: DataFrame, curve: DataFrame) -> DataFrame:
    """For each scenario and type the least service level whose shortage share is within the critical ratio's target."""
    prices = cost.groupBy("tipo_material").agg(ratio(F.sum(F.col("costo_unitario_usd") * F.col("viajes")), F.sum("viajes")).alias("costo"), F.max("desechable_equiv_usd").alias("desechable"))
    cycle = variability.where("ventana = 'calibracion'").groupBy("tipo_material").agg(ratio(F.sum("uso_promedio"), F.sum("d_ventana")).alias("ciclo_dias"))
    base = policy.select("tipo_material", F.col("factor_costo_quiebre").alias("f0"), F.col("costo_capital_anual_pct").alias("c0"))
    mine = scenarios.withColumnRenamed("tipo_material", "solo").crossJoin(F.broadcast(base))
    own = lambda c: F.when(F.col("solo").isNull() | (F.col("solo") == F.col("tipo_material")), F.col(c))
    mine = mine.select(
        "escenario", "tipo_material", F.coalesce(own("factor_costo_quiebre"), F.col("f0")).alias("factor_costo_quiebre"), F.coalesce(own("costo_capital_anual_pct"), F.col("c0")).alias("costo_capital_anual_pct"),
        own("z_fija").alias("z_fija"), F.coalesce(own("ajuste_ciclo_dias"), F.lit(0.0)).alias("ajuste_ciclo_dias"),
    ).join(prices, "tipo_material").join(cycle, "tipo_material")
    short = F.try_divide(F.col("desechable") * F.col("factor_costo_quiebre"), F.col("ciclo_dias"))
    mine = mine.withColumn("costo_corto_dia", short).withColumn("costo_exceso_dia", F.col("costo") * F.col("costo_capital_anual_pct") / 100 / 365)
    mine = mine.withColumn("razon", F.try_divide("costo_corto_dia", F.col("costo_corto_dia") + F.col("costo_exceso_dia"))).withColumn("objetivo", 1 - F.col("razon"))
    keyed = curve.select("tipo_material", F.round(F.col("z") * 100).cast("int").alias("z100"), "quiebre")
    least = mine.join(keyed, "tipo_material").where("quiebre <= objetivo").groupBy("escenario", "tipo_material").agg((F.min("z100") / 100).alias("z_economica"))
    chosen = mine.join(least, ["escenario", "tipo_material"], "left").withColumn("z_servicio", F.coalesce("z_fija", "z_economica")).withColumn("z100", F.round(F.col("z_servicio") * 100).cast("int"))
    return chosen.join(keyed, ["tipo_material", "z100"], "left").select(
        "escenario", "tipo_material", "factor_costo_quiebre", "costo_capital_anual_pct", "z_fija", "ajuste_ciclo_dias", rounded("ciclo_dias", 2).alias("ciclo_dias"), "costo_corto_dia", "costo_exceso_dia",
        rounded("razon", 4).alias("razon_critica"), rounded("objetivo", 4).alias("objetivo_quiebre"), "z_servicio", F.col("quiebre").alias("quiebre_calibracion"),
    )


def backtest(variability: DataFrame, use: DataFrame, calendar: DataFrame, policy: DataFrame, levels: DataFrame, tolerance_pp: float = 1.0) -> DataFrame:
    """How the base scenario's service level holds on days it was not fitted on: the need by the backtest window against the use of each
    day after it, with the share of days that exceed it by type, and whether that is over the target by more than the tolerance."""
    level = levels.where("escenario = 'base'").select("tipo_material", "z_servicio", "objetivo_quiebre")
    fitted = variability.where("ventana = 'backtest'").join(F.broadcast(policy.select("tipo_material", "dias_cobertura")), "tipo_material").join(F.broadcast(level), "tipo_material")
    d = F.col("d_base")
    needed = d * F.col("ciclo_dias") + safety_stock(d, F.col("sigma_uso"), d, F.col("z_servicio"), F.col("dias_cobertura"))
    days = use.crossJoin(F.broadcast(calendar.select("inicio_prueba", "fin_base"))).where("fecha between inicio_prueba and fin_base")
    met = days.select(*MATERIAL, "en_uso").join(fitted.select(*MATERIAL, "tipo_material", "objetivo_quiebre", needed.alias("necesidad")), list(MATERIAL))
    made = met.groupBy("tipo_material").agg(F.max("objetivo_quiebre").alias("objetivo_quiebre"), F.count(F.lit(1)).alias("dias"), F.count_if(F.col("en_uso") > F.col("necesidad")).alias("dias_quiebre"))
    pct, target = F.col("dias_quiebre") * 100.0 / F.col("dias"), F.col("objetivo_quiebre") * 100.0
    return made.select("tipo_material", "objetivo_quiebre", "dias", "dias_quiebre", rounded(pct, 2).alias("pct_quiebre"), F.coalesce(pct > target + tolerance_pp, F.lit(True)).alias("rebasa"))


def plan_demand(plan: DataFrame, instruction: DataFrame, variability: DataFrame, policy: DataFrame) -> DataFrame:
    """Daily containers that the plan asks for, with each material's history, or its plant's cycle for want of one."""
    packed = plan.join(instruction, ["planta", "parte"]).where("piezas_por_contenedor > 0").groupBy(*MATERIAL, "tipo_material", "semana").agg(
        (F.sum(F.col("piezas").cast("double") / F.col("piezas_por_contenedor")) / 7).alias("d_plan")
    )
    past = variability.where("ventana = 'necesidad'")
    mine = past.select(*MATERIAL, "d_base", F.col("ciclo_dias").alias("propio"), "sigma_uso")
    plant = past.select("planta", "tipo_material", F.col("ciclo_dias").alias("de_planta")).distinct()
    made = packed.join(mine, list(MATERIAL), "left").join(F.broadcast(plant), ["planta", "tipo_material"], "left").join(F.broadcast(policy.select("tipo_material", "dias_cobertura")), "tipo_material")
    return made.select(
        *MATERIAL, "tipo_material", "semana", "d_plan", "d_base", F.coalesce("propio", "de_planta").alias("ciclo_dias"), "sigma_uso", "dias_cobertura",
        ((F.coalesce("d_base", F.lit(0.0)) > 0) & F.col("sigma_uso").isNotNull()).alias("con_historia"),
    )


def scenario_need(demand: DataFrame, levels: DataFrame) -> DataFrame:
    """Containers needed for the plan in each scenario."""
    made = demand.join(F.broadcast(levels.select("escenario", "tipo_material", "z_servicio", "ajuste_ciclo_dias")), "tipo_material")
    use = F.col("d_plan") * (F.col("ciclo_dias") + F.col("ajuste_ciclo_dias"))
    stock = safety_stock(F.col("d_plan"), F.col("sigma_uso"), F.col("d_base"), F.col("z_servicio"), F.col("dias_cobertura"))
    return made.select(
        "escenario", *MATERIAL, "tipo_material", "semana", "d_plan", "d_base", "ciclo_dias", "sigma_uso", "dias_cobertura", "con_historia", "z_servicio", "ajuste_ciclo_dias",
        use.alias("uso_plan"), stock.alias("stock_seguridad"), F.ceil(use + stock).cast("long").alias("necesidad"),
    )


def fleet_need(need: DataFrame) -> DataFrame:
    base = need.where("escenario = 'base'")
    return base.select(
        *MATERIAL, "tipo_material", "semana", rounded("d_plan", 4).alias("d_plan"), rounded("d_base", 4).alias("d_base"), rounded("ciclo_dias", 2).alias("ciclo_dias"), rounded("sigma_uso", 2).alias("sigma_uso"), "con_historia",
        rounded("uso_plan", 1).alias("uso_plan"), rounded("stock_seguridad", 1).alias("stock_seguridad"), rounded(ratio("stock_seguridad", "d_plan"), 1).alias("stock_seguridad_dias"), "necesidad",
    )


def projected_fleet(moves: DataFrame, calendar: DataFrame, comparison: DataFrame, routes: DataFrame, changes: DataFrame, fleet: DataFrame, demand: DataFrame, v: Vars = VARS, world: Column | None = None) -> DataFrame:
    """Fleet in each plan week: what stands at the cutoff, less losses not yet recognised and those the plan will cause."""
    own = [] if world is None else ["mundo"]
    latest = overall(moves.where("mov_type = '702'"), world, F.max("fecha_contab").alias("ultima"))
    by_type = comparison.select("planta", "tipo_material", (F.col("tasa_merma_pct") / 100).alias("tasa"))
    by_route = routes.select("planta", "cliente", (F.col("tasa_merma_pct") / 100).alias("de_ruta"))
    open_ = beside(moves.where("mov_type = '621'"), latest, world).where(F.col("fecha_contab") > F.date_sub("ultima", v.antiguedad_conciliacion_dias))
    open_ = open_.groupBy(*MATERIAL, "tipo_material", "cliente").agg(F.sum(F.abs("cantidad")).alias("n"))
    pending = open_.join(by_route, ["planta", "cliente"], "left").join(F.broadcast(by_type), ["planta", "tipo_material"], "left")
    pending = pending.groupBy(*MATERIAL).agg(F.sum(F.col("n") * F.coalesce("de_ruta", "tasa")).alias("pendiente"))
    scrapped = (F.col("estado") == "scrap") & (F.col("evento") == "traslado_bloqueado") & (F.col("delta") > 0)
    shipped = (F.col("estado") == "cliente") & (F.col("evento") == "salida_cliente")
    seen = beside(changes.where(scrapped | shipped), calendar.select(*own, "inicio_sigma", "fin_base"), world).where("fecha between inicio_sigma and fin_base")
    scrap = seen.groupBy("planta", "tipo_material").agg(ratio(F.coalesce(filtered_sum(F.col("delta"), scrapped), F.lit(0)), filtered_sum(F.col("delta"), shipped)).alias("tasa_scrap"))
    now = fleet.where(F.col("fecha_cierre") == F.lit(v.fecha_extraccion)).select(*MATERIAL, "tipo_material", "flota")
    base = now.crossJoin(F.broadcast(demand.select("semana").distinct()))
    made = base.join(demand.select(*MATERIAL, "semana", "d_plan", "ciclo_dias"), [*MATERIAL, "semana"], "left").join(pending, list(MATERIAL), "left")
    made = made.join(F.broadcast(by_type), ["planta", "tipo_material"]).join(F.broadcast(scrap), ["planta", "tipo_material"], "left")
    d, waiting = F.coalesce("d_plan", F.lit(0.0)), F.coalesce("pendiente", F.lit(0.0))
    lost = running_sum(d * 7 * (F.col("tasa") + F.coalesce("tasa_scrap", F.lit(0.0))), MATERIAL, "semana")
    cents = lambda x: rounded(rounded(x, 9), 2)  # noqa: E731  the ninth decimal settles sums that stand on half a cent
    return made.select(
        *MATERIAL, "tipo_material", "semana", d.alias("d_plan"), "ciclo_dias", F.col("flota").alias("flota_corte"), cents(waiting).alias("merma_pendiente"),
        cents(lost).alias("perdida_acumulada"), cents(F.col("flota") - waiting - lost).alias("flota_proyectada"),
    )
