"""Invariants of the models: queries that must give no rows. Each compares a model with a sum that is made another way."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import rounded, running, running_sum
from ..operators import capacity, cycle, gap, quality, stock
from .models import Models


def total(df: DataFrame, keys: list, value) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).cast("double").alias("n"))


def unequal(left: DataFrame, right: DataFrame, keys: list[str], eps: float = 0.0) -> DataFrame:
    """Keys whose `n` differs by more than eps, or that one side lacks: a full outer join."""
    met = left.select(*keys, F.col("n").cast("double").alias("izquierda")).join(right.select(*keys, F.col("n").cast("double").alias("derecha")), keys, "full")
    return met.where(F.coalesce(F.abs(F.col("izquierda") - F.col("derecha")) > eps, F.lit(True)))


def differ(keys: str, left: str, right: str, eps: float = 0.0, before: str = "") -> str:
    """The SQL of `unequal`."""
    return f"""{before}
        select * from (select {keys}, n::double as izquierda from ({left})) full join (select {keys}, n::double as derecha from ({right})) using ({keys})
        where coalesce(abs(izquierda - derecha) > {eps}, true)"""


def outflows(m: Models) -> DataFrame:
    return m.account.where("mov_type = '621'")


def fifo_keeps_quantity(m: Models) -> DataFrame:
    keys = ["planta", "cliente", "material", "anio_salida", "doc_salida", "pos_salida"]
    out = outflows(m).withColumnsRenamed({"anio_contable": "anio_salida", "doc_material": "doc_salida", "posicion": "pos_salida"})
    return unequal(total(out, keys, "cantidad_abs"), total(m.tranches, keys, "cantidad"), keys)


def customer_balance(m: Models) -> DataFrame:
    daily = m.account.groupBy(*cycle.ACCOUNT, "fecha_contab").agg(F.sum("delta_saldo").alias("delta"))
    return daily.select(*cycle.ACCOUNT, "fecha_contab", running_sum("delta", cycle.ACCOUNT, "fecha_contab").alias("saldo")).where("saldo < 0")


def monthly_balance(m: Models) -> DataFrame:
    """Of accounts that have a close in the month of their first movement (one after its last weekday has none)."""
    keys = list(cycle.ACCOUNT)
    closed = m.monthly.groupBy(*keys).agg(F.max_by("saldo_fin_mes", "mes").alias("n"), F.min("mes").alias("desde"))
    moved = m.account.groupBy(*keys).agg(F.sum("delta_saldo").alias("n"), F.trunc(F.min("fecha_contab"), "month").alias("desde"))
    return unequal(closed.join(moved.select(*keys, "desde"), [*keys, "desde"], "left_semi"), moved.join(closed.select(*keys, "desde"), [*keys, "desde"], "left_semi"), keys)


def losses_of_702(m: Models) -> DataFrame:
    keys = ["planta", "material"]
    return unequal(total(cycle.losses_usd(m.moves_days), keys, "unidades_perdidas"), total(m.customer.where("mov_type = '702'"), keys, F.abs("cantidad")), keys)


def all_routes(m: Models) -> DataFrame:
    keys = ["planta", "cliente"]
    return unequal(m.routes.withColumn("n", F.col("contenedores_salida")), total(outflows(m), keys, "cantidad_abs"), keys)


def route_balance(m: Models) -> DataFrame:
    keys = ["planta", "cliente", "mes"]
    return unequal(cycle.route_excess(m.monthly, m.account_days, m.curve).withColumn("n", F.col("saldo_fin_mes")), total(m.monthly, keys, "saldo_fin_mes"), keys)


def valid_curve(m: Models) -> DataFrame:
    before = F.lag("prob_en_cliente").over(Window.partitionBy("tipo_material").orderBy("edad"))
    return m.curve.withColumn("antes", before).where("prob_en_cliente not between 0 and 1 or prob_en_cliente > antes").select("tipo_material", "edad", "prob_en_cliente")


def cohorts_add_up(m: Models) -> DataFrame:
    made = cycle.cohort_cycle(m.rotation, m.tranches_days).withColumn("todo", F.lit("flota"))
    return unequal(total(made.where("nivel = 'flota'"), ["todo"], "contenedores_recogidos"), total(made.where("nivel = 'planta'"), ["todo"], "contenedores_recogidos"), ["todo"])


def cycle_without_photo(m: Models) -> DataFrame:
    """Stock that customers held in the snapshot has no day and no document: rotation, cohorts and the cycle of routes count only what
    went out afterwards."""
    known = m.tranches.where("doc_salida is not null")
    timed = m.tranches.where("tipo_cierre = '622' and dias is not null")
    named = lambda df, what: df.select(F.lit(what).alias("falla"), "llave", "izquierda", "derecha")
    turned = unequal(total(m.rotation, ["planta"], "contenedores_salida"), total(known, ["planta"], "cantidad"), ["planta"]).withColumn("llave", F.col("planta"))
    full = m.rotation.where("cohorte_completa").select("planta", "mes")
    mine = timed.withColumn("mes", F.trunc("fecha_salida", "month")).join(F.broadcast(full), ["planta", "mes"], "left_semi")
    cohorts = cycle.cohort_cycle(m.rotation, m.tranches_days).where("nivel = 'flota'").withColumn("llave", F.lit("flota"))
    cohorts = unequal(total(cohorts, ["llave"], "contenedores_recogidos"), total(mine.withColumn("llave", F.lit("flota")), ["llave"], "cantidad"), ["llave"])
    cycles = timed.groupBy("planta", "cliente").agg(rounded(F.sum(F.col("cantidad") * F.col("dias")).cast("double") / F.sum("cantidad"), 1).alias("n"))
    routes = unequal(m.routes.where("ciclo_promedio_dias is not null").withColumn("n", F.col("ciclo_promedio_dias")), cycles.join(m.routes.select("planta", "cliente"), ["planta", "cliente"], "left_semi"), ["planta", "cliente"])
    return named(turned, "rotacion").unionByName(named(cohorts, "cohortes")).unionByName(named(routes.withColumn("llave", F.concat_ws(" ", "planta", "cliente")), "ruta"))


def valid_opening(m: Models) -> DataFrame:
    first = m.ledger.agg(F.min("fecha_contab").alias("primero"))
    return m.snapshot.crossJoin(F.broadcast(first)).where("cantidad < 0 or fecha >= primero").select("planta", "material", "cantidad")


def fleet_is_kept(m: Models) -> DataFrame:
    """A week changes the fleet by the opening stock and by recognised losses, and by nothing else."""
    keys = ["planta", "material", "semana"]
    w = Window.partitionBy("planta", "material").orderBy("semana")
    change = m.fleet.where("tipo_material <> 'CARTON'").withColumn("n", F.col("flota") - F.coalesce(F.lag("flota").over(w), F.lit(0))).where("n <> 0")
    lost = m.customer.where("mov_type = '702'").select("planta", "material", stock.week("fecha_contab").alias("semana"), (-F.abs("cantidad")).cast("long").alias("n"))
    opened = m.snapshot.select("planta", "material", stock.week("fecha").alias("semana"), F.col("cantidad").alias("n"))
    return unequal(change, total(lost.unionByName(opened), keys, "n").where("n <> 0"), keys)


def flows_are_kept(m: Models) -> DataFrame:
    """What flows into a place less what flows out is how its stock changes."""
    keys = ["planta", "tipo_material", "semana", "estado"]
    ends = F.explode(F.array(F.struct(F.col("origen").alias("estado"), (-F.col("contenedores")).alias("n")), F.struct(F.col("destino").alias("estado"), F.col("contenedores").alias("n"))))
    flow = stock.weekly_flows(m.ledger, m.places, m.classes).select("planta", "tipo_material", "semana", ends.alias("x")).select("planta", "tipo_material", "semana", "x.*").where("estado <> 'faltante'")
    moved = m.changes.where("evento <> 'apertura' and tipo_material <> 'CARTON'").withColumn("semana", stock.week("fecha"))
    return unequal(total(flow, keys, "n").where("n <> 0"), total(moved, keys, "delta").where("n <> 0"), keys)


def network_is_flow(m: Models) -> DataFrame:
    keys = ["planta", "tipo_material", "semana"]
    flow = stock.weekly_flows(m.ledger, m.places, m.classes).where("origen = 'llenos' and destino = 'cliente'")
    return unequal(total(stock.weekly_network(m.customer, m.classes), keys, "salidas").where("n <> 0"), total(flow, keys, "contenedores"), keys)


CALENDAR = """apertura <= inicio_estable and inicio_sigma <= fin_base and fin_base <= corte and inicio_estimacion <= fin_estimacion
              and fin_estimacion < inicio_prueba and fin_est_calibracion < inicio_calibracion"""
#: A null level says that the history is too short for any; it breaks nothing.
LEVEL = "z_servicio not between 1 and 4 or razon_critica not between 0 and 1 or (z_fija is null and quiebre_calibracion > objetivo_quiebre + 0.0001)"
UNCOVERED = "deficit_pico - recibido_mismo_pais - recibido_otro_pais - compra > 0.2"


def loans_balance(m: Models) -> DataFrame:
    keys = ["escenario", "material"]
    got, gave = F.col("recibido_mismo_pais") + F.col("recibido_otro_pais"), F.col("prestado_mismo_pais") + F.col("prestado_otro_pais")
    return unequal(total(m.lent, keys, got), total(m.lent, keys, gave), keys, 1e-6)


def sensitivity_has_base(m: Models) -> DataFrame:
    keys = ["tipo_material"]
    cost = F.col("usd_flete") + F.col("usd_compra") + F.col("usd_desechable")
    base = gap.gap_sensitivity(m.gap, m.need, m.levels).where("escenario = 'base'").withColumn("n", F.col("usd_brecha"))
    return unequal(base, total(gap.base_gap(m.gap), keys, cost), keys, 0.05)


def scenarios_of_one_type(m: Models) -> DataFrame:
    """A scenario of one type leaves the service level of the others as it is in the base scenario."""
    keys = ["escenario", "tipo_material"]
    lone = m.scenarios.where("tipo_material is not null").select("escenario", F.col("tipo_material").alias("suyo"))
    other = m.levels.join(F.broadcast(lone), "escenario").where("tipo_material <> suyo").withColumn("n", F.coalesce("z_servicio", F.lit(0.0)))
    base = m.levels.where("escenario = 'base'").select("tipo_material", F.coalesce("z_servicio", F.lit(0.0)).alias("n"))
    return unequal(other, other.select(*keys).join(base, "tipo_material"), keys)


def plan_is_shipped(m: Models) -> DataFrame:
    return m.plan[1].join(m.customer.where("mov_type = '621'").select("planta", "material").distinct(), ["planta", "material"], "left_anti").select("planta", "material", "parte")


def board_adds_up(m: Models) -> DataFrame:
    return unequal(total(m.board, ["regla"], "violaciones"), total(m.all_violations, ["regla"], F.lit(1)), ["regla"])


def known_figures(m: Models) -> DataFrame:
    named = m.all_violations.where("cifra_afectada is not null").select("regla", F.explode(F.split("cifra_afectada", " ")).alias("cifra")).distinct()
    return named.where(~F.col("cifra").isin("todas", *quality.CIFRAS))


def lots_keep_target(m: Models) -> DataFrame:
    """What washing does not give back to the empties enters repair, and what repair does not give back enters scrap."""
    keys = ["planta", "material", "fecha", "destino"]
    out = m.lots.where("not a_vacios").withColumn("destino", F.when(F.col("estacion") == "lavado", "reparacion").otherwise("scrap"))
    entered = m.changes.where("delta > 0 and evento = 'traslado_bloqueado' and estado in ('reparacion', 'scrap')").withColumnRenamed("estado", "destino")
    return unequal(total(out, keys, "cantidad"), total(entered, keys, "delta"), keys)


def stations_hold(m: Models) -> DataFrame:
    """Station days that break a rule: what is ready is what the lots say, nothing leaves before it is ready, and no day releases more than
    its capacity, nor anything on a Saturday or Sunday. Windows hold a row a day."""
    station = list(capacity.STATION)
    keys = [*station, "fecha"]
    traced = unequal(m.release.where("listo <> 0").withColumnRenamed("listo", "n"), total(m.lots, keys, "cantidad"), keys)
    ready = m.release.withColumn("listo_acum", F.sum("listo").over(running(station, "fecha"))).withColumn("salido", F.sum("liberado").over(running(station, "fecha")))
    bad = {
        "listo distinto a la traza": traced,
        "sale antes de estar listo": ready.where("salido > listo_acum + 1e-6"),
        "pasa la capacidad": m.release.where("liberado > if(weekday(fecha) < 5, capacidad, 0) + 1e-6"),
    }
    return functools.reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("falla"), *keys) for name, rows in bad.items()])


#: name: how to build it, what its SQL reads, and the SQL's final select
TABLE: dict[str, tuple[Callable[[Models], DataFrame], str, str]] = {
    "inv_fifo_conserva_cantidad": (
        fifo_keeps_quantity,
        "acc tr",
        differ(
            "planta, cliente, material, anio_salida, doc_salida, pos_salida",
            "select planta, cliente, material, anio_contable as anio_salida, doc_material as doc_salida, posicion as pos_salida, sum(n) as n from acc where mov_type = '621' group by all",
            "select planta, cliente, material, anio_salida, doc_salida, pos_salida, sum(cantidad) as n from tr group by all",
        ),
    ),
    "inv_tramos_fifo_validos": (
        lambda m: m.tranches.where("cantidad <= 0 or dias < 0").select("planta", "cliente", "material", "doc_salida", "cantidad", "dias"),
        "tr",
        "select planta, cliente, material, doc_salida, cantidad, dias from tr where cantidad <= 0 or dias < 0",
    ),
    "inv_saldo_cliente_no_negativo": (
        customer_balance,
        "acc",
        """select planta, cliente, material, fecha_contab, saldo::bigint as saldo from (select *, sum(d) over (partition by planta, cliente, material order by fecha_contab rows unbounded preceding) as saldo
           from (select planta, cliente, material, fecha_contab, sum(delta) as d from acc group by all)) where saldo < 0""",
    ),
    "inv_saldo_mensual_cuadra": (
        monthly_balance,
        "monthly acc",
        differ(
            "planta, cliente, material",
            "select * from inv_c semi join inv_m using (planta, cliente, material, desde)",
            "select * from inv_m semi join inv_c using (planta, cliente, material, desde)",
            before=""", inv_c as (select planta, cliente, material, arg_max(saldo_fin_mes, mes) as n, min(mes) as desde from monthly group by 1, 2, 3),
             inv_m as (select planta, cliente, material, sum(delta) as n, cast(date_trunc('month', min(fecha_contab)) as date) as desde from acc group by 1, 2, 3)""",
        ),
    ),
    "inv_perdidas_cuadran_702": (
        losses_of_702,
        "loss cust",
        differ("planta, material", "select planta, material, sum(n) as n from loss where mov_type = '702' group by 1, 2", "select planta, material, sum(abs(cantidad)) as n from cust where mov_type = '702' group by 1, 2"),
    ),
    "inv_rutas_universo": (
        all_routes,
        "routes acc",
        differ("planta, cliente", "select planta, cliente, contenedores_salida as n from routes", "select planta, cliente, sum(n) as n from acc where mov_type = '621' group by 1, 2"),
    ),
    "inv_exceso_ruta_cuadra": (
        route_balance,
        "monthly",
        differ("planta, cliente, mes", "select planta, cliente, mes, sum(saldo_fin_mes) as n from monthly group by 1, 2, 3", "select planta, cliente, mes, sum(saldo_fin_mes) as n from monthly group by 1, 2, 3"),
    ),
    "inv_cierre_dia_habil": (
        lambda m: m.monthly.select("mes", "fin_mes").distinct().where("weekday(fin_mes) > 4"),
        "monthly",
        "select distinct mes, fin_mes from monthly where isodow(fin_mes) > 5",
    ),
    "inv_supervivencia_valida": (
        valid_curve,
        "surv",
        "select tipo_material, edad, prob_en_cliente from (select *, lag(prob_en_cliente) over (partition by tipo_material order by edad) as antes from surv) where prob_en_cliente not between 0 and 1 or prob_en_cliente > antes",
    ),
    "inv_ciclo_cohortes_cuadra": (
        cohorts_add_up,
        "rot ret",
        differ(
            "todo",
            "select 'flota' as todo, sum(r.cantidad) as n from ret r join rot c on c.planta = r.planta and c.mes = date_trunc('month', r.fecha_salida) where cohorte_completa having count(*) > 0",
            "select 'flota' as todo, sum(n) as n from (select r.planta, sum(r.cantidad) as n from ret r join rot c on c.planta = r.planta and c.mes = date_trunc('month', r.fecha_salida) where cohorte_completa group by 1) having count(*) > 0",
        ),
    ),
    "inv_carton_fuera_del_ciclo": (
        lambda m: m.account.where("tipo_material = 'CARTON'").select("planta", "material", "doc_material"),
        "acc",
        "select planta, material, doc_material from acc where tipo_material = 'CARTON'",
    ),
    "inv_stock_no_negativo": (
        lambda m: m.daily.where("saldo < 0 and tipo_material <> 'CARTON'").select("planta", "material", "estado", "fecha", "saldo"),
        "dstock",
        "select planta, material, estado, fecha, saldo from dstock where saldo < 0 and tipo_material <> 'CARTON'",
    ),
    "inv_stock_inicial_valido": (valid_opening, "snap led", "select planta, material, cantidad from snap where cantidad < 0 or fecha >= (select min(fecha_contab) from led)"),
    "inv_conservacion_flota": (
        fleet_is_kept,
        "fleet cust snap",
        differ(
            "planta, material, semana",
            "select planta, material, semana, n from (select planta, material, semana, flota - coalesce(lag(flota) over (partition by planta, material order by semana), 0) as n from fleet where tipo_material <> 'CARTON') where n <> 0",
            """select planta, material, semana, sum(n) as n from (select planta, material, cast(date_trunc('week', fecha_contab) as date) as semana, -abs(cantidad) as n from cust where mov_type = '702'
               union all select planta, material, cast(date_trunc('week', fecha) as date), cantidad from snap) group by 1, 2, 3 having sum(n) <> 0""",
        ),
    ),
    "inv_flujos_conservan": (
        flows_are_kept,
        "flows smov",
        differ(
            "planta, tipo_material, semana, estado",
            """select planta, tipo_material, semana, estado, sum(n) as n from (select planta, tipo_material, semana, origen as estado, -contenedores as n from flows union all select planta, tipo_material, semana, destino, contenedores from flows)
               where estado <> 'faltante' group by 1, 2, 3, 4 having sum(n) <> 0""",
            "select planta, tipo_material, cast(date_trunc('week', fecha) as date) as semana, estado, sum(delta) as n from smov where evento <> 'apertura' and tipo_material <> 'CARTON' group by 1, 2, 3, 4 having sum(delta) <> 0",
        ),
    ),
    "inv_red_cuadra": (
        network_is_flow,
        "net flows",
        differ(
            "planta, tipo_material, semana",
            "select planta, tipo_material, semana, sum(salidas) as n from net group by 1, 2, 3 having sum(salidas) <> 0",
            "select planta, tipo_material, semana, sum(contenedores) as n from flows where origen = 'llenos' and destino = 'cliente' group by 1, 2, 3",
        ),
    ),
    "inv_calendario_necesidad": (lambda m: m.calendar.where(f"not ({CALENDAR})").select("apertura", "corte"), "cal", f"select apertura, corte from cal where not ({CALENDAR})"),
    "inv_z_economico_valido": (lambda m: m.levels.where(LEVEL).select("escenario", "tipo_material"), "level", f"select escenario, tipo_material from level where {LEVEL}"),
    "inv_brecha_cubierta": (lambda m: m.gap.where(UNCOVERED).select("escenario", "planta", "material"), "gap", f"select escenario, planta, material from gap where {UNCOVERED}"),
    "inv_prestamos_cuadran": (
        loans_balance,
        "lend",
        differ(
            "escenario, material",
            "select escenario, material, sum(recibido_mismo_pais + recibido_otro_pais) as n from lend group by 1, 2",
            "select escenario, material, sum(prestado_mismo_pais + prestado_otro_pais) as n from lend group by 1, 2",
            1e-6,
        ),
    ),
    "inv_sensibilidad_cuadra_base": (
        sensitivity_has_base,
        "gap",
        differ(
            "tipo_material",
            "select tipo_material, sum(usd_flete) + sum(usd_compra) + sum(usd_desechable) as n from gap where escenario = 'base' group by 1",
            "select tipo_material, sum(usd_flete + usd_compra + usd_desechable) as n from gap where escenario = 'base' group by 1",
            0.05,
        ),
    ),
    "inv_escenario_un_tipo": (
        scenarios_of_one_type,
        "level scen",
        differ(
            "escenario, tipo_material",
            "select escenario, tipo_material, coalesce(z_servicio, 0) as n from level join scen using (escenario) where solo is not null and tipo_material <> solo",
            "select l.escenario, l.tipo_material, coalesce(b.z_servicio, 0) as n from level l join scen using (escenario) join level b on b.escenario = 'base' and b.tipo_material = l.tipo_material where solo is not null and l.tipo_material <> solo",
        ),
    ),
    "inv_plan_con_embarques": (
        plan_is_shipped,
        "parts cust",
        "select planta, material, parte from parts p where not exists (select 1 from cust c where c.mov_type = '621' and c.planta = p.planta and c.material = p.material)",
    ),
    "inv_calidad_datos_cuadra": (
        board_adds_up,
        "allviol board",
        differ("regla", "select regla, sum(violaciones) as n from board group by 1", "select regla, count(*) as n from allviol group by 1"),
    ),
    "inv_cifras_conocidas": (
        known_figures,
        "allviol figures",
        "select distinct regla, cifra from (select regla, unnest(string_split(cifra_afectada, ' ')) as cifra from allviol where cifra_afectada is not null) where cifra <> 'todas' and cifra not in (select cifra from figures)",
    ),
    "inv_sim_estaciones_validas": (
        stations_hold,
        "queue lots",
        """, t as (select planta, tipo_material, estacion, fecha, sum(cantidad)::double as n from lots group by all),
             a as (select *, sum(listo) over w as la, sum(liberado) over w as ra from queue window w as (partition by planta, tipo_material, estacion order by fecha rows unbounded preceding))
        select 'listo distinto a la traza' as falla, planta, tipo_material, estacion, fecha from t full join (select * from queue where listo <> 0) using (planta, tipo_material, estacion, fecha) where n is distinct from listo
        union all select 'sale antes de estar listo', planta, tipo_material, estacion, fecha from a where ra > la + 1e-6
        union all select 'pasa la capacidad', planta, tipo_material, estacion, fecha from queue where liberado > case when isodow(fecha) > 5 then 0 else capacidad end + 1e-6""",
    ),
    "inv_impacto_completo": (
        lambda m: m.impact.where("valor_limpio is null").select("medida"),
        "impact",
        "select medida from impact where valor_limpio is null",
    ),
}


def assert_empty(df: DataFrame) -> None:
    """Raises with the first rows of what should have none."""
    if rows := df.take(3):
        raise AssertionError(f"rows where there should be none: {rows}")


def wrong_counts(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    """Of the named columns, those that are no 64-bit integers: a walk over the schema, without a job."""
    return [f.name for f in df.schema if f.name in names and f.dataType.typeName() != "long"]
