"""Registered queries with their SQL. Doubles that depend on the order of a sum are compared to six decimals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import rounded
from ..operators import capacity, contract, cycle, gap, need, quality, reports, stock
from ..sources import extract
from . import adapters, invariants, planted
from .models import ByDay, Models
from .oracles import SQL, statement

Build = Callable[[Models], DataFrame]


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: rounded(n, 6) for n in names})


#: name: how to build it, what its SQL reads, and the SQL's final select
TABLE: dict[str, tuple[Build, str, str]] = {
    "int_mov_cuenta": (
        lambda m: m.account,
        "acc",
        "select planta, cliente, material, tipo_material, mov_type, fecha_contab, anio_contable, doc_material, posicion, n as cantidad_abs, delta as delta_saldo, false as en_foto from acc",
    ),
    "int_tramos_fifo": (lambda m: m.tranches, "tr", "select *, false as salida_en_foto from tr"),
    "int_supervivencia_retorno": (lambda m: m.curve, "surv", "select * from surv"),
    "int_cuenta_mensual": (
        lambda m: six(m.monthly, "saldo_esperado", "exceso_saldo"),
        "monthly",
        "select * replace (round(saldo_esperado, 6) as saldo_esperado), round(saldo_fin_mes - saldo_esperado, 6) as exceso_saldo from monthly",
    ),
    "mart_exceso_saldo_ruta": (
        lambda m: cycle.route_excess(m.monthly, m.account_days, m.curve),
        "monthly acc surv",
        """, h as (select (select min(fecha_contab) from acc) + (select max(edad) from surv) as minima),
             r as (select planta, cliente, mes, fin_mes, sum(saldo_fin_mes)::bigint as s, sum(saldo_esperado) as e from monthly group by all),
             v as (select *, sum(s - e) over w as ve, sum(e) over w as vs, count(*) over w as k, min(fin_mes) over w as p from r window w as (partition by planta, cliente order by mes rows between 2 preceding and current row))
        select planta, cliente, mes, s as saldo_fin_mes, round(e, 1) as saldo_esperado, round(s - e, 1) as exceso_saldo, round((s - e) * 100 / nullif(e, 0), 2) as exceso_pct,
               round(ve * 100 / nullif(vs, 0), 2) as exceso_pct_ciclo, k = 3 and p >= minima as alerta_valida from v, h""",
    ),
    "int_merma_conciliable": (lambda m: m.loss, "loss", "select planta, cliente, material, tipo_material, mov_type, fecha_contab, n as cantidad_abs, costo_unitario_usd, en_tasa from loss"),
    "mart_rutas": (lambda m: m.routes, "routes", "select * from routes"),
    "mart_rutas_rotas": (lambda m: cycle.broken_routes(m.routes), "routes", "select * exclude (rota_por_merma, rota_por_ciclo, ruta_rota) from routes where ruta_rota"),
    "mart_perdidas_usd": (
        lambda m: cycle.losses_usd(m.moves_days),
        "loss",
        """select planta, material, tipo_material, cast(date_trunc('month', fecha_contab) as date) as mes, sum(n)::bigint as unidades_perdidas, max(costo_unitario_usd) as costo_unitario_usd,
                  round(sum(n * costo_unitario_usd), 2) as perdida_usd from loss where mov_type = '702' group by all""",
    ),
    "mart_rotacion_planta": (lambda m: m.rotation, "rot", "select * from rot"),
    "mart_ciclo_cohortes": (
        lambda m: cycle.cohort_cycle(m.rotation, m.tranches_days),
        "rot ret",
        """, t as (select r.planta, r.dias, r.cantidad from ret r join rot c on c.planta = r.planta and c.mes = date_trunc('month', r.fecha_salida) where cohorte_completa),
             d as (select case when grouping(planta) = 1 then 'flota' else 'planta' end as nivel, planta, dias, sum(cantidad) as n from t group by grouping sets ((planta, dias), (dias))),
             a as (select *, cast(sum(n) over (partition by nivel, planta order by dias rows unbounded preceding) as double) / cast(sum(n) over (partition by nivel, planta) as double) as s from d)
        select nivel, planta, sum(n)::bigint as contenedores_recogidos, round(sum(n * dias)::double / sum(n)::double, 1) as ciclo_promedio_dias, min(case when s >= 0.5 then dias end) as ciclo_p50_dias,
               min(case when s >= 0.9 then dias end) as ciclo_p90_dias from a group by nivel, planta""",
    ),
    "int_tco_por_material": (lambda m: six(m.cost, "vida_esperada_ciclos"), "tcomat", "select * replace (round(vida_esperada_ciclos, 6) as vida_esperada_ciclos) from tcomat"),
    "mart_tco_comparativo": (
        lambda m: cycle.cost_comparison(m.cost),
        "tcomat",
        """, c as (select *, costo_unitario_usd / vida_esperada_ciclos as a, ceil(costo_unitario_usd / (desechable_equiv_usd - mant_por_ciclo_usd)) as p from tcomat)
        select planta, tipo_material, viajes, salidas_conciliadas, faltantes, tasa_merma_pct, vida_util_ciclos, round(vida_esperada_ciclos, 1) as vida_esperada_ciclos, costo_unitario_usd, mant_por_ciclo_usd,
               desechable_equiv_usd, round(a, 4) as amortizacion_por_ciclo_usd, round(a + mant_por_ciclo_usd, 4) as costo_retornable_por_ciclo_usd,
               round(desechable_equiv_usd - (a + mant_por_ciclo_usd), 4) as ahorro_por_ciclo_usd, p::int as ciclos_payback, p <= vida_esperada_ciclos as recupera_inversion,
               round(viajes * (desechable_equiv_usd - (a + mant_por_ciclo_usd)), 2) as ahorro_neto_usd, round(perdida_reconocida_usd, 2) as perdida_reconocida_usd from c""",
    ),
    "stock_inicial_minimo": (lambda m: stock.minimum_opening(m.ledger_days, "VACI"), "minopen", "select * from minopen"),
    "int_mov_stock": (lambda m: m.changes, "smov", "select * from smov"),
    "int_stock_diario": (lambda m: m.daily, "dstock", "select * from dstock"),
    "mart_flota_semanal": (lambda m: m.fleet, "fleet", "select * from fleet"),
    "mart_flujos_semanales": (lambda m: stock.weekly_flows(m.ledger, m.places, m.classes), "flows", "select * from flows"),
    "mart_red_semanal": (lambda m: stock.weekly_network(m.customer_days, m.classes), "net", "select * from net"),
    "int_calendario_necesidad": (lambda m: m.calendar, "cal", "select * from cal"),
    "int_uso_diario": (lambda m: m.use, "use", "select * from use"),
    "int_variabilidad_uso": (
        lambda m: six(m.variability, "uso_promedio", "sigma_uso", "d_ventana", "d_base", "ciclo_dias"),
        "vari",
        "select ventana, planta, material, tipo_material, round(uso_promedio, 6) as uso_promedio, round(sigma_uso, 6) as sigma_uso, round(d_ventana, 6) as d_ventana, round(d_base, 6) as d_base, round(ciclo_dias, 6) as ciclo_dias from vari",
    ),
    "int_curva_z": (lambda m: six(m.service, "quiebre"), "curve", "select tipo_material, z, round(quiebre, 6) as quiebre from curve"),
    "int_z_economico": (
        lambda m: six(m.levels, "costo_corto_dia", "costo_exceso_dia", "quiebre_calibracion"),
        "level",
        "select * replace (round(costo_corto_dia, 6) as costo_corto_dia, round(costo_exceso_dia, 6) as costo_exceso_dia, round(quiebre_calibracion, 6) as quiebre_calibracion) from level",
    ),
    "int_demanda_plan": (
        lambda m: six(m.demand, "d_plan", "d_base", "ciclo_dias", "sigma_uso"),
        "dem",
        "select * replace (round(d_plan, 6) as d_plan, round(d_base, 6) as d_base, round(ciclo_dias, 6) as ciclo_dias, round(sigma_uso, 6) as sigma_uso) from dem",
    ),
    "int_necesidad_escenario": (
        lambda m: six(m.need, "d_plan", "d_base", "ciclo_dias", "sigma_uso", "uso_plan", "stock_seguridad"),
        "need",
        "select * replace (round(d_plan, 6) as d_plan, round(d_base, 6) as d_base, round(ciclo_dias, 6) as ciclo_dias, round(sigma_uso, 6) as sigma_uso, round(uso_plan, 6) as uso_plan, round(stock_seguridad, 6) as stock_seguridad) from need",
    ),
    "mart_necesidad_flota": (
        lambda m: need.fleet_need(m.need),
        "need",
        """select planta, material, tipo_material, semana, round(d_plan, 4) as d_plan, round(d_base, 4) as d_base, round(ciclo_dias, 2) as ciclo_dias, round(sigma_uso, 2) as sigma_uso, con_historia, round(uso_plan, 1) as uso_plan,
                  round(stock_seguridad, 1) as stock_seguridad, round(stock_seguridad / nullif(d_plan, 0), 1) as stock_seguridad_dias, necesidad from need where escenario = 'base'""",
    ),
    "int_flota_proyectada": (
        lambda m: six(m.projected, "d_plan", "ciclo_dias"),
        "proj",
        "select * replace (round(d_plan, 6) as d_plan, round(ciclo_dias, 6) as ciclo_dias) from proj",
    ),
    "int_balance_material": (
        lambda m: six(m.balance, "deficit_pico", "sobrante", "ciclo_dias"),
        "bal",
        "select * replace (round(deficit_pico, 6) as deficit_pico, round(sobrante, 6) as sobrante, round(ciclo_dias, 6) as ciclo_dias) from bal",
    ),
    "int_prestamos": (
        lambda m: six(m.lent, "ciclo_dias", "deficit_pico", "sobrante", "recibido_mismo_pais", "recibido_otro_pais", "prestado_mismo_pais", "prestado_otro_pais"),
        "lend",
        "select escenario, planta, pais, material, tipo_material, round(columns(* exclude (escenario, planta, pais, material, tipo_material)), 6) from lend",
    ),
    "int_brecha_escenario": (lambda m: m.gap, "gap", "select * from gap"),
    "mart_brecha_flota": (lambda m: gap.base_gap(m.gap), "gap", "select * exclude (escenario) from gap where escenario = 'base'"),
    "mart_sensibilidad_brecha": (
        lambda m: gap.gap_sensitivity(m.gap, m.need, m.levels),
        "gap need level",
        """, f as (select escenario, tipo_material, sum(necesidad)::bigint as necesidad_semana_1 from need where semana = (select min(semana) from need) group by 1, 2),
             t as (select escenario, tipo_material, sum(case when deficit_pico > 0 then 1 else 0 end)::bigint as materiales_deficit, round(sum(deficit_pico), 1) as deficit, round(sum(recibido_mismo_pais), 1) as recibido_mismo_pais,
                          round(sum(recibido_otro_pais), 1) as recibido_otro_pais, sum(compra)::bigint as compra, round(sum(viajes_desechable), 1) as viajes_desechable, round(sum(usd_flete), 2) as usd_flete, round(sum(usd_compra), 2) as usd_compra,
                          round(sum(usd_desechable), 2) as usd_desechable, round(sum(usd_flete) + sum(usd_compra) + sum(usd_desechable), 2) as usd_brecha, round(sum(sobrante_final), 1) as sobrante_final, round(sum(usd_capital_ocioso), 2) as usd_capital_ocioso from gap group by 1, 2)
        select t.*, factor_costo_quiebre, costo_capital_anual_pct, z_fija, ajuste_ciclo_dias, objetivo_quiebre, z_servicio, necesidad_semana_1 from t join level using (escenario, tipo_material) join f using (escenario, tipo_material)""",
    ),
    "mart_red_prestamos": (
        lambda m: gap.loan_network(m.lent, m.prices, m.policy),
        "lend prices params",
        """, p as (select * from lend where escenario = 'base'),
             x as (select d.planta as planta_origen, d.pais as pais_origen, r.planta as planta_destino, r.pais as pais_destino, r.material, r.tipo_material, 'mismo_pais' as etapa,
                          r.recibido_mismo_pais * d.prestado_mismo_pais / sum(d.prestado_mismo_pais) over (partition by r.planta, r.material) as n from p r join p d on d.material = r.material and d.pais = r.pais
                   where r.recibido_mismo_pais > 0 and d.prestado_mismo_pais > 0
                   union all
                   select d.planta, d.pais, r.planta, r.pais, r.material, r.tipo_material, 'otro_pais', r.recibido_otro_pais * d.prestado_otro_pais / sum(d.prestado_otro_pais) over (partition by r.planta, r.material)
                   from p r join p d on d.material = r.material where r.recibido_otro_pais > 0 and d.prestado_otro_pais > 0)
        select planta_origen, pais_origen, planta_destino, pais_destino, tipo_material, etapa, count(distinct material) as materiales, round(sum(n), 1) as contenedores,
               round(sum(n * costo_unitario_usd * case when etapa = 'mismo_pais' then flete_mismo_pais_pct else flete_otro_pais_pct end) / 100, 2) as usd_flete
        from x join prices using (tipo_material) join params using (tipo_material) group by all""",
    ),
    "int_calidad_mb51": (lambda m: m.violations.drop("severidad", "cifra_afectada"), "viol", "select * from viol"),
    "int_calidad_violaciones": (lambda m: m.all_violations, "allviol", "select * from allviol"),
    "mart_calidad_datos": (lambda m: m.board, "board", "select * from board"),
    "cifras_bloqueadas": (
        lambda m: quality.blocked_figures(m.violations),
        "viol rules figures",
        """, x as (select distinct regla, unnest(string_split(cifra_afectada, ' ')) as c from viol join rules using (regla) where severidad = 'bloquea'),
             y as (select distinct regla, figures.cifra from x join figures on c = figures.cifra or c = 'todas')
        select cifra, string_agg(regla, ', ' order by regla) as reglas from y group by 1""",
    ),
    "int_sim_calendario": (lambda m: m.days, "days", "select * from days"),
    "int_sim_lotes": (lambda m: m.lots, "lots", "select * from lots"),
    "int_sim_vacios": (lambda m: m.empties, "emp", "select * from emp"),
    "sim_liberacion": (
        lambda m: six(m.release, "liberado", "liberado_acum", "cola"),
        "queue",
        "select * replace (round(liberado, 6) as liberado, round(liberado_acum, 6) as liberado_acum, round(cola, 6) as cola) from queue",
    ),
    "sim_liberacion_por_lote": (
        lambda m: six(capacity.lot_release(m.lots, m.release), "cantidad"),
        "lots queue",
        """, l as (select *, sum(cantidad) over (partition by planta, tipo_material, estacion order by fecha, material, a_vacios rows unbounded preceding)::double as z from lots),
             q as (select *, liberado_acum - liberado as a from queue where liberado > 0),
             m as (select l.planta, l.tipo_material, l.estacion, material, a_vacios, l.fecha as fecha_lista, q.fecha as fecha_salida, least(z, liberado_acum) - greatest(z - cantidad, a) as cantidad
                   from l join q on q.planta = l.planta and q.tipo_material = l.tipo_material and q.estacion = l.estacion and a < z and z - cantidad < liberado_acum),
             t as (select planta, tipo_material, estacion, max(liberado_acum) as fin from q group by all)
        select * replace (round(cantidad, 6) as cantidad) from (
          select * from m union all
          select l.planta, l.tipo_material, l.estacion, material, a_vacios, l.fecha, null, least(cantidad, z - fin) from l join t on t.planta = l.planta and t.tipo_material = l.tipo_material and t.estacion = l.estacion where z > fin)
        where cantidad > 1e-6""",
    ),
    "sim_vacios_con_piso": (
        lambda m: capacity.capped_empties(m.empties, m.calendar),
        "emp days",
        """, d as (select k.*, fecha, coalesce(delta, 0) as delta from (select distinct planta, tipo_material, material from emp) k cross join (select fecha from days) left join emp using (planta, tipo_material, material, fecha)),
             s as (select *, sum(delta) over w as s from d window w as (partition by planta, tipo_material, material order by fecha rows unbounded preceding)),
             f as (select *, -least(0, min(s) over w) as f from s window w as (partition by planta, tipo_material, material order by fecha rows unbounded preceding))
        select planta, tipo_material, material, fecha, delta::bigint as delta, f::bigint as faltante_acum, (s + f)::bigint as saldo from f""",
    ),
    "foto_al_corte": (
        lambda m: stock.snapshot_at(m.ledger_days, m.snapshot, m.places, dt.date(1999, 1, 1)),
        "led places snap",
        """, x as (select planta, material, tipo_material, almacen, null as cliente, cantidad from snap
                   union all select planta, material, tipo_material, almacen, null, cantidad from led join places using (almacen) where estado <> 'fuera_ciclo' and fecha_contab < date '1999-01-01'
                   union all select planta, material, tipo_material, null, cliente, case when mov_type = '621' then 1 else -1 end * abs(cantidad) from led where mov_type in ('621', '622', '702') and fecha_contab < date '1999-01-01')
        select planta, material, tipo_material, almacen, cliente, sum(cantidad)::bigint as cantidad, date '1998-12-31' as fecha from x group by all having sum(cantidad) <> 0""",
    ),
    "contrato_movimientos": (
        lambda m: contract.failures(m.lines, contract.MOVEMENTS, ("doc_material", "posicion")),
        "dirty",
        """, x as (select unnest([case when length(almacen) not between 4 and 12 then {'c': 'almacen', 'k': 'str_length(4, 12)', 'v': almacen} end,
                                  case when length(cliente) not between 1 and 3 then {'c': 'cliente', 'k': 'str_length(1, 3)', 'v': cliente} end]) as x, doc_material || '|' || posicion as llave from dirty)
        select 'raw_mb51' as tabla, x.c as columna, x.k as chequeo, x.v as valor, llave from x where x is not null""",
    ),
    "reporte_titular": (
        lambda m: reports.headline(cycle.losses_usd(m.moves_days), m.routes),
        "loss routes",
        """, l as (select sum(n * costo_unitario_usd) as perdida_usd, sum(n)::bigint as unidades from loss where mov_type = '702')
        select l.*, round(sum(faltantes) * 100.0::double / sum(salidas_conciliadas)::double, 3) as tasa_flota_pct, count(case when ruta_rota then 1 end) as rutas_rotas, count(*) as rutas from routes, l group by all""",
    ),
    "reporte_perdida_por_tipo": (
        lambda m: reports.loss_by_type(cycle.losses_usd(m.moves_days)),
        "loss",
        "select tipo_material, sum(n * costo_unitario_usd) as perdida_usd, sum(n)::bigint as unidades from loss where mov_type = '702' group by 1",
    ),
    "reporte_perdida_por_mes": (
        lambda m: reports.loss_by_month(cycle.losses_usd(m.moves_days)),
        "loss",
        """select cast(date_trunc('month', fecha_contab) as date) as mes, sum(case when tipo_material = 'KLT' then n * costo_unitario_usd else 0 end) as KLT, sum(case when tipo_material = 'RACK' then n * costo_unitario_usd else 0 end) as RACK
           from loss where mov_type = '702' group by 1""",
    ),
    "reporte_pareto": (
        lambda m: reports.pareto(cycle.losses_usd(m.moves_days)),
        "loss",
        """, p as (select planta, sum(n * costo_unitario_usd) as perdida_usd from loss where mov_type = '702' group by 1),
             a as (select *, sum(perdida_usd) over (order by perdida_usd desc, planta rows unbounded preceding) / sum(perdida_usd) over () as a from p)
        select planta, perdida_usd, round(a * 100, 2) as acumulado_pct, coalesce(lag(a) over (order by perdida_usd desc, planta), 0) < 0.8 as en_80 from a""",
    ),
    "reporte_top_materiales": (
        lambda m: reports.top_materials(cycle.losses_usd(m.moves_days)),
        "loss",
        """select planta, material, tipo_material, sum(n * costo_unitario_usd) as perdida_usd, sum(n)::bigint as unidades from loss where mov_type = '702' group by 1, 2, 3
           order by perdida_usd desc, planta, material limit 15""",
    ),
    "reporte_costo_por_viaje": (
        lambda m: reports.cost_per_trip(cycle.cost_comparison(m.cost)),
        "tcomat",
        """select tipo_material, sum(viajes)::bigint as viajes, round(sum(round(costo_unitario_usd / vida_esperada_ciclos + mant_por_ciclo_usd, 4) * viajes) / sum(viajes)::double, 4) as costo_retornable_por_ciclo_usd,
                  round(sum(desechable_equiv_usd * viajes) / sum(viajes)::double, 4) as desechable_equiv_usd, sum(round(viajes * (desechable_equiv_usd - (costo_unitario_usd / vida_esperada_ciclos + mant_por_ciclo_usd)), 2)) as ahorro_neto_usd
           from tcomat group by 1""",
    ),
    "reporte_cobertura": (
        lambda m: reports.coverage(stock.weekly_fleet(m.daily_t, m.v), m.use, m.policy),
        "fleet use params",
        """, r as (select planta, material, sum(salidas)::double / 91 as d from use where fecha > (select max(fecha) from use) - 91 group by 1, 2),
             f as (select planta, material, tipo_material, arg_max(vacios, semana) as vacios from fleet group by 1, 2, 3)
        select planta, material, tipo_material, vacios, round(d, 4) as demanda, round(vacios / nullif(d, 0), 2) as dias, coalesce(vacios / nullif(d, 0) < dias_cobertura, false) as alerta
        from f join r using (planta, material) join params using (tipo_material)""",
    ),
    "reporte_perfil": (
        lambda m: reports.profile(m.ledger),
        "led",
        """, p as (select mov_type, planta, cast(date_trunc('month', fecha_contab) as date) as mes, count(*) as lineas, sum(abs(cantidad))::bigint as unidades from led group by 1, 2, 3)
        select *, round(lineas * 100.0::double / (sum(lineas) over (partition by planta, mes))::double, 4) as pct_planta_mes from p""",
    ),
    "reporte_encabezado": (
        lambda m: reports.header(m.ledger),
        "led",
        "select count(distinct planta) as plantas, count(distinct date_trunc('month', fecha_contab)) as meses, max(fecha_contab) as ultima from led",
    ),
    "int_calidad_maestro": (lambda m: m.master_violations, "mviol", "select * from mviol"),
    "int_calidad_plan": (lambda m: m.plan_violations, "pviol", "select * from pviol"),
    "int_calidad_stock_inicial": (lambda m: m.snapshot_violations, "fviol", "select * from fviol"),
    "cifras_bloqueadas_todas": (
        lambda m: quality.blocked_figures(m.all_violations),
        "allviol figures",
        """, x as (select distinct regla, unnest(string_split(cifra_afectada, ' ')) as c from allviol where severidad = 'bloquea'),
             y as (select distinct regla, figures.cifra from x join figures on c = figures.cifra or c = 'todas')
        select cifra, string_agg(regla, ', ' order by regla) as reglas from y group by 1""",
    ),
    "contrato_tablas": (lambda m: m.contract_failures, "cfail", "select * from cfail"),
    "deteccion_por_defecto": (
        lambda m: quality.detection(quality.injected(m.ledger), m.violations),
        "led viol",
        """, k as (select * from (values (0, 'D05', 'signo_invertido'), (1, 'D02', 'bwart_fuera_de_catalogo'), (2, 'D03', 'lgort_fuera_de_catalogo'), (3, 'D04', 'cliente_vacio'), (4, 'D01', 'llave_duplicada'),
                   (5, 'D08', 'registro_despues_del_cierre'), (6, 'B04', 'budat_despues_del_corte'), (7, 'B02', 'kunnr_con_formato'), (8, 'B01', 'matnr_con_formato'), (9, 'D06', 'cantidad_en_piezas'), (10, 'B03', 'documento_repetido'), (11, 'D16', 'precio_documento_distinto')) as t(h, defecto, regla)),
             i as (select distinct defecto, regla, planta, case when h <> 11 then anio_contable end as anio_contable, case when h = 11 then material end as mat, case when h = 11 then null else case when defecto = 'B03' then 'Z' else '' end || case when mov_type = '311' then concat(doc_material, '-', posicion // 2) else doc_material end end as doc,
                          case when h = 11 then null when mov_type = '311' then 1 + posicion % 2 else posicion end as pos
                   from led join k on (posicion * 31 + cast(right(doc_material, 6) as bigint)) % 997 = h
                   where (h <> 2 or almacen is not null) and (h <> 3 or cliente is not null) and (h <> 7 or (cliente is not null and mov_type in ('621', '622', '702'))) and (h <> 9 or mov_type = '621') and (h <> 10 or mov_type = '621') and (h <> 11 or mov_type in ('621', '622', '702'))),
             v as (select distinct regla, planta, anio_contable, doc_material, posicion, case when doc_material is null then material end as mat from viol)
        select defecto, i.regla, count(*) as casos, count(v.regla) as detectados from i left join v on v.regla = i.regla and v.planta = i.planta and v.anio_contable is not distinct from i.anio_contable and v.doc_material is not distinct from i.doc and v.posicion is not distinct from i.pos
             and v.mat is not distinct from i.mat group by 1, 2""",
    ),
    "deteccion_en_tablas": (
        lambda m: quality.detection_in_tables(quality.injected_tables(m.customer_days, m.snapshot, m.plan[1]), m.table_violations),
        "cust snap parts allviol",
        """, k as (select * from (values (5, 'm', 'D17', 'grupo_fuera_de_catalogo'), (9, 'm', 'D14', 'grupo_contradice_codigo'), (3, 'm', 'D13', 'unidad_de_precio'), (7, 'm', 'D18', 'moneda_distinta'), (11, 'm', 'D15', 'material_sin_maestro'),
                   (2, 'm', null, 'llave_maestro_duplicada'), (4, 'f', 'D09', 'material_sin_foto'), (1, 'f', 'D03', 'lgort_fuera_de_catalogo'), (6, 'p', 'D10', 'parte_sin_instruccion'), (8, 'p', 'D11', 'piezas_en_cero'),
                   (10, 'p', 'D12', 'instruccion_a_desechable'), (12, 'p', null, 'instruccion_fuera_de_planta'), (13, 'p', null, 'parte_sin_registro'), (14, 'p', null, 'llave_plan_duplicada')) as t(n, t, defecto, regla)),
             r as (select 'm' as t, planta, material as llave, tipo_material, cast(split_part(material, '-', 2) as int) as n from cust union select 'f', planta, material, tipo_material, cast(split_part(material, '-', 2) as int) from snap
                   union select 'p', planta, parte, tipo_material, cast(list_last(string_split(parte, '-')) as int) from parts),
             i as (select distinct regla, planta, llave, 1 as caso from r join k using (t, n) where (t = 'm' and n = 9 and tipo_material = 'RACK') is not true and (t = 'm' and n = 2 and planta <> 'P0') is not true),
             v as (select distinct regla, planta, coalesce(parte, material) as llave, 1 as visto from allviol where regla in (select regla from i)),
             j as (select regla, caso, visto from i full join v using (regla, planta, llave))
        select k.defecto, j.regla, count(caso) as casos, count(case when caso = 1 then visto end) as detectados, count(case when caso is null then visto end) as otros from j join k using (regla) group by 1, 2""",
    ),
    "mart_impacto_defectos": (lambda m: m.impact, "impact", "select * from impact"),
    "mart_impacto_por_defecto": (lambda m: m.impact_by_fault, "impactk", "select * from impactk"),
    "matriz_impacto_defectos": (
        lambda m: quality.impact_matrix(m.impact_by_fault),
        "impactk",
        """select defecto, max(case medida when 'perdida' then delta_pct end) as perdida, max(case medida when 'salidas_usd' then delta_pct end) as salidas_usd, max(case medida when 'recogidas_usd' then delta_pct end) as recogidas_usd,
                  coalesce(string_agg(case when tipo = 'identidad' and supera_materialidad then medida end, ', ' order by medida), '') as identidades_rotas from impactk group by 1""",
    ),
    "extracto_mb51": (
        lambda m: extract.movements(extract.as_extract(m.ledger)),
        "led",
        """select planta as Werks, almacen as Lgort, material as Matnr, 'Contenedor ' || material as Maktx, mov_type as Bwart, anio_contable as Mjahr, fecha_contab as Budat, fecha_contab as Cpudt, '09:05:07' as Cputm, cantidad::bigint as Menge,
                  'PC' as Meins, doc_material as Mblnr, lpad(posicion::varchar, greatest(4, length(posicion::varchar))::int, '0') as Zeile, null as Lifnr, cliente as Kunnr, null as Xblnr,
                  case when posicion % 2 = 0 and cantidad <> 0 then round((abs(cantidad) * 25 + 0.5::double) / abs(cantidad), 2) end as Costo_usd from led""",
    ),
    "extracto_regreso": (
        lambda m: m.rolled_back,
        "snap",
        "select planta, almacen, material, null as cliente, cantidad, date '1995-01-01' as fecha from snap",
    ),
    "reporte_flota_y_necesidad": (
        lambda m: reports.fleet_against_need(m.projected, m.need),
        "proj need",
        """select f.semana, f.tipo_material, round(sum(flota_proyectada), 2) as flota, sum(coalesce(necesidad, 0))::bigint as necesidad, round(sum(greatest(coalesce(necesidad, 0) - flota_proyectada, 0)), 2) as deficit
           from proj f left join (select * from need where escenario = 'base') n on n.planta = f.planta and n.material = f.material and n.semana = f.semana group by 1, 2""",
    ),
    "reporte_stock_seguridad": (
        lambda m: reports.safety_distribution(need.fleet_need(m.need)),
        "need",
        """, d as (select tipo_material, round(stock_seguridad / nullif(d_plan, 0), 1) as d from need where escenario = 'base')
        select tipo_material, min(d) as minimo, quantile_cont(d, 0.01) as p01, median(d) as mediana, count(case when d <= 7 then 1 end) as hasta_7, count(d) as n from d group by 1""",
    ),
    "reporte_brecha_por_nivel": (
        lambda m: reports.gap_by_level(m.gap),
        "gap",
        """select tipo_material, round(sum(deficit_pico), 1) as deficit, round(sum(recibido_mismo_pais), 1) as mismo_pais, round(sum(recibido_otro_pais), 1) as otro_pais, sum(compra)::bigint as compra,
                  round(sum(viajes_desechable), 1) as viajes_desechable, round(sum(usd_flete + usd_compra + usd_desechable), 2) as usd from gap where escenario = 'base' group by 1""",
    ),
    "reporte_sensibilidad_merma": (
        lambda m: reports.saving_sensitivity(m.cost),
        "tcomat",
        """select tipo_material, r as tasa_pct, round(sum(viajes * (desechable_equiv_usd - costo_unitario_usd / ((1 - power(1 - r / 100, vida_util_ciclos)) / (r / 100)) - mant_por_ciclo_usd)), 2) as ahorro_neto_usd
           from tcomat cross join (select unnest([0.5, 1.0, 2.0, 5.0])::double as r) group by 1, 2""",
    ),
    "reporte_sensibilidad_desechable": (
        lambda m: reports.saving_by_price(cycle.cost_comparison(m.cost)),
        "tcomat",
        """select d as desechable_usd, round(sum(viajes * (d - round(costo_unitario_usd / vida_esperada_ciclos + mant_por_ciclo_usd, 4))), 2) as ahorro_neto_usd
           from tcomat cross join (select unnest([34, 40, 45, 50, 55, 60, 66])::double as d) where tipo_material = 'RACK' group by 1""",
    ),
    "stg_maestro_materiales": (
        lambda m: cycle.price_of(m.dirty["master"]),
        "dmast",
        "select planta, material, tipo_material, precio / nullif(unidad_precio, 0) as costo_unitario_usd from dmast",
    ),
    "stg_mb51": (
        lambda m: cycle.staged_movements(m.lines, m.clean_master),
        "dirty mastr cust",
        """, t as (select distinct planta, material, tipo_material from cust)
        select planta, cliente, material, t.tipo_material, almacen, mov_type, fecha_contab, fecha_registro, anio_contable, doc_material, posicion, cantidad::bigint as cantidad, costo as costo_unitario_usd,
               (fecha_registro - fecha_contab)::int as lag_dias, fecha_registro - fecha_contab > 2 as flag_tardio from (select * exclude (tipo_material) from dirty) left join mastr using (planta, material) left join t using (planta, material)""",
    ),
    "stg_stock_inicial": (lambda m: cycle.typed(m.snapshot, m.clean_master), "snap", "select planta, almacen, material, tipo_material, null as cliente, cantidad, fecha from snap"),
    "stg_instruccion_empaque": (lambda m: cycle.typed(m.plan[1], m.clean_master), "parts", "select planta, parte, material, tipo_material, ppc as piezas_por_contenedor from parts"),
    "reporte_exceso_mensual": (
        lambda m: six(reports.excess_by_month(cycle.route_excess(m.monthly, m.account_days, m.curve), m.routes), "rota", "resto"),
        "exc routes",
        """select mes, round(median(case when ruta_rota then exceso_pct_ciclo end), 6) as rota, round(median(case when not ruta_rota then exceso_pct_ciclo end), 6) as resto
           from exc join routes using (planta, cliente) where alerta_valida group by 1""",
    ),
    "reporte_ahorro_por_planta": (
        lambda m: reports.saving_by_plant(cycle.cost_comparison(m.cost)),
        "tcomat",
        """, a as (select planta, tipo_material, round(viajes * (desechable_equiv_usd - (costo_unitario_usd / vida_esperada_ciclos + mant_por_ciclo_usd)), 2) as ahorro from tcomat),
             p as (select planta, sum(case when tipo_material = 'KLT' then ahorro end) as KLT, sum(case when tipo_material = 'RACK' then ahorro end) as RACK from a group by 1)
        select *, coalesce(KLT, 0) + coalesce(RACK, 0) as total from p""",
    ),
    "reporte_huella": (
        lambda m: reports.fingerprint(m.customer),
        "cust",
        """select planta, count(*) as lineas, sum(case when mov_type = '621' then abs(cantidad) end)::bigint as unidades_621, sum(case when mov_type = '622' then abs(cantidad) end)::bigint as unidades_622,
                  sum(case when mov_type = '702' then abs(cantidad) end)::bigint as unidades_702, sum(('0x' || substr(md5(concat_ws('|', cliente, material, mov_type, fecha_contab, cantidad, doc_material, posicion)), 1, 8))::bigint)::bigint as huella
           from cust where mov_type in ('621', '622', '702') group by 1""",
    ),
    "reporte_rezago": (
        lambda m: reports.lag_distribution(m.lines),
        "dirty",
        """, d as (select (fecha_registro - fecha_contab)::int as lag_dias, count(*) as lineas from dirty group by 1)
        select lag_dias, lineas, round(lineas * 100.0::double / (sum(lineas) over ())::double, 4) as pct from d""",
    ),
    "reporte_brecha_arranque": (
        lambda m: reports.gap_by_ramp(m.gap, m.plan[1]),
        "gap parts",
        """select tipo_material, coalesce(a, false) as con_arranque, count(*) as materiales, round(sum(deficit_pico), 1) as deficit, round(sum(usd_flete + usd_compra + usd_desechable), 2) as usd_brecha
           from gap left join (select planta, material, bool_or(num % 5 = 0) as a from parts group by 1, 2) using (planta, material) where escenario = 'base' group by 1, 2""",
    ),
    "reporte_frontera": (lambda m: reports.frontier(gap.gap_sensitivity(m.gap, m.need, m.levels)), "sens", f"select * from sens where escenario in ({', '.join(repr(e) for e in reports.POLICIES)})"),
    "reporte_coeficientes_flete": (
        lambda m: reports.freight_coefficients(m.lent, m.prices),
        "lend prices",
        """select tipo_material, round(sum(recibido_mismo_pais * costo_unitario_usd) / 100, 2) as mismo_pais, round(sum(recibido_otro_pais * costo_unitario_usd) / 100, 2) as otro_pais
           from lend join prices using (tipo_material) where escenario = 'base' group by 1""",
    ),
    "reporte_rangos_supuestos": (
        lambda m: reports.assumption_ranges(gap.gap_sensitivity(m.gap, m.need, m.levels), reports.freight_coefficients(m.lent, m.prices)),
        "gap lend prices",
        f""", c as (select tipo_material, round(sum(recibido_mismo_pais * costo_unitario_usd) / 100, 2) as a, round(sum(recibido_otro_pais * costo_unitario_usd) / 100, 2) as b
                    from lend join prices using (tipo_material) where escenario = 'base' group by 1),
             k as (select sum(a) as a, sum(b) as b from c), s as (select escenario, sum(u) as usd, sum(f) as flete from (select escenario, tipo_material, round(sum(usd_flete) + sum(usd_compra) + sum(usd_desechable), 2) as u, round(sum(usd_flete), 2) as f from gap group by 1, 2) group by 1),
             z as (select usd, flete from s where escenario = 'base'),
             r as (select supuesto, x.usd as bajo, y.usd as alto from (values {", ".join(map(str, reports.RANGOS))}) as v(supuesto, desde, hasta) join s x on x.escenario = desde join s y on y.escenario = hasta
                   union all select '{reports.RANGO_FLETE[0]}', usd - flete + a * 3 + b * 10, usd - flete + a * 8 + b * 25 from z, k)
        select supuesto, round(bajo, 2) as bajo, round(alto, 2) as alto, round(usd, 2) as base, round(round(alto, 2) - round(bajo, 2), 2) as amplitud from r, z""",
    ),
    "reporte_racks_compartidos": (
        lambda m: reports.shared_racks(m.plan[1]),
        "parts",
        "select planta, material, count(distinct cliente) as clientes from parts where tipo_material = 'RACK' group by 1, 2 having count(distinct cliente) > 1",
    ),
    "plan_derivado": (lambda m: m.plan[0], "plan", "select planta, parte, semana, piezas::bigint as piezas from plan"),
    "instruccion_derivada": (lambda m: m.plan[1], "parts", "select planta, parte, material, tipo_material, ppc::bigint as piezas_por_contenedor from parts"),
    "reporte_tablero": (
        lambda m: reports.rule_board(m.rules, m.board),
        "rules board",
        """select r.regla, r.defecto, r.unidad, r.severidad, r.cifra_afectada, coalesce(sum(violaciones), 0)::bigint as violaciones, round(sum(usd_expuesto), 2) as usd_expuesto
           from rules r left join board b on b.regla = r.regla group by 1, 2, 3, 4, 5""",
    ),
    "reporte_correlacion_rangos": (
        lambda m: reports.rank_correlation(m.board),
        "board",
        """, s as (select regla, planta, sum(violaciones) as n, sum(usd_expuesto) as usd from board where usd_expuesto is not null group by 1, 2),
             r as (select regla, rank() over (partition by regla order by n) + (count(*) over (partition by regla, n) - 1) / 2.0::double as a, rank() over (partition by regla order by usd) + (count(*) over (partition by regla, usd) - 1) / 2.0::double as b from s)
        select regla, count(*) as plantas, round(case when stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) end, 6) as correlacion from r group by 1""",
    ),
    "documentos_numerados": (
        lambda m: stock.numbered_documents(m.ledger),
        "led",
        """select anio_contable, fecha_contab, doc_material, concat('49', lpad((dense_rank() over (partition by anio_contable order by fecha_contab, doc_material))::varchar, 8, '0')) as numero
           from (select distinct anio_contable, fecha_contab, doc_material from led)""",
    ),
    "faltantes_por_cierre": (
        lambda m: stock.month_end_batch(m.customer.where("mov_type = '702'"), m.v),
        "cust",
        """, d as (select planta, material, tipo_material, last_day(fecha_contab) - greatest(0, isodow(last_day(fecha_contab)) - 5)::int as fecha_contab, sum(abs(cantidad))::bigint as cantidad from cust where mov_type = '702' group by 1, 2, 3, 4)
        select * from d where fecha_contab <= date '2001-06-30'""",
    ),
}
SQL["red"] = (TABLE["mart_red_prestamos"][1], "with " + TABLE["mart_red_prestamos"][2].lstrip(", "))
TABLE["reporte_matriz_prestamos"] = (
    lambda m: reports.loan_matrix(gap.loan_network(m.lent, m.prices, m.policy)),
    "red",
    "select planta_origen, " + ", ".join(f"round(sum(case when planta_destino = 'P{n}' then contenedores end), 1) as P{n}" for n in range(5)) + " from red group by 1",
)
TABLE |= adapters.TABLE | invariants.TABLE | planted.TABLE


def shared(spark: SparkSession, sf_dir: str) -> Models:
    """The models of a folder: queries of one session build each node once between them."""
    kept = spark.__dict__.setdefault("_fleetledger_models", {})
    return kept.setdefault(sf_dir, ByDay(spark, sf_dir))


def forget(spark: SparkSession) -> None:
    """Lets go of the session's models: the next query builds, and writes, all its nodes again."""
    spark.__dict__.pop("_fleetledger_models", None)


def queries() -> dict[str, Callable]:
    return {name: (lambda spark, sf_dir, b=build: b(shared(spark, sf_dir))) for name, (build, _, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that have it."""
    return {name: statement(final, needs) for name, (_, needs, final) in TABLE.items() if final}
