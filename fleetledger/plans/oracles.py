"""The same results in DuckDB SQL, as named relations that build on each other.

Each entry is (relations it reads, its text). `statement` puts what a query needs before it, in order.
"""

from __future__ import annotations

from ..operators.quality import CIFRAS, REGLAS
from ..sources import ledger as L

CUTOFF = f"date '{L.VARS.fecha_extraccion}'"


def values(name_and_columns: str, rows: list[tuple]) -> str:
    """A relation of fixed rows."""
    quoted = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else "null" if x is None else f"{x}::double" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
    return f"select * from (values {quoted}) as {name_and_columns}"


SQL: dict[str, tuple[str, str]] = {
    "b": ("", f"""
        select concat('P', cast(l_suppkey % 5 as varchar)) as planta, concat('C', cast(l_orderkey % 7 as varchar)) as cliente,
               concat(case when l_partkey % 20 < 12 then 'KLT-' when l_partkey % 20 < 18 then 'RCK-' else 'CTN-' end, cast(l_partkey % 20 as varchar)) as material,
               case when l_partkey % 20 < 12 then 'KLT' when l_partkey % 20 < 18 then 'RACK' else 'CARTON' end as tipo_material,
               cast(l_shipdate as date) as f, cast(l_quantity as int) as q,
               case when l_orderkey % 7 = 0 then cast(floor(l_quantity / 10) as int) when (l_orderkey + l_linenumber) % 40 = 0 and l_quantity > 1 then 1 else 0 end as loss,
               cast(10 + (l_partkey * 7 + l_orderkey * 3) % 40 as int) as lag, lpad(cast(l_orderkey as varchar), 10, '0') as doc,
               cast(l_linenumber * 100 + row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_quantity,
                    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as int) as pos
        from lineitem where cast(l_shipdate as date) <= {CUTOFF}"""),
    "cust": ("b", f"""
        select planta, cliente, material, tipo_material, mov_type, almacen, fecha_contab, cantidad, doc_material, posicion, cast(year(fecha_contab) as bigint) as anio_contable from (
          select planta, cliente, material, tipo_material, case when tipo_material = 'CARTON' then '601' else '621' end as mov_type, 'LLEN' as almacen, f as fecha_contab, -q as cantidad,
                 concat('A', doc) as doc_material, pos as posicion from b
          union all select planta, cliente, material, tipo_material, '622', 'SUCI', f + lag, q - loss, concat('B', doc), pos from b where tipo_material <> 'CARTON' and q > loss
          union all select planta, cliente, material, tipo_material, '702', null, last_day(cast(date_trunc('quarter', f + 120) as date) + interval 2 month), -loss, concat('C', doc), pos
          from b where tipo_material <> 'CARTON' and loss > 0)
        where fecha_contab <= {CUTOFF}"""),
    "led": ("cust", f"""
        select * from cust union all
        select planta, cast(null as varchar), material, tipo_material, '311', a, d, cast(abs(cantidad) * s as int), concat(serie, posicion, doc_material), posicion * 2 + k, cast(year(d) as bigint)
        from (select c.*, t.*, fecha_contab + dias as d from cust c join (values ('622', 3, 'SUCI', -1, 0, 'D'), ('622', 3, 'VACI', 1, 1, 'D'), ('621', -2, 'VACI', -1, 0, 'E'), ('621', -2, 'LLEN', 1, 1, 'E'))
              as t(mt, dias, a, s, k, serie) on t.mt = c.mov_type)
        where d <= {CUTOFF}"""),
    "prices": ("", values("t(tipo_material, costo_unitario_usd)", L.PRECIOS)),
    "params": ("", values("t(" + ", ".join(c.split()[0] for c in L.PARAMETROS_SCHEMA.split(", ")) + ")", L.PARAMETROS)),
    "plants": ("", values("t(planta, pais)", L.PLANTAS)),
    "acc": ("cust", """
        select planta, cliente, material, tipo_material, mov_type, fecha_contab, anio_contable, doc_material, posicion, abs(cantidad)::bigint as n,
               (case when mov_type = '621' then 1 else -1 end * abs(cantidad))::bigint as delta
        from cust where mov_type in ('621', '622', '702')"""),
    "ends": ("acc", """
        select *, mov_type = '621' as es_salida, sum(n) over (partition by planta, cliente, material, mov_type = '621'
               order by fecha_contab, anio_contable, doc_material, posicion rows unbounded preceding)::bigint as hasta from acc"""),
    "tr": ("ends", """
        with o as (select * from ends where es_salida), c as (select * from ends where not es_salida),
             top as (select planta, cliente, material, max(hasta) as todo from c group by all)
        select o.planta, o.cliente, o.material, o.tipo_material, o.fecha_contab as fecha_salida, o.anio_contable as anio_salida, o.doc_material as doc_salida, o.posicion as pos_salida,
               c.mov_type as tipo_cierre, c.fecha_contab as fecha_cierre, c.anio_contable as anio_cierre, c.doc_material as doc_cierre,
               least(o.hasta, c.hasta) - greatest(o.hasta - o.n, c.hasta - c.n) as cantidad, c.fecha_contab - o.fecha_contab as dias
        from o join c on o.planta = c.planta and o.cliente = c.cliente and o.material = c.material and o.hasta - o.n < c.hasta and c.hasta - c.n < o.hasta
        union all
        select o.planta, o.cliente, o.material, o.tipo_material, o.fecha_contab, o.anio_contable, o.doc_material, o.posicion, null, null, null, null,
               least(o.n, o.hasta - coalesce(todo, 0)), null
        from o left join top using (planta, cliente, material) where o.hasta > coalesce(todo, 0)"""),
    "ret": ("tr", "select * from tr where tipo_cierre = '622'"),
    "surv": ("ret", """
        with k as (select tipo_material, max(dias) as m, sum(cantidad) as total from ret group by 1),
             a as (select tipo_material, total, unnest(range(0, m + 1)) as edad from k),
             d as (select tipo_material, dias, sum(cantidad) as n from ret group by 1, 2)
        select a.tipo_material, cast(edad as int) as edad,
               1 - cast(sum(coalesce(n, 0)) over (partition by a.tipo_material order by edad rows unbounded preceding) as double) / cast(total as double) as prob_en_cliente
        from a left join d on d.tipo_material = a.tipo_material and d.dias = a.edad"""),
    "months": ("acc", f"""
        select cast(m as date) as mes, last_day(m) - greatest(0, isodow(last_day(m)) - 5)::int as fin_mes
        from (select unnest(generate_series(date_trunc('month', min(fecha_contab)), date_trunc('month', {CUTOFF}), interval 1 month)) as m from acc)"""),
    "monthly": ("acc months surv", """
        with op as (select planta, cliente, material, tipo_material, min(fecha_contab) as desde from acc group by all),
             f as (select planta, cliente, material, cast(date_trunc('month', fecha_contab) as date) as mes, sum(case when mov_type = '621' then n end) as salidas,
                          sum(case when mov_type = '622' then n end) as recogidas, sum(case when mov_type = '702' then n end) as faltantes, sum(delta) as delta from acc group by all),
             e as (select a.planta, a.cliente, a.material, m.mes, sum(a.n * s.prob_en_cliente) as esperado
                   from (select planta, cliente, material, tipo_material, fecha_contab, sum(n) as n from acc where mov_type = '621' group by all) a
                   join surv s on s.tipo_material = a.tipo_material join months m on m.fin_mes = a.fecha_contab + s.edad group by all)
        select op.planta, op.cliente, op.material, op.tipo_material, months.mes, fin_mes, coalesce(salidas, 0)::bigint as salidas, coalesce(recogidas, 0)::bigint as recogidas,
               coalesce(faltantes, 0)::bigint as faltantes,
               (sum(coalesce(delta, 0)) over (partition by op.planta, op.cliente, op.material order by months.mes rows unbounded preceding))::bigint as saldo_fin_mes,
               coalesce(esperado, 0) as saldo_esperado
        from op join months on fin_mes >= desde left join f on f.planta = op.planta and f.cliente = op.cliente and f.material = op.material and f.mes = months.mes
        left join e on e.planta = op.planta and e.cliente = op.cliente and e.material = op.material and e.mes = months.mes"""),
    "loss": ("cust prices", f"""
        select planta, cliente, material, tipo_material, mov_type, fecha_contab, abs(cantidad)::bigint as n, costo_unitario_usd,
               mov_type = '702' or fecha_contab <= (select max(fecha_contab) from cust where mov_type = '702') - {L.VARS.antiguedad_conciliacion_dias} as en_tasa
        from cust join prices using (tipo_material) where mov_type in ('621', '702')"""),
    "routes": ("loss ret", f"""
        with f as (select planta, cliente, sum(case when mov_type = '621' then n end)::bigint as contenedores_salida, sum(case when mov_type = '621' and en_tasa then n end)::bigint as salidas_conciliadas,
                          coalesce(sum(case when mov_type = '702' and en_tasa then n end), 0)::bigint as faltantes,
                          coalesce(round(sum(case when mov_type = '702' then n * costo_unitario_usd end), 2), 0) as perdida_acum_usd from loss group by 1, 2),
             c as (select planta, cliente, round(sum(cantidad * dias)::double / sum(cantidad)::double, 1) as ciclo_promedio_dias from ret group by 1, 2),
             r as (select *, round(faltantes * 100.0::double / nullif(salidas_conciliadas, 0)::double, 3) as tasa_merma_pct from f left join c using (planta, cliente))
        select planta, cliente, contenedores_salida, salidas_conciliadas, faltantes, tasa_merma_pct, ciclo_promedio_dias, perdida_acum_usd,
               coalesce(tasa_merma_pct > {L.VARS.umbral_merma_pct}, false) as rota_por_merma, coalesce(ciclo_promedio_dias > {L.VARS.umbral_ciclo_dias}, false) as rota_por_ciclo,
               coalesce(tasa_merma_pct > {L.VARS.umbral_merma_pct}, false) or coalesce(ciclo_promedio_dias > {L.VARS.umbral_ciclo_dias}, false) as ruta_rota
        from r"""),
    "rot": ("tr surv", f"""
        with t as (select *, cast(date_trunc('month', fecha_salida) as date) as mes from tr),
             d as (select planta, mes, dias, sum(cantidad) as n from t where tipo_cierre = '622' group by 1, 2, 3),
             a as (select *, cast(sum(n) over (partition by planta, mes order by dias rows unbounded preceding) as double) / cast(sum(n) over (partition by planta, mes) as double) as s from d),
             c as (select planta, mes, sum(n)::bigint as rec, round(sum(n * dias)::double / sum(n)::double, 1) as media, min(case when s >= 0.5 then dias end) as p50, min(case when s >= 0.9 then dias end) as p90
                   from a group by 1, 2)
        select planta, mes, o.n as contenedores_salida, coalesce(rec, 0) as contenedores_recogidos, media as ciclo_promedio_dias, p50 as ciclo_p50_dias, p90 as ciclo_p90_dias,
               last_day(mes) + (select max(edad) from surv) <= {CUTOFF} as cohorte_completa
        from (select planta, mes, sum(cantidad)::bigint as n from t group by 1, 2) o left join c using (planta, mes)"""),
    "tcomat": ("loss params", """
        with f as (select planta, tipo_material, sum(case when mov_type = '621' then n end)::bigint as viajes, sum(case when mov_type = '621' and en_tasa then n end)::bigint as salidas_conciliadas,
                          coalesce(sum(case when mov_type = '702' and en_tasa then n end), 0)::bigint as faltantes, coalesce(sum(case when mov_type = '702' then n * costo_unitario_usd end), 0) as perdida_reconocida_usd,
                          sum(case when mov_type = '621' then n * costo_unitario_usd end) / sum(case when mov_type = '621' then n end)::double as costo_unitario_usd from loss group by 1, 2)
        select planta, tipo_material, viajes, salidas_conciliadas, faltantes, round(p * 100, 3) as tasa_merma_pct, perdida_reconocida_usd, costo_unitario_usd, vida_util_ciclos, mant_por_ciclo_usd, desechable_equiv_usd,
               case when coalesce(p, 0) = 0 then vida_util_ciclos::double else (1 - power(1 - p, vida_util_ciclos)) / p end as vida_esperada_ciclos
        from (select *, faltantes::double / nullif(salidas_conciliadas, 0)::double as p from f) join params using (tipo_material)"""),
    "places": ("", values("t(almacen, estado)", L.ALMACENES)),
    "classes": ("", values("t(mov_type, evento)", L.CLASES_MOVIMIENTO)),
    "minopen": ("led", """
        with d as (select planta, material, tipo_material, fecha_contab as f, sum(cantidad)::bigint as neto, sum(greatest(-cantidad, 0))::bigint as sal from led where almacen = 'VACI' group by all),
             w as (select *, sum(neto) over (partition by planta, material order by f rows unbounded preceding) - neto - sal as bajo from d)
        select planta, material, tipo_material, greatest(0, -min(bajo))::bigint as minimo from w group by all"""),
    "snap": ("minopen led", """
        select planta, 'VACI' as almacen, material, tipo_material, minimo + 10 as cantidad, (select min(fecha_contab) - 1 from led) as fecha from minopen where tipo_material <> 'CARTON'"""),
    "smov": ("led places classes snap", """
        select planta, material, tipo_material, estado, case when evento in ('traslado_bloqueado', 'baja') or (evento = 'bloqueo' and cantidad > 0) or (evento = 'desbloqueo' and cantidad < 0) then 'bloqueado' else 'libre' end as tipo_stock,
               evento, fecha_contab as fecha, cantidad::bigint as delta from led join places using (almacen) join classes using (mov_type) where estado <> 'fuera_ciclo'
        union all
        select planta, material, tipo_material, 'cliente', 'libre', evento, fecha_contab, (case when evento = 'salida_cliente' then 1 else -1 end * abs(cantidad))::bigint
        from led join classes using (mov_type) where evento in ('salida_cliente', 'recogida_cliente', 'faltante_cliente')
        union all select planta, material, tipo_material, 'vacios', 'libre', 'apertura', fecha, cantidad from snap"""),
    "dstock": ("smov", """
        select planta, material, tipo_material, estado, tipo_stock, fecha, delta, (sum(delta) over (partition by planta, material, estado, tipo_stock order by fecha rows unbounded preceding))::bigint as saldo
        from (select planta, material, tipo_material, estado, tipo_stock, fecha, sum(delta)::bigint as delta from smov group by all) where delta <> 0"""),
    "fleet": ("dstock", f"""
        with w as (select cast(x as date) as semana from (select unnest(generate_series(date_trunc('week', min(fecha)), date_trunc('week', {CUTOFF}), interval 7 day)) as x from dstock)),
             k as (select distinct planta, material, tipo_material from dstock),
             x as (select k.*, semana, s.* from k cross join w cross join (values {', '.join(f"('{s}')" for s in ("recepcion", "vacios", "linea", "llenos", "sucios", "reparacion", "scrap", "cliente", "bloqueado"))}) as s(que)),
             d as (select planta, material, cast(date_trunc('week', fecha) as date) as semana, unnest(case when tipo_stock = 'bloqueado' then [estado, 'bloqueado'] else [estado] end) as que, delta from dstock),
             a as (select x.planta, x.material, x.tipo_material, x.semana, x.que, sum(coalesce(n, 0)) over (partition by x.planta, x.material, x.que order by x.semana rows unbounded preceding)::bigint as n
                   from x left join (select planta, material, semana, que, sum(delta) as n from d group by all) d on d.planta = x.planta and d.material = x.material and d.semana = x.semana and d.que = x.que),
             p as (select planta, material, tipo_material, semana, {', '.join(f"max(case when que = '{s}' then n end) as {s}" for s in ("recepcion", "vacios", "linea", "llenos", "sucios", "reparacion", "scrap", "cliente", "bloqueado"))} from a group by all)
        select *, least(semana + 6, {CUTOFF}) as fecha_cierre, recepcion + vacios + linea + llenos + sucios + reparacion + scrap as en_planta,
               recepcion + vacios + linea + llenos + sucios + reparacion + scrap + cliente as flota from p"""),
    "flows": ("led places classes", """
        with m as (select led.*, estado, evento, cast(date_trunc('week', fecha_contab) as date) as semana from led join classes using (mov_type) left join places using (almacen) where tipo_material in ('KLT', 'RACK')),
             t as (select a.planta, a.tipo_material, a.semana, a.estado as origen, z.estado as destino, -a.cantidad as n from m a join m z on a.planta = z.planta and a.anio_contable = z.anio_contable
                   and a.doc_material = z.doc_material and a.material = z.material and z.cantidad > 0 where a.cantidad < 0 and a.evento like 'traslado%' and a.estado <> z.estado
                   union all
                   select planta, tipo_material, semana, case evento when 'salida_cliente' then 'llenos' else 'cliente' end,
                          case evento when 'salida_cliente' then 'cliente' when 'recogida_cliente' then 'sucios' else 'faltante' end, abs(cantidad)
                   from m where evento in ('salida_cliente', 'recogida_cliente', 'faltante_cliente'))
        select planta, tipo_material, semana, origen, destino, sum(n)::bigint as contenedores from t group by all"""),
    "net": ("cust classes", """
        select planta, cliente, tipo_material, cast(date_trunc('week', fecha_contab) as date) as semana, sum(case when mov_type = '621' then abs(cantidad) else 0 end)::bigint as salidas,
               sum(case when mov_type = '622' then abs(cantidad) else 0 end)::bigint as recogidas, sum(case when mov_type = '702' then abs(cantidad) else 0 end)::bigint as faltante
        from cust where mov_type in ('621', '622', '702') group by all"""),
    "rules": ("", values("t(regla, defecto, objeto, unidad, severidad, cifra_afectada)", REGLAS)),
    "figures": ("", values("t(cifra)", [(c,) for c in CIFRAS])),
    "scen": ("", values("t(escenario, solo, factor, capital, z_fija, ajuste)", L.ESCENARIOS_BRECHA)),
    "cal": ("dstock smov", f"""
        with b as (select (select min(fecha) from dstock) as apertura, {CUTOFF} as corte, exists (select 1 from smov where estado = 'cliente' and evento = 'apertura') as hay),
             c as (select apertura, corte, corte - (isodow(corte) % 7)::int as fin_base, cast(date_trunc('week', apertura + 7) as date) + case when hay then 0 else 91 end as inicio_estable from b)
        select apertura, corte, inicio_estable, fin_base, fin_base - 90 as inicio_base, greatest(fin_base - 363, inicio_estable) as inicio_sigma, fin_base - 90 as inicio_prueba, fin_base - 91 as fin_estimacion,
               greatest(fin_base - 454, inicio_estable) as inicio_estimacion, fin_base - 181 as inicio_calibracion, fin_base - 182 as fin_est_calibracion, greatest(fin_base - 545, inicio_estable) as inicio_est_calibracion from c"""),
    "use": ("dstock smov cal", """
        with k as (select distinct planta, material, tipo_material from dstock), d as (select unnest(generate_series(apertura, corte, interval 1 day))::date as fecha from cal),
             u as (select planta, material, fecha, sum(delta) as n from dstock where estado <> 'vacios' group by all), o as (select planta, material, fecha, sum(delta) as n from smov where estado = 'cliente' and evento = 'salida_cliente' group by all)
        select k.planta, k.material, k.tipo_material, d.fecha, (sum(coalesce(u.n, 0)) over (partition by k.planta, k.material order by d.fecha rows unbounded preceding))::bigint as en_uso, coalesce(o.n, 0)::bigint as salidas
        from k cross join d left join u on u.planta = k.planta and u.material = k.material and u.fecha = d.fecha left join o on o.planta = k.planta and o.material = k.material and o.fecha = d.fecha"""),
    "vari": ("use cal", """
        with w as (select 'necesidad' as ventana, inicio_sigma as a, fin_base as z from cal union all select 'backtest', inicio_estimacion, fin_estimacion from cal union all select 'calibracion', inicio_est_calibracion, fin_est_calibracion from cal),
             p as (select ventana, planta, material, tipo_material, avg(case when fecha >= a and fecha <= z then en_uso end) as uso_promedio, stddev_pop(case when fecha >= a and fecha <= z then en_uso end) as sigma_uso,
                          sum(case when fecha >= a and fecha <= z then salidas end)::double / (z - a + 1) as d_ventana, sum(case when fecha > z - 91 and fecha <= z then salidas end)::double / 91 as d_base
                   from use cross join w group by ventana, planta, material, tipo_material, a, z)
        select *, sum(uso_promedio) over (partition by ventana, planta, tipo_material) / nullif(sum(d_ventana) over (partition by ventana, planta, tipo_material), 0) as ciclo_dias from p"""),
    "curve": ("vari use cal params", """
        select v.tipo_material, g.k / 100.0::double as z, avg(case when u.en_uso > v.d_base * v.ciclo_dias + greatest(dias_cobertura * v.d_base, coalesce(g.k / 100.0::double * v.sigma_uso * sqrt(v.d_base / nullif(v.d_base, 0)), 0)) then 1.0 else 0.0 end) as quiebre
        from vari v join params using (tipo_material) join use u on u.planta = v.planta and u.material = v.material cross join cal cross join (select unnest(range(100, 405, 5))::double as k) g
        where v.ventana = 'calibracion' and u.fecha >= inicio_calibracion and u.fecha < inicio_prueba group by 1, 2"""),
    "level": ("vari tcomat scen params curve", """
        with c as (select tipo_material, sum(costo_unitario_usd * viajes) / sum(viajes)::double as costo, max(desechable_equiv_usd) as des from tcomat group by 1),
             y as (select tipo_material, sum(uso_promedio) / sum(d_ventana) as ciclo from vari where ventana = 'calibracion' group by 1),
             e as (select escenario, tipo_material, solo is null or solo = tipo_material as suyo, coalesce(case when solo is null or solo = tipo_material then factor end, factor_costo_quiebre) as f,
                          coalesce(case when solo is null or solo = tipo_material then capital end, costo_capital_anual_pct) as k, case when solo is null or solo = tipo_material then z_fija end as zf,
                          coalesce(case when solo is null or solo = tipo_material then ajuste end, 0) as aj from scen cross join params),
             o as (select *, des * f / ciclo as corto, costo * k / 100 / 365 as exceso from e join c using (tipo_material) join y using (tipo_material)),
             q as (select *, corto / (corto + exceso) as razon from o),
             z as (select q.escenario, q.tipo_material, min(z) as ze from q join curve on curve.tipo_material = q.tipo_material and quiebre <= 1 - razon group by 1, 2)
        select q.escenario, q.tipo_material, f as factor_costo_quiebre, k as costo_capital_anual_pct, zf as z_fija, aj as ajuste_ciclo_dias, round(ciclo, 2) as ciclo_dias, corto as costo_corto_dia, exceso as costo_exceso_dia,
               round(razon, 4) as razon_critica, round(1 - razon, 4) as objetivo_quiebre, coalesce(zf, ze) as z_servicio, curve.quiebre as quiebre_calibracion
        from q left join z using (escenario, tipo_material) left join curve on curve.tipo_material = q.tipo_material and round(curve.z * 100) = round(coalesce(zf, ze) * 100)"""),
    "parts": ("cust", f"""
        select *, concat(cliente, '-', material) as parte, {L.PIEZAS} + num as ppc from (select planta, cliente, material, tipo_material, sum(abs(cantidad))::bigint as n, cast(split_part(material, '-', 2) as bigint) as num
        from cust where mov_type = '621' and fecha_contab > {CUTOFF} - 91 group by 1, 2, 3, 4)"""),
    "plan": ("parts", f"""
        select planta, parte, material, tipo_material, ppc, cast(date_trunc('week', {CUTOFF}) as date) + 7 * k::int as semana, (n * ppc * case when num % 5 = 0 and k >= 6 then 13 else 10 end) // 130 as piezas
        from parts cross join (select unnest(range(1, 13)) as k)"""),
    "dem": ("plan vari params", """
        with h as (select * from vari where ventana = 'necesidad'), c as (select distinct planta, tipo_material, ciclo_dias from h),
             p as (select planta, material, tipo_material, semana, sum(piezas::double / ppc) / 7 as d_plan from plan group by 1, 2, 3, 4)
        select p.*, h.d_base, coalesce(h.ciclo_dias, c.ciclo_dias) as ciclo_dias, h.sigma_uso, dias_cobertura, coalesce(h.d_base, 0) > 0 and h.sigma_uso is not null as con_historia
        from p left join h on h.planta = p.planta and h.material = p.material left join c on c.planta = p.planta and c.tipo_material = p.tipo_material join params on params.tipo_material = p.tipo_material"""),
    "need": ("dem level", """
        select *, ceil(uso_plan + stock_seguridad)::bigint as necesidad from (
          select escenario, dem.*, z_servicio, ajuste_ciclo_dias, d_plan * (dem.ciclo_dias + ajuste_ciclo_dias) as uso_plan,
                 greatest(dias_cobertura * d_plan, coalesce(z_servicio * sigma_uso * sqrt(d_plan / nullif(d_base, 0)), 0)) as stock_seguridad from dem join level using (tipo_material))"""),
    "proj": ("cust cal tcomat routes smov fleet dem", f"""
        with t as (select planta, tipo_material, tasa_merma_pct / 100 as tasa from tcomat),
             o as (select planta, material, tipo_material, cliente, sum(abs(cantidad)) as n from cust where mov_type = '621' and fecha_contab > (select max(fecha_contab) from cust where mov_type = '702') - 120 group by all),
             p as (select o.planta, o.material, sum(n * coalesce(r.tasa_merma_pct / 100, tasa)) as pend from o left join routes r using (planta, cliente) left join t on t.planta = o.planta and t.tipo_material = o.tipo_material group by 1, 2),
             w as (select distinct semana from dem),
             a as (select f.planta, f.material, f.tipo_material, w.semana, coalesce(d_plan, 0) as d_plan, ciclo_dias, flota, coalesce(pend, 0) as pend,
                          sum(coalesce(d_plan, 0) * 7 * tasa) over (partition by f.planta, f.material order by w.semana rows unbounded preceding) as perd
                   from (select planta, material, tipo_material, flota from fleet where fecha_cierre = {CUTOFF}) f cross join w left join dem on dem.planta = f.planta and dem.material = f.material and dem.semana = w.semana
                   left join p on p.planta = f.planta and p.material = f.material join t on t.planta = f.planta and t.tipo_material = f.tipo_material)
        select planta, material, tipo_material, semana, d_plan, ciclo_dias, flota as flota_corte, round(round(pend, 9), 2) as merma_pendiente, round(round(perd, 9), 2) as perdida_acumulada, round(round(flota - pend - perd, 9), 2) as flota_proyectada from a"""),
    "bal": ("level proj need plants", """
        select e.escenario, f.planta, pais, f.material, f.tipo_material, greatest(max(coalesce(necesidad, 0) - flota_proyectada), 0) as deficit_pico, greatest(min(flota_proyectada - coalesce(necesidad, 0)), 0) as sobrante, max(f.ciclo_dias) as ciclo_dias
        from proj f cross join (select distinct escenario from level) e join plants using (planta) left join need n on n.escenario = e.escenario and n.planta = f.planta and n.material = f.material and n.semana = f.semana group by 1, 2, 3, 4, 5"""),
    "lend": ("bal", """
        with a as (select *, sum(deficit_pico) over p as d, sum(sobrante) over p as s from bal window p as (partition by escenario, material, pais)),
             b as (select *, case when d > 0 then deficit_pico * least(1, s / d) else 0 end as r1, case when s > 0 then sobrante * least(1, d / s) else 0 end as l1 from a),
             c as (select *, deficit_pico - r1 as d2, sobrante - l1 as s2 from b), e as (select *, sum(d2) over m as dd, sum(s2) over m as ss from c window m as (partition by escenario, material))
        select escenario, planta, pais, material, tipo_material, ciclo_dias, deficit_pico, sobrante, r1 as recibido_mismo_pais, case when dd > 0 then d2 * least(1, ss / dd) else 0 end as recibido_otro_pais,
               l1 as prestado_mismo_pais, case when ss > 0 then s2 * least(1, dd / ss) else 0 end as prestado_otro_pais from e"""),
    "gap": ("lend prices proj need params", """
        with w as (select n.escenario, f.planta, f.material, necesidad - flota_proyectada as corto, row_number() over (partition by n.escenario, f.planta, f.material order by f.semana) as k
                   from proj f join need n on n.planta = f.planta and n.material = f.material and n.semana = f.semana),
             v as (select l.escenario, l.planta, l.material, sum(greatest(corto - recibido_mismo_pais - recibido_otro_pais, 0) * 7 / ciclo_dias) as v from lend l join params using (tipo_material)
                   join w on w.escenario = l.escenario and w.planta = l.planta and w.material = l.material and k <= lead_time_semanas group by 1, 2, 3),
             c as (select l.*, costo_unitario_usd as usd, params.* exclude (tipo_material), ceil(greatest(deficit_pico - recibido_mismo_pais - recibido_otro_pais - 1e-6, 0))::bigint as compra, coalesce(v, 0) as v,
                          sobrante - prestado_mismo_pais - prestado_otro_pais as fin from lend l join prices using (tipo_material) join params using (tipo_material) left join v using (escenario, planta, material))
        select escenario, planta, pais, material, tipo_material, round(deficit_pico, 1) as deficit_pico, round(sobrante, 1) as sobrante, round(recibido_mismo_pais, 1) as recibido_mismo_pais, round(recibido_otro_pais, 1) as recibido_otro_pais,
               round(prestado_mismo_pais, 1) as prestado_mismo_pais, round(prestado_otro_pais, 1) as prestado_otro_pais, compra, round(v, 1) as viajes_desechable, round(fin, 1) as sobrante_final,
               round(usd * (recibido_mismo_pais * flete_mismo_pais_pct + recibido_otro_pais * flete_otro_pais_pct) / 100, 2) as usd_flete, round(compra * usd, 2) as usd_compra, round(v * desechable_equiv_usd, 2) as usd_desechable, round(fin * usd, 2) as usd_capital_ocioso from c"""),
    "days": ("cal", """
        select fecha, isodow(fecha) <= 5 as habil, fecha between inicio_estable and fin_base as estable, isodow(fecha) = 1 and fecha between inicio_estable and fin_base - 28 as inicio_paro
        from cal, (select unnest(generate_series((select apertura from cal), (select corte from cal), interval 1 day))::date as fecha)"""),
    "lots": ("led places classes", """
        with m as (select led.*, estado from led join places using (almacen) join classes using (mov_type) where evento like 'traslado%')
        select a.planta, a.tipo_material, a.material, case a.estado when 'sucios' then 'lavado' else 'reparacion' end as estacion, coalesce(z.estado = 'vacios', false) as a_vacios, a.fecha_contab as fecha, -sum(a.cantidad)::bigint as cantidad
        from m a left join m z on z.cantidad > 0 and z.planta = a.planta and z.anio_contable = a.anio_contable and z.doc_material = a.doc_material and z.material = a.material
        where a.cantidad < 0 and a.estado in ('sucios', 'reparacion') group by all"""),
    "queue": ("lots days", """
        with r as (select planta, tipo_material, estacion, fecha, sum(cantidad)::double as listo from lots group by all), k as (select distinct planta, tipo_material, estacion from r),
             d as (select k.*, days.fecha, habil, estable, coalesce(listo, 0) as listo from k cross join days left join r on r.planta = k.planta and r.tipo_material = k.tipo_material and r.estacion = k.estacion and r.fecha = days.fecha),
             m as (select *, case when habil then round(sum(case when estable then listo end) over p / count(case when estable and habil then 1 end) over p / 0.9, 4) else 0 end as capacidad from d window p as (partition by planta, tipo_material, estacion)),
             c as (select *, sum(listo) over w as rr, sum(capacidad) over w as cc from m window w as (partition by planta, tipo_material, estacion order by fecha rows unbounded preceding)),
             l as (select *, round(cc + least(0, min(rr - cc) over w), 6) as liberado_acum from c window w as (partition by planta, tipo_material, estacion order by fecha rows unbounded preceding))
        select planta, tipo_material, estacion, fecha, listo, capacidad, liberado_acum - coalesce(lag(liberado_acum) over (partition by planta, tipo_material, estacion order by fecha), 0) as liberado, liberado_acum, rr - liberado_acum as cola from l"""),
    "emp": ("dstock", "select planta, tipo_material, material, fecha, sum(delta)::bigint as delta from dstock where estado = 'vacios' group by all"),
    "dirty": ("led prices classes", f"""
        with a as (select *, (posicion * 31 + cast(right(doc_material, 6) as bigint)) % 997 as h from led),
             b as (select planta, cliente, material, almacen, fecha_contab, anio_contable, mov_type, cantidad, h, case when mov_type = '311' then concat(doc_material, '-', posicion // 2) else doc_material end as doc_material,
                          case when mov_type = '311' then 1 + posicion % 2 else posicion end as posicion from a),
             c as (select planta, case h when 3 then null when 7 then '00' || cliente else cliente end as cliente, case h when 8 then '000' || material else material end as material, case when h = 2 and almacen is not null then 'XX99' else almacen end as almacen,
                          case h when 6 then {CUTOFF} + 3 else fecha_contab end as fecha_contab, anio_contable, case h when 1 then '999' else mov_type end as mov_type,
                          case when h = 0 then -cantidad when h = 9 and mov_type = '621' then cantidad * ({L.PIEZAS} + cast(split_part(material, '-', 2) as bigint)) else cantidad end as cantidad, doc_material, posicion, h, case when mov_type = '621' then 'R' || doc_material end as ref_externa,
                          case when h = 5 then last_day(fecha_contab) + 15 else fecha_contab + posicion % 5 end as fecha_registro from b),
             d as (select * exclude (doc_material), case when h = 10 and copia = 1 then 'Z' || doc_material else doc_material end as doc_material from (select *, unnest(case when h in (4, 10) then [0, 1] else [0] end) as copia from c)),
             e as (select *, case substr(material, 1, 4) when 'KLT-' then 'KLT' when 'RCK-' then 'RACK' when 'CTN-' then 'CARTON' end as tipo_material from d)
        select *, case when mov_type in ('621', '622', '702') and (posicion % 2 = 0 or h = 11) then case when h = 11 then costo_unitario_usd * 1.2::double else costo_unitario_usd end end as costo_documento_usd
        from e left join prices using (tipo_material) left join classes using (mov_type)"""),
    "mastr": ("cust prices", "select distinct planta, material, costo_unitario_usd as costo from cust join prices using (tipo_material)"),
    "viol": ("dirty places mastr parts dmast snap", f"""
        with k as (select planta, material, anio_contable, doc_material, posicion, sum(abs(cantidad)) - max(abs(cantidad)) as n, max(costo_unitario_usd) as c, count(*) as f from dirty group by 1, 2, 3, 4, 5 having count(*) > 1),
             lin as (select *, case when evento is null then 'bwart_fuera_de_catalogo' when almacen is not null and almacen not in (select almacen from places) then 'lgort_fuera_de_catalogo'
                              when evento in ('salida_cliente', 'recogida_cliente', 'faltante_cliente', 'salida_desechable') and cliente is null then 'cliente_vacio'
                              when (evento in ('salida_cliente', 'faltante_cliente', 'salida_desechable') and cantidad >= 0) or (evento = 'recogida_cliente' and cantidad <= 0)
                                   or (evento = 'traslado' and not ((posicion = 1 and cantidad < 0) or (posicion = 2 and cantidad > 0))) then 'signo_invertido' end as regla from dirty),
             dia as (select planta, cliente, material, fecha_contab, sum(case when evento = 'salida_cliente' then 1 else -1 end * abs(cantidad)) as delta, sum(case when evento = 'salida_cliente' then abs(cantidad) else 0 end) as ent
                     from dirty where evento in ('salida_cliente', 'recogida_cliente', 'faltante_cliente') and cliente is not null group by 1, 2, 3, 4),
             acu as (select *, sum(delta) over w as saldo, sum(ent) over w as ents, sum(delta) over w - delta as antes from dia window w as (partition by planta, cliente, material order by fecha_contab)),
             mf as (select d.*, m.material as em, m.costo from dirty d join mastr m on m.planta = d.planta and ltrim(m.material, '0') = ltrim(d.material, '0') and m.material <> d.material where d.tipo_material is null),
             cs as (select distinct planta, cliente from dirty where evento = 'salida_cliente' and cliente is not null),
             cc as (select planta, ltrim(cliente, '0') as cod, min(cliente) as cuenta from cs group by 1, 2),
             kf as (select d.*, cuenta from dirty d join cc on cc.planta = d.planta and cc.cod = ltrim(d.cliente, '0') and cuenta <> d.cliente
                    where evento in ('salida_cliente', 'recogida_cliente', 'faltante_cliente') and not exists (select 1 from cs where cs.planta = d.planta and cs.cliente = d.cliente)),
             fm as (select planta, anio_contable, doc_material, posicion from mf union select planta, anio_contable, doc_material, posicion from kf),
             rp as (select *, row_number() over w as rn, first_value(doc_material) over w as primero from (select planta, ref_externa, material, cliente, cantidad, fecha_contab, anio_contable, doc_material, min(fecha_registro) as reg
                    from dirty where evento = 'salida_cliente' and ref_externa is not null group by all) window w as (partition by planta, ref_externa, material, cliente, cantidad, fecha_contab order by reg, anio_contable, doc_material)),
             pz as (select planta, material, min(ppc) as piezas from parts where ppc > 0 group by 1, 2),
             pd as (select planta, material, max(abs(costo_documento_usd - costo_unitario_usd)) as lejos, min(costo_documento_usd) as menor, max(costo_documento_usd) as mayor, max(costo_unitario_usd) as maestro
                    from dirty d where costo_documento_usd > 0 and abs(costo_documento_usd - costo_unitario_usd) > costo_unitario_usd * {L.VARS.calidad_tolerancia_precio_pct} / 100
                    and exists (select 1 from dmast m where m.moneda = 'USD' and m.planta = d.planta and m.material = d.material) group by 1, 2)
        select 'llave_duplicada' as regla, planta, material, anio_contable, doc_material, posicion, n::bigint as unidades, n * c as usd_expuesto, f || ' filas con la misma llave' as detalle from k
        union all select regla, planta, material, anio_contable, doc_material, posicion, abs(cantidad), abs(cantidad) * costo_unitario_usd, mov_type || ' ' || coalesce(almacen, '-') || ' ' || cantidad from lin where regla is not null
        union all select 'recogida_sin_saldo', d.planta, d.material, d.anio_contable, d.doc_material, d.posicion, abs(cantidad), abs(cantidad) * costo_unitario_usd, 'saldo al cierre ' || saldo
                  from dirty d join acu a on a.planta = d.planta and a.cliente = d.cliente and a.material = d.material and a.fecha_contab = d.fecha_contab
                  where evento = 'recogida_cliente' and (ents = 0 or (saldo < 0 and antes >= 0)) and not exists (select 1 from fm where fm.planta = d.planta and fm.anio_contable = d.anio_contable and fm.doc_material = d.doc_material and fm.posicion = d.posicion)
        union all select 'registro_despues_del_cierre', planta, material, anio_contable, doc_material, posicion, abs(cantidad), abs(cantidad) * costo_unitario_usd, 'registrado ' || fecha_registro || ', contabilizado ' || fecha_contab from dirty where fecha_registro > last_day(fecha_contab) + 10
        union all select 'budat_despues_del_corte', planta, material, anio_contable, doc_material, posicion, abs(cantidad), abs(cantidad) * costo_unitario_usd, 'contabilizado ' || fecha_contab || ', extracto al ' || {CUTOFF} from dirty where fecha_contab > {CUTOFF}
        union all select 'documento_repetido', d.planta, d.material, d.anio_contable, d.doc_material, d.posicion, abs(d.cantidad), abs(d.cantidad) * costo_unitario_usd, 'entrega ' || d.ref_externa || ', primero en ' || primero
                  from dirty d join rp on rp.planta = d.planta and rp.ref_externa = d.ref_externa and rp.material = d.material and rp.cliente = d.cliente and rp.cantidad = d.cantidad and rp.fecha_contab = d.fecha_contab
                  and rp.anio_contable = d.anio_contable and rp.doc_material = d.doc_material where rn > 1 and evento = 'salida_cliente'
        union all select 'cantidad_en_piezas', planta, material, anio_contable, doc_material, posicion, abs(cantidad) - abs(cantidad) // piezas, (abs(cantidad) - abs(cantidad) // piezas) * costo_unitario_usd,
                  abs(cantidad) || ' con ' || piezas || ' piezas por contenedor' from dirty join pz using (planta, material) where evento = 'salida_cliente' and abs(cantidad) >= piezas and abs(cantidad) % piezas = 0
        union all select 'precio_documento_distinto', planta, material, null, null, null, coalesce(flota, 0), coalesce(flota, 0) * lejos, 'documento ' || menor || ' a ' || mayor || ', maestro ' || maestro
                  from pd left join (select planta, material, sum(cantidad)::bigint as flota from snap group by 1, 2) using (planta, material)
        union all select 'matnr_con_formato', planta, material, anio_contable, doc_material, posicion, abs(cantidad), abs(cantidad) * costo, 'en el maestro como ' || em from mf
        union all select 'kunnr_con_formato', planta, material, anio_contable, doc_material, posicion, abs(cantidad), abs(cantidad) * costo_unitario_usd, 'cuenta ' || cuenta from kf"""),
    "dmast": ("cust prices", """
        with a as (select distinct planta, material, tipo_material, cast(split_part(material, '-', 2) as int) as n from cust), b as (select *, unnest(case when n = 2 and planta = 'P0' then [0, 1] else [0] end) as copia from a where n <> 11),
             c as (select planta, material, case n when 5 then 'G9' when 9 then 'G2' else case tipo_material when 'KLT' then 'G1' when 'RACK' then 'G2' else 'G3' end end as grupo_articulos, costo_unitario_usd as precio,
                          case n when 3 then 100 else 1 end as unidad_precio, case n when 7 then 'MXN' else 'USD' end as moneda from b join prices using (tipo_material))
        select *, case grupo_articulos when 'G1' then 'KLT' when 'G2' then 'RACK' when 'G3' then 'CARTON' end as tipo_material, precio / unidad_precio as costo,
               case substr(material, 1, 4) when 'KLT-' then 'KLT' when 'RCK-' then 'RACK' else 'CARTON' end as tipo_codigo from c"""),
    "dsnap": ("snap", """
        select * replace (case cast(split_part(material, '-', 2) as int) when 1 then 'ZZ99' else almacen end as almacen) from snap where cast(split_part(material, '-', 2) as int) <> 4"""),
    "dinst": ("parts", """
        select planta, parte, case num when 12 then material || 'X' else material end as material, case num when 10 then 'CARTON' else tipo_material end as tipo_material, case num when 8 then 0 else ppc end as ppc from parts where num <> 6"""),
    "mviol": ("dmast dsnap cust dinst dirty", """
        with f as (select planta, material, sum(cantidad) as flota from dsnap group by 1, 2), b as (select grupo_articulos, moneda, median(costo) as med from dmast group by 1, 2),
             t as (select tipo_material as tipo_codigo, moneda, median(costo) as medc from dmast where tipo_material is not null group by 1, 2),
             a as (select m.*, med, medc, coalesce(flota, 0) as flota, grupo_articulos in ('G1', 'G2', 'G3') as con from dmast m left join b using (grupo_articulos, moneda) left join t using (tipo_codigo, moneda) left join f using (planta, material)),
             r as (select *, unnest([case when not con then 'grupo_fuera_de_catalogo' end, case when moneda <> 'USD' then 'moneda_distinta' end, case when unidad_precio <> 1 and (costo < med / 3 or costo > med * 3) then 'unidad_de_precio' end,
                                     case when con and tipo_codigo is distinct from tipo_material then 'grupo_contradice_codigo' end]) as regla from a),
             u as (select planta, material from cust union select planta, material from dsnap union select planta, material from dinst)
        select regla, planta, material, null as parte, flota::double as unidades, case regla when 'unidad_de_precio' then abs(costo - med) * flota when 'grupo_contradice_codigo' then abs(costo - medc) * flota else costo * flota end as usd_expuesto,
               concat_ws(' ', grupo_articulos, precio::bigint, moneda, 'por', unidad_precio) as detalle from r where regla is not null
        union all select 'llave_maestro_duplicada', planta, material, null, count(*), null, count(*) || ' filas' from dmast group by planta, material having count(*) > 1
        union all select 'material_sin_maestro', u.planta, u.material, null, coalesce(flota, 0), coalesce(flota, 0) * p.costo, 'sin fila en el maestro'
                  from u left join f using (planta, material) left join (select planta, material, round(avg(costo_documento_usd), 4) as costo from dirty where costo_documento_usd > 0 group by 1, 2) p using (planta, material)
                  where not exists (select 1 from dmast m where m.planta = u.planta and m.material = u.material)
                  and not (exists (select 1 from dmast m where m.planta = u.planta and ltrim(m.material, '0') = ltrim(u.material, '0')) and exists (select 1 from dirty d where d.planta = u.planta and d.material = u.material))"""),
    "pviol": ("plan parts dinst cust", """
        with d as (select *, unnest(case when cast(list_last(string_split(parte, '-')) as int) = 14 then [0, 1] else [0] end) as copia from plan), t as (select planta, parte, sum(piezas) as piezas from d group by 1, 2),
             g as (select planta, parte from parts where num <> 13), e as (select distinct planta, material from cust),
             x as (select case when i.parte is null then 'parte_sin_instruccion' else 'parte_sin_registro' end as regla, t.planta, coalesce(i.material, '-') as material, t.parte, t.piezas from t left join dinst i using (planta, parte)
                   left join g on g.planta = t.planta and g.parte = t.parte where i.parte is null or g.parte is null
                   union all
                   select case when ppc <= 0 then 'piezas_en_cero' when tipo_material = 'CARTON' then 'instruccion_a_desechable' when e.material is null then 'instruccion_fuera_de_planta' end, i.planta, i.material, i.parte, coalesce(piezas, 0)
                   from dinst i left join t using (planta, parte) left join e on e.planta = i.planta and e.material = i.material)
        select regla, planta, material, parte, piezas::double as unidades, null::double as usd_expuesto, piezas || ' piezas en el horizonte' as detalle from x where regla is not null
        union all select 'llave_plan_duplicada', planta, null, parte, count(*), null, count(*) || ' filas en stg_plan_produccion' from d group by planta, parte, semana having count(*) > 1"""),
    "fviol": ("dsnap led prices classes", """
        with l as (select led.*, costo_unitario_usd as c, evento from led join prices using (tipo_material) join classes using (mov_type) where almacen is not null),
             m as (select * from l where tipo_material <> 'CARTON' and not exists (select 1 from dsnap where dsnap.planta = l.planta and dsnap.material = l.material)),
             d as (select planta, material, fecha_contab, sum(cantidad) as n, max(c) as c, min(evento) as evento from m group by 1, 2, 3), s as (select *, sum(n) over (partition by planta, material order by fecha_contab rows unbounded preceding) as s from d)
        select 'lgort_fuera_de_catalogo' as regla, planta, material, null as parte, cantidad::double as unidades, cantidad * costo_unitario_usd as usd_expuesto, 'foto en ' || almacen as detalle from dsnap join prices using (tipo_material) where almacen = 'ZZ99'
        union all select 'material_sin_foto', planta, material, null, greatest(-min(s), 0), greatest(-min(s), 0) * max(c), 'primer movimiento: ' || arg_min(evento, fecha_contab) from s group by planta, material"""),
    "cfail": ("dirty dmast plan", """
        with x as (select unnest([case when length(almacen) not between 4 and 12 then {'c': 'almacen', 'k': 'str_length(4, 12)', 'v': almacen} end,
                                  case when length(cliente) not between 1 and 3 then {'c': 'cliente', 'k': 'str_length(1, 3)', 'v': cliente} end]) as x, doc_material || '|' || posicion as llave from dirty)
        select 'raw_mb51' as tabla, x.c as columna, x.k as chequeo, x.v as valor, llave from x where x is not null
        union all select 'raw_maestro_materiales', 'planta,material', 'multiple_fields_uniqueness', count(*)::varchar, planta || '|' || material from dmast group by planta, material having count(*) > 1
        union all select 'raw_plan_produccion', 'planta,parte,semana', 'multiple_fields_uniqueness', '2', planta || '|' || parte || '|' || semana from plan where cast(list_last(string_split(parte, '-')) as int) = 14"""),
    "allviol": ("viol mviol pviol fviol cfail rules", """
        with v as (select regla, planta, material, anio_contable, doc_material, posicion, null::varchar as parte, unidades::double as unidades, usd_expuesto, detalle from viol
                   union all select regla, planta, material, null, null, null, parte, unidades, usd_expuesto, detalle from mviol union all select regla, planta, material, null, null, null, parte, unidades, usd_expuesto, detalle from pviol
                   union all select regla, planta, material, null, null, null, parte, unidades, usd_expuesto, detalle from fviol
                   union all select 'error_de_schema', null, null, null, null, null, null, 1, null, tabla || '.' || columna || ' ' || chequeo || ': ' || valor || ' (' || llave || ')' from cfail)
        select * from v left join rules using (regla)"""),
    "board": ("allviol dirty dmast parts plan cust", """
        with u as (select planta, 'linea' as unidad, count(*) as universo_planta from dirty group by 1
                   union all select planta, 'material', count(*) from (select planta, material from dmast union select planta, material from dirty) group by 1
                   union all select planta, 'parte', count(*) from (select planta, parte from parts where num <> 13 union select planta, parte from plan) group by 1),
             t as (select distinct planta, material, tipo_material from cust)
        select regla, defecto, objeto, unidad, severidad, cifra_afectada, planta, material, tipo_material, count(*) as violaciones, sum(unidades) as unidades, sum(usd_expuesto) as usd_expuesto, universo_planta
        from allviol left join u using (planta, unidad) left join t using (planta, material) group by all"""),
    "exc": ("monthly acc surv", """
        with h as (select (select min(fecha_contab) from acc) + (select max(edad) from surv) as minima),
             r as (select planta, cliente, mes, fin_mes, sum(saldo_fin_mes)::bigint as s, sum(saldo_esperado) as e from monthly group by all),
             v as (select *, sum(s - e) over w as ve, sum(e) over w as vs, count(*) over w as k, min(fin_mes) over w as p from r window w as (partition by planta, cliente order by mes rows between 2 preceding and current row))
        select planta, cliente, mes, round(ve * 100 / nullif(vs, 0), 2) as exceso_pct_ciclo, k = 3 and p >= minima as alerta_valida from v, h"""),
    "sens": ("gap", """
        select escenario, round(sum(b), 2) as usd_brecha, round(sum(c), 2) as usd_capital_ocioso from (
          select escenario, tipo_material, round(sum(usd_flete) + sum(usd_compra) + sum(usd_desechable), 2) as b, round(sum(usd_capital_ocioso), 2) as c from gap group by 1, 2) group by 1"""),
    "impactk": ("led prices dirty", """
        with c as (select (posicion * 31 + cast(right(doc_material, 6) as bigint)) % 997 as h, mov_type, cantidad, costo_unitario_usd as c, planta, anio_contable, doc_material, posicion, 'limpio' as de from led join prices using (tipo_material)
                   union all select h, mov_type, cantidad, costo_unitario_usd, planta, anio_contable, doc_material, posicion, 'sucio' from dirty),
             a as (select de, h, coalesce(sum(case when mov_type = '702' then abs(cantidad) * c end), 0) as perdida, coalesce(sum(case when mov_type = '621' then abs(cantidad) * c end), 0) as salidas_usd,
                          coalesce(sum(case when mov_type = '622' then abs(cantidad) * c end), 0) as recogidas_usd, (count(*) - count(distinct (planta, anio_contable, doc_material, posicion)))::double as llave from c group by 1, 2),
             u as (unpivot a on perdida, salidas_usd, recogidas_usd, llave into name medida value valor), t as (select medida, sum(valor) as total from u where de = 'limpio' group by 1),
             k as (select * from (values (0, 'D05'), (1, 'D02'), (2, 'D03'), (3, 'D04'), (4, 'D01'), (5, 'D08'), (6, 'B04'), (7, 'B02'), (8, 'B01'), (9, 'D06'), (10, 'B03'), (11, 'D16')) as t(h, defecto)),
             j as (select defecto, case when s.medida = 'llave' then 'identidad' else 'cifra' end as tipo, s.medida, round(total, 6) as valor_limpio, round(s.valor - coalesce(l.valor, 0), 6) as delta
                   from u s join k on k.h = s.h join t on t.medida = s.medida left join u l on l.h = s.h and l.medida = s.medida and l.de = 'limpio' where s.de = 'sucio'),
             p as (select *, case when tipo = 'cifra' then round(delta / nullif(valor_limpio, 0) * 100, 4) end as delta_pct from j)
        select *, case when tipo = 'cifra' then coalesce(abs(delta_pct) > 1, false) else delta > 0 end as supera_materialidad from p"""),
    "impact": ("led prices dirty", """
        with c as (select mov_type, cantidad, costo_unitario_usd, planta, anio_contable, doc_material, posicion, 'limpio' as de from led join prices using (tipo_material) union all select mov_type, cantidad, costo_unitario_usd, planta, anio_contable, doc_material, posicion, 'sucio' from dirty),
             a as (select de, coalesce(sum(case when mov_type = '702' then abs(cantidad) * costo_unitario_usd end), 0) as perdida, coalesce(sum(case when mov_type = '621' then abs(cantidad) * costo_unitario_usd end), 0) as salidas_usd,
                          coalesce(sum(case when mov_type = '622' then abs(cantidad) * costo_unitario_usd end), 0) as recogidas_usd, (count(*) - count(distinct (planta, anio_contable, doc_material, posicion)))::double as llave from c group by 1),
             u as (unpivot a on perdida, salidas_usd, recogidas_usd, llave into name medida value valor),
             j as (select case when s.medida = 'llave' then 'identidad' else 'cifra' end as tipo, s.medida, s.valor, l.valor as valor_limpio from u s join u l on l.medida = s.medida and l.de = 'limpio' where s.de = 'sucio')
        select *, valor - valor_limpio as delta, case when tipo = 'cifra' then round((valor / nullif(valor_limpio, 0) - 1) * 100, 4) end as delta_pct,
               case when tipo = 'cifra' then abs(round((valor / nullif(valor_limpio, 0) - 1) * 100, 4)) > 1 else valor > 0 end as supera_materialidad from j"""),
}


def statement(final: str, needs: str) -> str:
    """A whole query: the relations that `needs` names, all that these read, and the final select."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in SQL[name][0].split():
                visit(n)
            order.append(name)

    for n in needs.split():
        visit(n)
    return "with " + ",\n".join(f"{n} as materialized ({SQL[n][1]})" for n in order) + f"\n{final}"
