"""Queries over planted faults, the backtest and stock at a date, with their SQL."""

from __future__ import annotations

import re

from ..operators import reports, stock
from ..sources import faults
from ..sources import ledger as L
from . import invariants, variants
from .models import PHOTO
from .oracles import CUTOFF, SQL

KEY = "planta, anio_contable, doc_material, posicion"


def drawn(name: str, t: str = "") -> str:
    """faults.draw in SQL."""
    key = ", ".join(t + c for c in KEY.split(", "))
    return f"('0x' || substr(md5(concat_ws('|', '{name}', {key})), 1, {faults.BITS // 4}))::bigint"


#: What each kind writes into its field, as text.
VALUES = {
    "D01": "'copia'", "D02": "'999'", "D03": "'XX99'", "D04": "null", "D05": "cast(-cantidad as varchar)",
    "D06": f"cast(cantidad * ({L.PIEZAS} + cast(split_part(material, '-', 2) as bigint)) as varchar)", "D08": "cast(last_day(fecha_contab) + 15 as varchar)",
    "D07": f"list_filter(todos, lambda c: not list_contains(usados, c))[{drawn('cliente')} % libres + 1]",
}


def choice(n: int, kind: faults.Kind) -> str:
    """A kind's targets, after those of the kinds before it."""
    doc = "planta, anio_contable, doc_material"
    free = f" anti join ({' union '.join(f'select {doc} from q{i}' for i in range(n))}) using ({doc})" if n else ""
    field = "null" if kind.campo == "linea" else f"cast({kind.campo} as varchar)"
    lists = " left join qused using (planta, material) left join qall using (planta)" if kind.defecto == "D07" else ""
    return f"""
        select '{kind.defecto}' as defecto, '{kind.regla}' as regla, {KEY}, material, '{kind.campo}' as campo, {field} as valor_original, {VALUES[kind.defecto]} as valor_inyectado from (
          select * from (select *, row_number() over (partition by planta order by {drawn(kind.defecto)}, anio_contable, doc_material, posicion) as rn from qfree{free} where {kind.candidatos})
          join quni using (planta) where rn <= greatest(1, round(u{n} * {kind.tasa}::double))){lists}"""


SQL |= {
    "qled": ("led", f"select * replace (case when cliente is not null then concat(cliente, '-', try_cast(substr(doc_material, 2, 10) as bigint) % {faults.FINER}) end as cliente) from led"),
    "qlines": ("qled prices classes", """
        with b as (select planta, cliente, material, almacen, fecha_contab, anio_contable, mov_type, cantidad, case when mov_type = '311' then concat(doc_material, '-', posicion // 2) else doc_material end as doc_material,
                          case when mov_type = '311' then 1 + posicion % 2 else posicion end as posicion, case when mov_type = '621' then 'R' || doc_material end as ref_externa, tipo_material from qled)
        select *, fecha_contab + posicion % 5 as fecha_registro, case when mov_type in ('621', '622', '702') and posicion % 2 = 0 then costo_unitario_usd end as costo_documento_usd
        from b left join prices using (tipo_material) left join classes using (mov_type)"""),
    "qship": ("qlines", "select distinct planta, material, cliente from qlines where mov_type = '621' and cliente is not null"),
    "qused": ("qship", "select planta, material, list(cliente) as usados from qship group by 1, 2"),
    "qall": ("qship", "select planta, list(distinct cliente order by cliente) as todos from qship group by 1"),
    "qfree": ("qlines qship", """
        with u as (select planta, material, count(*) as n from qship group by 1, 2), a as (select planta, count(distinct cliente) as m from qship group by 1)
        select l.*, coalesce(m - n, 0) as libres from qlines l left join u using (planta, material) left join a using (planta)"""),
    "quni": ("qlines", "select planta, " + ", ".join(f"count(case when {k.universo} then 1 end) as u{n}" for n, k in enumerate(faults.KINDS)) + " from qlines group by 1"),
    **{f"q{n}": ("qfree quni qused qall" + "".join(f" q{i}" for i in range(n)), choice(n, kind)) for n, kind in enumerate(faults.KINDS)},
    "qlog": (" ".join(f"q{n}" for n in range(len(faults.KINDS))), " union all ".join(f"select * from q{n}" for n in range(len(faults.KINDS)))),
    "qdirty": ("qlines qlog classes", f"""
        with m as (select l.* exclude (evento), campo, valor_inyectado as v from qlines l left join qlog using ({KEY})),
             c as (select * replace (case campo when 'mov_type' then v else mov_type end as mov_type, case campo when 'almacen' then v else almacen end as almacen, case campo when 'cliente' then v else cliente end as cliente,
                          case campo when 'cantidad' then try_cast(v as bigint) else cantidad end as cantidad, case campo when 'fecha_registro' then try_cast(v as date) else fecha_registro end as fecha_registro),
                          unnest(case when campo = 'linea' then [0, 1] else [0] end) as copia from m)
        select * exclude (campo, v, copia) from c left join classes using (mov_type)"""),
    "qviol": ("qdirty places mastr parts dmast snap", re.sub(r"\bdirty\b", "qdirty", SQL["viol"][1])),
    "back": ("vari use cal params level", """
        with n as (select v.planta, v.material, v.tipo_material, objetivo_quiebre, d_base * v.ciclo_dias + greatest(dias_cobertura * d_base, coalesce(z_servicio * sigma_uso * sqrt(d_base / nullif(d_base, 0)), 0)) as necesidad
                   from vari v join params using (tipo_material) join level l on l.tipo_material = v.tipo_material and l.escenario = 'base' where ventana = 'backtest'),
             t as (select n.tipo_material, max(objetivo_quiebre) as objetivo_quiebre, count(*) as dias, count(case when en_uso > necesidad then 1 end) as dias_quiebre
                   from n join use u on u.planta = n.planta and u.material = n.material cross join cal where u.fecha between inicio_prueba and fin_base group by 1)
        select *, round(dias_quiebre * 100.0::double / dias, 2) as pct_quiebre, coalesce(dias_quiebre * 100.0::double / dias > objetivo_quiebre * 100.0::double + 1, true) as rebasa from t"""),
}

def instead(name: str, **relations: str) -> str:
    """A relation's SQL over others."""
    text = SQL[name][1]
    for old, new in relations.items():
        text = re.sub(rf"\b{old}\b", new, text)
    return text


def family(prefix: str, root: str, *names: str) -> dict[str, tuple[str, str]]:
    """Relations over another one in the root's place: each with the prefix, reading each other."""
    new = {n: prefix + n for n in (root, *names)}
    return {prefix + n: (" ".join(new.get(x, x) for x in SQL[n][0].split()), instead(n, **new)) for n in names}


#: The ledger with every class of movement.
LINES = ", ".join(f"({'null' if w is None else w}, {d}, '{c}', '{a}', {n}, '{s}', {p})" for w, d, c, a, n, s, p in L.WORKSHOP)
SQL |= {
    "wled": ("led cust", f"""
        select * from led union all
        select planta, null, material, tipo_material, mt, al, dia, ca, concat(se, posicion, doc_material), po, cast(year(dia) as bigint)
        from (select c.*, t.*, fecha_contab + di as dia from (select *, ('0x' || substr(md5(concat_ws('|', doc_material, posicion)), 1, 8))::bigint as h from cust where mov_type = '622') c
              join (values {LINES}) as t(tu, di, mt, al, ca, se, po) on h % 10 = 0 and (tu is null or tu = h // 10 % 2)) where dia <= {CUTOFF}"""),
    **family("w", "led", "smov", "dstock", "fleet", "cal", "use", "vari", "dem", "flows", "proj", "dirty", "lots"),
}
SQL["wproj"] = (
    SQL["wproj"][0],
    SQL["wproj"][1].replace("* 7 * tasa)", "* 7 * (tasa + coalesce(ts, 0)))").replace("w as (select distinct", """sc as (select planta, tipo_material, sum(case when estado = 'scrap' and evento = 'traslado_bloqueado' and delta > 0 then delta end)::double
                        / nullif(sum(case when estado = 'cliente' and evento = 'salida_cliente' then delta end), 0) as ts from wsmov, wcal where fecha between inicio_sigma and fin_base group by 1, 2),
             w as (select distinct""").replace(" join t on t.planta = f.planta and t.tipo_material = f.tipo_material)", " join t on t.planta = f.planta and t.tipo_material = f.tipo_material left join sc on sc.planta = f.planta and sc.tipo_material = f.tipo_material)"),
)

#: A ledger that begins with a photo: accounts open with what customers held, without day or document of its shipment.
DAY = f"date '{PHOTO}'"
SQL |= {
    "facc": ("acc", f"""
        select planta, cliente, material, tipo_material, mov_type, fecha_contab, anio_contable, doc_material, posicion, n, delta, false as en_foto from acc where fecha_contab >= {DAY}
        union all select planta, cliente, material, tipo_material, null, {DAY} - 1, null, null, null, sum(delta)::bigint, sum(delta)::bigint, true from acc where fecha_contab < {DAY} group by 1, 2, 3, 4 having sum(delta) <> 0"""),
    "fends": ("facc", """
        select *, coalesce(mov_type = '621', false) or en_foto as es_salida, sum(n) over (partition by planta, cliente, material, coalesce(mov_type = '621', false) or en_foto
               order by fecha_contab, anio_contable nulls last, doc_material nulls last, posicion nulls last rows unbounded preceding)::bigint as hasta from facc"""),
    "ftr": ("fends", """
        with o as (select * from fends where es_salida), c as (select * from fends where not es_salida), top as (select planta, cliente, material, max(hasta) as todo from c group by all)
        select o.planta, o.cliente, o.material, o.tipo_material, o.fecha_contab as fecha_salida, o.anio_contable as anio_salida, o.doc_material as doc_salida, o.posicion as pos_salida, o.en_foto as salida_en_foto,
               c.mov_type as tipo_cierre, c.fecha_contab as fecha_cierre, c.anio_contable as anio_cierre, c.doc_material as doc_cierre,
               least(o.hasta, c.hasta) - greatest(o.hasta - o.n, c.hasta - c.n) as cantidad, case when not o.en_foto then c.fecha_contab - o.fecha_contab end as dias
        from o join c on o.planta = c.planta and o.cliente = c.cliente and o.material = c.material and o.hasta - o.n < c.hasta and c.hasta - c.n < o.hasta
        union all
        select o.planta, o.cliente, o.material, o.tipo_material, o.fecha_contab, o.anio_contable, o.doc_material, o.posicion, o.en_foto, null, null, null, null, least(o.n, o.hasta - coalesce(todo, 0)), null
        from o left join top using (planta, cliente, material) where o.hasta > coalesce(todo, 0)"""),
    "fret": ("ftr", "select * from ftr where tipo_cierre = '622' and not salida_en_foto"),
    "floss": ("cust prices facc", f"""
        with m as (select * from cust join prices using (tipo_material) where mov_type in ('621', '702') and fecha_contab >= {DAY}),
             s as (select distinct planta, cliente, true as con_foto from facc where en_foto), k as (select distinct planta, fecha_contab as cierre from m where mov_type = '702'),
             a as (select *, lag(cierre) over (partition by planta order by cierre) as anterior from k),
             w as (select planta, min(cierre) as primera, arg_min(anterior, cierre) as anterior from a where planta in (select planta from s) and anterior - {L.VARS.antiguedad_conciliacion_dias} >= {DAY} - 1 group by 1)
        select m.planta, m.cliente, material, tipo_material, mov_type, fecha_contab, abs(cantidad)::bigint as n, costo_unitario_usd,
               coalesce(case when mov_type = '702' then con_foto is null or fecha_contab >= primera
                             else fecha_contab <= (select max(cierre) from k) - {L.VARS.antiguedad_conciliacion_dias} and (con_foto is null or fecha_contab > anterior - {L.VARS.antiguedad_conciliacion_dias}) end, false) as en_tasa
        from m left join s on s.planta = m.planta and s.cliente = m.cliente left join w on w.planta = m.planta"""),
    "froutes": ("floss fret", instead("routes", loss="floss", ret="fret")),
}

#: name: how to build it, what its SQL reads, and the SQL's final select; none for what SQL would need a run of all models a fault for.
TABLE = {
    "defectos_por_cuota": (lambda m: m.quota_log, "qlog", "select * from qlog"),
    "deteccion_por_cuota": (
        lambda m: variants.quality.detection(m.quota_log, m.quota_violations),
        "qlog qviol",
        f"""select defecto, q.regla, count(*) as casos, count(v.regla) as detectados from (select distinct defecto, regla, {KEY} from qlog) q
            left join (select distinct regla, {KEY} from qviol) v using (regla, {KEY}) group by 1, 2""",
    ),
    "backtest_necesidad": (lambda m: m.backtest, "back", "select * from back"),
    "stock_al_embarque": (
        lambda m: m.stock_at_shipment,
        "acc dstock",
        """, v as (select planta, material, fecha, saldo from dstock where estado = 'vacios' and tipo_stock = 'libre')
        select a.planta, a.material, anio_contable, doc_material, posicion, fecha_contab, n as cantidad_abs, saldo as vacios
        from acc a asof left join v on v.planta = a.planta and v.material = a.material and v.fecha <= a.fecha_contab where mov_type = '621'""",
    ),
    "stock_con_todas_las_clases": (lambda m: m.all_classes.daily, "wdstock", "select * from wdstock"),
    "flujos_con_todas_las_clases": (
        lambda m: stock.weekly_flows(m.all_classes.ledger, m.places, m.classes),
        "wflows wled classes",
        """select * from wflows union all
        select planta, tipo_material, cast(date_trunc('week', fecha_contab) as date), 'scrap', 'baja', sum(abs(cantidad))::bigint from wled join classes using (mov_type)
        where evento = 'baja' and tipo_material in ('KLT', 'RACK') group by 1, 2, 3""",
    ),
    "flota_con_todas_las_clases": (lambda m: m.all_classes.projected, "wproj", "select * from wproj"),
    "signos_con_todas_las_clases": (
        lambda m: m.all_classes.signs,
        "wdirty places",
        """, s as (select *, case when evento in ('storno_compra', 'consumo', 'baja', 'salida_desechable', 'salida_cliente', 'faltante_cliente') then cantidad >= 0
                                  when evento in ('entrada_compra', 'recogida_cliente') then cantidad <= 0
                                  when evento in ('traslado', 'traslado_bloqueado', 'bloqueo', 'desbloqueo') then not ((posicion = 1 and cantidad < 0) or (posicion = 2 and cantidad > 0)) end as mal from wdirty)
        select planta, material, anio_contable, doc_material, posicion, abs(cantidad)::bigint as unidades, abs(cantidad) * costo_unitario_usd as usd_expuesto from s
        where mal and (almacen is null or almacen in (select almacen from places)) and not (evento in ('salida_cliente', 'recogida_cliente', 'faltante_cliente', 'salida_desechable') and cliente is null)""",
    ),
    "lotes_con_todas_las_clases": (lambda m: m.all_classes.lots, "wlots", "select * from wlots"),
    "inv_sim_lotes_cuadran": (
        lambda m: invariants.lots_keep_target(m.all_classes),
        "wlots wsmov",
        invariants.differ(
            "planta, material, fecha, destino",
            "select planta, material, fecha, case estacion when 'lavado' then 'reparacion' else 'scrap' end as destino, sum(cantidad) as n from wlots where not a_vacios group by all",
            "select planta, material, fecha, estado as destino, sum(delta) as n from wsmov where delta > 0 and evento = 'traslado_bloqueado' and estado in ('reparacion', 'scrap') group by all",
        ),
    ),
    "tramos_con_foto": (lambda m: m.from_photo.tranches, "ftr", "select * from ftr"),
    "merma_con_foto": (lambda m: m.from_photo.routes, "froutes", "select * from froutes"),
    "inv_ciclo_sin_stock_de_la_foto": (
        lambda m: invariants.cycle_without_photo(m.from_photo),
        "ftr froutes",
        """, t as (select planta, cliente, round(sum(cantidad * dias)::double / sum(cantidad)::double, 1) as ciclo from ftr where tipo_cierre = '622' and dias is not null group by 1, 2)
        select 'ruta' as falla, concat_ws(' ', planta, cliente) as llave, ciclo_promedio_dias as izquierda, ciclo as derecha from froutes join t using (planta, cliente) where ciclo_promedio_dias <> ciclo""",
    ),
    "impacto_por_variante": (lambda m: m.impact_of_all, "", ""),
    "impacto_sin_declarar": (lambda m: variants.undeclared(m.impact_of_all), "", ""),
    "reporte_defectos_por_cifra": (lambda m: reports.faults_by_figure(m.impact_of_all), "", ""),
    "reporte_tasa_por_planta": (
        lambda m: reports.rate_by_plant(m.board),
        "board",
        """, s as (select regla, severidad, planta, sum(violaciones)::bigint as violaciones, max(universo_planta) as universo from board where planta is not null group by 1, 2, 3)
        select *, round(violaciones * 100.0::double / universo, 3) as tasa_pct from s""",
    ),
    "severidad_medida": (lambda m: variants.severity(m.impact_of_all), "", ""),
}
