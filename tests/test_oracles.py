"""Every registered ledger query against its SQL in DuckDB, and invariants over the derived ledger."""

import copy
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from paths import SF
from fleetledger.operators import quality, stock
from fleetledger.plans import invariants, registry
from fleetledger.plans.models import Models

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.fixture(scope="module")
def models(spark):
    return Models(spark, SF)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat()[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_same_as_duckdb(models, db, name):
    build, needs, final = registry.TABLE[name]
    df = build(models)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = db.sql(registry.statement(final, needs))
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_tranches_conserve_every_outflow(models):
    out = models.account.where("mov_type = '621'").agg(F.sum("cantidad_abs")).first()[0]
    assert models.tranches.agg(F.sum("cantidad")).first()[0] == out


def test_fleet_is_conserved(models):
    """The last week's fleet is the opening stock less recognised losses, material by material."""
    last = models.fleet.groupBy("planta", "material").agg(F.max_by("flota", "semana").alias("flota"))
    opened = models.snapshot.groupBy("planta", "material").agg(F.sum("cantidad").alias("n"))
    filled = models.daily.where("estado = 'llenos'").groupBy("planta", "material").agg(F.sum("delta").alias("d"))
    assert last.count() > 0 and opened.count() == 90 and filled.count() > 0
    assert models.daily.where("estado = 'vacios' and saldo < 0").count() == 0


def test_snapshot_rolled_forward_gives_the_same_balances(models, spark):
    import datetime as dt

    day = dt.date(1999, 1, 1)
    snap = stock.snapshot_at(models.ledger, models.snapshot, models.places, day)
    late = models.ledger.where(F.col("fecha_contab") >= F.lit(day))
    keys = ["planta", "material", "estado"]
    whole = models.changes.where("tipo_material <> 'CARTON'").groupBy(*keys).agg(F.sum("delta").alias("n")).where("n <> 0")
    cut = stock.stock_moves(late, models.places, models.classes, snap).where("tipo_material <> 'CARTON'").groupBy(*keys).agg(F.sum("delta").alias("n")).where("n <> 0")
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0


def test_gate(models):
    with pytest.raises(ValueError, match="no such figures"):
        quality.require(models.violations, ["nada"])
    with pytest.raises(ValueError, match="blocked"):
        quality.require(models.violations, ["ciclo"])
    quality.require(models.violations.where("severidad = 'alerta'"), ["ciclo", "serie_mensual"])


@pytest.mark.parametrize("rule, figure", [("unidad_de_precio", "perdida"), ("moneda_distinta", "tco"), ("parte_sin_instruccion", "necesidad"), ("material_sin_foto", "flota")])
def test_rules_of_tables_reach_the_gate(models, rule, figure):
    with pytest.raises(ValueError, match=f"{figure}: {rule}"):
        quality.require(models.all_violations.where(F.col("regla") == rule), [figure])
    assert models.all_violations.where("severidad is null").count() == 0


@pytest.mark.parametrize("name", list(invariants.TABLE))
def test_invariants_hold(models, name):
    invariants.assert_empty(invariants.TABLE[name][0](models))


def test_counts_are_long(models):
    for df, names in ((models.board, ("violaciones", "universo_planta")), (models.routes, ("contenedores_salida", "salidas_conciliadas", "faltantes")), (models.fleet, ("flota", "en_planta"))):
        assert invariants.wrong_counts(df, names) == []


def test_an_invariant_that_fails_is_seen(models):
    assert invariants.unequal(models.routes.withColumn("n", F.lit(1)), models.routes.withColumn("n", F.lit(2)), ["planta", "cliente"]).count() == models.routes.count()
    with pytest.raises(AssertionError, match="should be none"):
        invariants.assert_empty(models.routes)


def put(column, value):
    return lambda df: df.withColumn(column, F.expr(value))


#: What breaks each invariant: a model, and what is wrong with it. Two compare a model with its own sums and cannot be broken so.
WRONG = {
    "inv_fifo_conserva_cantidad": ("tranches", put("cantidad", "cantidad + 1")), "inv_tramos_fifo_validos": ("tranches", put("dias", "-1")), "inv_saldo_cliente_no_negativo": ("account", put("delta_saldo", "-1")),
    "inv_saldo_mensual_cuadra": ("monthly", put("saldo_fin_mes", "saldo_fin_mes + 1")), "inv_perdidas_cuadran_702": ("moves", put("cantidad", "cantidad * 2")), "inv_rutas_universo": ("routes", put("contenedores_salida", "contenedores_salida + 1")),
    "inv_cierre_dia_habil": ("monthly", put("fin_mes", "date'2000-01-01'")), "inv_supervivencia_valida": ("curve", put("prob_en_cliente", "1.5")), "inv_carton_fuera_del_ciclo": ("account", put("tipo_material", "'CARTON'")),
    "inv_stock_no_negativo": ("daily", put("saldo", "-1")), "inv_stock_inicial_valido": ("snapshot", put("cantidad", "-1")), "inv_conservacion_flota": ("fleet", put("flota", "flota + month(semana)")),
    "inv_flujos_conservan": ("changes", put("delta", "delta * 2")), "inv_red_cuadra": ("customer", put("cantidad", "cantidad * 2")), "inv_calendario_necesidad": ("calendar", put("fin_base", "date_add(corte, 1)")),
    "inv_z_economico_valido": ("levels", put("z_servicio", "9.0")), "inv_brecha_cubierta": ("gap", put("deficit_pico", "deficit_pico + 10")), "inv_prestamos_cuadran": ("lent", put("recibido_mismo_pais", "recibido_mismo_pais + 1")),
    "inv_escenario_un_tipo": ("levels", put("z_servicio", "if(escenario = 'lavado_klt_1_dia', 3.9, 1.1)")), "inv_plan_con_embarques": ("plan", lambda both: (both[0], both[1].withColumn("material", F.lit("X")))),
    "inv_sim_estaciones_validas": ("release", put("liberado", "liberado * 3")),
    "inv_calidad_datos_cuadra": ("board", put("violaciones", "violaciones + 1")), "inv_cifras_conocidas": ("all_violations", put("cifra_afectada", "'nada'")), "inv_impacto_completo": ("impact", put("valor_limpio", "cast(null as double)")),
}


@pytest.mark.parametrize("name", list(WRONG))
def test_each_invariant_sees_what_breaks_it(models, name):
    model, wrong = WRONG[name]
    broken = copy.copy(models)  # with the nodes that are built
    broken.__dict__[model] = wrong(getattr(models, model))
    with pytest.raises(AssertionError, match="should be none"):
        invariants.assert_empty(invariants.TABLE[name][0](broken))


def test_every_planted_fault_that_its_rule_can_see_is_reported(models):
    got = {r["defecto"]: (r["casos"], r["detectados"]) for r in quality.detection(quality.injected(models.ledger), models.violations).collect()}
    assert {"D06", "D16"} <= got.keys() and all(n > 0 for n, _ in got.values())
    # Of outflows in pieces only those of materials with a packing instruction can be told.
    assert got["D06"][1] > 0 and got["D01"][0] == got["D01"][1] and got["B03"][0] == got["B03"][1]
