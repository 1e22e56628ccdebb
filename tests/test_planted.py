"""Faults by quota, strangers, and every fault alone: against loops, and against models of one fault by themselves."""

import copy
import datetime
import random
from collections import Counter
from functools import cached_property

import pytest
from pyspark.sql import functions as F

from paths import SF
from fleetledger.operators import cycle, quality, reports
from fleetledger.plans import invariants, variants
from fleetledger.plans.models import ByDay, Models
from fleetledger.sources import faults
from fleetledger.sources import ledger as src
from fleetledger.functions.tables import stored


@pytest.fixture(scope="module")
def models(spark):
    return Models(spark, SF)


@pytest.mark.parametrize("last", [5000, 3])
def test_smallest_by_digits(spark, monkeypatch, last):
    """Histograms find the same rows as a sort; with little room for ranking they go on to the last digit, ties by key."""
    monkeypatch.setattr(faults, "LAST", last)
    rng = random.Random(6)
    rows = [("p", 2020, f"d{i}", i, rng.getrandbits(60)) for i in range(900)] + [("q", 2020, f"d{i}", i, rng.choice([5, 7])) for i in range(40)] + [("r", 2020, "d", 1, 9)]
    df = spark.createDataFrame(rows, "planta string, anio_contable long, doc_material string, posicion int, h long").repartition(5)
    wanted = {"p": 250, "q": 33, "r": 4, "none": 2}
    got = faults.smallest(df, spark.createDataFrame(list(wanted.items()), "planta string, n long"))
    want = [r for p, n in wanted.items() for r in sorted([r for r in rows if r[0] == p], key=lambda r: (r[4], r[:4]))[:n]]
    assert Counter(tuple(r) for r in got.select("planta", "anio_contable", "doc_material", "posicion", "h").collect()) == Counter(want)


def test_quota_log_is_exact(models):
    """Exact counts in each plant, no document twice, candidates only."""
    lines, log = models.quota_lines, models.quota_log.collect()
    assert len({r["defecto"] for r in log}) == len(faults.KINDS)
    docs = [(r["planta"], r["anio_contable"], r["doc_material"]) for r in log]
    by_kind = {}
    for r, d in zip(log, docs):
        by_kind.setdefault(d, set()).add(r["defecto"])
    assert all(len(kinds) == 1 for kinds in by_kind.values())
    counts = Counter((r["defecto"], r["planta"]) for r in log)
    for kind in faults.KINDS:
        universe = {r["planta"]: r["n"] for r in lines.groupBy("planta").agg(F.count_if(F.expr(kind.universo)).alias("n")).collect()}
        for plant, n in universe.items():
            assert counts[kind.defecto, plant] == max(1, int(n * kind.tasa + 0.5)), (kind, plant)
    assert faults.targets(lines, [faults.KINDS[0]._replace(tasa=0.0), faults.KINDS[4]]).select("defecto").distinct().collect()[0][0] == "D05"


def test_strangers_never_had_the_material(models):
    shipped = {(r["planta"], r["material"], r["cliente"]) for r in models.quota_lines.where("mov_type = '621'").select("planta", "material", "cliente").collect()}
    customers = {(p, c) for p, _, c in shipped}
    moved = models.quota_log.where("defecto = 'D07'").collect()
    assert moved and all((r["planta"], r["valor_inyectado"]) in customers and (r["planta"], r["material"], r["valor_inyectado"]) not in shipped for r in moved)


def test_free_customers_are_numbered_without_pairs(spark):
    """Every free customer is reached by exactly one number."""
    rng = random.Random(1)
    pairs = {(m, f"c{rng.randint(10, 39)}") for m in ("a", "b") for _ in range(25)} | {("full", f"c{i}") for i in range(10, 40)}
    lines = spark.createDataFrame([("p", m, c, "621") for m, c in sorted(pairs)], "planta string, material string, cliente string, mov_type string")
    customers, free, steps = faults.free_customers(lines)
    names = {r["numero"]: r["cliente"] for r in customers.collect()}
    free = {r["material"]: r["libres"] for r in free.collect()}
    rows = steps.collect()
    assert sorted(names) == list(range(len(names))) and free["full"] == 0
    for m in ("a", "b"):
        reached = [names[k + max([r["antes"] for r in rows if r["material"] == m and r["hueco"] <= k], default=0)] for k in range(free[m])]
        assert reached == sorted(set(names.values()) - {c for n, c in pairs if n == m})


def test_quota_faults_are_found(models):
    got = {r["defecto"]: (r["casos"], r["detectados"]) for r in quality.detection(models.quota_log, models.quota_violations).collect()}
    # Of outflows in pieces only those of materials with a packing instruction can be told.
    assert set(got) == {k.defecto for k in faults.KINDS} and all(n == m for d, (n, m) in got.items() if d != "D06")


class Alone(Models):
    """The models of one world by themselves, codes as they are."""

    def __init__(self, base, h, number):
        super().__init__(base.spark, base.sf_dir, base.v)
        self.base, self.h, self.number = base, h, number

    @cached_property
    def tables(self):
        b = self.base
        return src.dirty_tables(b.customer, b.snapshot, *b.plan, only=F.lit(self.number))

    @cached_property
    def master(self):
        return self.tables["master"]

    @cached_property
    def ledger(self):
        lines = src.dirty_lines(self.base.ledger, self.classes, mark=F.when(src.fault_mark() == self.h, self.h).otherwise(-1))
        return stored(cycle.staged_movements(lines, self.master), "alone")

    @cached_property
    def customer(self):
        return self.ledger.where("mov_type <> '311'")

    moves = property(lambda self: self.customer)
    snapshot = property(lambda self: self.tables["snapshot"])
    plan = property(lambda self: (self.tables["plan"], self.tables["instruction"]))


def test_worlds_are_what_each_fault_does_by_itself(models):
    """Worlds at once give the figures of runs by themselves: a fault that moves the last date, and one of the tables."""
    chosen = [w for w in variants.worlds() if w[0] in (variants.CLEAN, "B04", "D05", "llave_maestro_duplicada")]
    assert len(chosen) == 4
    together = {(r["mundo"], r["medida"]): r["valor"] for r in variants.VariantModels(models, chosen).measured.collect()}
    for name, h, number in chosen[2:]:
        m = Alone(models, h, number)
        base = m.gap.where("escenario = 'base'").agg(F.sum(F.col("usd_flete") + F.col("usd_compra") + F.col("usd_desechable")).alias("brecha"), F.sum("usd_capital_ocioso").alias("ocioso")).first()
        fleet = m.fleet.agg(F.max_by("semana", "fecha_cierre")).first()[0]
        week = m.need.agg(F.min("semana")).first()[0]
        alone = {
            "perdida": cycle.losses_usd(m.moves).agg(F.sum("perdida_usd")).first()[0], "tco": cycle.cost_comparison(m.cost).agg(F.sum("ahorro_neto_usd")).first()[0],
            "brecha": base["brecha"], "ocioso": base["ocioso"], "ciclo": cycle.cohort_cycle(m.rotation, m.tranches).where("nivel = 'flota'").first()["ciclo_promedio_dias"],
            "necesidad": m.need.where((F.col("escenario") == "base") & (F.col("semana") == week)).agg(F.sum("necesidad")).first()[0], "flota": m.fleet.where(F.col("semana") == fleet).agg(F.sum("flota")).first()[0],
            "stock": m.daily.where("saldo < 0 and tipo_material <> 'CARTON'").count(),
        }
        for measure, value in alone.items():
            assert together[name, measure] == pytest.approx(value, rel=1e-9, abs=1e-6), (name, measure)
    assert all(together[variants.CLEAN, i] == 0 for i in variants.IDENTITIES)
    found = {(r["defecto"], r["medida"]): r for r in variants.impact(variants.VariantModels(models, chosen[:3]), models.rules).collect()}
    assert all(found["D05", m]["delta"] == pytest.approx(together["D05", m] - together[variants.CLEAN, m]) for m in variants.FIGURES)
    assert found["D05", "flota"]["declarada"] and not found["D05", "perdida"]["declarada"] and found["D05", "stock"]["declarada"] is None


def test_every_fault_has_a_world_and_a_rule():
    names = [w for w, *_ in variants.worlds()]
    assert len(names) == len(set(names)) == 1 + len(quality.FALLAS) + len(quality.FALLAS_TABLAS)
    assert all(variants.rule_of(w) in {r[0] for r in quality.REGLAS} for w in names[1:])


def test_ledger_with_every_class(models):
    """Every class moves stock, no place runs below zero, and what is bought less what is reversed, used and scrapped stays."""
    m = models.all_classes
    assert {r[0] for r in m.ledger.select("mov_type").distinct().collect()} >= {"101", "102", "261", "311", "325", "343", "344", "555", "621", "622", "702"}
    assert m.daily.where("saldo < 0 and tipo_material <> 'CARTON'").count() == 0
    more = m.ledger.where("mov_type in ('101', '102', '261', '555')").agg(F.sum("cantidad")).first()[0]
    held = lambda x: x.daily.agg(F.sum("delta")).first()[0]
    assert held(m) - held(models) == more != 0
    assert m.projected.agg(F.sum("perdida_acumulada")).first()[0] > models.projected.agg(F.sum("perdida_acumulada")).first()[0]


def test_a_cycle_that_counts_the_photo_is_seen(models):
    """The invariant of the photo fails where its stock is given the snapshot's day as that of a shipment."""
    from fleetledger.plans import invariants
    from fleetledger.plans.models import PHOTO, FromPhoto

    assert models.from_photo.tranches.where("salida_en_foto").count() > 0
    assert invariants.cycle_without_photo(models.from_photo).count() == 0

    class Wrong(FromPhoto):
        @cached_property
        def tranches(self):
            aged = models.from_photo.tranches
            return aged.withColumn("salida_en_foto", F.lit(False))

        @cached_property
        def routes(self):
            worse = F.when(F.col("ciclo_promedio_dias").isNotNull(), F.col("ciclo_promedio_dias") + 1)
            return models.from_photo.routes.withColumn("ciclo_promedio_dias", worse)

    seen = {r["falla"] for r in invariants.cycle_without_photo(Wrong(models, PHOTO)).collect()}
    assert {"rotacion", "ruta"} <= seen


def test_lots_and_stations_tell_what_is_wrong(models):
    """A lot that loses its target, a day that says more is ready than its lots, and work on a Sunday."""
    every = copy.copy(models.all_classes)
    assert every.lots.where("not a_vacios").count() > 0 and invariants.lots_keep_target(every).count() == 0
    every.__dict__["lots"] = every.lots.withColumn("a_vacios", F.lit(True))
    assert {r["destino"] for r in invariants.lots_keep_target(every).collect()} == {"scrap"}
    for column, value, fault in (("listo", "listo + 1", "listo distinto a la traza"), ("liberado", "if(weekday(fecha) = 6, 1, liberado)", "pasa la capacidad"), ("listo", "listo / 2", "sale antes de estar listo")):
        broken = copy.copy(models)
        broken.__dict__["release"] = models.release.withColumn(column, F.expr(value))
        assert fault in {r["falla"] for r in invariants.stations_hold(broken).select("falla").distinct().collect()}


def test_ranges_and_shared_racks(spark):
    """Freight follows from its coefficients; of two racks one carries parts of two customers."""
    names = {n for _, *ends in reports.RANGOS for n in ends}
    rows = [("base", 100.0, 40.0)] + [(n, 100.0 + (k + 1) * 2.5, 40.0) for k, n in enumerate(sorted(names))]
    sens = spark.createDataFrame(rows, "escenario string, usd_brecha double, usd_flete double")
    coefficients = spark.createDataFrame([("KLT", 2.0, 1.0), ("RACK", 0.0, 1.0)], "tipo_material string, mismo_pais double, otro_pais double")
    got = {r["supuesto"]: r for r in reports.assumption_ranges(sens, coefficients).collect()}
    value = {n: b for n, b, _ in rows}
    for name, low, high in reports.RANGOS:
        assert (got[name]["bajo"], got[name]["alto"], got[name]["amplitud"]) == (value[low], value[high], value[high] - value[low])
    freight = got[reports.RANGO_FLETE[0]]
    assert (freight["bajo"], freight["alto"], freight["base"]) == (60.0 + 6 + 20, 60.0 + 16 + 50, 100.0) and len(got) == 5
    told = [("P0", "r1", "C1-r1"), ("P0", "r1", "C2-r1"), ("P0", "r2", "C1-r2"), ("P1", "r1", "C1-r1"), ("P1", "r1", "C1-r1b")]
    instruction = spark.createDataFrame([(*t, "RACK") for t in told] + [("P0", "k", "C1-k", "KLT"), ("P0", "k", "C2-k", "KLT")], "planta string, material string, parte string, tipo_material string")
    assert [tuple(r) for r in reports.shared_racks(instruction).collect()] == [("P0", "r1", 2)]


def test_repeated_deliveries_and_customer_codes(spark):
    """The later documents of a delivery, whatever their numbers; customers whose code only zeros tell from one with outflows."""
    line = lambda doc, pos, day, ref="R1", who="C1", event="salida_cliente", n=-5: ("P0", "M", 2020, doc, pos, event, ref, who, n, datetime.date(2020, 1, 1), day and datetime.date(2020, 1, day), 2.0)
    rows = [line("B", 1, 2), line("A", 1, 4), line("A", 2, 3), line("C", 1, 9, ref="R2"), line("D", 1, 2, ref=None), line("E", 1, 2, ref=None), line("F", 1, 5, ref="R3"), line("G", 1, None, ref="R3")]
    rows += [line("H", 1, 2, who="00C1", event="recogida_cliente", n=5), line("I", 1, 2, who="0C9", event="recogida_cliente", n=5), line("J", 1, 2, who=None, event="recogida_cliente", n=5)]
    schema = "planta string, material string, anio_contable long, doc_material string, posicion int, evento string, ref_externa string, cliente string, cantidad long, fecha_contab date, fecha_registro date, costo_unitario_usd double"
    lines = spark.createDataFrame(rows, schema)
    assert {(r["doc_material"], r["posicion"], r["detalle"][-1]) for r in quality.repeated_documents(lines).collect()} == {("A", 1, "B"), ("A", 2, "B"), ("F", 1, "G")}
    assert [(r["doc_material"], r["detalle"]) for r in quality.padded_customers(lines).collect()] == [("H", "cuenta C1")]


def test_quota_from_short_lists(models, monkeypatch):
    """Lists below a cut hold a small part of the lines and give the same log; lists that others' documents leave too short are made good."""
    key = lambda log: sorted(tuple(r[c] for c in ("defecto", *faults.KEY, "valor_inyectado")) for r in log.collect())
    lines, kinds = models.quota_lines.where("planta = 'P0' and mov_type in ('621', '622')"), [faults.KINDS[1]._replace(tasa=0.2), faults.KINDS[5]._replace(tasa=0.2)]
    want = key(faults.targets(lines, kinds))
    monkeypatch.setattr(faults, "SPARE", (1, 20))
    made, whole = [], faults.shortlists
    monkeypatch.setattr(faults, "shortlists", lambda *a: made.append(whole(*a)) or made[0])
    assert key(faults.targets(lines, kinds)) == want
    assert 0 < made[0].count() < lines.count() / 2


def test_only_repeated_line_numbers_are_sorted(spark):
    """Lines that share order and number are numbered in their order; all others are the first, null keys too."""
    cols = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    line = lambda o, n, p: (o, n, p, 1, datetime.date(1997, 1, 1), 1.0, 1.0, 0.0, 0.0, "N", "O")
    df = spark.createDataFrame([line(1, 1, 9), line(1, 1, 3), line(1, 2, 5), line(None, 1, 8), line(None, 1, 7), line(None, None, 4)], cols)
    got = {(r["l_orderkey"], r["l_linenumber"], r["l_partkey"]): r["_n"] for r in src.numbered(df).collect()}
    assert got == {(1, 1, 9): 2, (1, 1, 3): 1, (1, 2, 5): 1, (None, 1, 8): 2, (None, 1, 7): 1, (None, None, 4): 1}


@pytest.fixture(scope="module")
def by_day(spark):
    return ByDay(spark, SF)


def test_sums_by_day_are_those_of_lines(models, by_day):
    """Models that read the ledger by day give what those over its lines give, without storing or numbering a line."""
    rows = lambda df: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    for name in ("routes", "rotation", "cost", "snapshot", "curve", "daily", "projected"):
        assert rows(getattr(by_day, name)) == rows(getattr(models, name)), name
    assert "customer" not in vars(by_day) and "tranches" not in vars(by_day)
    assert by_day.customer_days.count() < models.customer.count()


def test_days_keep_sign_number_and_order(spark):
    """Lines of a day and series are one row for each sign; sums of sizes, numbers, and what of a day comes first are those of the lines."""
    cols = "planta string, cliente string, material string, tipo_material string, mov_type string, almacen string, fecha_contab date, anio_contable long, doc_material string, posicion int, cantidad int"
    day = datetime.date(1997, 5, 5)
    line = lambda kind, doc, n, d=day: ("P0", "C0", "KLT-1", "KLT", kind, None, d, 1997, doc, 1, n)
    moves = [line("621", "A01", -5, day - datetime.timedelta(9)), line("621", "A02", 2, day), line("621", "A03", -4, day), line("622", "B01", 3), line("622", "B02", 3), line("702", "C01", -2), line("622", "ZB02", 1)]
    df = spark.createDataFrame(moves, cols)
    got = {(r["doc_material"], r["signo"], r["fecha_contab"]): (r["cantidad"], r["lineas"]) for r in src.by_day(df).collect()}
    assert got["A", 1, day] == (2, 1) and got["A", -1, day] == (-4, 1) and got["B", 1, day] == (6, 2) and got["C", -1, day] == (-2, 1) and got["ZB", 1, day] == (1, 1)
    sums = lambda m: Counter({tuple(r)[:-1]: r["n"] for r in cycle.fifo_tranches(cycle.account_movements(m, src.no_snapshot(spark))).groupBy("fecha_salida", "tipo_cierre", "fecha_cierre", "dias").agg(F.sum("cantidad").alias("n")).collect()})
    assert sums(df) == sums(src.by_day(df))


def test_worlds_are_built_by_day(by_day):
    """A world's lines are counted, and its keys, without a line of any world: copies have a key twice, a material twice in the master all its lines."""
    chosen = [w for w in variants.worlds() if w[0] in (variants.CLEAN, "D01", "B03", "llave_maestro_duplicada")]
    m = variants.VariantModels(by_day, chosen)
    lines = {r["mundo"]: r["n"] for r in m.ledger_days.groupBy(m.world.alias("mundo")).agg(F.sum("lineas").alias("n")).collect()}
    keys = {r["mundo"]: r["n"] for r in m.keys.collect()}
    whole = by_day.ledger.withColumn("h", src.fault_mark())
    n, d01, b03, double = whole.agg(F.count(F.lit(1)), F.count_if(F.expr("h = 4")), F.count_if(F.expr("h = 10")), F.count_if(F.expr("planta = 'P0' and split(material, '-')[1] = '2'"))).first()
    assert lines == {variants.CLEAN: n, "D01": n + d01, "B03": n + b03, "llave_maestro_duplicada": n + double}
    assert keys == {variants.CLEAN: n, "D01": n, "B03": n + b03, "llave_maestro_duplicada": n}


def test_rules_look_only_at_suspects(models, monkeypatch):
    """Suspects are a small part of the lines, by broadcast hashes or by a shuffle, and every rule finds among them what it finds in all
    lines; the lines are not written."""
    from fleetledger.functions import tables

    rows = lambda df: Counter(tuple(r) for r in df.collect())
    lines, daily = models.lines, quality.account_days(models.lines)
    bad, wrong = quality.days_without_balance(daily), quality.misspelt_customers(daily)
    master, snapshot = models.dirty["master"], models.snapshot
    rules = [
        quality.duplicate_keys, quality.repeated_documents, lambda x: quality.padded_customers(x, wrong), lambda x: quality.pickups_without_balance(x, bad), lambda x: quality.padded_materials(x, models.master),
        lambda x: quality.line_rules(x, models.places, models.pieces, models.v), lambda x: quality.other_document_prices(x, master, snapshot, models.v),
    ]
    want = [rows(rule(lines)) for rule in rules]
    assert sum(map(bool, want)) >= 4
    for few in (tables.FEW, 0):
        monkeypatch.setattr(tables, "FEW", few)
        near = stored(quality.suspects(lines, models.places, models.pieces, bad, wrong, models.v), "near")
        assert [rows(rule(near)) for rule in rules] == want
        assert 0 < near.count() < lines.count() / 10
    assert not any("/lines-" in f for f in lines.inputFiles())


def test_only_hit_lines_meet_the_log(spark, models):
    """Lines without a fault go by the log, told by a hash of their key; those with one are what the log makes of them, null keys stay."""
    line = lambda doc, pos, who="C1", n=-5: ("P0", 2020, doc, pos, "KLT-1", "621", "LLEN", who, n, datetime.date(2020, 1, 2), "salida_cliente")
    cols = "planta string, anio_contable long, doc_material string, posicion int, material string, mov_type string, almacen string, cliente string, cantidad int, fecha_registro date, evento string"
    lines = spark.createDataFrame([line("A", 1), line("A", 2), line("B", 1), line(None, 1), line("C", 1)], cols)
    log = spark.createDataFrame([("P0", 2020, "A", 2, "cantidad", "7"), ("P0", 2020, "B", 1, "linea", "copia"), ("P0", 2020, "C", 1, "cliente", None)], "planta string, anio_contable int, doc_material string, posicion long, campo string, valor_inyectado string")
    got = Counter((r["doc_material"], r["posicion"], r["cliente"], r["cantidad"], r["evento"]) for r in faults.planted(lines, log, models.classes).collect())
    out = "salida_cliente"
    assert got == {("A", 1, "C1", -5, out): 1, ("A", 2, "C1", 7, out): 1, ("B", 1, "C1", -5, out): 2, (None, 1, "C1", -5, out): 1, ("C", 1, None, -5, out): 1}
    assert any("quota-hit" in f for f in faults.planted(lines, log, models.classes).inputFiles())


def test_faults_of_tables_need_no_other_rules(spark):
    """What the tables' faults are counted by is found without the rules of single movements: no key, delivery or balance is looked at."""
    from fleetledger.plans import registry

    m = Models(spark, SF)
    got = {r["regla"]: (r["casos"], r["detectados"]) for r in registry.TABLE["deteccion_en_tablas"][0](m).collect()}
    assert got and "violations" not in vars(m) and "contract_failures" not in vars(m)
    moved = {r for r, *_ in quality.REGLAS if r in got and r in {rule for _, _, rule, _ in quality.FALLAS}}
    assert moved == {"lgort_fuera_de_catalogo"}
