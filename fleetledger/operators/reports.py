"""Report queries over the models: losses, Pareto, cost per trip, coverage, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import FIRST, filtered_sum, ratio, rounded


def headline(losses: DataFrame, routes: DataFrame) -> DataFrame:
    """One row: recognised loss, units, fleet loss rate, and broken routes of all."""
    money = losses.agg(F.sum("perdida_usd").alias("perdida_usd"), F.sum("unidades_perdidas").alias("unidades"))
    fleet = routes.agg(
        ratio(F.sum("faltantes") * 100.0, F.sum("salidas_conciliadas")).alias("tasa_flota_pct"), F.count_if("ruta_rota").alias("rutas_rotas"), F.count(F.lit(1)).alias("rutas")
    )
    return money.crossJoin(F.broadcast(fleet)).withColumn("tasa_flota_pct", rounded("tasa_flota_pct", 3))


def loss_by_type(losses: DataFrame) -> DataFrame:
    return losses.groupBy("tipo_material").agg(F.sum("perdida_usd").alias("perdida_usd"), F.sum("unidades_perdidas").alias("unidades"))


def loss_by_month(losses: DataFrame) -> DataFrame:
    """Months by type, zero where a type lost nothing."""
    return losses.groupBy("mes").pivot("tipo_material", ["KLT", "RACK"]).agg(F.sum("perdida_usd")).na.fill(0.0)


def pareto(losses: DataFrame) -> DataFrame:
    """Plants by loss with their cumulative share, and whether they are among the fewest that make eight tenths."""
    by = losses.groupBy("planta").agg(F.sum("perdida_usd").alias("perdida_usd"))
    w = Window.orderBy(F.desc("perdida_usd"), "planta").rowsBetween(FIRST, 0)  # one row a plant
    share = F.sum("perdida_usd").over(w) / F.sum("perdida_usd").over(Window.partitionBy())
    made = by.withColumn("acum", share)
    return made.select("planta", "perdida_usd", rounded(F.col("acum") * 100, 2).alias("acumulado_pct"), (F.coalesce(F.lag("acum").over(Window.orderBy(F.desc("perdida_usd"), "planta")), F.lit(0.0)) < 0.8).alias("en_80"))


def top_materials(losses: DataFrame, n: int = 15) -> DataFrame:
    by = losses.groupBy("planta", "material", "tipo_material").agg(F.sum("perdida_usd").alias("perdida_usd"), F.sum("unidades_perdidas").alias("unidades"))
    return by.orderBy(F.desc("perdida_usd"), "planta", "material").limit(n)


def excess_by_month(excess: DataFrame, routes: DataFrame) -> DataFrame:
    """Median excess of broken and other routes, month by month, from closes whose alert is valid."""
    kinds = routes.select("planta", "cliente", F.when(F.col("ruta_rota"), "rota").otherwise("resto").alias("tipo"))
    met = excess.where("alerta_valida").join(kinds, ["planta", "cliente"])
    return met.groupBy("mes").pivot("tipo", ["rota", "resto"]).agg(F.median("exceso_pct_ciclo"))


def cost_per_trip(comparison: DataFrame) -> DataFrame:
    """Trip-weighted cost of a returnable trip beside one-way packaging, by type."""
    mean = lambda c: rounded(ratio(F.sum(F.col(c) * F.col("viajes")), F.sum("viajes")), 4).alias(c)
    return comparison.groupBy("tipo_material").agg(F.sum("viajes").alias("viajes"), mean("costo_retornable_por_ciclo_usd"), mean("desechable_equiv_usd"), F.sum("ahorro_neto_usd").alias("ahorro_neto_usd"))


def saving_by_plant(comparison: DataFrame) -> DataFrame:
    made = comparison.groupBy("planta").pivot("tipo_material", ["KLT", "RACK"]).agg(F.sum("ahorro_neto_usd"))
    return made.withColumn("total", F.coalesce("KLT", F.lit(0.0)) + F.coalesce("RACK", F.lit(0.0)))


def coverage(fleet: DataFrame, use: DataFrame, policy: DataFrame, days: int = 91) -> DataFrame:
    """Days that the empties at the cutoff would last at recent demand, and whether that is below the policy's cover."""
    last = use.agg(F.max("fecha").alias("fin"))
    recent = use.crossJoin(F.broadcast(last)).where(F.col("fecha") > F.date_sub("fin", days)).groupBy("planta", "material").agg((F.sum("salidas") / days).alias("demanda"))
    now = fleet.groupBy("planta", "material", "tipo_material").agg(F.max_by("vacios", "semana").alias("vacios"))
    made = now.join(recent, ["planta", "material"]).join(F.broadcast(policy.select("tipo_material", "dias_cobertura")), "tipo_material")
    cover = ratio("vacios", "demanda")
    return made.select("planta", "material", "tipo_material", "vacios", rounded("demanda", 4).alias("demanda"), rounded(cover, 2).alias("dias"), F.coalesce(cover < F.col("dias_cobertura"), F.lit(False)).alias("alerta"))


def profile(ledger: DataFrame) -> DataFrame:
    """Lines and units by class, plant and month, with the class's share of its plant's lines."""
    by = ledger.groupBy("mov_type", "planta", F.trunc("fecha_contab", "month").alias("mes")).agg(F.count(F.lit(1)).alias("lineas"), F.sum(F.abs(F.col("cantidad").cast("long"))).alias("unidades"))
    return by.withColumn("pct_planta_mes", rounded(F.col("lineas") * 100.0 / F.sum("lineas").over(Window.partitionBy("planta", "mes")), 4))


def header(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.countDistinct("planta").alias("plantas"), F.countDistinct(F.trunc("fecha_contab", "month")).alias("meses"), F.max("fecha_contab").alias("ultima"))


def fingerprint(ledger: DataFrame) -> DataFrame:
    """Count, units by class and an order-insensitive hash (a sum of 32 bits of each line's MD5) of each plant's customer cycle."""
    mine = ledger.where(F.col("mov_type").isin("621", "622", "702"))
    units = {k: filtered_sum(F.abs(F.col("cantidad").cast("long")), F.col("mov_type") == k).alias(f"unidades_{k}") for k in ("621", "622", "702")}
    text = F.concat_ws("|", "cliente", "material", "mov_type", *[F.col(c).cast("string") for c in ("fecha_contab", "cantidad", "doc_material", "posicion")])
    line = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return mine.groupBy("planta").agg(F.count(F.lit(1)).alias("lineas"), *units.values(), F.sum(line).alias("huella"))


def lag_distribution(lines: DataFrame) -> DataFrame:
    """Lines by days from posting to record, with their share."""
    by = lines.groupBy(F.datediff("fecha_registro", "fecha_contab").alias("lag_dias")).agg(F.count(F.lit(1)).alias("lineas"))
    return by.withColumn("pct", rounded(F.col("lineas") * 100.0 / F.sum("lineas").over(Window.partitionBy()), 4))  # one row a day of lag


def gap_by_ramp(all_gaps: DataFrame, instruction: DataFrame) -> DataFrame:
    """The base scenario's gap, by whether a part that the material packs ramps up in the plan."""
    ramp = instruction.groupBy("planta", "material").agg(F.bool_or(F.split("material", "-")[1].cast("int") % 5 == 0).alias("con_arranque"))
    met = all_gaps.where("escenario = 'base'").join(F.broadcast(ramp), ["planta", "material"], "left").withColumn("con_arranque", F.coalesce("con_arranque", F.lit(False)))
    usd = F.col("usd_flete") + F.col("usd_compra") + F.col("usd_desechable")
    return met.groupBy("tipo_material", "con_arranque").agg(F.count(F.lit(1)).alias("materiales"), rounded(F.sum("deficit_pico"), 1).alias("deficit"), rounded(F.sum(usd), 2).alias("usd_brecha"))


#: The scenarios between which a policy chooses.
POLICIES = ("base", "quiebre_1", "quiebre_1_5", "quiebre_2_5", "quiebre_3", "capital_10", "capital_15", "optimista", "conservador", "z_fija_3")


def frontier(sensitivity: DataFrame) -> DataFrame:
    """Cost of the gap against idle capital, policy by policy."""
    mine = sensitivity.where(F.col("escenario").isin(*POLICIES))
    return mine.groupBy("escenario").agg(rounded(F.sum("usd_brecha"), 2).alias("usd_brecha"), rounded(F.sum("usd_capital_ocioso"), 2).alias("usd_capital_ocioso"))


def freight_coefficients(lent: DataFrame, prices: DataFrame) -> DataFrame:
    """What each per cent of freight costs in the base scenario, inside a country and across: freight is linear in both."""
    met = lent.where("escenario = 'base'").join(F.broadcast(prices), "tipo_material")
    part = lambda c: rounded(F.sum(F.col(c) * F.col("costo_unitario_usd")) / 100, 2)
    return met.groupBy("tipo_material").agg(part("recibido_mismo_pais").alias("mismo_pais"), part("recibido_otro_pais").alias("otro_pais"))


#: Ranges of assumptions, each from the scenario of its low end to that of its high end; per cents of freight inside a
#: country and across, low and high.
RANGOS = [
    ("factor de quiebre 1 a 3", "quiebre_1", "quiebre_3"), ("costo de capital 15 a 8 %", "capital_15", "capital_8"),
    ("reparación de rack baja a alta", "reparacion_rack_baja", "reparacion_rack_alta"), ("lavado de KLT 1 a 3 días", "lavado_klt_1_dia", "lavado_klt_3_dias"),
]
RANGO_FLETE = ("flete 3 y 10 % a 8 y 25 %", (3.0, 10.0), (8.0, 25.0))


def assumption_ranges(sensitivity: DataFrame, coefficients: DataFrame) -> DataFrame:
    """How far each assumption moves the total gap: what it is at both ends of the range, in the base scenario, and the distance. Freight
    has no scenarios of its own: it is linear in its two per cents, so its ends follow from the coefficients."""
    usd = lambda name, c: F.sum(F.when(F.col("escenario") == name, F.col(c)))
    ends = {n for _, *both in RANGOS for n in both}
    totals = sensitivity.agg(usd("base", "usd_brecha").alias("base"), usd("base", "usd_flete").alias("flete"), *[usd(n, "usd_brecha").alias(n) for n in sorted(ends)])
    linear = coefficients.agg(F.sum("mismo_pais").alias("a"), F.sum("otro_pais").alias("b"))
    freight = lambda pct: F.col("base") - F.col("flete") + F.col("a") * pct[0] + F.col("b") * pct[1]
    end = lambda name, low, high: F.struct(F.lit(name).alias("supuesto"), rounded(low, 2).alias("bajo"), rounded(high, 2).alias("alto"))
    rows = [end(n, F.col(low), F.col(high)) for n, low, high in RANGOS] + [end(RANGO_FLETE[0], freight(RANGO_FLETE[1]), freight(RANGO_FLETE[2]))]
    made = totals.crossJoin(F.broadcast(linear)).select(rounded("base", 2).alias("base"), F.explode(F.array(*rows)).alias("x"))  # one row each
    return made.select("x.*", "base", rounded(F.col("x.alto") - F.col("x.bajo"), 2).alias("amplitud"))


def shared_racks(instruction: DataFrame) -> DataFrame:
    """Racks that carry parts of more than one customer. A rack is made for its part, so a second customer is a fault of the instruction
    or of the master. A part's code begins with its customer."""
    racks = instruction.where("tipo_material = 'RACK'").select("planta", "material", F.substring_index("parte", "-", 1).alias("cliente"))
    return racks.distinct().groupBy("planta", "material").agg(F.count(F.lit(1)).alias("clientes")).where("clientes > 1")


def rule_board(rules: DataFrame, board: DataFrame) -> DataFrame:
    """Every rule with its violations, those without any too."""
    seen = board.groupBy("regla").agg(F.sum("violaciones").alias("violaciones"), rounded(F.sum("usd_expuesto"), 2).alias("usd_expuesto"))
    met = rules.join(F.broadcast(seen), "regla", "left")
    return met.select("regla", "defecto", "unidad", "severidad", "cifra_afectada", F.coalesce("violaciones", F.lit(0)).alias("violaciones"), "usd_expuesto")


def rate_by_plant(board: DataFrame) -> DataFrame:
    """Each rule's violations in a plant, in per cent of what the plant has of the rule's unit."""
    by = board.where("planta is not null").groupBy("regla", "severidad", "planta").agg(F.sum("violaciones").alias("violaciones"), F.max("universo_planta").alias("universo"))
    return by.withColumn("tasa_pct", rounded(ratio(F.col("violaciones") * 100.0, F.col("universo")), 3))


def faults_by_figure(impacts: DataFrame) -> DataFrame:
    """How many faults move each figure past the materiality or break each identity, the one that moves it most, and by how much."""
    past = F.col("supera_materialidad")
    most = F.when(past, F.struct(F.coalesce(F.abs("delta_pct"), F.abs("delta"), F.lit(float("inf"))).alias("n"), F.col("defecto").alias("d")))
    by = impacts.groupBy("tipo", "medida").agg(F.count_if(past).alias("defectos"), F.max(most).alias("mayor"))
    return by.select("tipo", "medida", "defectos", F.col("mayor.d").alias("defecto_mayor"), rounded("mayor.n", 4).alias("movimiento"))


def rank_correlation(board: DataFrame) -> DataFrame:
    """For each rule: whether plants with more violations also have more money exposed, as the correlation of their ranks
    (mean ranks for ties; null where all are tied)."""
    sums = board.where("usd_expuesto is not null").groupBy("regla", "planta").agg(F.sum("violaciones").alias("n"), F.sum("usd_expuesto").alias("usd"))
    rank = lambda c: F.rank().over(Window.partitionBy("regla").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("regla", c)) - 1) / 2.0
    ranked = sums.select("regla", rank("n").alias("a"), rank("usd").alias("b"))
    found = ratio(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))
    return ranked.groupBy("regla").agg(F.count(F.lit(1)).alias("plantas"), rounded(found, 6).alias("correlacion"))


def fleet_against_need(projected: DataFrame, need: DataFrame) -> DataFrame:
    """Fleet, need and deficit of each plan week in the base scenario."""
    base = need.where("escenario = 'base'").select("planta", "material", "semana", "necesidad")
    met = projected.join(base, ["planta", "material", "semana"], "left").withColumn("necesidad", F.coalesce("necesidad", F.lit(0)))
    short = F.greatest(F.col("necesidad") - F.col("flota_proyectada"), F.lit(0.0))
    return met.groupBy("semana", "tipo_material").agg(rounded(F.sum("flota_proyectada"), 2).alias("flota"), F.sum("necesidad").cast("long").alias("necesidad"), rounded(F.sum(short), 2).alias("deficit"))


def safety_distribution(need_mart: DataFrame) -> DataFrame:
    """How many days of demand the safety stock covers: lowest, first percentile, median, and how many have a week at most."""
    d = F.col("stock_seguridad_dias")
    return need_mart.groupBy("tipo_material").agg(F.min(d).alias("minimo"), F.percentile(d, 0.01).alias("p01"), F.median(d).alias("mediana"), F.count_if(d <= 7).alias("hasta_7"), F.count(d).alias("n"))


def gap_by_level(gap: DataFrame) -> DataFrame:
    """How far each level of escalation closes the base scenario's deficit."""
    return gap.where("escenario = 'base'").groupBy("tipo_material").agg(
        rounded(F.sum("deficit_pico"), 1).alias("deficit"), rounded(F.sum("recibido_mismo_pais"), 1).alias("mismo_pais"), rounded(F.sum("recibido_otro_pais"), 1).alias("otro_pais"),
        F.sum("compra").cast("long").alias("compra"), rounded(F.sum("viajes_desechable"), 1).alias("viajes_desechable"), rounded(F.sum(F.col("usd_flete") + F.col("usd_compra") + F.col("usd_desechable")), 2).alias("usd"),
    )


def loan_matrix(network: DataFrame) -> DataFrame:
    """Containers lent, origin by destination."""
    return network.groupBy("planta_origen").pivot("planta_destino", ["P0", "P1", "P2", "P3", "P4"]).agg(rounded(F.sum("contenedores"), 1))


def saving_sensitivity(cost: DataFrame, rates: tuple[float, ...] = (0.5, 1.0, 2.0, 5.0)) -> DataFrame:
    """Net saving of each type if every trip lost containers at a given rate in per cent."""
    grid = cost.sparkSession.createDataFrame([(r,) for r in rates], "tasa_pct double")
    p = F.col("tasa_pct") / 100
    life = (1 - F.pow(1 - p, F.col("vida_util_ciclos"))) / p
    saved = F.col("viajes") * (F.col("desechable_equiv_usd") - F.col("costo_unitario_usd") / life - F.col("mant_por_ciclo_usd"))
    return cost.crossJoin(F.broadcast(grid)).groupBy("tipo_material", "tasa_pct").agg(rounded(F.sum(saved), 2).alias("ahorro_neto_usd"))


def saving_by_price(comparison: DataFrame, prices: tuple[float, ...] = (34.0, 40.0, 45.0, 50.0, 55.0, 60.0, 66.0), tipo: str = "RACK") -> DataFrame:
    """Net saving of a type if its one-way packaging had a given price."""
    grid = comparison.sparkSession.createDataFrame([(p,) for p in prices], "desechable_usd double")
    saved = F.col("viajes") * (F.col("desechable_usd") - F.col("costo_retornable_por_ciclo_usd"))
    return comparison.where(F.col("tipo_material") == tipo).crossJoin(F.broadcast(grid)).groupBy("desechable_usd").agg(rounded(F.sum(saved), 2).alias("ahorro_neto_usd"))
