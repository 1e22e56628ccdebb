"""The fleet gap: balances by scenario, loans between plants, and what the rest costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import allocate, rounded

KEY = ("escenario", "planta", "material")


def material_balance(levels: DataFrame, fleet: DataFrame, need: DataFrame, plants: DataFrame) -> DataFrame:
    """Peak deficit and lasting surplus of each material over the plan's weeks."""
    scenarios = levels.select("escenario").distinct()
    weekly = fleet.crossJoin(F.broadcast(scenarios)).join(need.select(*KEY, "semana", "necesidad"), [*KEY, "semana"], "left")
    left = F.col("flota_proyectada") - F.coalesce("necesidad", F.lit(0))
    made = weekly.groupBy(*KEY, "tipo_material").agg(F.greatest(F.max(-left), F.lit(0.0)).alias("deficit_pico"), F.greatest(F.min(left), F.lit(0.0)).alias("sobrante"), F.max("ciclo_dias").alias("ciclo_dias"))
    return made.join(F.broadcast(plants), "planta").select("escenario", "planta", "pais", "material", "tipo_material", "deficit_pico", "sobrante", "ciclo_dias")


def loans(balance: DataFrame) -> DataFrame:
    """Surplus lent in proportion: within the country first, what is left then across countries."""
    home = allocate(balance, ("escenario", "material", "pais"), "deficit_pico", "sobrante", "recibido_mismo_pais", "prestado_mismo_pais")
    rest = home.withColumns({"d": F.col("deficit_pico") - F.col("recibido_mismo_pais"), "s": F.col("sobrante") - F.col("prestado_mismo_pais")})
    both = allocate(rest, ("escenario", "material"), "d", "s", "recibido_otro_pais", "prestado_otro_pais")
    return both.select(
        "escenario", "planta", "pais", "material", "tipo_material", "ciclo_dias", "deficit_pico", "sobrante", "recibido_mismo_pais", "recibido_otro_pais", "prestado_mismo_pais", "prestado_otro_pais"
    )


def scenario_gap(lent: DataFrame, prices: DataFrame, fleet: DataFrame, need: DataFrame, policy: DataFrame) -> DataFrame:
    """Freight, purchases, one-way trips while waiting for them, and idle capital."""
    got = F.col("recibido_mismo_pais") + F.col("recibido_otro_pais")
    place = ("planta", "material")
    weekly = fleet.select(*place, "semana", "flota_proyectada").join(need.select(*KEY, "semana", "necesidad"), [*place, "semana"])
    weekly = weekly.withColumn("semana_n", F.row_number().over(Window.partitionBy(*KEY).orderBy("semana"))).select(*KEY, "semana_n", (F.col("necesidad") - F.col("flota_proyectada")).alias("corto"))
    mine = lent.join(F.broadcast(policy), "tipo_material")
    early = mine.join(weekly, list(KEY)).where("semana_n <= lead_time_semanas")
    trips = early.groupBy(*KEY).agg(F.sum(F.try_divide(F.greatest(F.col("corto") - got, F.lit(0.0)) * 7, F.col("ciclo_dias"))).alias("v"))
    full = mine.join(F.broadcast(prices), "tipo_material").join(trips, list(KEY), "left")
    price, buy = F.col("costo_unitario_usd"), F.ceil(F.greatest(F.col("deficit_pico") - got - 1e-6, F.lit(0.0))).cast("long")
    one_way, spare = F.coalesce("v", F.lit(0.0)), F.col("sobrante") - F.col("prestado_mismo_pais") - F.col("prestado_otro_pais")
    freight = price * (F.col("recibido_mismo_pais") * F.col("flete_mismo_pais_pct") + F.col("recibido_otro_pais") * F.col("flete_otro_pais_pct")) / 100
    tenth = [rounded(c, 1).alias(c) for c in ("deficit_pico", "sobrante", "recibido_mismo_pais", "recibido_otro_pais", "prestado_mismo_pais", "prestado_otro_pais")]
    return full.select(
        "escenario", "planta", "pais", "material", "tipo_material", *tenth, buy.alias("compra"), rounded(one_way, 1).alias("viajes_desechable"), rounded(spare, 1).alias("sobrante_final"),
        rounded(freight, 2).alias("usd_flete"), rounded(buy * price, 2).alias("usd_compra"), rounded(one_way * F.col("desechable_equiv_usd"), 2).alias("usd_desechable"), rounded(spare * price, 2).alias("usd_capital_ocioso"),
    )


def base_gap(gap: DataFrame) -> DataFrame:
    return gap.where("escenario = 'base'").drop("escenario")


def gap_sensitivity(gap: DataFrame, need: DataFrame, levels: DataFrame) -> DataFrame:
    """Totals of each scenario and type beside the parameters that made them."""
    first = need.agg(F.min("semana").alias("semana"))
    week1 = need.join(F.broadcast(first), "semana").groupBy("escenario", "tipo_material").agg(F.sum("necesidad").cast("long").alias("necesidad_semana_1"))
    sums = ("recibido_mismo_pais", "recibido_otro_pais", "compra", "viajes_desechable", "usd_flete", "usd_compra", "usd_desechable", "sobrante_final", "usd_capital_ocioso")
    total = gap.groupBy("escenario", "tipo_material").agg(F.count_if(F.col("deficit_pico") > 0).alias("materiales_deficit"), F.sum("deficit_pico").alias("deficit"), *[F.sum(c).alias(c) for c in sums])
    digits = {"deficit": 1, "recibido_mismo_pais": 1, "recibido_otro_pais": 1, "viajes_desechable": 1, "usd_flete": 2, "usd_compra": 2, "usd_desechable": 2, "sobrante_final": 1, "usd_capital_ocioso": 2}
    made = total.withColumn("usd_brecha", rounded(F.col("usd_flete") + F.col("usd_compra") + F.col("usd_desechable"), 2)).withColumns({c: rounded(c, n) for c, n in digits.items()})
    par = levels.select("escenario", "tipo_material", "factor_costo_quiebre", "costo_capital_anual_pct", "z_fija", "ajuste_ciclo_dias", "objetivo_quiebre", "z_servicio")
    return made.withColumn("compra", F.col("compra").cast("long")).join(par, ["escenario", "tipo_material"]).join(week1, ["escenario", "tipo_material"])


def loan_network(lent: DataFrame, prices: DataFrame, policy: DataFrame) -> DataFrame:
    """Flows from lenders to borrowers in the base scenario: each borrower draws on its pool's lenders in proportion."""
    base = lent.where("escenario = 'base'")

    def stage(name: str, pool: list[str], got: str, gave: str) -> DataFrame:
        give = base.where(F.col(gave) > 0).select("material", F.col("pais").alias("pais_origen"), F.col("planta").alias("planta_origen"), F.col(gave).alias("g"))
        give = give.withColumn("parte", F.col("g") / F.sum("g").over(Window.partitionBy("material", *(["pais_origen"] if pool else []))))
        take = base.where(F.col(got) > 0).select("material", "tipo_material", F.col("pais").alias("pais_destino"), F.col("planta").alias("planta_destino"), F.col(got).alias("r"))
        on = (give["material"] == take["material"]) & (give["pais_origen"] == take["pais_destino"]) if pool else give["material"] == take["material"]
        met = take.join(give, on).drop(give["material"])
        return met.select("material", "tipo_material", "planta_origen", "pais_origen", "planta_destino", "pais_destino", F.lit(name).alias("etapa"), (F.col("r") * F.col("parte")).alias("contenedores"))

    flows = stage("mismo_pais", ["pais"], "recibido_mismo_pais", "prestado_mismo_pais").unionByName(stage("otro_pais", [], "recibido_otro_pais", "prestado_otro_pais"))
    priced = flows.join(F.broadcast(prices), "tipo_material").join(F.broadcast(policy), "tipo_material")
    pct = F.when(F.col("etapa") == "mismo_pais", F.col("flete_mismo_pais_pct")).otherwise(F.col("flete_otro_pais_pct"))
    return priced.groupBy("planta_origen", "pais_origen", "planta_destino", "pais_destino", "tipo_material", "etapa").agg(
        F.countDistinct("material").alias("materiales"), rounded(F.sum("contenedores"), 1).alias("contenedores"), rounded(F.sum(F.col("contenedores") * F.col("costo_unitario_usd") * pct) / 100, 2).alias("usd_flete")
    )
