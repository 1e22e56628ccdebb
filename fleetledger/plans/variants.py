"""What each planted fault does alone to the published figures and identities, for all faults at once.

A world is the ledger and its tables with one fault, or none. Worlds are not run one after the other: a world's name is part of the
codes of its plants, materials and types (world|code), so that every key of the models, and every pool that materials or types
share, is a key inside its world, and one run of the models over the union gives all of them. The few aggregates over everything
(calendar, latest reconciliation, horizon) are taken by world.
"""

from __future__ import annotations

import functools
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import ratio, rounded, running_sum
from ..functions.tables import stored
from ..operators import cycle, gap, need, quality, stock
from ..sources import ledger as src
from .models import ByDay, Models

CLEAN = "limpio"
#: The seven measured figures and the four identities.
FIGURES = ("perdida", "tco", "brecha", "ocioso", "ciclo", "necesidad", "flota")
IDENTITIES = ("llave", "stock", "saldo", "conservacion")


def faults_of_tables() -> list[tuple[str, str, int]]:
    """World, rule and number of each fault of the tables. A world is named by its fault, or by the rule of one without a name; a fault
    that stands in the movements too (D03) is named with its table."""
    lines = {d for _, d, *_ in quality.FALLAS}
    return [(f"{d}.{t}" if d in lines else d or r, r, n) for n, t, d, r, _ in quality.FALLAS_TABLAS]


def worlds() -> list[tuple[str, int, int]]:
    """Each world's name, its mark in the movements and its number in the other tables; -1 for none."""
    return [(CLEAN, -1, -1), *((d, h, -1) for h, d, *_ in quality.FALLAS), *((w, -1, n) for w, _, n in faults_of_tables())]


def rule_of(world: str) -> str | None:
    return ({d: r for _, d, r, _ in quality.FALLAS} | {w: r for w, r, _ in faults_of_tables()}).get(world)


def own(code: str) -> Column:
    """A code as its world has it; the world stands in the row's plant."""
    return F.when(F.col(code).isNotNull(), F.concat(F.substring_index("planta", "|", 1), F.lit("|"), F.col(code)))


def same_account() -> Column:
    """Whether a row's account is that of the columns with a low line before their names; customers may be null."""
    return functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cycle.ACCOUNT])


#: What an account's days are summed up in.
SIZES = ("cantidad_abs", "delta_saldo")


def day_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*[c for c in rows.columns if c not in SIZES]).agg(*[F.sum(c).alias(c) for c in SIZES])


class VariantModels(ByDay):
    """The models over all worlds at once."""

    @property
    def world(self) -> Column:
        return F.substring_index("planta", "|", 1)

    def __init__(self, base: Models, chosen: list[tuple[str, int, int]] | None = None):
        super().__init__(base.spark, base.sf_dir, base.v)
        self.base, self.chosen = base, worlds() if chosen is None else chosen

    def spread(self, df: DataFrame, *codes: str, among: list[str] | None = None) -> DataFrame:
        """df once for each world, or each of some, its plants named after it, and so the codes."""
        names = F.explode(F.array(*[F.lit(w) for w, *_ in self.chosen if among is None or w in among])).alias("_w")
        out = df.select("*", names).withColumn("planta", F.concat("_w", F.lit("|"), "planta")).drop("_w")
        return out.withColumns({c: own(c) for c in codes})

    def by_world(self, df: DataFrame) -> DataFrame:
        """A table by type for each world."""
        names = F.explode(F.array(*[F.lit(w) for w, *_ in self.chosen])).alias("_w")
        return df.select("*", names).withColumn("tipo_material", F.concat("_w", F.lit("|"), "tipo_material")).drop("_w")

    def mark(self, place: int) -> Column:
        """A world's mark (1) or number (2), from the row's plant."""
        pairs = [F.lit(x) for w in self.chosen for x in (w[0], w[place])]
        return F.element_at(F.create_map(*pairs), self.world)

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        """The tables of each world, codes as in the base but for the plants."""
        b = self.base
        plan, instruction = b.plan
        materials = stored(b.customer_days.select("planta", "material", "tipo_material").distinct(), "materials")
        return src.dirty_tables(self.spread(materials), self.spread(b.snapshot), self.spread(plan), self.spread(instruction), only=self.mark(2))

    @cached_property
    def master(self) -> DataFrame:
        return stored(self.tables["master"].withColumns({c: own(c) for c in ("material", "tipo_material")}), "world-master")

    @cached_property
    def hit(self) -> DataFrame:
        """The base's lines that a fault of the movements is on, in its world, with the fault's mark: a line has one mark."""
        if not self.marked:
            return self.base.ledger.withColumn("marca", src.fault_mark()).where(F.lit(False))
        names = F.create_map(*[F.lit(x) for w, h, _ in self.chosen if h >= 0 for x in (h, w)])
        marked = self.base.ledger.withColumn("marca", src.fault_mark()).where(F.col("marca").isin([h for _, h, _ in self.chosen if h >= 0]))
        return stored(marked.withColumn("planta", F.concat(F.element_at(names, F.col("marca").cast("int")), F.lit("|"), "planta")), "world-hit")

    def lines_of_hit(self, mark: Column) -> DataFrame:
        return src.dirty_lines(self.hit, self.classes, self.v, mark=mark)

    @cached_property
    def clean_days(self) -> DataFrame:
        return stored(src.by_day(self.base.ledger_days), "clean-days")

    @cached_property
    def gone(self) -> DataFrame:
        """By day, the lines that a fault is on as they were, in its world."""
        return stored(src.by_day(self.lines_of_hit(F.lit(-1))), "world-gone")

    @cached_property
    def made(self) -> DataFrame:
        """By day, what the fault makes of these lines."""
        return stored(src.by_day(self.lines_of_hit(F.col("marca"))), "world-made")

    @property
    def marked(self) -> list[str]:
        return [w for w, h, _ in self.chosen if h >= 0]

    def summed(self, clean: DataFrame, gone: DataFrame, made: DataFrame, *sums: str) -> DataFrame:
        """What is summed up from lines, in all worlds, from the sums over the clean lines, over those that faults are on, and over what
        these become: a world of a fault in the movements has the first, less the second, and with the third; the others have the first
        as it is. Groups without a line left (lineas) are none."""
        clean = stored(clean, "clean-sums")  # few rows, in as many tasks as there are cores where they are spread
        others = [w for w, h, _ in self.chosen if h < 0]
        if not self.marked:
            return self.spread(clean)
        less = gone.withColumns({c: -F.col(c) for c in (*sums, "lineas")})
        both = self.spread(clean, among=self.marked).unionByName(less).unionByName(made)
        rest = [c for c in both.columns if c not in (*sums, "lineas")]
        both = both.groupBy(*rest).agg(*[F.sum(c).alias(c) for c in (*sums, "lineas")]).where("lineas > 0")
        return self.spread(clean, among=others).unionByName(both) if others else both

    def typed(self, rows: DataFrame) -> DataFrame:
        """rows with their world's code of the material, and type and unit cost as its master has them: a row for each of the master's."""
        priced = F.broadcast(cycle.price_of(self.master))
        return rows.withColumn("material", own("material")).join(priced, ["planta", "material"], "left")

    @cached_property
    def ledger_days(self) -> DataFrame:
        """By day, type and unit cost as the world's master has them. The models below don't read it: they sum up the clean lines first, and
        spread what is left."""
        rows = self.summed(*[t.drop("tipo_material") for t in (self.clean_days, self.gone, self.made)], "cantidad")
        return self.typed(rows.drop("signo"))

    @cached_property
    def moved(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Changes of stock by place, event and day, without the opening: the clean ones, those that faults take away, those that they
        bring. Their units stand for their lines."""

        def changes(days: DataFrame) -> DataFrame:
            legs = stock.stock_moves(days, self.places, self.classes, src.no_snapshot(self.spark))
            return legs.groupBy("planta", "material", "estado", "tipo_stock", "evento", "fecha", F.signum("delta").cast("int").alias("signo")).agg(F.sum("delta").alias("delta"), F.sum(F.abs("delta")).alias("lineas"))

        return stored(changes(self.clean_days), "clean-changes"), changes(self.gone), changes(self.made)

    @cached_property
    def opened(self) -> DataFrame:
        return stock.stock_moves(self.gone.where(F.lit(False)), self.places, self.classes, self.snapshot)

    @cached_property
    def changes_t(self) -> DataFrame:
        """Of the changes of stock those whose event is read: the opening, what goes to customers, and what is scrapped."""
        read = "(estado = 'cliente' and evento = 'salida_cliente') or (estado = 'scrap' and evento = 'traslado_bloqueado')"
        rows = self.summed(*[t.where(read) for t in self.moved], "delta")
        return stored(self.typed(rows.drop("signo", "lineas")).drop("costo_unitario_usd").unionByName(self.opened), "changes")

    @cached_property
    def daily_t(self) -> DataFrame:
        """Balances from the changes by place and day, whatever their events."""
        place = (*stock.PLACE, "fecha")
        rows = self.summed(*[t.groupBy(*place).agg(F.sum("delta").alias("delta"), F.sum("lineas").alias("lineas")) for t in self.moved], "delta")
        return stored(stock.daily_stock(self.typed(rows.drop("lineas")).drop("costo_unitario_usd").unionByName(self.opened.drop("evento"))), "daily")

    @property
    def daily(self) -> DataFrame:
        return self.daily_t

    @cached_property
    def customer_days(self) -> DataFrame:
        """Outflows and losses. Losses are by day; of outflows no model of the worlds reads the day, but only whether it lies behind that of
        a world's last loss, less the age of reconciliation: they are summed up between these days, and stand on the last day that they
        have there."""
        key = ("planta", "cliente", "material", "mov_type", "signo")
        lost, out = "mov_type = '702'", "mov_type = '621'"
        sums = (F.sum("cantidad").alias("cantidad"), F.sum("lineas").alias("lineas"))
        by_day = lambda t: t.where(lost).groupBy(*key, "fecha_contab").agg(*sums)
        losses = stored(self.summed(*map(by_day, (self.clean_days, self.gone, self.made)), "cantidad"), "world-losses")
        last = losses.groupBy(self.world.alias("mundo")).agg(F.max("fecha_contab").alias("ultima"))
        cuts = stored(last.agg(F.collect_set(F.date_sub("ultima", self.v.antiguedad_conciliacion_dias)).alias("cortes")), "cuts")
        between = F.size(F.filter("cortes", lambda c: F.col("fecha_contab") > c))
        days = [t.where(out).crossJoin(F.broadcast(cuts)).withColumn("tramo", between) for t in (self.clean_days, self.gone, self.made)]
        held = [t.groupBy("tramo").agg(F.max("fecha_contab").alias("fecha_contab")) for t in days]
        ends = functools.reduce(DataFrame.unionByName, held).groupBy("tramo").agg(F.max("fecha_contab").alias("fecha_contab"))
        outflows = self.summed(*[t.groupBy(*key, "tramo").agg(*sums) for t in days], "cantidad").join(F.broadcast(ends), "tramo").drop("tramo")
        return stored(self.typed(losses.unionByName(outflows).drop("signo")), "world-flows")

    @cached_property
    def moves_days(self) -> DataFrame:
        return self.customer_days

    def account_sums(self, days: DataFrame) -> DataFrame:
        rows = cycle.account_movements(days, self.no_snapshot).drop("tipo_material", "en_foto")
        return day_totals(rows)

    @cached_property
    def changed(self) -> DataFrame:
        """What faults change in the days of accounts: what they bring less what they take away."""
        less = self.account_sums(self.gone).withColumns({c: -F.col(c) for c in SIZES})
        return stored(day_totals(less.unionByName(self.account_sums(self.made))).where("cantidad_abs <> 0"), "world-changed")

    @cached_property
    def touched(self) -> DataFrame:
        """The accounts that a world's fault changes."""
        return stored(self.changed.select(*[F.col(c).alias(f"_{c}") for c in cycle.ACCOUNT]).distinct(), "world-touched")

    @cached_property
    def account_days(self) -> DataFrame:
        """The accounts that have to be run: those of the clean world, and in each other those that its fault changes. A fault that
        leaves an account's days as they are leaves its balances and tranches too; masters change their types alone."""
        clean = stored(self.account_sums(self.clean_days), "clean-accounts")
        every = clean.withColumn("planta", F.concat(F.lit(f"{CLEAN}|"), "planta"))
        if self.marked:
            there = self.spread(clean, among=self.marked).join(self.touched, same_account(), "left_semi")
            every = every.unionByName(day_totals(there.unionByName(self.changed)).where("cantidad_abs <> 0"))
        return stored(every.withColumns({"tipo_material": F.lit(None).cast("string"), "en_foto": F.lit(False)}), "world-accounts")

    def of_accounts(self, found: DataFrame, *keys: str) -> DataFrame:
        """found, rows by account and `keys` with their sum `n` from the accounts of account_days, in every world: an account that was not
        run in a world has there what it has in the clean one."""
        clean = found.where(self.world == CLEAN).withColumn("planta", F.substring_index("planta", "|", -1))
        left = self.spread(clean).join(self.touched, same_account(), "left_anti")
        every = left.unionByName(found.where(self.world != CLEAN))
        return every.groupBy(*keys).agg(F.sum("n").alias("n"))

    @cached_property
    def tranche_sums(self) -> DataFrame:
        """What the tranches of the accounts that were run sum up to by account, month of outflow, closure and age."""
        month = F.trunc("fecha_salida", "month").alias("mes")
        return stored(cycle.fifo_tranches(self.account_days).groupBy(*cycle.ACCOUNT, month, "tipo_cierre", "dias").agg(F.sum("cantidad").alias("n")), "tranche-sums")

    @cached_property
    def tranches_days(self) -> DataFrame:
        """Tranches by plant, material, month of outflow, closure and age, which is all that rates, cycles and curves read; an outflow
        stands on its month's first day."""
        sums = self.of_accounts(self.tranche_sums, "planta", "material", "mes", "tipo_cierre", "dias")
        return stored(self.typed(sums).select("planta", "material", "tipo_material", F.col("mes").alias("fecha_salida"), F.lit(False).alias("salida_en_foto"), "tipo_cierre", "dias", F.col("n").alias("cantidad")), "tranches-days")

    @cached_property
    def routes(self) -> DataFrame:
        closed = self.tranche_sums.groupBy(*cycle.ACCOUNT, "tipo_cierre", "dias").agg(F.sum("n").alias("n"))
        sums = self.typed(self.of_accounts(closed, *cycle.ACCOUNT, "tipo_cierre", "dias"))
        return cycle.routes(self.loss_days, sums.select("planta", "cliente", F.lit(False).alias("salida_en_foto"), "tipo_cierre", "dias", F.col("n").alias("cantidad")), self.v)

    @cached_property
    def keys(self) -> DataFrame:
        """mundo, n: how many different keys each world's lines have: those of the clean lines, less those of lines that a fault is on, and
        those that it gives them. All lines of a key have one mark."""
        key = ["planta", "anio_contable", "doc_material", "posicion"]
        count = lambda df: df.select(self.world.alias("mundo"), *key).distinct().groupBy("mundo").agg(F.count(F.lit(1)).alias("n"))
        again = src.dirty_lines(self.base.repeated, self.classes, self.v, mark=F.lit(-1))
        whole = self.clean_days.agg(F.sum("lineas").alias("lineas")).crossJoin(again.agg(F.count(F.lit(1)).alias("filas"))).crossJoin(again.select(*key).distinct().agg(F.count(F.lit(1)).alias("llaves")))
        whole = whole.select((F.col("lineas") - F.col("filas") + F.col("llaves")).alias("todas"))
        parts = count(self.lines_of_hit(F.col("marca"))).unionByName(count(self.lines_of_hit(F.lit(-1))).withColumn("n", -F.col("n")))
        names = self.spark.createDataFrame([(w,) for w, *_ in self.chosen], "mundo string")
        own_ = parts.groupBy("mundo").agg(F.sum("n").alias("n"))
        return names.join(own_, "mundo", "left").crossJoin(F.broadcast(whole)).select("mundo", (F.col("todas") + F.coalesce("n", F.lit(0))).alias("n"))

    @cached_property
    def snapshot(self) -> DataFrame:
        return stored(self.tables["snapshot"].withColumns({c: own(c) for c in ("material", "tipo_material")}), "world-snapshot")

    @cached_property
    def plan(self) -> tuple[DataFrame, DataFrame]:
        return self.tables["plan"], self.tables["instruction"].withColumns({c: own(c) for c in ("material", "tipo_material")})

    @cached_property
    def prices(self) -> DataFrame:
        return self.by_world(self.base.prices)

    @cached_property
    def policy(self) -> DataFrame:
        return self.by_world(self.base.policy)

    @cached_property
    def plants(self) -> DataFrame:
        return self.spread(self.base.plants)

    @cached_property
    def scenarios(self) -> DataFrame:
        return self.base.scenarios.where("escenario = 'base'")

    @cached_property
    def figures(self) -> DataFrame:
        """mundo, medida, valor of the seven figures; a figure without rows has none."""

        def one(name: str, df: DataFrame, value: Column) -> DataFrame:
            return df.groupBy(self.world.alias("mundo")).agg(value.cast("double").alias("valor")).select("mundo", F.lit(name).alias("medida"), "valor")

        # In decimals, so that a sum doesn't depend on the order of its rows, which differs between worlds.
        usd = lambda c: F.sum(c.cast("decimal(28,6)"))
        base = gap.base_gap(self.gap)
        needed = need.fleet_need(self.need)
        first = needed.groupBy(self.world.alias("mundo")).agg(F.min("semana").alias("primera"))
        week1 = needed.withColumn("mundo", self.world).join(F.broadcast(first), "mundo").where("semana = primera").drop("mundo")
        cohorts = cycle.cohort_cycle(self.rotation, self.tranches_days, self.world).where("nivel = 'flota'")
        fleet = self.fleet_t
        last = fleet.groupBy(self.world.alias("mundo")).agg(F.max("fecha_cierre").alias("ultimo"))
        closing = fleet.withColumn("mundo", self.world).join(F.broadcast(last), "mundo").where("fecha_cierre = ultimo").drop("mundo")
        cost = F.col("usd_flete") + F.col("usd_compra") + F.col("usd_desechable")
        parts = [
            one("perdida", cycle.losses_usd(self.moves_days), usd(F.col("perdida_usd"))), one("tco", cycle.cost_comparison(self.cost_t), usd(F.col("ahorro_neto_usd"))),
            one("brecha", base, usd(cost)), one("ocioso", base, usd(F.col("usd_capital_ocioso"))), one("ciclo", cohorts, F.max("ciclo_promedio_dias")),
            one("necesidad", week1, F.sum("necesidad")), one("flota", closing, F.sum("flota")),
        ]
        return functools.reduce(DataFrame.unionByName, parts)

    @cached_property
    def fleet_t(self) -> DataFrame:
        return stored(stock.weekly_fleet(self.daily_t, self.v, self.world), "world-fleet")

    @cached_property
    def identities(self) -> DataFrame:
        """mundo, medida, valor: how many rows break each identity; none where it holds."""
        carton = F.col("tipo_material").endswith("|CARTON")
        count = lambda df: df.groupBy(self.world.alias("mundo")).agg(F.count(F.lit(1)).alias("n"))
        sums = [t.groupBy("planta", "material").agg(F.sum("lineas").alias("lineas")) for t in (self.clean_days, self.gone, self.made)]
        lines = self.typed(self.summed(*sums)).groupBy(self.world.alias("mundo")).agg(F.sum("lineas").alias("lineas"))
        twice = lines.join(self.keys, "mundo").select("mundo", (F.col("lineas") - F.col("n")).alias("n"))
        low = self.daily_t.where((F.col("saldo") < 0) & ~carton)
        daily = self.account_days.groupBy(*cycle.ACCOUNT, "fecha_contab").agg(F.sum("delta_saldo").alias("delta"))
        owed = daily.withColumn("saldo", running_sum("delta", cycle.ACCOUNT, "fecha_contab")).where("saldo < 0").groupBy(*cycle.ACCOUNT).agg(F.count(F.lit(1)).alias("n"))
        owed = self.of_accounts(owed, "planta").groupBy(self.world.alias("mundo")).agg(F.sum("n").alias("n"))
        parts = {"llave": twice, "stock": count(low), "saldo": owed, "conservacion": count(self.unkept)}
        return functools.reduce(DataFrame.unionByName, [p.select("mundo", F.lit(m).alias("medida"), F.col("n").cast("double").alias("valor")) for m, p in parts.items()])

    @cached_property
    def unkept(self) -> DataFrame:
        """Weeks that change a fleet by other than its opening stock and its recognised losses."""
        keys = ["planta", "material", "semana"]
        returnable = ~F.col("tipo_material").endswith("|CARTON")
        w = Window.partitionBy("planta", "material").orderBy("semana")
        change = self.fleet_t.where(returnable).withColumn("n", F.col("flota") - F.coalesce(F.lag("flota").over(w), F.lit(0))).select(*keys, "n")
        lost = self.customer_days.where("mov_type = '702'").select("planta", "material", stock.week("fecha_contab").alias("semana"), (-F.abs("cantidad")).cast("long").alias("n"))
        opened = self.snapshot.select("planta", "material", stock.week("fecha").alias("semana"), F.col("cantidad").cast("long").alias("n"))
        moved = lost.unionByName(opened).groupBy(*keys).agg(F.sum("n").alias("m"))
        return change.join(moved, keys, "full").where("coalesce(n, 0) <> coalesce(m, 0)")

    @cached_property
    def measured(self) -> DataFrame:
        """mundo, tipo, medida, valor of every world and measurement, null where a figure has no rows."""
        kinds = [F.struct(F.lit(t).alias("tipo"), F.lit(m).alias("medida")) for t, ms in (("cifra", FIGURES), ("identidad", IDENTITIES)) for m in ms]
        grid = self.spark.createDataFrame([(w,) for w, *_ in self.chosen], "mundo string").select("mundo", F.explode(F.array(*kinds)).alias("x")).select("mundo", "x.*")
        found = stored(self.figures.unionByName(self.identities), "world-measures")
        made = grid.join(found, ["mundo", "medida"], "left")
        return made.withColumn("valor", F.when(F.col("tipo") == "identidad", F.coalesce("valor", F.lit(0.0))).otherwise(F.col("valor")))


def impact(m: VariantModels, rules: DataFrame, materiality_pct: float = 1.0) -> DataFrame:
    """Every fault by every measurement: defecto, regla, severidad, tipo, medida, valor_limpio, valor, delta, delta_pct, whether it passes
    the materiality (a figure that vanishes does, and so does an identity that no longer holds), and whether the fault's rule declares
    the figure."""
    names = m.spark.createDataFrame([(w, rule_of(w)) for w, *_ in m.chosen if w != CLEAN], "defecto string, regla string")
    all_ = m.measured
    clean = all_.where(F.col("mundo") == CLEAN).select("tipo", "medida", F.col("valor").alias("valor_limpio"))
    told = rules.select("regla", "severidad", "cifra_afectada")
    made = all_.withColumnRenamed("mundo", "defecto").join(F.broadcast(names), "defecto").join(F.broadcast(clean), ["tipo", "medida"]).join(F.broadcast(told), "regla", "left")
    figure = F.col("tipo") == "cifra"
    made = made.withColumn("delta", rounded(F.col("valor") - F.col("valor_limpio"), 6))
    made = made.withColumn("delta_pct", F.when(figure, rounded((ratio("valor", "valor_limpio") - 1) * 100, 4)))
    moved = F.when(F.col("valor").isNull(), F.col("valor_limpio").isNotNull()).otherwise(F.abs("delta_pct") > materiality_pct)
    words = F.split(F.coalesce("cifra_afectada", F.lit("")), " ")
    declared = F.when(figure, F.array_contains(words, "todas") | F.array_contains(words, F.col("medida")))
    return made.select(
        "defecto", "regla", "severidad", "tipo", "medida", rounded("valor_limpio", 6).alias("valor_limpio"), rounded("valor", 6).alias("valor"), "delta", "delta_pct",
        F.when(figure, F.coalesce(moved, F.lit(False))).otherwise(F.col("valor") > 0).alias("supera_materialidad"), declared.alias("declarada"),
    )


def undeclared(found: DataFrame) -> DataFrame:
    """Figures that a fault moves past the materiality and its rule does not declare."""
    return found.where("tipo = 'cifra' and supera_materialidad and not declarada").select("defecto", "regla", "medida", "delta_pct")


def severity(found: DataFrame) -> DataFrame:
    """Each fault's measured severity beside its rule's: `bloquea` where it moves a figure or breaks an identity."""
    by = found.groupBy("defecto", "regla", "severidad").agg(F.count_if((F.col("tipo") == "cifra") & F.col("supera_materialidad")).alias("cifras"), F.count_if((F.col("tipo") == "identidad") & F.col("supera_materialidad")).alias("identidades"))
    return by.withColumn("medida", F.when(F.col("cifras") + F.col("identidades") > 0, "bloquea").otherwise("alerta"))
