"""Faults planted by quota: each kind takes from each plant a share of its universe, at least one line, and never a document that
another kind has.

Targets are the candidates with the smallest hashes. One pass over the lines keeps, of every kind, those whose hash is below a cut that
some twice the quota should fall under; a kind whose list turns out too short goes over all lines. Which are the smallest follows from
histograms of the hash, digit by digit: all candidates before the digit at which the quota is reached are taken, those with it are
looked at closer, and only a last handful is ranked. No plant is sorted, and none is the work of one task.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import as_of, running_sums
from ..functions.tables import beside_hashes, stored
from .ledger import PIEZAS, dirty_lines

DOC = ("planta", "anio_contable", "doc_material")
KEY = (*DOC, "posicion")
#: Bits of a hash and of a histogram's digit; candidates that are ranked at most, but for equal hashes.
BITS, DIGIT, LAST = 60, 12, 5000
#: How many times a quota, and how many lines besides, are expected below a kind's cut.
SPARE = (2, 1000)
#: Fixed value: how many customers a code of the derived ledger stands for where faults are planted.
FINER = 1009


class Kind(NamedTuple):
    """A kind of fault: its rule, the lines that its rate counts, those that it can hit, the rate, and the field that it changes."""

    defecto: str
    regla: str
    universo: str
    candidatos: str
    tasa: float
    campo: str


#: Kinds in the order in which they choose. Rates of a common catalogue of faults.
KINDS = [
    Kind("D01", "llave_duplicada", "true", "true", 0.0005, "linea"),
    Kind("D02", "bwart_fuera_de_catalogo", "mov_type = '621'", "mov_type = '621'", 0.001, "mov_type"),
    Kind("D03", "lgort_fuera_de_catalogo", "mov_type = '621'", "mov_type = '621' and almacen is not null", 0.0005, "almacen"),
    Kind("D04", "cliente_vacio", "mov_type = '621'", "mov_type = '621' and cliente is not null", 0.0005, "cliente"),
    Kind("D05", "signo_invertido", "true", "cantidad <> 0", 0.0002, "cantidad"),
    Kind("D06", "cantidad_en_piezas", "mov_type = '621'", "mov_type = '621'", 0.002, "cantidad"),
    Kind("D07", "recogida_sin_saldo", "mov_type = '622'", "mov_type = '622' and libres > 0", 0.0005, "cliente"),
    Kind("D08", "registro_despues_del_cierre", "true", "true", 0.001, "fecha_registro"),
]


def finer_customers(ledger: DataFrame) -> DataFrame:
    """The ledger with many customers for each code, so that not every customer gets every material."""
    order = F.expr("try_cast(substring(doc_material, 2, 10) as bigint)") % FINER
    return ledger.withColumn("cliente", F.concat("cliente", F.lit("-"), order.cast("string")))


def clean_lines(ledger: DataFrame, classes: DataFrame) -> DataFrame:
    return dirty_lines(ledger, classes, mark=F.lit(-1))


def drawn_digits(*parts) -> Column:
    """BITS bits of the MD5 of the parts, as hexadecimal digits."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if p in KEY else F.lit(p) for p in parts])
    return F.substring(F.md5(text.cast("binary")), 1, BITS // 4)


def draw(*parts) -> Column:
    """BITS bits of the MD5 of the parts."""
    return F.conv(drawn_digits(*parts), 16, 10).cast("long")


def smallest(candidates: DataFrame, wanted: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Of each planta the `n` rows (wanted: planta, n) with the smallest h, ties by key; all where there are fewer."""
    rows, taken = candidates.join(wanted, "planta"), []
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        rows = rows.withColumn("_b", F.shiftright("h", shift))
        count = rows.groupBy("planta", "n", "_b").agg(F.count(F.lit(1)).alias("size"))
        upto = F.sum("size").over(Window.partitionBy("planta").orderBy("_b"))  # 2**DIGIT rows a plant
        total = F.sum("size").over(Window.partitionBy("planta"))
        count = count.withColumn("upto", upto).withColumn("quota", F.least(F.col("n"), total))
        at = stored(count.where("quota > 0 and upto >= quota and upto - size < quota").select("planta", F.col("_b").alias("_at"), (F.col("quota") - F.col("upto") + F.col("size")).alias("_rest"), "size"), "quota-digit")
        met = rows.join(at.drop("size"), "planta")
        taken.append(met.where("_b < _at").select(*candidates.columns))
        rows = met.where("_b = _at").withColumn("n", F.col("_rest")).drop("_b", "_at", "_rest")
        if (at.agg(F.max("size")).first()[0] or 0) <= LAST:
            break
    rank = F.row_number().over(Window.partitionBy("planta").orderBy("h", *key))
    taken.append(rows.withColumn("_n", rank).where("_n <= n").select(*candidates.columns))
    return functools.reduce(DataFrame.unionByName, taken)


def free_customers(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a plant's materials have not been shipped to, without a row for each pair: the plant's customers numbered from 0
    (planta, cliente, numero); how many are free for each material (planta, material, libres); and steps (planta, material, hueco,
    antes): `antes` taken customers stand before the free one whose number among the free is `hueco` or more."""
    shipped = stored(lines.where("mov_type = '621' and cliente is not null").select("planta", "material", "cliente").distinct(), "shipped-to")
    one = F.lit(1).cast("long")
    customers = running_sums(shipped.select("planta", "cliente").distinct(), ["planta"], ["cliente"], {"n": one})
    customers = stored(customers.select("planta", "cliente", (F.col("n") - 1).alias("numero")), "customers")
    taken = running_sums(shipped.join(customers, ["planta", "cliente"]), ["planta", "material"], ["numero"], {"antes": one})
    steps = taken.groupBy("planta", "material", (F.col("numero") - F.col("antes") + 1).alias("hueco")).agg(F.max("antes").alias("antes"))
    all_ = customers.groupBy("planta").agg(F.count(F.lit(1)).alias("todos"))
    free = shipped.groupBy("planta", "material").agg(F.count(F.lit(1)).alias("usados")).join(all_, "planta").select("planta", "material", (F.col("todos") - F.col("usados")).alias("libres"))
    return customers, free, steps


def strangers(rows: DataFrame, customers: DataFrame, steps: DataFrame) -> DataFrame:
    """rows (planta, material, libres and the key) with a customer of the plant that never got the material, as `nuevo`: the draw's
    number among the free, moved on by the taken ones before it."""
    drawn = rows.withColumn("hueco", draw("cliente", *KEY) % F.col("libres"))
    placed = as_of(drawn, steps, ["planta", "material"], "hueco", "antes")
    number = F.col("hueco") + F.coalesce("antes", F.lit(0))
    named = customers.select("planta", F.col("numero").alias("_n"), F.col("cliente").alias("nuevo"))
    return placed.withColumn("_n", number).join(named, ["planta", "_n"]).drop("_n", "hueco", "antes")


def injected_value(kind: Kind) -> Column:
    """What the fault writes into its field, as text; null for none."""
    text = lambda c: c.cast("string")
    pieces = F.col("cantidad") * (PIEZAS + F.split("material", "-")[1].cast("long"))
    return {
        "D01": F.lit("copia"), "D02": F.lit("999"), "D03": F.lit("XX99"), "D04": F.lit(None).cast("string"), "D05": text(-F.col("cantidad")),
        "D06": text(pieces), "D08": text(F.date_add(F.last_day("fecha_contab"), 15)),
    }[kind.defecto]


LOG = ("defecto", "regla", *KEY, "material", "campo", "valor_original", "valor_inyectado")


def shortlists(lines: DataFrame, universe: DataFrame, kinds: list[Kind]) -> DataFrame:
    """lines below the cuts, once for each kind that they are candidates of (`_tipo`), with their hash as h; universe has a kind's
    candidates in a plant as c_<kind> and its quota as n_<kind>. No kind has a cut where all candidates would be below it."""

    def cut(k: Kind) -> Column:
        wanted = F.col(f"n_{k.defecto}") * SPARE[0] + SPARE[1]
        digits = F.lpad(F.lower(F.hex(F.floor(wanted / F.col(f"c_{k.defecto}") * 2.0**BITS).cast("long"))), BITS // 4, "0")
        return F.when(F.col(f"c_{k.defecto}") > wanted, digits).otherwise("g").alias(f"_{k.defecto}")  # g: behind all digits

    cuts = universe.select("planta", *[cut(k) for k in kinds])
    below = lambda k: F.expr(k.candidatos) & (drawn_digits(k.defecto, *KEY) < F.col(f"_{k.defecto}"))
    mine = F.explode(F.array(*[F.when(below(k), F.struct(F.lit(k.defecto).alias("tipo"), draw(k.defecto, *KEY).alias("h"))) for k in kinds])).alias("_x")
    found = lines.join(F.broadcast(cuts), "planta").select(*lines.columns, mine).where("_x is not null")
    return found.select(*lines.columns, F.col("_x.tipo").alias("_tipo"), F.col("_x.h").alias("h"))


def targets(lines: DataFrame, kinds: list[Kind] | None = None) -> DataFrame:
    """The log of faults to plant: defecto, regla, the line's key and material, campo, valor_original, valor_inyectado. A kind's
    quota in a plant is max(1, round(rate x universe)), none where the rate is zero, and never more than its candidates; kinds choose
    one after the other, and documents that one has touched are no candidates of the next. Lines are read three times: for who got
    what, for the quotas, and for the short lists."""
    kinds = [k for k in (KINDS if kinds is None else kinds) if k.tasa > 0]
    customers, free, steps = free_customers(lines)
    lines = lines.join(F.broadcast(free), ["planta", "material"], "left").withColumn("libres", F.coalesce("libres", F.lit(0)))
    counts = lines.groupBy("planta").agg(*[F.count_if(F.expr(e)).alias(f"{c}_{k.defecto}") for k in kinds for c, e in (("u", k.universo), ("c", k.candidatos))])
    quota = lambda k: F.greatest(F.lit(1), F.round(F.col(f"u_{k.defecto}") * k.tasa)).cast("long")
    universe = stored(counts.withColumns({f"n_{k.defecto}": quota(k) for k in kinds}), "universe")
    near = stored(shortlists(lines, universe, kinds), "quota-near")
    found: list[DataFrame] = []
    for kind in kinds:
        untouched = lambda df: df
        if found:
            touched = functools.reduce(DataFrame.unionByName, [f.select(*DOC) for f in found]).distinct()
            untouched = lambda df, t=touched: df.join(t, list(DOC), "left_anti")
        own = universe.select("planta", F.col(f"n_{kind.defecto}").alias("n"), F.col(f"c_{kind.defecto}").alias("_c"))
        mine = untouched(near.where(F.col("_tipo") == kind.defecto).drop("_tipo"))
        # Where documents that others have leave a cut list too short, more than the list is needed.
        enough = own.where(F.col("_c") > F.col("n") * SPARE[0] + SPARE[1]).join(mine.groupBy("planta").agg(F.count(F.lit(1)).alias("_m")), "planta", "left")
        if not enough.where("coalesce(_m, 0) < n").isEmpty():
            mine = untouched(lines.where(kind.candidatos)).withColumn("h", draw(kind.defecto, *KEY))
        chosen = stored(smallest(mine, own.select("planta", "n")), "quota-chosen")
        if kind.defecto == "D07":
            chosen = strangers(chosen, customers, steps).withColumn("valor_inyectado", F.col("nuevo"))
        else:
            chosen = chosen.withColumn("valor_inyectado", injected_value(kind))
        old = F.lit(None).cast("string") if kind.campo == "linea" else F.col(kind.campo).cast("string")
        found.append(stored(chosen.select(F.lit(kind.defecto).alias("defecto"), F.lit(kind.regla).alias("regla"), *KEY, "material", F.lit(kind.campo).alias("campo"), old.alias("valor_original"), "valor_inyectado"), "quota-log"))
    return functools.reduce(DataFrame.unionByName, found)


def planted(lines: DataFrame, log: DataFrame, classes: DataFrame) -> DataFrame:
    """The lines with the log's faults. Lines without one are told by the hash of their key and stay where they are."""
    faults = log.select(*KEY, F.col("campo").alias("_campo"), F.col("valor_inyectado").alias("_valor"))
    kinds = {"mov_type": "string", "almacen": "string", "cliente": "string", "cantidad": "long", "fecha_registro": "date"}
    lines = lines.drop("evento")
    lines = lines.select(*[c for c in lines.columns if c not in kinds], *[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    hashes = log.select(F.xxhash64(*[F.col(c).cast(lines.schema[c].dataType) for c in KEY]).alias("_h")).distinct()
    told = beside_hashes(lines, F.xxhash64(*KEY), hashes, "_h")
    met = stored(told.where("_h is not null").drop("_h"), "quota-hit").join(faults, list(KEY), "left")
    put = lambda c, kind: F.when(F.col("_campo") == c, F.col("_valor").cast(kind)).otherwise(F.col(c)).alias(c)
    copies = F.explode(F.when(F.col("_campo") == "linea", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copia")
    hit = met.select(*[put(c, kinds[c]) if c in kinds else c for c in lines.columns], copies).drop("_copia")
    return told.where("_h is null").drop("_h").unionByName(hit).join(F.broadcast(classes), "mov_type", "left")
