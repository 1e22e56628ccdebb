"""The input contract: every check of a table runs in one pass, and what fails becomes rows; nothing stops."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """What a column must hold. Checks other than non-null pass nulls."""

    name: str
    nullable: bool = False
    length: tuple[int, int] | None = None
    among: tuple[str, ...] | None = None
    least: float | None = None
    most: float | None = None
    above: float | None = None
    optional: bool = False  # may be missing from the table

    def checks(self) -> list[tuple[str, Column]]:
        """Names of checks with the condition under which each fails."""
        c, out = F.col(self.name), []
        if not self.nullable:
            out.append(("not_nullable", c.isNull()))
        if self.length:
            out.append((f"str_length({self.length[0]}, {self.length[1]})", ~F.length(c).between(*self.length)))
        if self.among:
            out.append((f"isin({', '.join(self.among)})", ~c.isin(*self.among)))
        if self.least is not None:
            out.append((f"ge({self.least})", c < self.least))
        if self.most is not None:
            out.append((f"le({self.most})", c > self.most))
        if self.above is not None:
            out.append((f"gt({self.above})", c <= self.above))
        return out


@dataclass(frozen=True)
class Contract:
    table: str
    fields: tuple[Field, ...]
    unique: tuple[str, ...] = ()
    strict: bool = True
    rows: dict[str, str] = field(default_factory=dict)


MOVEMENTS = Contract(
    "raw_mb51",
    (
        Field("planta", length=(2, 12)), Field("almacen", nullable=True, length=(4, 12)), Field("material", length=(1, 40)), Field("mov_type", length=(3, 3)),
        Field("anio_contable", least=1990, most=2100), Field("fecha_contab"), Field("cantidad"), Field("doc_material", length=(10, 40)), Field("posicion", least=1),
        Field("cliente", nullable=True, length=(1, 3)), Field("costo_unitario_usd", nullable=True, above=0),
    ),
    strict=False,
)
#: The movement list as an ERP's adapter gives it: 17 columns, and six that it may have. Names and limits.
MB51 = Contract(
    "mb51",
    (
        Field("Werks", length=(4, 12)), Field("Lgort", nullable=True, length=(4, 12)), Field("Matnr", length=(1, 40)), Field("Maktx", length=(1, 40)), Field("Bwart", length=(3, 3)), Field("Mjahr", least=1990, most=2100),
        Field("Budat"), Field("Cpudt"), Field("Cputm", length=(6, 8)), Field("Menge"), Field("Meins", among=("PC", "EA", "KG")), Field("Mblnr", length=(10, 10)), Field("Zeile", length=(4, 4)),
        Field("Lifnr", nullable=True, length=(1, 12)), Field("Kunnr", nullable=True, length=(1, 12)), Field("Xblnr", nullable=True, length=(1, 16)), Field("Costo_usd", nullable=True, above=0),
        Field("Ebeln", nullable=True, length=(10, 10), optional=True), Field("Ebelp", nullable=True, least=1, optional=True), Field("Sgtxt", nullable=True, length=(1, 50), optional=True),
        Field("Umwrk", nullable=True, length=(4, 4), optional=True), Field("Umlgo", nullable=True, length=(4, 4), optional=True), Field("Usnam", nullable=True, length=(1, 12), optional=True),
    ),
    strict=False,
)
SNAPSHOT = Contract(
    "raw_stock_inicial",
    (Field("planta", length=(2, 12)), Field("material", length=(1, 40)), Field("cantidad", least=0), Field("fecha")),
    unique=("planta", "almacen", "material", "cliente"),
    strict=False,
    rows={"exactly one of almacen and cliente": "(almacen is null) <> (cliente is null)"},
)

MASTER = Contract(
    "raw_maestro_materiales",
    (
        Field("planta", length=(2, 12)), Field("material", length=(1, 40)), Field("grupo_articulos", length=(1, 9)), Field("precio", nullable=True, least=0), Field("unidad_precio", above=0),
        Field("moneda", length=(3, 3)),
    ),
    unique=("planta", "material"),
    strict=False,
)
PARTS = Contract("raw_partes", (Field("planta", length=(2, 12)), Field("parte", length=(1, 40))), unique=("planta", "parte"))
INSTRUCTION = Contract(
    "raw_instruccion_empaque",
    (Field("planta", length=(2, 12)), Field("parte", length=(1, 40)), Field("material", length=(1, 40)), Field("tipo_material", nullable=True, among=("KLT", "RACK", "CARTON")), Field("piezas_por_contenedor", least=0)),
    unique=("planta", "parte"),
)
PLAN = Contract("raw_plan_produccion", (Field("planta", length=(2, 12)), Field("parte", length=(1, 40)), Field("semana"), Field("piezas", least=0)), unique=("planta", "parte", "semana"))
#: Table, its contract, and the key that a failure names.
TABLES = [
    ("movements", MOVEMENTS, ("doc_material", "posicion")), ("master", MASTER, ("planta", "material")), ("snapshot", SNAPSHOT, ("planta", "material")),
    ("parts", PARTS, ("planta", "parte")), ("instruction", INSTRUCTION, ("planta", "parte")), ("plan", PLAN, ("planta", "parte", "semana")),
]


def failures(df: DataFrame, contract: Contract, key: tuple[str, ...]) -> DataFrame:
    """tabla, columna, chequeo, valor and the row's key, for every check that a row, a key or the schema fails; with the row's file as
    `archivo` where df has such a column (inputs.plant_files), null for what no one row fails."""
    told = ["archivo"] if "archivo" in df.columns else []
    spark, have, empty = df.sparkSession, set(df.columns), F.lit(None).cast("string")
    wanted = [f.name for f in contract.fields]
    named = [(f.name, "column_in_dataframe", None) for f in contract.fields if f.name not in have and not f.optional] + [(n, "column_in_schema", None) for n in df.columns if contract.strict and n not in wanted and n not in told]
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in key])
    bad = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(f.name).alias("columna"), F.lit(name).alias("chequeo"), F.col(f.name).cast("string").alias("valor"))) for f in contract.fields if f.name in have for name, cond in f.checks()]
    bad += [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.struct(empty.alias("columna"), F.lit(name).alias("chequeo"), empty.alias("valor"))) for name, rule in contract.rows.items()]
    # No filter over all checks at once: pushed below df's own projections, each of whose columns is then either name in it, it would
    # be planned in as many forms as there are choices, 2 to the number of columns.
    found = df.select(*told, text.alias("llave"), F.explode(F.array(*bad)).alias("x")).where("x is not null").select(*told, "x.*", "llave")
    if contract.unique:
        twice = df.groupBy(*contract.unique).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        twice = twice.select(F.lit(",".join(contract.unique)).alias("columna"), F.lit("multiple_fields_uniqueness").alias("chequeo"), F.col("n").cast("string").alias("valor"), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in contract.unique]).alias("llave"))
        found = found.unionByName(twice, allowMissingColumns=True)
    if named:
        found = found.unionByName(spark.createDataFrame(named, "columna string, chequeo string, valor string").withColumn("llave", empty), allowMissingColumns=True)
    return found.select(F.lit(contract.table).alias("tabla"), *told, "columna", "chequeo", "valor", "llave")
