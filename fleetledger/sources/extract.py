"""Adapters from text extracts of an ERP to the input contract. Nothing is corrected: what cannot be read is null and the
contract checks report it; a missing required field stops at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import unsorted_writes

REQUIRED = ("WERKS", "MATNR", "MAKTX", "BWART", "BUDAT", "CPUDT", "CPUTM", "MENGE", "MEINS", "MBLNR", "ZEILE")
OPTIONAL = ("LGORT", "MJAHR", "LIFNR", "KUNNR", "XBLNR", "SHKZG", "DMBTR", "WAERS")
MASTER_REQUIRED = ("WERKS", "MATNR", "MAKTX", "MTART", "MATKL", "MEINS", "PEINH")
MASTER_OPTIONAL = ("VERPR", "STPRS", "VPRSV", "WAERS")
#: Stock columns whose sum is what a place, or a customer, holds.
STORED = ("LABST", "UMLME", "INSME", "EINME", "SPEME", "RETME")
HELD = ("KULAB", "KUINS", "KUEIN")
UNITS = {"ST": "PC", "PCE": "PC", "C62": "PC", "KGM": "KG"}


#: What a text extract's rows carry beside their fields: the whole record where it is broken, and the file that it stands in.
BROKEN, FILE = "_roto", "archivo"


def read_names(spark: SparkSession, path: str) -> dict[str, str]:
    """A header map: CSV with `columna`, a header as the file has it, and `campo`, the technical name."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path).collect()  # a row a column of the extract
    return {r["columna"]: r["campo"].upper() for r in rows}


def read_text(spark: SparkSession, path: str, separator: str = ";", names: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV extracts, a file, a folder or a glob, every column as text; `names` gives the technical names of other headers, `columns`
    those of files without a header. A record with too few fields or too many is no error: it is kept whole in BROKEN. FILE is the
    file's name, or where files stand in folders planta=..., that folder's, by which scans are pruned."""
    text = spark.read.option("sep", separator).option("inferSchema", False)
    found = columns or [c for c in text.option("header", True).csv(path).columns if c != "planta"]
    fields = ", ".join(f"`{c}` string" for c in (*found, BROKEN))
    # A record is judged by all its fields, whichever of them a query reads.
    rows = text.schema(fields).option("columnPruning", False).option("header", columns is None).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).csv(path)
    at = F.col("_metadata.file_path")
    folder = F.regexp_extract(at, r"/(planta=[^/]+)/", 1)
    return rows.select("*", F.when(folder != "", folder).otherwise(F.col("_metadata.file_name")).alias(FILE)).withColumnsRenamed(names or {})


def write_text(rows: DataFrame, path: str) -> None:
    """Lines of text (planta, linea) in a folder for each plant, gzipped, and in the order in which they come."""
    with unsorted_writes(rows.sparkSession):
        rows.select("planta", "linea").write.partitionBy("planta").option("compression", "gzip").text(path)


def extract_failures(rows: DataFrame, table: str, required: tuple[str, ...] = REQUIRED, decimal: str = ",", date_format: str = "dd.MM.yyyy") -> DataFrame:
    """What the movement extract's rows (of read_text) fail, all checks in one pass: tabla, archivo, columna, chequeo, valor, llave. A
    broken record fails as a whole."""
    demand(rows, required, "the movement extract")
    fault = lambda cond, column, check, value: F.when(cond, F.struct(F.lit(column).cast("string").alias("columna"), F.lit(check).alias("chequeo"), value.cast("string").alias("valor")))
    whole = F.col(BROKEN).isNull()
    faults = [fault(~whole, None, "registro_roto", F.col(BROKEN))]
    faults += [fault(whole & text(c).isNull(), c, "not_nullable", F.lit(None)) for c in required]
    faults += [fault(whole & text(c).isNotNull() & number(c, decimal).isNull(), c, "no_es_numero", F.col(c)) for c in ("MENGE", "DMBTR") if c in rows.columns]
    faults += [fault(whole & text(c).isNotNull() & F.expr(f"try_to_timestamp({c}, '{date_format}')").isNull(), c, "no_es_fecha", F.col(c)) for c in ("BUDAT", "CPUDT")]
    key = F.when(whole, F.concat_ws("|", text("MBLNR"), text("ZEILE")))
    found = rows.select(FILE, key.alias("llave"), F.explode(F.array(*faults)).alias("x")).where("x is not null")
    return found.select(F.lit(table).alias("tabla"), FILE, "x.*", "llave")


def text(name: str) -> Column:
    """Trimmed text; nothing is null."""
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def number(name: str, decimal: str) -> Column:
    """1.234,50 or 1,234.50 by the decimal mark, with the minus sign behind."""
    plain = F.replace(F.col(name), F.lit("." if decimal == "," else ","), F.lit(""))
    plain = F.replace(plain, F.lit(","), F.lit(".")) if decimal == "," else plain
    value = F.rtrim(plain, F.lit("-")).try_cast("double")
    return F.when(plain.endswith("-"), -value).otherwise(value)


def padded(c: Column, n: int) -> Column:
    """Zeros in front up to n characters; longer texts stay whole."""
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def demand(df: DataFrame, required: tuple[str, ...], what: str) -> None:
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{what} lacks {', '.join(missing)}")


def completed(df: DataFrame, required: tuple[str, ...], optional: tuple[str, ...]) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(*[text(c).alias(c) for c in required], *[(text(c) if c in df.columns else none).alias(c) for c in optional])


def unit(c: str, units: dict[str, str]) -> Column:
    """Known units by their contract name, others as they are."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in units.items() for x in p]), F.col(c)), F.col(c))


def movements(raw: DataFrame, units: dict[str, str] = UNITS, decimal: str = ",", date_format: str = "dd.MM.yyyy") -> DataFrame:
    """The 17 contract columns of the movement ledger. A debit/credit mark gives the sign where there is one; document prices
    count only in USD and above zero."""
    demand(raw, REQUIRED, "the movement extract")
    c = completed(raw, REQUIRED, OPTIONAL).withColumns({"n": number("MENGE", decimal), "usd": number("DMBTR", decimal), "day": F.expr(f"to_date(try_to_timestamp(BUDAT, '{date_format}'))")})
    signed = F.when(F.col("SHKZG") == "H", -F.abs("n")).when(F.col("SHKZG") == "S", F.abs("n")).otherwise(F.col("n"))
    clock = F.regexp_replace(padded(F.replace(F.col("CPUTM"), F.lit(":"), F.lit("")), 6), r"^(\d{2})(\d{2})(\d{2})$", "$1:$2:$3")
    price = F.when((F.col("WAERS") == "USD") & (F.col("usd") > 0), F.round(F.try_divide(F.col("usd"), F.abs("n")), 2))
    return c.select(
        F.col("WERKS").alias("Werks"), F.col("LGORT").alias("Lgort"), F.col("MATNR").alias("Matnr"), F.col("MAKTX").alias("Maktx"), F.col("BWART").alias("Bwart"),
        F.coalesce(F.col("MJAHR").try_cast("long"), F.year("day").cast("long")).alias("Mjahr"), F.col("day").alias("Budat"), F.expr(f"to_date(try_to_timestamp(CPUDT, '{date_format}'))").alias("Cpudt"),
        clock.alias("Cputm"), signed.cast("long").alias("Menge"), unit("MEINS", units).alias("Meins"), F.col("MBLNR").alias("Mblnr"), padded(F.col("ZEILE"), 4).alias("Zeile"),
        F.col("LIFNR").alias("Lifnr"), F.col("KUNNR").alias("Kunnr"), F.col("XBLNR").alias("Xblnr"), price.alias("Costo_usd"),
    )


def master(raw: DataFrame, units: dict[str, str] = UNITS, decimal: str = ",", currency: str | None = None) -> DataFrame:
    """The material master. The price control says which price counts: the standard price, or else the moving one."""
    demand(raw, MASTER_REQUIRED, "the master extract")
    if not {"VERPR", "STPRS"} & set(raw.columns):
        raise ValueError("the master extract has no price: VERPR or STPRS")
    if "WAERS" not in raw.columns and currency is None:
        raise ValueError("the master extract has no WAERS and no currency is given")
    c = completed(raw, MASTER_REQUIRED, MASTER_OPTIONAL)
    price = F.when(F.col("VPRSV") == "S", number("STPRS", decimal)).otherwise(F.coalesce(number("VERPR", decimal), number("STPRS", decimal)))
    return c.select(
        F.col("WERKS").alias("Werks"), F.col("MATNR").alias("Matnr"), F.col("MAKTX").alias("Maktx"), F.col("MTART").alias("Mtart"), F.col("MATKL").alias("Matkl"), unit("MEINS", units).alias("Meins"),
        price.alias("Verpr"), F.col("PEINH").try_cast("long").alias("Peinh"), F.coalesce("WAERS", F.lit(currency)).alias("Waers"),
    )


def stock(raw: DataFrame, holder: str, columns: tuple[str, ...], decimal: str = ",") -> DataFrame:
    """Stock by place (holder LGORT) or by customer (KUNNR): the sum of the stock columns that there are; of special stock
    only that at customers (V); zeros are left out."""
    demand(raw, ("WERKS", "MATNR", holder), "the stock extract")
    have = [c for c in (*columns, "MENGE") if c in raw.columns]
    if not have:
        raise ValueError(f"the stock extract has no quantity: {', '.join(columns)} or MENGE")
    rows = raw.where(text("SOBKZ") == "V") if "SOBKZ" in raw.columns else raw
    total = sum((F.coalesce(number(c, decimal), F.lit(0.0)) for c in have), F.lit(0.0))
    return rows.select(text("WERKS").alias("Werks"), text(holder).alias(holder.capitalize()), text("MATNR").alias("Matnr"), total.cast("long").alias("Menge")).where("Menge <> 0")


def roll_back(closing: DataFrame, moves: DataFrame, places: DataFrame, day) -> DataFrame:
    """The snapshot before the first movement: what stands at the close less all that moved. Places are those of the cycle and
    those that the closing snapshot names; customer accounts are those of plants that it has customer stock for."""
    key = ("planta", "almacen", "material", "cliente")
    none, n = F.lit(None).cast("string"), F.col("cantidad").cast("long")
    scope = places.where("estado <> 'fuera_ciclo'").select("almacen").unionByName(closing.where("almacen is not null").select("almacen")).distinct()
    stored = moves.join(F.broadcast(scope), "almacen", "left_semi").select("planta", "almacen", "material", none.alias("cliente"), (-n).alias("cantidad"))
    plants = closing.where("cliente is not null").select("planta").distinct()
    at = moves.where(F.col("mov_type").isin("621", "622", "702")).join(F.broadcast(plants), "planta", "left_semi")
    held = at.select("planta", none.alias("almacen"), "material", "cliente", F.when(F.col("mov_type") == "621", -F.abs(n)).otherwise(F.abs(n)).alias("cantidad"))
    every = closing.select(*key, "cantidad").unionByName(stored).unionByName(held)
    return every.groupBy(*key).agg(F.sum("cantidad").alias("cantidad")).where("cantidad <> 0").withColumn("fecha", F.lit(day))


def as_extract(ledger: DataFrame) -> DataFrame:
    """The ledger as an ERP would print it: all text, comma decimals, thousands by dots, the minus sign behind."""
    n = F.abs(F.col("cantidad").cast("long"))
    shown = F.concat(F.regexp_replace(n.cast("string"), r"(\d)(?=(\d{3})+$)", "$1."), F.lit(",000"), F.when(F.col("cantidad") < 0, "-").otherwise(""))
    day = F.date_format("fecha_contab", "dd.MM.yyyy")
    return ledger.select(
        F.col("planta").alias("WERKS"), F.coalesce("almacen", F.lit("  ")).alias("LGORT"), F.concat(F.lit(" "), "material").alias("MATNR"), F.concat(F.lit("Contenedor "), "material").alias("MAKTX"), F.col("mov_type").alias("BWART"),
        day.alias("BUDAT"), day.alias("CPUDT"), F.lit("90507").alias("CPUTM"), shown.alias("MENGE"), F.lit("ST").alias("MEINS"), F.col("doc_material").alias("MBLNR"), F.col("posicion").cast("string").alias("ZEILE"),
        F.coalesce("cliente", F.lit("")).alias("KUNNR"), F.concat((n * 25).cast("string"), F.lit(",50")).alias("DMBTR"), F.when(F.col("posicion") % 2 == 0, "USD").otherwise("MXN").alias("WAERS"),
    )
