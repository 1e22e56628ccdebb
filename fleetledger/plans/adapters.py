"""Queries of the extract adapters: the engine's own tables printed as an ERP would print them, and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import shared_dir
from ..operators import contract, stock
from ..sources import extract, inputs
from .models import Models


def number_of(material: str = "material"):
    return F.split(material, "-")[1].cast("int")


def printed_master(m: Models) -> DataFrame:
    """The master as text, with a standard price and a moving one and the mark of which counts."""
    whole = F.col("precio").cast("int").cast("string")
    return m.clean_master.select(
        F.col("planta").alias("WERKS"), F.concat(F.lit(" "), "material").alias("MATNR"), F.col("material_desc").alias("MAKTX"), F.lit("VERP").alias("MTART"), F.col("grupo_articulos").alias("MATKL"),
        F.lit("ST").alias("MEINS"), F.lit("1").alias("PEINH"), F.concat(whole, F.lit(",25")).alias("VERPR"), F.concat(F.lit("1."), F.lpad(whole, 3, "0"), F.lit(",50")).alias("STPRS"),
        F.when(number_of() % 2 == 0, "S").otherwise("V").alias("VPRSV"), F.when(number_of() == 7, "MXN").otherwise("").alias("WAERS"),
    )


def printed_stock(m: Models) -> DataFrame:
    """The opening snapshot as text, part of it under inspection."""
    return m.snapshot.select(
        F.col("planta").alias("WERKS"), F.col("almacen").alias("LGORT"), F.col("material").alias("MATNR"),
        F.concat(F.col("cantidad").cast("string"), F.lit(",000")).alias("LABST"), F.when(number_of() % 3 == 0, "4,000-").otherwise("").alias("INSME"),
    )


#: Marks of records that are broken on the way: fields lacking, a field too many, a number and a date that cannot be read.
SHORT, LONG, NO_NUMBER, NO_DATE = 20, 21, 22, 23


def extract_with_faults(m: Models) -> DataFrame:
    """The ledger printed as text files, one folder a plant, some records broken, and read back: what fails, by plant and check."""
    printed = extract.as_extract(m.ledger)
    names = printed.columns
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "MBLNR", "ZEILE").cast("binary")), 1, 8), 16, 10).cast("long") % 997
    value = {"MENGE": F.when(F.col("h") == NO_NUMBER, F.lit("doce")).otherwise(F.col("MENGE")), "BUDAT": F.when(F.col("h") == NO_DATE, F.lit("31.02.2000")).otherwise(F.col("BUDAT"))}
    whole = F.concat_ws(";", *[value.get(c, F.col(c)) for c in names])
    line = F.when(F.col("h") == SHORT, F.substring_index(whole, ";", len(names) - 3)).when(F.col("h") == LONG, F.concat(whole, F.lit(";sobra"))).otherwise(whole)
    path = f"{shared_dir(m.spark)}/fleetledger/extract-{uuid.uuid4().hex}"
    extract.write_text(printed.withColumn("h", h).select(F.col("WERKS").alias("planta"), line.alias("linea")), path)
    found = extract.extract_failures(extract.read_text(m.spark, path, columns=names), "mb51")
    return found.groupBy("archivo", "columna", "chequeo").agg(F.count(F.lit(1)).alias("casos"))


def contract_by_file(m: Models) -> DataFrame:
    """The movement contract over files of each plant, with the file of what fails."""
    path = f"{shared_dir(m.spark)}/fleetledger/plants-{uuid.uuid4().hex}"
    inputs.write_as_they_come(m.lines.select(*[f.name for f in contract.MOVEMENTS.fields]), path)
    found = contract.failures(inputs.plant_files(m.spark, path), contract.MOVEMENTS, ("planta", "doc_material", "posicion"))
    return found.groupBy("tabla", "archivo", "columna", "chequeo").agg(F.count(F.lit(1)).alias("casos"))


def contract_of_17(m: Models) -> DataFrame:
    """The ledger under an ERP's plant codes and document numbers, through the adapter and against the contract of 17 columns, one of
    them lacking and one of the optional ones there, with broken values of four kinds: cases by column and check."""
    docs = stock.numbered_documents(m.ledger)
    named = m.ledger.join(docs, ["anio_contable", "fecha_contab", "doc_material"]).withColumn("doc_material", F.col("numero")).withColumn("planta", F.concat(F.lit("PLNT_"), "planta"))
    rows = extract.movements(extract.as_extract(named))
    rows = rows.withColumn("h", F.conv(F.substring(F.md5(F.concat_ws("|", "Mblnr", "Zeile").cast("binary")), 1, 8), 16, 10).cast("long") % 997)
    put = lambda h, c, x: F.when(F.col("h") == h, x).otherwise(F.col(c))
    broken = {"Meins": put(20, "Meins", F.lit("XX")), "Mblnr": put(21, "Mblnr", F.substring("Mblnr", 1, 9)), "Cpudt": put(22, "Cpudt", F.lit(None)), "Ebelp": F.when(F.col("h") == 23, 0).otherwise(10)}
    found = contract.failures(rows.withColumns(broken).drop("h", "Cputm"), contract.MB51, ("Mblnr", "Zeile"))
    return found.groupBy("tabla", "columna", "chequeo").agg(F.count(F.lit(1)).alias("casos"))


#: name: how to build it, what its SQL reads, and the SQL's final select
TABLE: dict[str, tuple[Callable[[Models], DataFrame], str, str]] = {
    "extracto_maestro": (
        lambda m: extract.master(inputs.with_plant(printed_master(m)), currency="USD"),
        "cust prices",
        """, d as (select distinct planta, material, tipo_material, cast(split_part(material, '-', 2) as int) as n from cust)
        select planta as Werks, material as Matnr, 'Contenedor ' || material as Maktx, 'VERP' as Mtart, case tipo_material when 'KLT' then 'G1' when 'RACK' then 'G2' else 'G3' end as Matkl, 'PC' as Meins,
               case when n % 2 = 0 then 1000 + costo_unitario_usd + 0.5::double else costo_unitario_usd + 0.25::double end as Verpr, 1::bigint as Peinh, case when n = 7 then 'MXN' else 'USD' end as Waers from d join prices using (tipo_material)""",
    ),
    "contrato_mb51": (
        contract_of_17,
        "led",
        """, d as (select anio_contable, fecha_contab, doc_material, '49' || lpad((dense_rank() over (partition by anio_contable order by fecha_contab, doc_material))::varchar, 8, '0') as n from (select distinct anio_contable, fecha_contab, doc_material from led)),
             h as (select ('0x' || substr(md5(n || '|' || lpad(posicion::varchar, greatest(4, length(posicion::varchar))::int, '0')), 1, 8))::bigint % 997 as h from led join d using (anio_contable, fecha_contab, doc_material))
        select 'mb51' as tabla, case h when 20 then 'Meins' when 21 then 'Mblnr' when 22 then 'Cpudt' else 'Ebelp' end as columna,
               case h when 20 then 'isin(PC, EA, KG)' when 21 then 'str_length(10, 10)' when 22 then 'not_nullable' else 'ge(1)' end as chequeo, count(*) as casos from h where h between 20 and 23 group by all
        union all select 'mb51', 'Cputm', 'column_in_dataframe', 1""",
    ),
    "contrato_por_archivo": (
        contract_by_file,
        "cfail dirty",
        """, k as (select doc_material || '|' || posicion as llave, planta from dirty group by all)
        select tabla, 'planta=' || planta as archivo, columna, chequeo, count(*) as casos from cfail join k using (llave) where tabla = 'raw_mb51' group by all""",
    ),
    "extracto_con_fallas": (
        extract_with_faults,
        "led",
        """, h as (select planta, ('0x' || substr(md5(concat_ws('|', doc_material, posicion)), 1, 8))::bigint % 997 as h from led)
        select 'planta=' || planta as archivo, case h when 22 then 'MENGE' when 23 then 'BUDAT' end as columna, case h when 22 then 'no_es_numero' when 23 then 'no_es_fecha' else 'registro_roto' end as chequeo, count(*) as casos
        from h where h between 20 and 23 group by all""",
    ),
    "extracto_stock": (
        lambda m: extract.stock(printed_stock(m), "LGORT", extract.STORED),
        "snap",
        """select planta as Werks, almacen as Lgort, material as Matnr, cantidad - case when cast(split_part(material, '-', 2) as int) % 3 = 0 then 4 else 0 end as Menge from snap
           where cantidad - case when cast(split_part(material, '-', 2) as int) % 3 = 0 then 4 else 0 end <> 0""",
    ),
}
