"""Optional inputs, snapshot routing, windows, and tables that leave the engine."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paths import SF
from fleetledger.functions.tables import shared_dir
from fleetledger.plans.models import Models
from fleetledger.sources import inputs

D = dt.date


@pytest.fixture(scope="module")
def models(spark):
    return Models(spark, SF)


@pytest.fixture(scope="module")
def folder(spark):
    import uuid

    return f"{shared_dir(spark)}/inputs-{uuid.uuid4().hex}"


def test_missing_inputs(spark, folder):
    assert inputs.log_if_any(spark, f"{folder}/none") is None
    empty = inputs.input_table(spark, f"{folder}/none", "planta string, n long", required=False)
    assert empty.columns == ["planta", "n"] and empty.count() == 0
    with pytest.raises(FileNotFoundError, match="none"):
        inputs.input_table(spark, f"{folder}/none", "planta string")
    spark.createDataFrame([("P0", 1)], "planta string, n long").write.parquet(f"{folder}/some")
    assert inputs.input_table(spark, f"{folder}/some", "planta string, n long").collect()[0]["n"] == 1


def test_rows_without_plant_stop(spark):
    raw = spark.createDataFrame([("P0",), (" ",), (None,)], "WERKS string")
    with pytest.raises(ValueError, match="2 rows without WERKS"):
        inputs.with_plant(raw)
    assert inputs.with_plant(raw.where("WERKS = 'P0'")).count() == 1


def test_snapshot_goes_by_its_date(models):
    opening = models.snapshot
    assert inputs.snapshot_for(opening, models.ledger, models.places).exceptAll(opening).count() == 0
    closing = models.rolled_back  # a closing snapshot rolled back is the opening one
    key = ["planta", "almacen", "material", "cantidad"]
    assert closing.select(*key).exceptAll(opening.select(*key)).count() == 0
    with pytest.raises(ValueError, match="inside the movements"):
        inputs.snapshot_for(opening.withColumn("fecha", F.lit(D(1999, 1, 1))), models.ledger, models.places)


def test_trim(models):
    moves, snapshot = inputs.trim(models.ledger, models.snapshot, models.places, D(1999, 1, 1))
    assert moves.agg(F.min("fecha_contab")).first()[0] >= D(1999, 1, 1) and {r[0] for r in snapshot.select("fecha").distinct().collect()} == {D(1998, 12, 31)}
    for day in (D(1980, 1, 1), D(2030, 1, 1)):
        with pytest.raises(ValueError, match="not inside"):
            inputs.trim(models.ledger, models.snapshot, models.places, day)


def test_movements_by_plant(spark, models, folder):
    inputs.write_by_plant(models.customer, f"{folder}/moves")
    inputs.write_by_plant(models.customer, f"{folder}/moves")  # replaced, not added
    back = spark.read.parquet(f"{folder}/moves")
    assert back.count() == models.customer.count() and {r[0] for r in back.select("planta").distinct().collect()} == {"P0", "P1", "P2", "P3", "P4"}


def test_measurements_and_blind_faults(spark, folder):
    rows = lambda *x: spark.createDataFrame(list(x), inputs.MEASUREMENTS)
    before = rows((None, "limpio", "cifra", "tco", 100.0, None, None), (None, "limpio", "cifra", "perdida", 50.0, None, None), ("B01", "alto", "cifra", "tco", 150.126, 4, 0), ("B01", "alto", "cifra", "perdida", 49.0, 4, 0))
    after = rows((None, "limpio", "cifra", "tco", 100.0, None, None), (None, "limpio", "cifra", "perdida", 50.0, None, None), ("B01", "alto", "cifra", "tco", 101.0, 4, 4), ("B01", "alto", "cifra", "perdida", None, 4, 4), ("D01", "alto", "cifra", "tco", 1.0, 1, 1))
    inputs.write_measurements(before, f"{folder}/measured")
    back = inputs.read_measurements(spark, f"{folder}/measured")
    assert {(r["medida"], r["nivel"], r["valor"], r["casos"]) for r in back.collect()} == {("tco", "limpio", 100.0, None), ("perdida", "limpio", 50.0, None), ("tco", "alto", 150.13, 4), ("perdida", "alto", 49.0, 4)}
    got = inputs.blind_detection(back, after).collect()
    assert [tuple(r) for r in got] == [("B01", "alto", 4, 0, "tco", 50.13, 4, 4, "perdida", None)]


def test_broken_records_of_an_extract(spark, tmp_path):
    """Headers by a map, records with fields too few and too many, an unreadable number and date: reported with their file, and nothing else."""
    from fleetledger.sources import extract

    names = list(extract.REQUIRED)
    good = ["P1", "M1", "Caja", "621", "03.02.2024", "03.02.2024", "90507", "1.234,000-", "ST", "D1", "1"]
    put = lambda c, x: ";".join(x if n == c else v for n, v in zip(names, good))
    (tmp_path / "mb51_a.csv").write_text("\n".join([";".join(f"c{n}" for n in names), ";".join(good), ";".join(good[:-2]), put("MENGE", "doce")]) + "\n")
    (tmp_path / "mb51_b.csv").write_text("\n".join([";".join(f"c{n}" for n in names), ";".join(good + ["x"]), put("BUDAT", "31.02.2024"), put("WERKS", " ")]) + "\n")
    (tmp_path / "names.csv").write_text("columna,campo\n" + "\n".join(f"c{n},{n.lower()}" for n in names) + "\n")
    rows = extract.read_text(spark, str(tmp_path / "mb51_*.csv"), names=extract.read_names(spark, str(tmp_path / "names.csv")))
    got = {(r["archivo"], r["columna"], r["chequeo"], r["valor"]) for r in extract.extract_failures(rows, "mb51").collect()}
    assert got == {
        ("mb51_a.csv", None, "registro_roto", ";".join(good[:-2])), ("mb51_a.csv", "MENGE", "no_es_numero", "doce"), ("mb51_b.csv", None, "registro_roto", ";".join(good + ["x"])),
        ("mb51_b.csv", "BUDAT", "no_es_fecha", "31.02.2024"), ("mb51_b.csv", "WERKS", "not_nullable", None),
    }
    assert extract.movements(rows.where(F.col(extract.BROKEN).isNull())).where("Menge = -1234").count() == 3
    with pytest.raises(ValueError, match="MENGE"):
        extract.extract_failures(rows.drop("MENGE"), "mb51")


def test_plant_files_are_pruned_and_named(spark, tmp_path):
    from fleetledger.sources import inputs

    moves = spark.createDataFrame([(f"P{i % 3}", i, f"d{i}", 1) for i in range(30)], "planta string, fecha_contab int, doc_material string, posicion int")
    inputs.write_by_plant(moves, str(tmp_path / "mb51"))
    back = inputs.plant_files(spark, str(tmp_path / "mb51"))
    assert {(r["planta"], r["archivo"]) for r in back.select("planta", "archivo").distinct().collect()} == {(f"P{i}", f"planta=P{i}") for i in range(3)}
    plan = back.where("planta = 'P1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(planta" in plan and back.where("planta = 'P1'").count() == 10
    moves.where("planta = 'P0'").coalesce(1).write.parquet(str(tmp_path / "flat"))
    assert inputs.plant_files(spark, str(tmp_path / "flat" / "part-*")).select("archivo").first()[0].startswith("part-")
