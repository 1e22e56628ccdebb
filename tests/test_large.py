"""What keeps queries within their time and disk on large tables."""

from pyspark.sql import functions as F

from paths import SF
from fleetledger.operators import contract, cycle, quality
from fleetledger.plans import adapters, variants
from fleetledger.plans.models import ByDay
from fleetledger.sources import extract, inputs
from fleetledger.sources import ledger as src


def test_checks_are_planned_in_one_form(spark):
    """A filter over all checks at once would be planned under either name of every column."""
    names = [f"c{i}" for i in range(8)]
    rows = spark.range(4).select(*[F.when(F.col("id") != i, F.concat(F.lit(f"{i}-"), F.col("id").cast("string"))).alias(f"r{i}") for i in range(8)])
    rows = rows.select(*[F.trim(f"r{i}").alias(c) for i, c in enumerate(names)]).select(*[F.upper(c).alias(c) for c in names])
    found = contract.failures(rows, contract.Contract("t", tuple(contract.Field(c, length=(3, 3)) for c in names)), ("c0",))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert all("isnotnull(x#" in line for line in plan if "Filter" in line)
    assert sorted(r["columna"] for r in found.collect()) == names[:4] and {r["chequeo"] for r in found.collect()} == {"not_nullable"}


def test_worlds_run_only_accounts_that_a_fault_changes(spark):
    """Tranches and balances of the other accounts are the clean ones: a sign that an account doesn't read changes none, a copied line its
    own account's; and the changes of stock are summed up before they are spread."""
    base = ByDay(spark, SF)
    chosen = [w for w in variants.worlds() if w[0] in (variants.CLEAN, "D05", "D01", "material_sin_maestro", "D15")]
    m = variants.VariantModels(base, chosen)
    run = {r["w"]: r["n"] for r in m.account_days.select(*cycle.ACCOUNT).distinct().groupBy(m.world.alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    hit = base.ledger.where((src.fault_mark() == 4) & F.col("mov_type").isin("621", "622", "702")).select(*cycle.ACCOUNT).distinct().count()
    assert set(run) == {variants.CLEAN, "D01"} and 0 < run["D01"] == hit
    sums = {r["w"]: r["n"] for r in m.tranches_days.groupBy(m.world.alias("w")).agg(F.sum("cantidad").alias("n")).collect()}
    clean = base.account_days.where("mov_type = '621'").agg(F.sum("cantidad_abs")).first()[0]
    more = base.ledger.where((src.fault_mark() == 4) & (F.col("mov_type") == "621")).agg(F.sum(F.abs("cantidad"))).first()[0]
    assert sums == {variants.CLEAN: clean, "D05": clean, "D15": clean, "D01": clean + (more or 0)}
    assert m.customer_days.where("mov_type = '621'").count() < base.customer_days.where("mov_type = '621'").count()
    assert "ledger_days" not in vars(m)


def test_keys_are_counted_from_few_lines(spark):
    """Order lines that stand twice get positions of their own; only movements whose document and line stand twice are looked at."""
    base = ByDay(spark, SF)
    assert base.repeated.count() == 0
    once = base.customer.where("fecha_contab = date'1997-03-03'")
    del base.__dict__["repeated"]
    base.__dict__["customer"] = base.customer.unionByName(once)
    twice = src.with_transfers(once)
    key = ["planta", "anio_contable", "doc_material", "posicion"]
    assert base.repeated.count() == 2 * twice.count() and base.repeated.select(*key).distinct().count() == twice.select(*key).distinct().count() > 0


def test_impact_shuffles_only_keys_that_may_be_shared(spark):
    """Lines without a fault whose document and line stand once are summed up where they are; copies among the clean lines are counted."""
    m = ByDay(spark, SF)
    m.__dict__["customer"] = m.customer.unionByName(m.customer.where("fecha_contab = date'1997-03-03'")).localCheckpoint()
    n, keys = m.ledger.count(), m.ledger.select("planta", "anio_contable", "doc_material", "posicion").distinct().count()
    assert n > keys and m.at_fault.count() + m.repeated.count() < n / 20
    by_fault = {(r["defecto"], r["medida"]): r for r in m.impact_by_fault.collect()}
    again = m.ledger.where(src.fault_mark() == 4)
    assert by_fault["D01", "llave"]["valor_limpio"] == n - keys and by_fault["D05", "llave"]["delta"] == 0
    assert by_fault["D01", "llave"]["delta"] == again.count()
    whole = m.lines.agg(quality.surplus()).first()[0]
    got = {r["medida"]: r for r in m.impact.collect()}["llave"]
    assert (got["valor_limpio"], got["valor"]) == (n - keys, whole)


def test_folders_are_written_without_a_sort(spark, tmp_path):
    """Rows go to their plant's folder in the order in which they come, also where there are more plants than files that a task keeps open;
    extracts are gzipped, and read back whole. The session's setting is as it was."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    rows = spark.range(400, numPartitions=1).selectExpr("concat('P', id % 5) as planta", "id", "concat_ws(';', 'a', id) as linea")
    inputs.write_as_they_come(rows, str(tmp_path / "moves"))
    extract.write_text(rows, str(tmp_path / "text"))
    many = spark.range(400, numPartitions=1).selectExpr("concat('P', id % 40) as planta", "id")
    inputs.write_as_they_come(many, str(tmp_path / "many"))
    assert spark.conf.get(name) == before
    for plant in range(5):
        assert [r["id"] for r in spark.read.parquet(str(tmp_path / "moves" / f"planta=P{plant}")).collect()] == list(range(plant, 400, 5))
    assert len(list((tmp_path / "text").glob("planta=P*/*.txt.gz"))) == 5
    back = extract.read_text(spark, str(tmp_path / "text"), columns=["x", "n"])
    assert sorted(int(r["n"]) for r in back.collect()) == list(range(400)) and {r["archivo"] for r in back.collect()} == {f"planta=P{n}" for n in range(5)}
    assert inputs.plant_files(spark, str(tmp_path / "many")).count() == 400


def test_contract_by_file_shuffles_no_line(spark):
    """The files hold what the contract names, and are written by the tasks that make the lines."""
    m = ByDay(spark, SF)
    read, wrote = [], inputs.write_as_they_come

    def spy(moves, path):
        read.append((moves.columns, moves._jdf.queryExecution().executedPlan().toString()))
        wrote(moves, path)

    adapters.inputs.write_as_they_come = spy
    try:
        assert adapters.contract_by_file(m).count() > 0
    finally:
        adapters.inputs.write_as_they_come = wrote
    ((columns, plan),) = read
    assert columns == [f.name for f in contract.MOVEMENTS.fields] and "rangepartitioning" not in plan
