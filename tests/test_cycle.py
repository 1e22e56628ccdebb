import datetime as dt

from fleetledger.operators import cycle
from fleetledger.sources.ledger import no_snapshot

D = dt.date
MOVES = "planta string, cliente string, material string, tipo_material string, mov_type string, fecha_contab date, anio_contable long, doc_material string, posicion int, cantidad int, costo_unitario_usd double"


def move(kind, day, n, doc="1", client="C1", material="M1"):
    return ("P1", client, material, "KLT", kind, day, day.year, doc, 1, n, 10.0)


def tranches(spark, *moves, snapshot=None):
    df = spark.createDataFrame(list(moves), MOVES)
    got = cycle.fifo_tranches(cycle.account_movements(df, snapshot if snapshot is not None else no_snapshot(spark)))
    cols = ("material", "doc_salida", "doc_cierre", "tipo_cierre", "cantidad", "dias")
    return sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str)


def test_exact_match(spark):
    assert tranches(spark, move("621", D(2024, 1, 1), -5, "A"), move("622", D(2024, 1, 11), 5, "B")) == [("M1", "A", "B", "622", 5, 10)]


def test_partial_closure_leaves_the_rest_open(spark):
    got = tranches(spark, move("621", D(2024, 1, 1), -5, "A"), move("622", D(2024, 1, 4), 2, "B"))
    assert got == [("M1", "A", "B", "622", 2, 3), ("M1", "A", None, None, 3, None)]


def test_closure_across_two_outflows(spark):
    got = tranches(spark, move("621", D(2024, 1, 1), -3, "A"), move("621", D(2024, 1, 2), -3, "B"), move("622", D(2024, 1, 5), 5, "C"))
    assert got == [("M1", "A", "C", "622", 3, 4), ("M1", "B", "C", "622", 2, 3), ("M1", "B", None, None, 1, None)]


def test_loss_closes_the_oldest_and_accounts_do_not_mix(spark):
    got = tranches(
        spark, move("621", D(2024, 1, 1), -2, "A"), move("702", D(2024, 3, 31), -2, "L"), move("621", D(2024, 1, 1), -2, "X", material="M2")
    )
    assert got == [("M1", "A", "L", "702", 2, 90), ("M2", "X", None, None, 2, None)]


def test_same_day_goes_by_document(spark):
    got = tranches(spark, move("621", D(2024, 1, 1), -1, "B"), move("621", D(2024, 1, 1), -1, "A"), move("622", D(2024, 1, 2), 1, "C"))
    assert got == [("M1", "A", "C", "622", 1, 1), ("M1", "B", None, None, 1, None)]


def test_snapshot_stock_goes_first_and_has_no_age(spark):
    snapshot = spark.createDataFrame([("P1", None, "M1", "KLT", "C1", 2, D(2023, 12, 31))], no_snapshot(spark).schema)
    got = tranches(spark, move("621", D(2024, 1, 1), -2, "A"), move("622", D(2024, 1, 5), 3, "B"), snapshot=snapshot)
    assert got == [("M1", "A", "B", "622", 1, 4), ("M1", "A", None, None, 1, None), ("M1", None, "B", "622", 2, None)]


def test_losses_count_from_the_first_full_reconciliation_of_a_stocked_route(spark):
    snapshot = spark.createDataFrame([("P1", None, "M1", "KLT", "C1", 2, D(2024, 1, 1))], no_snapshot(spark).schema)
    moves = [
        move("621", D(2024, 1, 15), -4, "A"), move("621", D(2024, 6, 20), -4, "B"), move("702", D(2024, 3, 31), -1, "L1"), move("702", D(2024, 6, 30), -1, "L2"),
        move("702", D(2024, 9, 30), -1, "L3"), move("702", D(2024, 12, 31), -1, "L4"), move("621", D(2024, 1, 15), -4, "N", client="C2"),
    ]
    got = cycle.reconcilable_loss(spark.createDataFrame(moves, MOVES), snapshot).collect()
    counted = {(r["cliente"], r["mov_type"], r["fecha_contab"]): r["en_tasa"] for r in got}
    assert counted["C1", "702", D(2024, 3, 31)] is False and counted["C1", "702", D(2024, 6, 30)] is False
    assert counted["C1", "702", D(2024, 9, 30)] is True and counted["C1", "702", D(2024, 12, 31)] is True
    assert counted["C1", "621", D(2024, 1, 15)] is False and counted["C1", "621", D(2024, 6, 20)] is True
    assert counted["C2", "621", D(2024, 1, 15)] is True


def test_empty_ledger(spark):
    empty = spark.createDataFrame([], MOVES)
    account = cycle.account_movements(empty, no_snapshot(spark))
    cut = cycle.fifo_tranches(account)
    assert cut.count() == 0 and cycle.survival(cut).count() == 0 and cycle.routes(cycle.reconcilable_loss(empty, no_snapshot(spark)), cut).count() == 0


def test_single_lines_by_day_and_units(spark, monkeypatch):
    """Tranches of lines that are dealt by day and by units of the account are those of ranges: many blocks, ties, null customers, zeros,
    days with more lines than one task should have; nothing is dealt by ranges but those."""
    import random

    from fleetledger.functions import blocks

    rng = random.Random(8)
    moves = [move(rng.choice(["621", "621", "622", "702"]), D(2024, 1, rng.randint(1, 28)), rng.choice([0, 1, 5, 9, 30]), f"{i:04}", rng.choice(["C1", "C1", "C2", None]), rng.choice(["M1", "M2"])) for i in range(900)]
    snapshot = spark.createDataFrame([("P1", None, "M1", "KLT", "C1", 7, D(2023, 12, 31))], no_snapshot(spark).schema)
    account = cycle.account_movements(spark.createDataFrame(moves, MOVES), snapshot).repartition(5)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    want = rows(cycle.fifo_tranches(account))
    monkeypatch.setattr(cycle, "UNITS", 40)
    made, ranges = [], blocks.in_blocks
    monkeypatch.setattr(blocks, "in_blocks", lambda *a: made.append(a) or ranges(*a))
    assert rows(cycle.fifo_tranches(account, lines=True)) == want and not made
    monkeypatch.setattr(cycle, "sums_by_day", lambda *a: blocks.sums_by_day(*a, most=3))
    assert rows(cycle.fifo_tranches(account, lines=True)) == want and len(made) == 1
    assert cycle.fifo_tranches(account.limit(0), lines=True).count() == 0
