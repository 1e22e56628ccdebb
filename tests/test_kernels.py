import random

from pyspark.sql import functions as F

from fleetledger.functions import kernels as K


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_capped_release_and_floored_balance_against_loops(spark):
    rng = random.Random(5)
    days = [("s", t, float(rng.randint(0, 9)), float(rng.choice([0, 3, 4, 6]))) for t in range(60)]
    got = K.capped_release(spark.createDataFrame(days, "k string, t int, listo double, cap double"), ["k"], "t", "listo", "cap").orderBy("t").collect()
    waiting = 0.0
    for (_, _, ready, cap), r in zip(days, got):
        waiting += ready
        out = min(waiting, cap)
        waiting -= out
        assert abs(r["liberado"] - out) < 1e-6 and abs(r["cola"] - waiting) < 1e-6
    moves = [("m", t, rng.randint(-6, 5)) for t in range(80)]
    got = K.floored_balance(spark.createDataFrame(moves, "k string, t int, d long"), ["k"], "t", "d").orderBy("t").collect()
    balance = short = 0
    for (_, _, d), r in zip(moves, got):
        balance += d
        short += max(0, -balance)
        balance = max(0, balance)
        assert (r["saldo"], r["faltante_acum"]) == (balance, short)


def test_allocate_gives_no_more_than_there_is(spark):
    df = spark.createDataFrame([("p", 10.0, 0.0), ("p", 30.0, 0.0), ("p", 0.0, 20.0), ("q", 5.0, 0.0), ("z", 0.0, 0.0)], "pool string, d double, s double")
    got = {(r["pool"], r["d"], r["s"]): (r["got"], r["gave"]) for r in K.allocate(df, ["pool"], "d", "s", "got", "gave").collect()}
    assert got["p", 10.0, 0.0] == (5.0, 0.0) and got["p", 30.0, 0.0] == (15.0, 0.0) and got["p", 0.0, 20.0] == (0.0, 20.0) and got["q", 5.0, 0.0] == (0.0, 0.0)


def test_weighted_percentiles(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 9, 1), ("b", 7, 3)], "k string, v int, w long")
    assert rows(K.weighted_percentiles(df, ["k"], "v", "w", {"p50": 0.5, "p90": 0.9})) == [("a", 10, 2.2, 1, 2), ("b", 3, 7.0, 7, 7)]


def test_rounded_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.125,), (None,)], "x double")
    assert [r[0] for r in df.select(K.rounded("x", 0)).collect()] == [3.0, -3.0, 0.0, None]
