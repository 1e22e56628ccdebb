"""Scans in blocks against plain loops: one hot key over many blocks, null keys, ties, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from fleetledger.functions import blocks as B


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def many_blocks(spark):
    """More ranges than keys, so that keys are cut."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def series():
    rng = random.Random(4)
    keys = ["hot"] * 900 + ["b"] * 40 + [None] * 60 + ["one"]
    return [(k, rng.randint(0, 400), i, rng.choice([None, rng.randint(-9, 9)])) for i, k in enumerate(keys)]


def test_keys_are_cut_into_blocks(many_blocks, series):
    df = many_blocks.createDataFrame(series, "k string, t int, i int, v long")
    cut = B.in_blocks(df, ["k"], ["t", "i"]).where("k = 'hot'").groupBy(B.BLOCK).count().collect()
    assert len(cut) >= 5 and max(r["count"] for r in cut) < 400


def test_running_sums(many_blocks, series):
    df = many_blocks.createDataFrame(series, "k string, t int, i int, v long").repartition(5)
    got = rows(B.running_sums(df, ["k"], ["t", "i"], {"s": F.col("v"), "n": F.lit(1)}).select("k", "t", "i", "s", "n"))
    want, sums = [], {}
    for k, t, i, v in sorted(series, key=lambda r: (r[0] or "", r[1], r[2])):
        s, n = sums.get(k, (0, 0))
        sums[k] = s + (v or 0), n + 1
        want.append((k, t, i, *sums[k]))
    assert got == sorted(want, key=repr)
    assert B.running_sums(df.limit(0), ["k"], ["t"], {"s": F.col("v")}).count() == 0


def test_running_low(many_blocks, series):
    df = many_blocks.createDataFrame(series, "k string, t int, i int, v long").repartition(5)
    got = rows(B.running_low(df, ["k"], ["t", "i"], F.col("v"), "s", "low").select("k", "t", "i", "s", "low"))
    want, seen = [], {}
    for k, t, i, v in sorted(series, key=lambda r: (r[0] or "", r[1], r[2])):
        s, low = seen.get(k, (0, 10**9))
        s += v or 0
        seen[k] = s, min(low, s)
        want.append((k, t, i, *seen[k]))
    assert got == sorted(want, key=repr)


def test_as_of(many_blocks, series):
    rng = random.Random(9)
    asked = [(k, rng.randint(-5, 405), n) for n, k in enumerate(["hot"] * 300 + ["b", "b", None, None, "none"])]
    known = [(k, t, v) for k, t, _, v in {(k, t): (k, t, i, v) for k, t, i, v in series}.values()]
    left = many_blocks.createDataFrame(asked, "k string, t int, n int")
    right = many_blocks.createDataFrame(known, "k string, t int, v long").repartition(4)
    got = {r["n"]: r["v"] for r in B.as_of(left, right, ["k"], "t", "v").collect()}
    want = {n: max(((t2, v) for k2, t2, v in known if k2 == k and t2 <= t and v is not None), default=(0, None))[1] for k, t, n in asked}
    assert got == want


def test_interval_match_against_units(many_blocks):
    """Each unit of a side belongs to one interval; matching intervals is matching units one by one."""
    rng = random.Random(3)
    lines = {"k": (300, 200), "short": (3, 40), None: (12, 12), "lone": (2, 0)}
    a, b, want = [], [], []
    for k, (n, m) in lines.items():
        x, y = [(i, rng.randint(1, 9)) for i in range(n)], [(i, rng.randint(1, 9)) for i in range(m)]
        for out, side in ((a, x), (b, y)):
            total = 0
            for i, q in side:
                total += q
                out.append((k, total, (i,)))
        left, right = [i for i, q in x for _ in range(q)], [i for i, q in y for _ in range(q)]
        size = max(len(left), len(right))
        units: dict = {}
        for u, v in zip(left + [None] * (size - len(left)), right + [None] * (size - len(right))):
            units[k, u, v] = units.get((k, u, v), 0) + 1
        want += [(*u, n) for u, n in units.items()]
    made = lambda data, name: many_blocks.createDataFrame(data, f"k string, acum_fin long, {name} struct<{name}_i:int>").repartition(6)
    got = rows(B.interval_match(made(a, "a"), made(b, "b"), ["k"], "a", "b").select("k", "a.a_i", "b.b_i", "cantidad"))
    assert got == sorted(want, key=repr)
