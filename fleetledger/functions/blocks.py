"""Scans over ordered rows of a key in blocks, so that one key, however many rows it has, is the work of many tasks.

Rows are dealt by ranges of (key, order): a block is what a key has in one range. Each block is scanned by itself, blocks of a key
are summed up into a row each, what stands before (or behind) a block is carried from block to block over these few rows, and
meets the block's rows again. Scanned blocks are written before they are read twice, since two evaluations could deal the ranges
differently. Keys may be null; rows with equal order stay in one block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import FEW, stored

FIRST, HERE = Window.unboundedPreceding, Window.currentRow
#: Column that numbers the blocks in the order of (key, order).
BLOCK = "_bloque"


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """df with the number of its block; a scan of the whole must evaluate this once."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys, *order).withColumn(BLOCK, F.spark_partition_id())


def wide(df: DataFrame) -> int:
    """Partitions for rows that grow with the lines: enough that none has to be sorted on disk."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16 * df.sparkSession.sparkContext.defaultParallelism)


def inside(keys: Sequence[str], *order):
    """The window of a key's rows in a block."""
    return Window.partitionBy(BLOCK, *keys).orderBy(*order)


def carried(local: DataFrame, keys: Sequence[str], totals: dict[str, Column], carry: dict[str, Column], then: dict[str, Column] | None = None) -> DataFrame:
    """local, stored rows of blocks, with the columns of `carry` and, made from these, of `then`: window expressions with before() or
    behind(), over one row for each key and block with the aggregates `totals`. They are null for keys of one block, which nothing is
    carried to. Keys of several have the first or the last rows of their blocks, so that there are at most two a block: few enough to be
    broadcast, whatever the rows and keys, and the rows stay where they are."""
    then = then or {}
    per = local.groupBy(*keys, BLOCK).agg(*[c.alias(n) for n, c in totals.items()]).withColumn("_blocks", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    per = per.where("_blocks > 1").withColumns(carry).withColumns(then)
    names = {k: f"_c_{k}" for k in (*keys, BLOCK)}
    per = per.select(*[F.col(k).alias(n) for k, n in names.items()], *carry, *then)
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return local.join(F.broadcast(per), same, "left").drop(*names.values())


def before(keys: Sequence[str]):
    """The blocks of a key before this one."""
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(FIRST, -1)


def behind(keys: Sequence[str]):
    """The blocks of a key after this one, nearest last."""
    return Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(FIRST, -1)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence, sums: dict[str, Column]) -> DataFrame:
    """df with running sums from a key's first row to this one; null values count as nothing."""
    w = inside(keys, *order).rowsBetween(FIRST, HERE)
    local = stored(in_blocks(df, keys, order).withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()}), "block-sums")
    made = carried(local, keys, {f"_v_{n}": F.sum(c) for n, c in sums.items()}, {f"_p_{n}": F.sum(f"_v_{n}").over(before(keys)) for n in sums})
    return made.withColumns({n: F.col(n) + F.coalesce(f"_p_{n}", F.lit(0)) for n in sums}).drop(BLOCK, *[f"_p_{n}" for n in sums])


def running_low(df: DataFrame, keys: Sequence[str], order: Sequence, value: Column, total: str, low: str) -> DataFrame:
    """df with the running sum of a value as `total` and the lowest such sum so far as `low`: what a queue with a capacity or a
    balance with a floor needs. A block's lowest sum is that of its own start, moved by what stood before it."""
    upto = inside(keys, *order).rowsBetween(FIRST, HERE)
    sums = in_blocks(df, keys, order).withColumn(total, F.coalesce(F.sum(value).over(upto), F.lit(0)))
    local = stored(sums.withColumn(low, F.min(total).over(upto)), "block-lows")
    start = F.coalesce(F.sum("_sum").over(before(keys)), F.lit(0))
    least = F.min(F.col("_start") + F.col("_low")).over(before(keys))
    made = carried(local, keys, {"_sum": F.sum(value), "_low": F.min(low)}, {"_start": start}, {"_least": least})
    moved = F.coalesce("_start", F.lit(0))
    return made.withColumns({total: F.col(total) + moved, low: F.least(F.col(low) + moved, "_least")}).drop(BLOCK, "_start", "_least")


def sums_by_day(df: DataFrame, keys: Sequence[str], day: str, order: Sequence, sums: dict[str, Column], most: int = 1_000_000) -> DataFrame:
    """running_sums where `order` begins with the day: what a key has by day is summed first, so that a day's rows need only each other,
    and are shuffled once. Where a key has more than `most` rows in a day, ranges are cut as in running_sums."""
    per = stored(df.groupBy(*keys, day).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_d_{n}") for n, c in sums.items()], F.count(F.lit(1)).alias("_rows")), "day-sums")
    if (per.agg(F.max("_rows")).first()[0] or 0) > most:
        return running_sums(df, keys, order, sums)
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(day)).rowsBetween(FIRST, -1)
    names = {k: f"_k_{k}" for k in (*keys, day)}
    starts = stored(per.select(*[F.col(k).alias(n) for k, n in names.items()], *[F.coalesce(F.sum(f"_d_{n}").over(w), F.lit(0)).alias(f"_p_{n}") for n in sums]), "day-starts")
    upto = Window.partitionBy(*keys, day).orderBy(*order).rowsBetween(FIRST, HERE)
    local = df.repartition(wide(df), *keys, day).withColumns({n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()})
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    made = local.join(F.broadcast(starts) if starts.count() <= FEW else starts, same)
    return made.withColumns({n: F.col(n) + F.col(f"_p_{n}") for n in sums}).drop(*names.values(), *[f"_p_{n}" for n in sums])


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """left with the last non-null `value` of right at or before `at`, of the same key; null where there is none. What a block's
    first rows need is handed on from the blocks before it."""
    rows = left.withColumn("_side", F.lit(1)).unionByName(right.select(*keys, at, value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    known = F.when(F.col("_side") == 0, F.col(value))
    # Ranges are dealt by (key, at) alone: a value stands in the block of the rows of its own time.
    order = (at, "_side")
    local = stored(in_blocks(rows, keys, [at]).withColumn("_here", F.last(known, True).over(inside(keys, *order).rowsBetween(FIRST, HERE))), "block-as-of")
    latest = F.max_by(known, F.when(known.isNotNull(), F.col(at)))
    made = carried(local, keys, {"_last": latest}, {"_earlier": F.last("_last", True).over(before(keys))})
    return made.where("_side = 1").withColumn(value, F.coalesce("_here", "_earlier")).drop("_side", "_here", "_earlier", BLOCK)


def interval_match(left: DataFrame, right: DataFrame, keys: Sequence[str], left_row: str, right_row: str) -> DataFrame:
    """Intersects two series of intervals laid end to end on the same line, key by key.

    Each side has keys, `acum_fin` (where its interval ends; it begins where the one before it ends) and one struct
    column. All end points are sorted; each slice between neighbours belongs to the first interval of each side that
    ends at its end or later: it stands in the slice's own block, or is the first of a block behind it. Result: keys, both structs
    (null where a side has run out) and `cantidad`, the slice's length. Costs n log n, and no join of overlaps.
    """
    a = left.select(*keys, "acum_fin", left_row, F.lit(None).cast(right.schema[right_row].dataType).alias(right_row))
    b = right.select(*keys, "acum_fin", F.lit(None).cast(left.schema[left_row].dataType).alias(left_row), right_row)
    return match_points(a.unionByName(b), keys, left_row, right_row)


def match_points(both: DataFrame, keys: Sequence[str], left_row: str, right_row: str, width: int | None = None) -> DataFrame:
    """interval_match of both sides' rows in one table: each has its own side's struct, the other's is null. With a width, whole numbers
    are cut into blocks of so many units of the line, without a shuffle by ranges."""
    n = wide(both) if width else int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = both.withColumn(BLOCK, F.floor((F.col("acum_fin") - 1) / width)) if width else in_blocks(both, keys, ["acum_fin"])
    points = cut.repartition(n, BLOCK, *keys)  # serves the grouping and the windows below
    at = points.groupBy(BLOCK, *keys, "acum_fin").agg(F.first(left_row, True).alias(left_row), F.first(right_row, True).alias(right_row))
    # From the far end: what is ahead of a point is then a frame that only grows, and costs one step a row.
    order = inside(keys, F.desc("acum_fin"))
    ahead = order.rowsBetween(FIRST, HERE)
    local = stored(
        at.select(
            BLOCK, *keys, "acum_fin", F.last(left_row, True).over(ahead).alias("_left"), F.last(right_row, True).over(ahead).alias("_right"), F.lead("acum_fin").over(order).alias("_from")
        ),
        "block-points",
    )
    # A block's lowest point sees the first interval of each side in it.
    totals = {"_l": F.min_by("_left", "acum_fin"), "_r": F.min_by("_right", "acum_fin"), "_to": F.max("acum_fin")}
    carry = {"_next_l": F.last("_l", True).over(behind(keys)), "_next_r": F.last("_r", True).over(behind(keys)), "_start": F.last("_to").over(before(keys))}
    met = carried(local, keys, totals, carry)
    return met.select(
        *keys, F.coalesce("_left", "_next_l").alias(left_row), F.coalesce("_right", "_next_r").alias(right_row),
        (F.col("acum_fin") - F.coalesce("_from", "_start", F.lit(0))).alias("cantidad"),
    ).where("cantidad > 0")
