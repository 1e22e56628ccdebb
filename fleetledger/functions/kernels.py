"""Kernels that several operators share, as column and DataFrame compositions without UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST, HERE = Window.unboundedPreceding, Window.currentRow


def running(keys: Sequence[str], *order):
    """From the first row of the partition to this one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(FIRST, HERE)


def running_sum(value, keys: Sequence[str], *order) -> Column:
    return F.sum(value).over(running(keys, *order))


def rounded(x, digits: int) -> Column:
    """Half away from zero, on the binary value."""
    x, p = (F.col(x) if isinstance(x, str) else x).cast("double"), float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * p + 0.5).cast("double") / p


def filtered_sum(value, where: Column) -> Column:
    return F.sum(F.when(where, value))


def ratio(a, b) -> Column:
    """a / b as a double; null where b is zero."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def top1(df: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def weighted_percentiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, points: dict[str, float]) -> DataFrame:
    """For rows of one value each: the smallest value whose cumulative share of the weight reaches each point, the
    weight's sum as `total` and the weighted mean as `mean`."""
    share = running_sum(weight, keys, value).cast("double") / F.sum(weight).over(Window.partitionBy(*keys)).cast("double")
    found = [F.min(F.when(F.col("_share") >= p, F.col(value))).alias(n) for n, p in points.items()]
    mean = F.sum(F.col(weight) * F.col(value)).cast("double") / F.sum(weight).cast("double")
    return df.withColumn("_share", share).groupBy(*keys).agg(F.sum(weight).cast("long").alias("total"), mean.alias("mean"), *found)


def overall(df: DataFrame, world: Column | None, *sums: Column) -> DataFrame:
    """Aggregates of all rows; with worlds (see plans/variants.py), of each world's rows, beside its name as `mundo`."""
    return df.agg(*sums) if world is None else df.groupBy(world.alias("mundo")).agg(*sums)


def beside(df: DataFrame, one: DataFrame, world: Column | None) -> DataFrame:
    """df with the columns of a table of one row, or of a row a world, its own."""
    if world is None:
        return df.crossJoin(F.broadcast(one))
    return df.withColumn("mundo", world).join(F.broadcast(one), "mundo", "left").drop("mundo")


def dense_days(keys: DataFrame, calendar: DataFrame, first: str, last: str, world: Column | None = None) -> DataFrame:
    """Keys with every day from `first` to `last` of a calendar of one row, or of a row a world, as `fecha`."""
    return beside(keys, calendar.select(first, last, *(() if world is None else ("mundo",))), world).withColumn("fecha", F.explode(F.sequence(first, last))).drop(first, last)


def capped_release(df: DataFrame, keys: Sequence[str], day: str, ready: str, capacity: str) -> DataFrame:
    """A first-in first-out queue with a capacity for each day, in closed form: with running sums C of capacity and R of
    what is ready, C + min(0, least R - C so far) has left by each day. Adds liberado_acum, liberado and cola."""
    made = df.withColumn("_r", running_sum(ready, keys, day)).withColumn("_c", running_sum(capacity, keys, day))
    low = F.min(F.col("_r") - F.col("_c")).over(running(keys, day))
    made = made.withColumn("liberado_acum", rounded(F.col("_c") + F.least(F.lit(0.0), low), 6))
    before = F.coalesce(F.lag("liberado_acum").over(Window.partitionBy(*keys).orderBy(day)), F.lit(0.0))
    return made.withColumn("liberado", F.col("liberado_acum") - before).withColumn("cola", F.col("_r") - F.col("liberado_acum")).drop("_r", "_c")


def floored_balance(df: DataFrame, keys: Sequence[str], day: str, delta: str) -> DataFrame:
    """A balance that stops at zero: what would go below is a shortage. Adds faltante_acum and saldo."""
    made = df.withColumn("_s", running_sum(delta, keys, day))
    short = -F.least(F.min("_s").over(running(keys, day)), F.lit(0))
    return made.withColumn("faltante_acum", short).withColumn("saldo", F.col("_s") + F.col("faltante_acum")).drop("_s")


def allocate(df: DataFrame, pool: Sequence[str], demand: str, supply: str, received: str, lent: str) -> DataFrame:
    """Within each pool, demand gets and supply gives in proportion, as far as the smaller of both sums goes."""
    w = Window.partitionBy(*pool)
    d, s = F.sum(demand).over(w).cast("double"), F.sum(supply).over(w).cast("double")
    share = lambda a, b: F.coalesce(F.least(F.lit(1.0), ratio(a, b)), F.lit(0.0))
    return df.withColumns({received: F.col(demand) * share(s, d), lent: F.col(supply) * share(d, s)})
