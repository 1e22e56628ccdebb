"""Sharding by a hierarchical weighted hash tree.

A topology names for each shard its rack, its region, its weight and the generation that brought it. A row descends from the
root: regions, then the racks of the region that won, then the shards of that rack. At each level every child draws
-ln(u) / weight, with u from a hash of the row's key and the child's name, and the smallest draw wins, so that a child wins
in proportion to its weight, whatever its siblings are. A change of one shard's weight changes the weights of its rack and its
region alone: rows move only between those and the rest.

What is added later draws for itself, beside what was there: the children of a level are nodes by generation, and a win
descends only into what that generation added. So an added shard, in whatever rack, takes rows only into itself, and no row
moves between the old ones.

Rows are never dealt by shard to be numbered: each task counts on within its own rows, and only the counts, a row for each task
and shard, are summed up over the tasks before it. A shard that holds most rows is as many tasks as it was read in.

Edge cases: the key is doc_id as text, and null is a key of its own; rows that share an id share a shard and have slots of
their own; null text counts as no bytes (size 1, crc32 0); an empty table gives an empty result; other columns of the input are
ignored, whatever their names. Shards of weight zero get no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Shards of the first generation of the default topology, racks of two and regions of two racks.
FIRST = 16


class Shard(NamedTuple):
    shard: int
    rack: str
    region: str
    weight: float = 1.0
    generation: int = 0


def topology(shards: int = FIRST, first: int = FIRST) -> list[Shard]:
    """The first `first` shards at once, two a rack and two racks a region; each further one as a generation of its own, in the
    rack where it would have stood."""
    if shards < first:
        raise ValueError(f"a topology that began with {first} shards has no {shards}")
    return [Shard(s, f"rack-{s // 2}", f"region-{s // 4}", 1.0, max(0, s - first + 1)) for s in range(shards)]


def checked(shards: Sequence[Shard]) -> list[Shard]:
    if not shards or len({s.shard for s in shards}) < len(shards):
        raise ValueError("a topology needs shards, each named once")
    if any(not (s.weight >= 0 and math.isfinite(s.weight)) for s in shards) or all(s.weight == 0 for s in shards):
        raise ValueError("weights must be finite and not negative, and one above zero")
    return [s for s in shards if s.weight > 0]


def draw(key: str, name: str, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from 53 bits of the hash of key and name."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(name)), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / F.lit(float(weight))


LEVELS = ("region", "rack", "shard")


def descend(rows: DataFrame, key: str, shards: Sequence[Shard], out: str) -> DataFrame:
    """rows with the shard in which each ends, as column `out`. One column a level: the number of the node reached, found by the
    draws of the children of the node above."""
    at, above = "_fl_0", [list(checked(shards))]
    rows = rows.withColumn(at, F.lit(0))
    for depth, level in enumerate(LEVELS):
        below: list[list[Shard]] = []
        chosen: Column = F.lit(None).cast("int")
        for number, mine in enumerate(above):
            children: dict[str, list[Shard]] = {}
            for s in mine:
                children.setdefault(f"{level}:{s.generation}:{getattr(s, level)}", []).append(s)
            first = len(below)
            below += children.values()
            draws = [F.struct(draw(key, name, sum(s.weight for s in each)).alias("d"), F.lit(first + i).alias("i")) for i, (name, each) in enumerate(children.items())]
            won = F.array_min(F.array(*draws))["i"] if len(draws) > 1 else F.lit(first)
            chosen = F.when(F.col(at) == number, won).otherwise(chosen)
        rows, above, at = rows.withColumn(f"_fl_{depth + 1}", chosen), below, f"_fl_{depth + 1}"
    ends = F.array(*[F.lit(each[0].shard) for each in above])
    return rows.withColumn(out, F.get(ends, F.col(at)).cast("int")).drop(*[f"_fl_{i}" for i in range(len(LEVELS) + 1)])


COUNTED = "doc_id string, size long, text_crc32 long, shard int, grown_shard int, part int, nth long"


def numbered(rows: DataFrame) -> DataFrame:
    """nth: how many rows of its shard stand before a row in its task."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        for f in frames:
            before = f["shard"].map(seen).fillna(0).to_numpy(np.int64)
            yield f.assign(nth=before + f.groupby("shard").cumcount().to_numpy(np.int64))
            for shard, n in f["shard"].value_counts().items():
                seen[shard] = seen.get(shard, 0) + int(n)

    return rows.mapInPandas(count, COUNTED)


def assign(docs: DataFrame, now: Sequence[Shard] | None = None, grown: Sequence[Shard] | None = None) -> DataFrame:
    """One row per document: doc_id, size (bytes of the text and one), text_crc32, law, shard, slot (its number in the shard, from
    0, without gaps) and grown_shard (its shard in the topology `grown`: by default one shard more)."""
    now, grown = topology() if now is None else now, topology(FIRST + 1) if grown is None else grown
    common.prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("_key")
    keyed = docs.select(key, F.col("doc_id").cast("string").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = descend(descend(keyed, "_key", now, "shard"), "_key", grown, "grown_shard")
    dealt = dealt.select("doc_id", "size", "text_crc32", "shard", "grown_shard", F.spark_partition_id().alias("part"))
    rows = common.materialise(numbered(dealt), "sharded")
    counts = rows.groupBy("part", "shard").agg((F.max("nth") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "shard", F.coalesce(before, F.lit(0)).alias("offset"))
    return rows.join(offsets, ["part", "shard"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("nth")).alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, now: Sequence[Shard] | None = None, rows_a_file: int = 1_000_000) -> None:
    """The documents' rows, all columns as they were, as Parquet in folders shard=N under path. Tasks of a shard are as many as
    adaptive execution finds its size to need, and files are cut at rows_a_file."""
    if "shard" in docs.columns:
        raise ValueError("the folders are named by a column shard; rename the input's")
    keyed = docs.withColumn("_fl_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    dealt = descend(keyed, "_fl_key", topology() if now is None else now, "shard").drop("_fl_key")
    dealt.hint("rebalance", "shard").write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)


def movement(assigned: DataFrame) -> DataFrame:
    """How many rows and bytes each pair of shards exchanges on the way from shard to grown_shard, without those that stay."""
    moved = assigned.where("shard <> grown_shard")
    return moved.groupBy("shard", "grown_shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
