"""URL filtering by host and path rules: a sort-merge range join with a sweep over reversed hosts.

A host is written from its last label on, each label with a dot after it (`net.example.www.`), so that a rule's host and
all its subdomains are the keys that begin with the rule's key: an interval of the sorted keys. Pages are dealt by ranges
of (key, path, page_id) and sorted; each task sweeps its part, keeping a stack of the rules' hosts whose intervals hold
the current key, innermost on top. Each host on the stack has its paths sorted, with a link from each path to the longest
other that begins it, so the longest fitting path takes one search and a few links. A host with very many pages spreads
over tasks by path and page_id.

Rules reach the tasks by broadcast up to RULES rows and RULE_BYTES bytes (checked); beyond, the different hosts of the
pages are joined to rules by each of their suffixes instead, with the same result.

Of all rules that fit, the longest (host and path together) wins; of equally long ones that with the longer host. Equal
rules with different verdicts block.

Edge cases: a null url, or one without `://`, has an empty host and path and fits no rule; null and repeated page_ids
are allowed, each row gives a row; an empty table gives an empty result; without rules the default holds; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .decontaminate import LOWER, UPPER

RULES, RULE_BYTES = 500_000, 64_000_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Host:
    """Paths of one rule host in order, each with the place of the longest other path that begins it."""

    def __init__(self, key: str, rules: list[tuple[str, str, str]]):
        self.key = key
        self.paths = [r[0] for r in rules]
        self.rules = [r[1:] for r in rules]
        self.outer, open_ = [], []
        for i, path in enumerate(self.paths):
            while open_ and not path.startswith(self.paths[open_[-1]]):
                open_.pop()
            self.outer.append(open_[-1] if open_ else -1)
            open_.append(i)

    def longest(self, path: str) -> int:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return i


class Sweep:
    """Answers for keys in ascending order."""

    def __init__(self, hosts: list[Host]):
        self.hosts, self.keys = hosts, [h.key for h in hosts]
        self.stack: list[Host] = []
        self.next, self.at = 0, None

    def move(self, key: str) -> None:
        if self.at is None:  # what began before the first key: its own prefixes
            ends = [i + 1 for i, c in enumerate(key[:-1]) if c == "."]
            for e in ends:
                i = bisect_left(self.keys, key[:e])
                if i < len(self.keys) and self.keys[i] == key[:e]:
                    self.stack.append(self.hosts[i])
            self.next = bisect_left(self.keys, key)
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()
        while self.next < len(self.keys) and self.keys[self.next] <= key:
            host = self.hosts[self.next]
            while self.stack and not host.key.startswith(self.stack[-1].key):
                self.stack.pop()
            if key.startswith(host.key):
                self.stack.append(host)
            self.next += 1
        self.at = key

    def find(self, key: str, path: str) -> tuple[str, str] | None:
        if key != self.at:
            self.move(key)
        best, size = None, (-1, -1)
        for host in self.stack:
            i = host.longest(path)
            if i >= 0 and (own := (len(host.key) + len(host.paths[i]), len(host.key))) > size:
                best, size = host.rules[i], own
        return best


def rules_of(rules: DataFrame) -> DataFrame:
    """key, host, path, verdict of rules (host, path, verdict), each host and path once; block beats allow."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    clean = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(host.alias("host"), "path", "verdict")
    return clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", key_of(F.col("host")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", most: int = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path of the rule, or null), verdict."""
    spark = pages.sparkSession
    common.prepare(spark)
    known = rules_of(rules)
    n, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("host") * 2 + F.octet_length("path")), F.lit(0))).first()
    url = F.col("url")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    if n > most or size > RULE_BYTES:
        return by_suffixes(base, known, default)

    grouped: dict[str, list] = {}
    for r in known.collect():  # bounded by the check above
        grouped.setdefault(r["key"], []).append((r["path"], r["host"] + r["path"], r["verdict"]))
    sent = spark.sparkContext.broadcast([Host(k, sorted(grouped[k])) for k in sorted(grouped)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sweep = Sweep(sent.value)
        for f in frames:
            found = [sweep.find(k, p) if h else None for k, h, p in zip(f["key"], f["host"], f["path"])]
            yield pd.DataFrame({
                "id": f["id"], "known": f["known"], "host": f["host"], "path": f["path"],
                "rule": np.array([x and x[0] for x in found], object), "verdict": [x[1] if x else default for x in found],
            })

    # pandas has no long with nulls but float64, which would round ids: the null travels beside.
    keyed = base.select(key_of(F.col("host")).alias("key"), "host", "path", F.coalesce("page_id", F.lit(0).cast("long")).alias("id"), F.col("page_id").isNotNull().alias("known"))
    dealt = keyed.repartitionByRange(common.partitions(spark), "key", "path", "id").sortWithinPartitions("key", "path")
    made = dealt.mapInPandas(run, "id long, known boolean, host string, path string, rule string, verdict string")
    return made.select(F.when(F.col("known"), F.col("id")).alias("page_id"), "host", "path", "rule", "verdict")


def by_suffixes(base: DataFrame, known: DataFrame, default: str) -> DataFrame:
    """The same by equal joins of host suffixes, for rules too many to broadcast."""
    places = base.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.lit(1 << 20)), "."))
    tried = places.select("host", "path", F.explode(suffix).alias("rule_host"))
    mine = known.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    fits = tried.join(mine, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    order = Window.partitionBy("host", "path").orderBy((F.length("rule_host") + F.length("rule_path")).desc(), F.length("rule_host").desc())
    best = fits.withColumn("_fl_n", F.row_number().over(order)).where("_fl_n = 1")
    best = best.select("host", "path", F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")
    return base.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
