"""Exact deduplication through a cuckoo-filter index over live text digests.

Texts are equal when they are identical after each run of ASCII white space became one space; null counts as
empty. Every task folds its rows into a `DigestIndex`: a cuckoo filter answers "surely new" at once, a hit is
verified against the stored digests of the key's bucket, and a filter that overflows is rebuilt at twice the
size from the stored keys. A first fold runs where the rows are read, so that a digest that many rows share
reaches its owner as one row per task; the second fold runs on the digest's owner partition.

Edge cases: null ids lose against any other id and group with equal texts; rows that repeat a doc_id and its
text are one document (all of them carry the same `kept`); an empty table gives an empty result; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SLOTS = 4
MAX_KICKS = 200
CONTENT_BUCKETS = 4096
#: Keys that the fold on the reading side holds before it passes them on.
LOCAL_KEYS = 100_000


class Overflow(Exception):
    pass


class CuckooFilter:
    """Partial-key cuckoo filter: 15-bit tags, 4 slots a bucket, insertion, deletion and lookup by 64-bit hash."""

    def __init__(self, buckets: int):
        self.mask = buckets - 1
        self.tags = array("H", bytes(2 * SLOTS * buckets))

    def _places(self, h: int) -> tuple[int, int, int]:
        tag = (h >> 49) | 0x8000
        first = h & self.mask
        return tag, first, first ^ (tag * 0x5BD1E995 >> 5 & self.mask)

    def __contains__(self, h: int) -> bool:
        tag, a, b = self._places(h)
        t, a, b = self.tags, a * SLOTS, b * SLOTS
        return tag in t[a : a + SLOTS] or tag in t[b : b + SLOTS]

    def _put(self, bucket: int, tag: int) -> bool:
        at = bucket * SLOTS
        for i in range(at, at + SLOTS):
            if not self.tags[i]:
                self.tags[i] = tag
                return True
        return False

    def insert(self, h: int) -> None:
        tag, a, b = self._places(h)
        if self._put(a, tag) or self._put(b, tag):
            return
        at = b
        for kick in range(MAX_KICKS):
            i = at * SLOTS + kick % SLOTS
            self.tags[i], tag = tag, self.tags[i]
            at ^= tag * 0x5BD1E995 >> 5 & self.mask
            if self._put(at, tag):
                return
        raise Overflow

    def delete(self, h: int) -> None:
        tag, a, b = self._places(h)
        for bucket in (a, b):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.tags[i] == tag:
                    self.tags[i] = 0
                    return


class DigestIndex:
    """Live digests with the smallest id and the number of rows of each."""

    def __init__(self, buckets: int = 1024):
        self.size = buckets
        self.filter = CuckooFilter(buckets)
        self.content: list[dict] = [{} for _ in range(CONTENT_BUCKETS)]
        self.live = 0

    @staticmethod
    def _hash(digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little")

    def find(self, digest: bytes) -> list | None:
        """The entry of a live digest. The filter answers misses; hits are verified in the content bucket."""
        h = self._hash(digest)
        return self.content[(h >> 20) % CONTENT_BUCKETS].get(digest) if h in self.filter else None

    def add(self, digest: bytes, smallest, rows: int) -> None:
        entry = self.find(digest)
        if entry is not None:
            if smallest is not None and (entry[0] is None or smallest < entry[0]):
                entry[0] = smallest
            entry[1] += rows
            return
        h = self._hash(digest)
        self.content[(h >> 20) % CONTENT_BUCKETS][digest] = [smallest, rows]
        self.live += 1
        try:
            self.filter.insert(h)
        except Overflow:
            self._resize()

    def remove(self, digest: bytes) -> bool:
        """Forgets a live digest; False if it was not live."""
        if self.find(digest) is None:
            return False
        h = self._hash(digest)
        del self.content[(h >> 20) % CONTENT_BUCKETS][digest]
        self.filter.delete(h)
        self.live -= 1
        return True

    def _resize(self) -> None:
        """A filter of twice the size from the stored keys (the failed insertion left a tag without a place)."""
        while True:
            self.size *= 2
            self.filter = CuckooFilter(self.size)
            try:
                for bucket in self.content:
                    for digest in bucket:
                        self.filter.insert(self._hash(digest))
                return
            except Overflow:
                continue

    def rows(self) -> Iterator[pd.DataFrame]:
        for at in range(0, CONTENT_BUCKETS, 256):
            found = [(d, *e) for bucket in self.content[at : at + 256] for d, e in bucket.items()]
            if found:
                digest, smallest, rows = zip(*found)
                yield pd.DataFrame({"digest": digest, "keep_id": pd.array(smallest, "Int64"), "group_size": rows})


INDEX_SCHEMA = "digest binary, keep_id long, group_size long"


def folded(rows: DataFrame) -> DataFrame:
    """Index rows for a fold: ids as strings, since pandas would take a long column with nulls for float64 and round it."""
    return rows.withColumn("keep_id", F.col("keep_id").cast("string"))


def _fold(limit: int | None):
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = DigestIndex()
        for f in frames:
            ids = [int(i) if isinstance(i, str) else None for i in f["keep_id"]]
            for digest, smallest, rows in zip(f["digest"], ids, f["group_size"]):
                index.add(bytes(digest), smallest, rows)
            if limit and index.live >= limit:
                yield from index.rows()
                index = DigestIndex()
        yield from index.rows()

    return fold


def digest() -> Column:
    """SHA-256 of the normalised text."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), common.WHITESPACE_RUN, " ")
    return F.unhex(F.sha2(text, 256))


def with_digest(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"))


def build_index(keyed: DataFrame) -> DataFrame:
    """Rows (doc_id, digest) to one row a live digest: digest, keep_id, group_size."""
    spark = keyed.sparkSession
    common.prepare(spark)
    ones = keyed.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    local = folded(ones).mapInPandas(_fold(LOCAL_KEYS), INDEX_SCHEMA)
    owned = folded(local).repartition(common.partitions(spark), "digest")
    return owned.mapInPandas(_fold(None), INDEX_SCHEMA)


def update_index(index: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """An index after deletion of digests (column digest; unknown ones are ignored) and then insertion of the
    rows of `added` (doc_id, digest)."""
    spark = index.sparkSession
    common.prepare(spark)
    fresh = build_index(added)
    gone = deleted.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size")).distinct()
    steps = index.withColumn("step", F.lit(0)).unionByName(gone.withColumn("step", F.lit(1))).unionByName(fresh.withColumn("step", F.lit(2)))

    def play(frames):
        live = DigestIndex()
        for f in frames:
            ids = [int(i) if isinstance(i, str) else None for i in f["keep_id"]]
            for digest, smallest, rows, step in zip(f["digest"], ids, f["group_size"], f["step"]):
                if step == 1:
                    live.remove(bytes(digest))
                else:
                    live.add(bytes(digest), smallest, rows)
        yield from live.rows()

    dealt = folded(steps).repartition(common.partitions(spark), "digest").sortWithinPartitions("step")
    return dealt.mapInPandas(play, INDEX_SCHEMA)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. See the module for edge cases."""
    keyed = common.materialise(with_digest(docs), "digests")
    index = common.materialise(build_index(keyed), "digest-index")
    joined = keyed.join(index, "digest")  # a digest of very many rows is split by adaptive execution
    return joined.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, dropped: DataFrame, lone: DataFrame) -> DataFrame:
    """The rows of docs but those whose id and text digest are in `dropped` (_fl_id, _fl_digest), and of the rows without an id
    one for each digest in `lone` (_fl_digest), all columns as they were. Digests in `lone` must be among the dropped. Both are written
    first: what is small by its files' size then meets the rows where they are scanned, and no text is shuffled."""
    dropped, lone = common.materialise(dropped, "dropped"), common.materialise(lone, "lone-digests")
    marked = docs.select(common.whole_row(docs).alias("_fl_row"), F.col("doc_id").cast("long").alias("_fl_own"), digest().alias("_fl_mark"), F.coalesce("text", F.lit("")).alias("_fl_text"))
    same = F.col("_fl_own").eqNullSafe(F.col("_fl_id")) & (F.col("_fl_mark") == F.col("_fl_digest"))
    kept = marked.join(dropped, same, "left_anti").select("_fl_row")
    nameless = marked.where("_fl_own is null").join(lone, F.col("_fl_mark") == F.col("_fl_digest"), "left_semi")
    return kept.union(nameless.groupBy("_fl_mark").agg(F.min_by("_fl_row", "_fl_text").alias("_fl_row")).select("_fl_row")).select("_fl_row.*")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, all columns as they were, whatever the names of others than doc_id (an integer) and
    text; of a group whose ids are all null, one row. Rows that repeat both the smallest id and the text all stay: by their id they are
    one document."""
    found = exact_dedup(docs).select(F.col("doc_id").alias("_fl_id"), "keep_id", "kept", F.unhex("text_sha256").alias("_fl_digest"))
    dropped = found.where("not kept or keep_id is null").select("_fl_id", "_fl_digest").distinct()
    return keep_rows(docs, dropped, found.where("keep_id is null").select("_fl_digest").distinct())
