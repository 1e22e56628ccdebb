"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

Words are the runs of digits, letters and non-ASCII characters, A-Z lower-cased. An item's windows are its runs of
`window` consecutive words (all its words if it has fewer). The index holds postings of document words: term, document,
position, and the neighbouring words on both sides. Counts over all documents tell which term of each window is the
rarest; only documents that hold it can hold the window. These anchors cover all windows of an item with few
positions. For each anchor, the postings of its term, adjusted by its offset in the item, are intersected with the
item's other words outward from the anchor: a run of at least a window's length that agrees is an exact match, and all
its words are hit. `proximity` reports looser matches, from postings of all words of the items.

Terms and anchors are broadcast in blocks of at most BLOCK rows; larger benchmarks take several blocks.

Edge cases: null or wordless texts have no words and are never hit; an item of fewer words than a window, but not
none, is one window; null and repeated doc_ids are allowed; items that share an item_id count once, items without one
hit words but are not counted; an empty documents table gives an empty result, an empty benchmark hits nothing; other
columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 10
BLOCK = 200_000
#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words in order, case as written. To split at what is between them takes an eighth of the time of extracting them."""
    return F.array_remove(F.split(text, BETWEEN), "")


def lowered(word: Column) -> Column:
    """A-Z in lower case and nothing else; lower() does just that, and faster, where all is ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def term_of(word: str) -> Column:
    """A word as the index knows it. Outer generators and this non-null form keep the optimizer from guarding them with
    filters that would cut each text, and lower each word, once more; the null of a wordless text meets no term."""
    return lowered(F.coalesce(F.col(word), F.lit("")))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (a key of its own), item_id, words, n; items without words are left out."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    items = benchmark.select(common.row_key("item_id").alias("item"), F.col("item_id").cast("string").alias("item_id"), words_of(text).alias("words")).distinct()
    return items.withColumn("n", F.size("words")).where("n > 0")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms occurs in all documents: term, freq (terms that don't occur are left out)."""
    every = docs.select(F.explode_outer(words_of(F.col("text"))).alias("word")).select(term_of("word").alias("term"))
    parts = [every.join(F.broadcast(t), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("freq")) for t in blocks(terms, "term")]
    return functools.reduce(DataFrame.unionByName, parts)


def blocks(df: DataFrame, key: str) -> list[DataFrame]:
    """df in parts of about BLOCK rows at most, by a hash of the key."""
    n = -(-df.count() // BLOCK) or 1
    return [df] if n == 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


def anchors_of(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """Positions that cover every window that can occur at all by its rarest term: item, item_id, n, term, offset,
    and the item's words outward from there, at most window - 1 on each side."""
    spot = items.select("item", "n", F.posexplode("words").alias("offset", "term")).join(counts, "term", "left")
    spot = spot.withColumn("freq", F.coalesce("freq", F.lit(0)))
    low, high = F.greatest(F.lit(0), F.col("offset") - (window - 1)), F.least(F.col("offset"), F.greatest(F.lit(0), F.col("n") - window))
    covered = spot.withColumn("start", F.explode(F.sequence(low, high)))
    rarest = covered.groupBy("item", "start").agg(F.min(F.struct("freq", "offset")).alias("best")).where("best.freq > 0")
    chosen = rarest.select("item", F.col("best.offset").alias("offset")).distinct().join(items, "item")
    return chosen.select(
        "item", "item_id", "n", "offset", F.expr("words[offset]").alias("term"),
        *outward("words", "offset", window - 1),
    )


def outward(words: str, at: str, reach: int) -> list[Column]:
    """before (nearest word first) and after: up to `reach` words on each side of position `at`."""
    return [
        F.expr(f"reverse(slice({words}, greatest({at} - {reach}, 0) + 1, least({at}, {reach})))").alias("before"),
        F.expr(f"slice({words}, {at} + 2, {reach})").alias("after"),
    ]


def build_postings(docs: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """Postings of the given terms: term, key, doc_id, pos, before, after."""
    base = docs.select(common.row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    every = base.select("key", "doc_id", "words", F.posexplode_outer("words").alias("pos", "word")).withColumn("term", term_of("word"))
    near = [F.transform(c, lowered).alias(n) for c, n in zip(outward("words", "pos", window - 1), ("before", "after"))]
    parts = [every.join(F.broadcast(t), "term", "left_semi").select("term", "key", "doc_id", "pos", *near) for t in blocks(terms, "term")]
    return functools.reduce(DataFrame.unionByName, parts)


def agreeing(mine: str, other: str) -> Column:
    """Length of the common beginning of two lists."""
    first = F.array_position(F.zip_with(mine, other, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(first == 0, F.size(mine)).otherwise(first - 1).cast("int")


def phrase_hits(postings: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """Exact matches: key, doc_id, item_id, first and last (positions of the words hit)."""
    mine = anchors.withColumnsRenamed({"before": "i_before", "after": "i_after"})
    parts = [postings.join(F.broadcast(b), "term") for b in blocks(mine, "item")]
    met = functools.reduce(DataFrame.unionByName, parts)
    met = met.withColumn("left", agreeing("i_before", "before")).withColumn("right", agreeing("i_after", "after"))
    met = met.where(F.col("left") + F.col("right") + 1 >= F.least(F.lit(window), F.col("n")))
    return met.select("key", "doc_id", "item_id", (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right")).alias("last"))


def proximity(docs: DataFrame, benchmark: DataFrame, least: int = 5, window: int = WINDOW) -> DataFrame:
    """Looser matches: documents in which at least `least` different words of an item stand, in any order, less than a
    window from one of its words, in the document as in the item: doc_id, item_id, shared (the most such words, that word
    among them). Postings are those of all words of the items, so that a window with words that occur nowhere counts too."""
    items = common.materialise(items_of(benchmark), "items")
    spots = items.select("item", "item_id", F.posexplode("words").alias("offset", "term"))
    every = docs.select(common.row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.posexplode_outer(words_of(F.col("text"))).alias("pos", "word")).withColumn("term", term_of("word"))
    parts = [every.join(F.broadcast(b), "term").select("key", "doc_id", "item", "item_id", "pos", "offset", "term") for b in blocks(spots, "item")]
    met = functools.reduce(DataFrame.unionByName, parts)
    reach = Window.partitionBy("key", "doc_id", "item").orderBy("pos").rangeBetween(1 - window, window - 1)
    met = met.withColumn("around", F.collect_set(F.struct("offset", "term")).over(reach))
    near = F.filter("around", lambda x: F.abs(x["offset"] - F.col("offset")) < window)
    shared = F.size(F.array_distinct(F.transform(near, lambda x: x["term"])))
    return met.withColumn("shared", shared).groupBy("doc_id", "item_id").agg(F.max("shared").alias("shared")).where(F.col("shared") >= least)


def index(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Anchors of the benchmark and the stored postings of their terms."""
    items = common.materialise(items_of(benchmark), "items")
    terms = items.select(F.explode("words").alias("term")).distinct()
    counts = common.materialise(term_counts(docs, terms), "term-counts")
    anchors = common.materialise(anchors_of(items, counts, window), "anchors")
    return anchors, common.materialise(build_postings(docs, anchors.select("term").distinct(), window), "postings")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    anchors, postings = index(docs, benchmark, window)
    hits = phrase_hits(postings, anchors, window)
    before = F.max("last").over(Window.partitionBy("key", "doc_id").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.coalesce(before, F.lit(-1)), F.col("first") - 1))
    per = hits.withColumn("fresh", fresh).groupBy("key", "doc_id").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    per = per.withColumnRenamed("doc_id", "hit_id")
    base = docs.select(
        common.row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.size(words_of(F.col("text"))), F.lit(0)).cast("long").alias("n_words"),
    )
    base = base.withColumn("n_words", F.greatest("n_words", F.lit(0)))
    found = base.join(per, (base["key"] == per["key"]) & base["doc_id"].eqNullSafe(per["hit_id"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, all columns as they were. The keys of what goes are written first: where
    their files are small they meet the rows where these are scanned, and no text is shuffled."""
    anchors, postings = index(docs, benchmark, window)
    bad = phrase_hits(postings, anchors, window).select(F.col("key").alias("_fl_key"), F.col("doc_id").alias("_fl_id")).distinct()
    bad = common.materialise(bad, "contaminated")
    rows = docs.select(common.whole_row(docs).alias("_fl_row"), common.row_key().alias("_fl_own_key"), F.col("doc_id").cast("long").alias("_fl_own_id"))
    same = (F.col("_fl_own_key") == F.col("_fl_key")) & F.col("_fl_own_id").eqNullSafe(F.col("_fl_id"))
    return rows.join(bad, same, "left_anti").select("_fl_row.*")
