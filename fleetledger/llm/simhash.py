"""SimHash near-duplicate groups, found by Golay-code fuzzy hashing.

A fingerprint has 64 bits: bit b is 1 if it is 1 in over half of the XXH64 hashes of the text's word shingles. It
is seen as three segments: A and B of 23 bits, C of 18. The perfect binary Golay code (23, 12) puts every 23-bit word
within 3 bits of exactly one codeword, so `decode` gives a 12-bit index, and two words at most 1 bit apart meet if one
gives its own index and the other the indices of all words around it (1 to 6 different ones). At most 3 errors over
(A, B, C) leave one of these cases, and each has its keys:

    A and B have one error each, so C at most one: fuzzy A, fuzzy B, and an error-free half of C
    A has none, B at most one, or the reverse:     exact A with fuzzy B, fuzzy A with exact B
    A has two or more, so B and C one at most:     exact B with fuzzy C, fuzzy B with exact C
    B has two or more, so A and C one at most:     exact A with fuzzy C, fuzzy A with exact C

Fingerprints that share a key are compared on all 64 bits. A bucket gives a spanning forest of its links, not all its
pairs; forests keep every component. Components are joined across buckets by large-star and small-star steps.

Edge cases: a null text counts as empty; texts without words have the fingerprint zero and are linked like others;
null doc_ids get a component_id only through other members (a group of null ids alone has a null one) but link others as
any do; repeated rows
are equal members; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, exact_dedup

RADIUS = 3
SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))

# --- fingerprints -----------------------------------------------------------------------------------------------


def fingerprint(text: str, words: int = 3) -> int:
    """Fingerprint of a text as an unsigned number."""
    w = text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space separates
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8")
    ones = np.zeros(64, "int64")
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, words: int = 3, *marks: str) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long), and binary columns `marks` of docs as they are."""
    common.prepare(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = np.array([fingerprint(t, words) for t in f["text"]], "u8").view("i8")
            yield f[["id", "known", *marks]].assign(fp=fp)

    # pandas has no long with nulls but float64, which would round ids: the null travels beside.
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(F.coalesce(doc_id, F.lit(0)).cast("long").alias("id"), doc_id.isNotNull().alias("known"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *marks)
    made = texts.mapInPandas(run, "id long, known boolean, " + "".join(f"{m} binary, " for m in marks) + "fp long")
    return made.select(F.when(F.col("known"), F.col("id")).alias("doc_id"), "fp", *marks)


# --- Golay keys -------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 23 single bits, and the error pattern of each of the 2,048 syndromes."""
    poly = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1

    def rest(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= poly << (i - 11)
        return x

    single = np.array([rest(1 << i) for i in range(23)])
    error = np.zeros(2048, "int64")
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                bits = {i, j, k}
                s = 0
                for b in bits:
                    s ^= int(single[b])
                error[s] = sum(1 << b for b in bits)
    return single, error


def decode(words: np.ndarray) -> np.ndarray:
    """Index (the 12 upper bits) of the codeword within 3 bits of each 23-bit word."""
    single, error = golay()
    syndrome = np.zeros(words.shape, "int64")
    for b in range(23):
        syndrome ^= (words >> b & 1) * single[b]
    return (words ^ error[syndrome]) >> 11


def around(words: np.ndarray, bits: int) -> np.ndarray:
    """Rows of the different indices of a word and of all words one bit away; -1 fills up."""
    flips = np.r_[0, 1 << np.arange(bits)]
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return np.sort(found, axis=1)[:, ::-1]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unsigned fingerprints: the row numbers and the keys under which they are filed."""
    seg = [(fp >> np.uint64(at)).astype("int64") & ((1 << n) - 1) for at, n in SEGMENTS]
    own = [decode(s) for s in seg]
    near = [around(s, n) for s, (_, n) in zip(seg, SEGMENTS)]
    rows, keys = [], []
    here = np.arange(len(fp))

    def file(kind: int, *parts: tuple[np.ndarray, int]) -> None:
        """One key for each way to take one value from each part; negative values give none."""
        at, key = here, np.full(len(fp), kind, "int64")
        for values, bits in parts:
            values = values[at] if values.ndim == 1 else values[at]
            if values.ndim == 2:
                keep = values >= 0
                n = keep.sum(1)
                at, key, values = np.repeat(at, n), np.repeat(key, n), values[keep]
            key = key << bits | values
        rows.append(at)
        keys.append(key)

    half = [seg[2] & 511, seg[2] >> 9]
    for kind, h in enumerate(half):
        file(kind, (h, 9), (near[0], 12), (own[1], 12))
        file(kind, (h, 9), (own[0], 12), (near[1], 12))
    pairs = [(0, 1), (1, 0), (1, 2), (2, 1), (0, 2), (2, 0)]
    for kind, (exact, fuzzy) in enumerate(pairs, 2):
        file(kind, (seg[exact], 23), (near[fuzzy], 12))
    return np.concatenate(rows), np.concatenate(keys)


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, as pairs of positions. Memory is linear."""
    left, links = np.arange(len(fp)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= RADIUS
            if near.any():
                reached = left[near].tolist()
                links += [(at, j) for j in reached]
                queue += reached
                left = left[~near]
    return links


def links(classes: DataFrame) -> DataFrame:
    """Distinct links a < b between the representatives of distinct fingerprints (columns fp, node)."""
    spark = classes.sparkSession
    common.prepare(spark)

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp, node = f["fp"].to_numpy().view("u8"), f["node"].to_numpy()
            for at in range(0, len(fp), 4096):
                row, key = keys_of(fp[at : at + 4096])
                yield pd.DataFrame({"key": key, "fp": fp[at : at + 4096][row].view("i8"), "node": node[at : at + 4096][row]})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; the last key of a batch may go on in the next."""
        held: list[pd.DataFrame] = []

        def done(f: pd.DataFrame) -> pd.DataFrame:
            key, fp, node = f["key"].to_numpy(), f["fp"].to_numpy().view("u8"), f["node"].to_numpy()
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[begin, len(key)])
            two = begin[size == 2]  # most buckets with company are pairs
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
            found = [np.stack([node[two], node[two + 1]], 1)]
            for a, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
                values, first = np.unique(fp[a : a + n], return_index=True)
                if pairs := forest(values):
                    found.append(node[a : a + n][first][np.array(pairs)])
            pairs = np.concatenate(found)
            pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
            return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

        for f in frames:
            if not len(f):
                continue
            last = f["key"].iloc[-1]
            tail = int(np.searchsorted(f["key"].to_numpy(), last))
            if tail:
                yield done(pd.concat([*held, f.iloc[:tail]]))
                held = []
            held.append(f.iloc[tail:])
        if held:
            yield done(pd.concat(held))

    filed = classes.mapInPandas(file, "key long, fp long, node long")
    dealt = filed.repartition(common.partitions(spark), "key").sortWithinPartitions("key")
    return dealt.mapInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Large-star and small-star steps until nothing changes: node, root (the smallest node reachable). Every
    step is written, so that no plan grows; the driver sees only sums."""
    edges = common.materialise(edges.select("a", "b"), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        edges = common.materialise(small.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct().select("a", "b"), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = now


def grouped(docs: DataFrame, words: int, *marks: str) -> DataFrame:
    """One row per document: doc_id, fp, root (the group's smallest fingerprint), component_id, and columns `marks` of docs."""
    marked = common.materialise(with_fingerprint(docs, words, *marks), "fingerprints")
    classes = common.materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    # Fingerprints are the nodes, so that those of null ids alone link others too.
    roots = components(links(classes.select("fp", F.col("fp").alias("node"))))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = common.materialise(named, "fingerprint-components")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_dedup(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    return grouped(docs, words).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of docs that stay when of each group only the document with the smallest doc_id does; of a group whose ids
    are all null, one row stays."""
    marked = docs.select("doc_id", "text", exact_dedup.digest().alias("_fl_digest"))
    found = common.materialise(grouped(marked, words, "_fl_digest"), "near-copies")
    dropped = found.where("component_id is null or doc_id is null or doc_id <> component_id").select(F.col("doc_id").alias("_fl_id"), "_fl_digest").distinct()
    lone = found.where("component_id is null").groupBy("root").agg(F.min("_fl_digest").alias("_fl_digest")).select("_fl_digest")
    return exact_dedup.keep_rows(docs, dropped, lone)
