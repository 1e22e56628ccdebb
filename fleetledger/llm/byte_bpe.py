"""Byte-level BPE encoding and decoding with a public rank file.

A text longer than `chunk` characters is cut into chunks that overlap by `overlap` characters. Chunks are
pre-tokenised in parallel, each as if it were a text of its own. The pattern looks only forward, so once a true
boundary is also a boundary of the next chunk, that chunk's boundaries are true from there to near its end:
stitching walks the chunks, changes over where boundaries resynchronise, and matches on piece by piece over the
whole text where an overlap has no common boundary. The stitched pieces are dealt again, a chunk's worth at a time, and
encoded in parallel. Decoding concatenates the bytes of the ids. Shorter texts are one chunk and need no stitching.
Of some AT_A_TIME characters the distinct pieces that are not remembered are merged together, in arrays, a pair of each in
a round; pieces of LONG characters or more are merged one by one, with a heap.

Edge cases: a null text counts as empty (no ids); null and repeated doc_ids are allowed, each row gives a row;
an empty table gives an empty result; other columns are ignored. The rank file must have all 256 bytes, and ids
below END.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK, OVERLAP = 32_768, 512
#: No alternative of the patterns looks further than this past its start, but for the runs that it matches.
REACH = 3
#: Pieces whose ids a worker remembers (8 ids for each); it forgets all behind the texts that reach this.
REMEMBERED = 300_000
#: Characters of text whose pieces are looked up, and merged where they are new, at a time; characters from which a piece
#: is merged by itself; places (a piece's bytes, filled up to others') that are merged in one array.
AT_A_TIME, LONG, PLACES = 2_000_000, 64, 1 << 19
#: Ids that are decoded at a time.
DECODED = 65_536
#: Ids are below 2^ID_BITS, bytes of a piece that is not long below 2^PLACE_BITS; END stands for no id.
ID_BITS, PLACE_BITS = 20, 8
END = (1 << ID_BITS) - 1


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank, leftmost first, is merged until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    dead = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if dead[i] or j >= n or end[j] != stop:
            continue
        dead[j], end[i], after[i] = 1, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if not dead[i]]


class Joins:
    """Which two ids join to which: a hash table in one array, so that many pairs are looked up at once."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= END:
            raise ValueError(f"ids must be below {END}")
        self.single = np.array([ranks[bytes([k])] for k in range(256)])
        made = [(a, b, i) for t, i in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        left, right, made = np.array(made, "int64").reshape(-1, 3).T
        self.bits = (8 * len(made) + 1).bit_length()
        self.table = np.full(1 << self.bits, -1, "int64")
        entry, at = (left << ID_BITS | right) << ID_BITS | made, self.slot(left << ID_BITS | right)
        while len(entry):
            free = self.table[at] < 0
            self.table[at[free]] = entry[free]
            again = self.table[at] != entry
            entry, at = entry[again], self.next(at[again])

    def slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair.astype("uint64") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype("int64")

    def next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & (len(self.table) - 1)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair, END where the two don't join."""
        pair = left << ID_BITS | right
        at = self.slot(pair)
        entry = self.table[at]
        found = entry >> ID_BITS == pair
        out = np.where(found, entry & END, END)
        other = np.flatnonzero(~found & (entry >= 0))
        while len(other):
            at[other] = self.next(at[other])
            entry = self.table[at[other]]
            found = entry >> ID_BITS == pair[other]
            out[other[found]] = entry[found] & END
            other = other[~found & (entry >= 0)]
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as `merge` finds them, as little-endian 32-bit integers."""
        out = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), "int64", len(pieces))
        width = (size + 3) // 4 * 4
        for w in np.unique(width).tolist():
            of_width, n = np.flatnonzero(width == w), max(1, PLACES // w)
            for rows in (of_width[k : k + n] for k in range(0, len(of_width), n)):
                ids, n_ids = self._merge([pieces[k] for k in rows.tolist()], size[rows], w)
                ends = np.cumsum(4 * n_ids).tolist()
                for k, a, b in zip(rows.tolist(), [0, *ends], ends):
                    out[k] = ids[a:b]
        return out

    def _merge(self, pieces: list[bytes], size: np.ndarray, w: int) -> tuple[bytes, np.ndarray]:
        """All ids end to end, and their number for each piece, of pieces of up to w bytes.

        A column is a piece, a row a place in it. order holds, where an id begins, the rank at which it joins to the next
        one and its place: the least of a column is the pair to be merged, leftmost first. Row w stands for no id.
        """
        n, place = len(pieces), np.arange(w + 1)[:, None]
        ids = np.full((w + 1, n), END)
        ids[:w] = self.single[np.frombuffer(b"".join([p.ljust(w, b"\0") for p in pieces]), np.uint8).reshape(n, w).T]
        ids[place >= size] = END
        order = (np.full((w + 1, n), END) << PLACE_BITS | place).astype("int32")
        order[:w] = self.join(ids[:w].ravel(), ids[1:].ravel()).reshape(w, n) << PLACE_BITS | place[:w]
        after, before = (np.repeat(p, n) for p in ((np.arange(w + 1) + 1).clip(max=w), np.r_[w, np.arange(w)]))
        ids, first, order = ids.ravel(), order[:w], order.ravel()

        def rank(at, col, left, right):
            order[at * n + col] = self.join(left, right) << PLACE_BITS | at

        while True:
            least = first.min(axis=0)
            col = np.flatnonzero(least < END << PLACE_BITS)
            if not len(col):
                break
            at, made = (least[col] & (1 << PLACE_BITS) - 1).astype("int64"), (least[col] >> PLACE_BITS).astype("int64")
            gone = after[at * n + col]
            right, left = after[gone * n + col], before[at * n + col]
            ids[at * n + col], ids[gone * n + col] = made, END
            after[at * n + col], before[right * n + col] = right, at
            order[gone * n + col] = END << PLACE_BITS
            rank(at, col, made, ids[right * n + col])
            rank(left, col, ids[left * n + col], made)
        ids = ids.reshape(w + 1, n).T
        there = ids != END
        return ids[there].astype("<u4").tobytes(), there.sum(axis=1)


class Encoder(dict):
    """Pieces to numbers; the ids of number k are the size[k] ones from begin[k] in `known`. A piece's string is looked up
    once, where it was cut; all else is done with numbers."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.forget()

    @cached_property
    def joins(self) -> Joins:
        return Joins(self.ranks)

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.known, self.begin, self.size = np.empty(0, "<u4"), np.empty(0, "int64"), np.empty(0, "int64")

    def __missing__(self, piece: str) -> int:
        self[piece] = k = len(self.begin) + len(self.new)
        self.new.append(piece)
        return k

    def learn(self) -> None:
        """Finds the ids of the new pieces; of long ones the string is not kept."""
        new, self.new = self.new, []
        spelt = [p.encode() for p in new]
        made = [None if (i := self.ranks.get(b)) is None else i.to_bytes(4, "little") for b in spelt]
        for k, p in enumerate(new):
            if len(p) >= LONG:
                del self[p]
                made[k] = made[k] or np.asarray(merge(spelt[k], self.ranks), "<u4").tobytes()
        rest = [k for k, ids in enumerate(made) if ids is None]
        for k, ids in zip(rest, self.joins.merge([spelt[k] for k in rest])):
            made[k] = ids
        size = np.fromiter(map(len, made), "int64", len(made)) // 4
        self.begin = np.r_[self.begin, len(self.known) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.known = np.r_[self.known, np.frombuffer(b"".join(made), "<u4")]

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def ids(self, pieces: list[str]) -> bytes:
        return next(self.encode([pieces]))

    def encode(self, cut: Iterable[list[str]]) -> Iterator[bytes]:
        """Ids of each text, given as its pieces, as little-endian 32-bit integers."""
        held, ends, length = [], [], 0
        for pieces in cut:
            held.extend(map(self.__getitem__, pieces))
            ends.append(len(held))
            length += sum(map(len, pieces))
            if length >= AT_A_TIME:
                yield from self._looked_up(held, ends)
                held, ends, length = [], [], 0
        yield from self._looked_up(held, ends)

    def _looked_up(self, held: list[int], ends: list[int]) -> list[bytes]:
        if self.new:
            self.learn()
        numbers = np.fromiter(held, "int64", len(held))
        ids = _runs(self.known, self.begin[numbers], n := self.size[numbers])
        ends = np.r_[0, np.cumsum(n)][ends].tolist()
        if max(len(self.begin), len(self.known) // 8) >= REMEMBERED:
            self.forget()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]


def _runs(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of values, end to end."""
    ends = np.cumsum(size)
    return values[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(maxsize=4)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids end to end; for each id where its own begin, and how many they are."""
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    size = np.fromiter(map(len, out), "int64", len(out))
    return np.frombuffer(b"".join(out), np.uint8), np.cumsum(size) - size, size


def decode_ids(ids: bytes, path: str) -> bytes:
    table, begin, size = byte_table(path)
    ids = np.frombuffer(ids, "<u4")
    cut = [ids[k : k + DECODED] for k in range(0, len(ids), DECODED)]
    return b"".join(_runs(table, begin[own], size[own]).tobytes() for own in cut)


def starts_of(text: str, enc: Encoder) -> np.ndarray:
    """Where the pieces of a text begin, and its length."""
    return np.cumsum([0, *map(len, enc.pieces(text))], dtype="int64")


def stitch(chunks: list[tuple[int, np.ndarray]], text: str, enc: Encoder) -> list[str]:
    """Pieces of the whole text from chunks (offset, own boundaries), in order of their offsets."""
    bounds, at = [0], 0
    for k, (offset, own) in enumerate(chunks):
        own = own + offset
        stop = int(own[-1])
        while at < stop and (i := int(np.searchsorted(own, at))) < len(own) and own[i] != at:
            at = enc.pattern.match(text, at).end()
            bounds.append(at)
        if at >= stop:
            continue
        begin, end = own[i:-1], own[i + 1 :]
        sure = np.ones(len(end), bool) if k == len(chunks) - 1 else (end < stop) & (begin + REACH <= stop)
        n = len(sure) if sure.all() else int(np.argmin(sure))
        if n:
            bounds += end[:n].tolist()
            at = bounds[-1]
    return [text[a:b] for a, b in zip(bounds, bounds[1:])]


def _raw(ids: bytes, path: str) -> tuple:
    return len(ids) // 4, ids


def _digests(ids: bytes, path: str) -> tuple:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decode_ids(ids, path)).hexdigest()


RAW = (_raw, {"n_tokens": "long", "ids": "binary"})
DIGESTS = (_digests, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})


def encode(docs: DataFrame, path: str, pattern: str, out: tuple[Callable, dict] = RAW, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and what `out` makes of the ids: RAW gives n_tokens and ids (little-endian unsigned 32-bit
    integers), DIGESTS gives n_tokens, ids_sha256 and decoded_sha256, of the ids and of what they decode to."""
    spark = docs.sparkSession
    common.prepare(spark)
    finish, columns = out
    schema, names = ", ".join(f"{c} {t}" for c, t in columns.items()), list(columns)

    @F.pandas_udf(schema)
    def whole(texts: pd.Series) -> pd.DataFrame:
        enc = encoder(path, pattern)
        return pd.DataFrame([finish(ids, path) for ids in enc.encode(map(enc.pieces, texts))], columns=names)

    def boundaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, pattern)
        for f in frames:
            yield f.assign(bounds=[starts_of(t, enc).astype("int32").tobytes() for t in f["part"]])

    def stitched(f: pd.DataFrame) -> pd.DataFrame:
        """A text's pieces, end to end in slices of about a chunk, with their lengths."""
        enc = encoder(path, pattern)
        f = f.sort_values("k")
        text = "".join(t[:chunk] for t in f["part"])
        pieces = stitch([(k * chunk, np.frombuffer(b, "int32").astype("int64")) for k, b in zip(f["k"], f["bounds"])], text, enc)
        size = np.fromiter(map(len, pieces), "int64", len(pieces))
        cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // chunk, prepend=-1))
        ends = [*cuts[1:].tolist(), len(pieces)]
        made = pd.DataFrame({"part": ["".join(pieces[a:b]) for a, b in zip(cuts, ends)], "bounds": [size[a:b].astype("int32").tobytes() for a, b in zip(cuts, ends)]})
        return made.assign(k=range(len(made)), **{c: f[c].iloc[0] for c in ("id", "key", "copies")})

    def cut(text: str, size: bytes) -> list[str]:
        end = np.cumsum(np.frombuffer(size, "int32")).tolist()
        return [text[a:b] for a, b in zip([0, *end], end)]

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, pattern)
        for f in frames:
            yield f.drop(columns=["part", "bounds"]).assign(ids=list(enc.encode(map(cut, f["part"], f["bounds"]))))

    def joined(f: pd.DataFrame) -> pd.DataFrame:
        row = finish(b"".join(f.sort_values("k")["ids"]), path)
        return pd.DataFrame([row] * int(f["copies"].iloc[0]), columns=names).assign(id=f["id"].iloc[0])

    # Ids go through pandas as text: it has no long with nulls but float64, which would round them.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = F.length("text")
    short = texts.where(size <= chunk).select("doc_id", whole("text").alias("made")).select("doc_id", "made.*")
    long = texts.where(size > chunk).groupBy(F.col("doc_id").cast("string").alias("id"), "text").agg(F.count(F.lit(1)).alias("copies"))
    parts = long.select(
        "id", "copies", F.sha2("text", 256).alias("key"), "text",
        F.explode(F.sequence(F.lit(0), F.floor((size - 1) / F.lit(chunk)).cast("int"))).alias("k"),
    ).select("id", "copies", "key", "k", F.expr(f"substring(text, k * {chunk} + 1, {chunk + overlap})").alias("part"))
    n, kept = common.partitions(spark), "id string, copies long, key string, k int, "
    bounds = parts.repartition(n, "key", "k").mapInPandas(boundaries, kept + "part string, bounds binary")
    slices = bounds.groupBy("id", "key").applyInPandas(stitched, kept + "part string, bounds binary")
    whole_ids = slices.repartition(n, "key", "k").mapInPandas(encoded, kept + "ids binary").groupBy("id", "key").applyInPandas(joined, f"id string, {schema}")
    return short.unionByName(whole_ids.select(F.col("id").cast("long").alias("doc_id"), *names))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Encoded rows (doc_id, ids) with the bytes that the ids stand for, as `decoded`."""
    common.prepare(encoded.sparkSession)

    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        return pd.Series([decode_ids(i, path) for i in ids], dtype=object)

    return encoded.select("doc_id", "ids", decoded("ids").alias("decoded"))
