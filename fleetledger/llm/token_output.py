"""Token ids in binary shard files, with a minimal perfect hash index for keyed access.

Documents are dealt by ranges of doc_id and sorted, encoded, and laid end to end in files. A file is one row of a
Parquet table (so Spark's commit protocol and any store that Spark writes to will do), cut at about FILE_BYTES:

    shard, file_no      the range it belongs to and its place there; ascending (shard, file_no) is ascending doc_id
    n_docs, n_ids       counts
    payload             the ids, little-endian, `width` bytes each (2 where the vocabulary fits, else 4)
    low, high           smallest and largest doc_id (null where there is none)
    keys, absent        the doc_ids in order as little-endian 64-bit integers, and a byte each: 1 for a null one
    bits, levels        the hash: level bitmaps end to end, and the number of bits of each
    fingerprints        by hash slot: 32 bits of the key's hash
    offsets, lengths    by hash slot: where the document's ids start in the payload, and how many there are

A key is a doc_id and its ordinal among equal doc_ids of the file. To look it up, try each level's bit for its hash;
the number of ones before the first set bit is the slot; a different fingerprint there means the key is absent.
A key that is not in a file passes the fingerprint with a probability of 2^-32.

Edge cases: null texts count as empty and get the end id alone; null doc_ids come first; equal doc_ids are in order
of their text; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FILE_BYTES = 2_000_000
FILE_DOCS = 20_000
GAMMA = 2.0
REMEMBERED = 800_000

FILE_SCHEMA = (
    "shard int, file_no int, n_docs long, n_ids long, width int, payload binary, low long, high long, keys binary, absent binary, "
    "bits binary, levels array<long>, fingerprints binary, offsets binary, lengths binary"
)

# --- minimal perfect hash ---------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them (splitmix64)."""
    x = x.astype("uint64")
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(ids: list[int | None], ordinals: np.ndarray) -> np.ndarray:
    values = np.array([0 if i is None else i for i in ids], "int64").view("uint64")
    absent = np.array([i is None for i in ids], "uint64")
    salt = mix(ordinals.astype("uint64") * np.uint64(2) + absent + np.uint64(1))
    return mix(values + np.uint64(0x9E3779B97F4A7C15)) ^ salt


def level_bit(h: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype("int64")


class PerfectHash:
    """Maps n distinct hashes one to one to 0..n-1; others to any of these, or to -1."""

    def __init__(self, bits: np.ndarray, levels: list[int]):
        self.bits, self.levels = bits, levels
        self.before = np.r_[0, np.cumsum(bits, dtype="int64")]

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, maps, levels = hashes, [], []
        while len(left):
            if len(levels) > 200:
                raise ValueError("two keys have the same hash")
            size = max(8, int(GAMMA * len(left)))
            bit = level_bit(left, len(levels), size)
            alone = np.bincount(bit, minlength=size) == 1
            maps.append(alone)
            levels.append(size)
            left = left[~alone[bit]]
        return cls(np.concatenate(maps) if maps else np.zeros(0, bool), levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        out, left, base = np.full(len(hashes), -1), np.arange(len(hashes)), 0
        for level, size in enumerate(self.levels):
            bit = base + level_bit(hashes[left], level, size)
            hit = self.bits[bit]
            out[left[hit]] = self.before[bit[hit]]
            left, base = left[~hit], base + size
        return out


def ordinals_of(ids: list[int | None]) -> np.ndarray:
    """Each id's place among the equal ones before it."""
    seen: dict = {}
    out = np.zeros(len(ids), "int64")
    for k, i in enumerate(ids):
        out[k] = seen.get(i, 0)
        seen[i] = out[k] + 1
    return out


def pack(shard: int, file_no: int, width: int, ids: list[int | None], texts: list[bytes]) -> dict:
    """One file of documents and their ids."""
    h = key_hash(ids, ordinals_of(ids))
    hashed = PerfectHash.build(h)
    slot = hashed.slots(h)
    size = np.array([len(t) // width for t in texts], "int64")
    start = np.cumsum(size) - size
    by_slot = [np.zeros(len(ids), "<u4"), np.zeros(len(ids), "<i8"), np.zeros(len(ids), "<i8")]
    for column, values in zip(by_slot, ((h >> np.uint64(32)).astype("<u4"), start, size)):
        column[slot] = values
    prints, offsets, lengths = (c.tobytes() for c in by_slot)
    known = [i for i in ids if i is not None]
    return {
        "shard": shard, "file_no": file_no, "n_docs": len(ids), "n_ids": int(size.sum()), "width": width, "payload": b"".join(texts),
        "low": min(known, default=None), "high": max(known, default=None), "keys": np.array([i or 0 for i in ids], "<i8").tobytes(), "absent": bytes(i is None for i in ids), "bits": np.packbits(hashed.bits).tobytes(), "levels": hashed.levels, "fingerprints": prints, "offsets": offsets, "lengths": lengths,
    }


def keys_of(row) -> list[int | None]:
    """The doc_ids of a file, in order."""
    return [None if a else i for i, a in zip(np.frombuffer(row.keys, "<i8").tolist(), row.absent)]


class IdFile:
    """A file that was read back: keyed access to its documents' ids."""

    def __init__(self, row):
        self.width, self.payload = int(row.width), row.payload
        levels = [int(x) for x in row.levels]
        self.hash = PerfectHash(np.unpackbits(np.frombuffer(row.bits, "u1"))[: sum(levels)].astype(bool), levels)
        self.prints = np.frombuffer(row.fingerprints, "<u4")
        self.offsets, self.lengths = np.frombuffer(row.offsets, "<i8"), np.frombuffer(row.lengths, "<i8")

    def find(self, ids: list[int | None], ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length of each key; -1 and -1 where the key is absent."""
        h = key_hash(ids, ordinals)
        slot = self.hash.slots(h)
        good = slot >= 0
        good[good] = self.prints[slot[good]] == (h[good] >> np.uint64(32)).astype("<u4")
        return np.where(good, self.offsets[slot], -1), np.where(good, self.lengths[slot], -1)

    def ids(self, offset: int, length: int) -> np.ndarray:
        return np.frombuffer(self.payload, f"<u{self.width}", length, offset * self.width)


# --- encoding ---------------------------------------------------------------------------------------------------

#: Unicode White_Space, at which the tokenizer's words end; str.split() also ends words at ODD.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD = re.compile("[\x1c-\x1f]")


#: Texts of these characters alone (white space, printable ASCII, Latin letters and marks up to U+017F) can be cut here:
#: each character is whole under NFC and, but for U+0130, lower-cases to one character.
NOT_PLAIN = re.compile("[^\t-\r -~\xa0-\u012f\u0131-\u017f]")
LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: How the tokenizer cuts a text of such characters.
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
JOINED = 500


class WordEncoder:
    """Encodes by distinct pieces: the tokenizer lower-cases, drops white space and never joins what stands on both sides
    of a cut, so that the ids of a text are those of its pieces, one after the other.

    Texts of plain characters are cut into the tokenizer's own pieces; others at white space alone, and these runs go to
    the tokenizer as they are. New pieces of letters are encoded many at a time, joined by spaces, and their ids told
    apart by the tokens that end a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        words, rest = [], []
        for x in new:
            (words if x.isalpha() and not NOT_PLAIN.search(x) else rest).append(x)
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            if len(cuts) != len(part):
                raise ValueError("a word is not one piece of the tokenizer")
            data = ids.tobytes()
            self.known.update(zip(part, (data[a:b] for a, b in zip([0, *cuts], cuts))))
        for piece, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.known[piece] = np.asarray(found.ids, f"<u{self.width}").tobytes()

    def cut(self, text: str) -> list[str]:
        if not NOT_PLAIN.search(text) and "<|" not in text:
            return PIECE.findall(text.lower())
        return [r for r in SPACES.split(text) if r] if ODD.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts a few hundred at a time: each looks up its pieces in a small table of the batch's own."""
        pieces = list(map(self.cut, texts))
        here = set().union(*pieces)
        # A difference with the keys would walk through all that is remembered.
        new = [p for p in here if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(here)
        if new:
            self._learn(new)
        ids = dict(zip(here, map(self.known.__getitem__, here)))
        return [b"".join(map(ids.__getitem__, p)) for p in pieces]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int | None, path: str) -> None:
    """Writes the ids of every text, `end_id` after each unless None, to files under `path`."""
    spark = docs.sparkSession
    common.prepare(spark)
    # Workers run as many at a time as there are cores; the tokenizer must not start threads of its own.
    spark.sparkContext.environment["TOKENIZERS_PARALLELISM"] = "false"

    def files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = word_encoder(tokenizer_path)
        tail = b"" if end_id is None else np.asarray([end_id], f"<u{enc.width}").tobytes()
        shard, file_no, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for f in frames:
            own = [i if known else None for i, known in zip(f["id"].tolist(), f["known"])]
            for at in range(0, len(f), 256):
                for i, t in zip(own[at : at + 256], enc.encode(f["text"].iloc[at : at + 256].tolist())):
                    ids.append(i)
                    texts.append(t + tail)
                    size += len(t) + len(tail)
                    if size >= FILE_BYTES or len(ids) >= FILE_DOCS:
                        yield pd.DataFrame([pack(shard, file_no, enc.width, ids, texts)])
                        file_no, ids, texts, size = file_no + 1, [], [], 0
        if ids:
            yield pd.DataFrame([pack(shard, file_no, enc.width, ids, texts)])

    # pandas has no long with nulls but float64, which would round ids: the null travels beside. Rows without an id, or with
    # one id, spread over ranges by how their texts begin.
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), text.alias("text"))
    dealt = texts.repartitionByRange(common.partitions(spark), "known", "id", F.substring("text", 1, 64)).sortWithinPartitions("known", "id", "text")
    dealt.mapInPandas(files, FILE_SCHEMA).write.parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def file_starts(files: DataFrame) -> DataFrame:
    """shard, file_no, first: the number of ids in all files before each. Shards are summed first, so that the
    one window without a partition has a row for each shard only."""
    sizes = files.select("shard", "file_no", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", before(Window.orderBy("shard")).alias("base"))
    within = sizes.select("shard", "file_no", before(Window.partitionBy("shard").orderBy("file_no")).alias("own"))
    return within.join(shards, "shard").select("shard", "file_no", (F.col("base") + F.col("own")).alias("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document by keyed access to the files: doc_id, start, n_tokens, ids_crc32."""
    common.prepare(spark)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                file = IdFile(row)
                ids = keys_of(row)
                offset, length = file.find(ids, ordinals_of(ids))
                if (offset < 0).any():
                    raise ValueError(f"file {row.file_no} of shard {row.shard} lacks keys of its own")
                crc = [zlib.crc32(file.ids(o, n).astype("<u4").tobytes()) for o, n in zip(offset.tolist(), length.tolist())]
                yield pd.DataFrame({"shard": row.shard, "file_no": row.file_no, "doc_id": pd.array(ids, "Int64"), "offset": offset, "n_tokens": length, "ids_crc32": crc})

    files = read_files(spark, path)
    found = files.mapInPandas(rows, "shard int, file_no int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    joined = found.join(file_starts(files), ["shard", "file_no"])
    return joined.select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of the first document of each of a short list of doc_ids, found through the index alone: doc_id, ids.
    Ids that no file holds have no row. Only files whose range of doc_ids can hold one are opened."""
    common.prepare(spark)
    wanted = sorted(set(doc_ids))
    near = read_files(spark, path).where(F.exists(F.array(*map(F.lit, wanted)).cast("array<bigint>"), lambda i: i.between(F.col("low"), F.col("high"))))

    def rows(frames):
        for f in frames:
            for row in f.itertuples():
                file = IdFile(row)
                offset, length = file.find(wanted, np.zeros(len(wanted), "int64"))
                hit = [(i, file.ids(o, n).astype("int64")) for i, o, n in zip(wanted, offset.tolist(), length.tolist()) if o >= 0]
                if hit:
                    yield pd.DataFrame(hit, columns=["doc_id", "ids"])

    return near.mapInPandas(rows, "doc_id long, ids array<long>")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Writes the ids and reads them back: doc_id, start, n_tokens (with the end id), ids_crc32."""
    spark = docs.sparkSession
    path = path or common.fresh_path(spark, "token-ids")
    write_ids(docs, tokenizer_path, end_id, path)
    return read_documents(spark, path)
