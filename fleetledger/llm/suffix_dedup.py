"""Removal of repeated substrings: every byte covered by a `length`-byte string that also starts in a document with a
smaller doc_id goes.

1. Every window of `length` bytes is assigned to its smallest hashed 20-gram; windows in a row with the same one form a
   segment. Equal windows have equal 20-grams, so only segments filed under the same one can share a window, and a
   segment's class (its content's hash) meets its copies there. Within a batch, of each class only the smallest
   document's segments travel; the others are repeats already.
2. Where all segments of a 20-gram are alike, all but the smallest document's are repeats. Where classes differ, the
   smallest document's segments of each are cut from their texts, and cut finer: filed by their smallest 35-gram, so that
   only strings meet that share most of a window. Of equal ones in a batch (equal byte by byte) the smallest document's go
   on and the others are repeats. A 35-gram with more than CROWD of them is cut finer once more, to single windows, each
   filed by itself: no 20-gram or 35-gram, however common, makes a large group.
3. Segments under one gram are compared as texts: segments are laid into shards, each shard's suffixes are sorted once to
   the depth of a window for its Burrows-Wheeler transform, and the transforms are merged by iterative interleave
   refinement: each round reads the symbols before the interleave's rotations from the transforms, permutes the interleave
   stably by them, steps back, and splits the intervals of equal prefix. Only rotations on the way to the start of a whole
   window are followed, and one whose common prefix with all others has ended is left. After `length` symbols the intervals
   are the strings that repeat, without another sort of suffixes. Their smallest document keeps its occurrences.
4. Marked ranges meet their texts, are united, and cut out.

Edge cases: a null text counts as empty; texts shorter than a window keep all; a null doc_id counts as larger than any
other, and rows with equal doc_ids don't repeat each other; an empty table gives an empty result; other columns are
ignored. 20-grams and classes are told apart by 48 bits each, 96 together.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 50
GRAM, FINE = 20, 35
BLOCK = 1_000_000
BATCH = 12_000_000
CROWD = 1_500
SHARDS = 8
COLLECTION = 200_000
#: Stands for a null doc_id where the smallest is sought.
LAST = np.iinfo("int64").max
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
LOW48 = np.uint64((1 << 48) - 1)

# --- segments ---------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` numbers, put together from runs of powers of two."""
    n, have, done, run, k = len(data) - size + 1, None, 0, data, 1
    while True:
        if size & k:
            have = run[:n] if have is None else have * np.uint64(pow(int(BASE), k, 1 << 64)) + run[done : done + n]
            done += k
        if 2 * k > size:
            return mix(have)
        run, k = run[:-k] * np.uint64(pow(int(BASE), k, 1 << 64)) + run[k:], 2 * k


def segments(texts: list[bytes], length: int, size_of_gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: gram and class of each segment (48 bits), number of its text, its first window's
    start there, and its number of windows. Texts must be at least `length` long."""
    size = np.array([len(t) for t in texts])
    offset = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), "u1").astype("uint64") + np.uint64(1)
    gram = gram_hashes(data, size_of_gram)
    span = length - size_of_gram + 1
    least, k = gram, 1
    while 2 * k <= span:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    if k < span:
        least = np.minimum(least[: -(span - k)], least[span - k :])
    inside = np.ones(len(least), bool)
    ends = offset + size
    for j in range(1, length):  # windows that would run over the end of their text
        at = ends - j
        inside[at[at < len(least)]] = False
    turn = least[1:] != least[:-1]
    begin = np.flatnonzero(inside & np.r_[True, turn | ~inside[:-1]])
    end = np.flatnonzero(inside & np.r_[turn | ~inside[1:], True])
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(gram) - 1, BASE)], dtype="uint64")
    sums = np.r_[np.uint64(0), np.cumsum(gram * power, dtype="uint64")]
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(gram) - 1, BASE_INVERSE)], dtype="uint64")
    content = mix((sums[end + span] - sums[begin]) * inverse[begin] + (end - begin).astype("uint64"))
    text = np.searchsorted(offset, begin, "right") - 1
    return least[begin] & LOW48, content & LOW48, text, begin - offset[text], end - begin + 1


def planes(x: np.ndarray, n: int) -> bytes:
    """The n lower bytes of numbers, byte by byte, so that zeros lie together."""
    return np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :n].T).tobytes()


def unplanes(data: bytes, n: int) -> np.ndarray:
    rows = np.frombuffer(data, "u1").reshape(n, -1)
    out = np.zeros((rows.shape[1], 8), "u1")
    out[:, :n] = rows.T
    return out.reshape(-1).view("<u8").astype("int64")


FILED = "bucket int, ids binary, keys binary, gram binary, class binary, text binary, start binary, size binary, done_text binary, done_start binary, done_size binary"


def file_segments(length: int, buckets: int):
    """Texts to packed rows of segments, one for each bucket and BATCH bytes of text."""

    def pack(ids: np.ndarray, keys: np.ndarray, parts: list[tuple]) -> Iterator[pd.DataFrame]:
        gram, content, text, start, size = (np.concatenate(x) for x in zip(*parts))
        same = mix(gram * BASE + content)
        order = np.argsort(same, kind="stable")
        # Neighbours are one only if gram and class agree too: two that share `same` by chance stay apart.
        first = np.flatnonzero(np.r_[True, (gram[order][1:] != gram[order][:-1]) | (content[order][1:] != content[order][:-1])])
        least = np.minimum.reduceat(ids[text[order]], first)
        done = np.zeros(len(gram), bool)
        done[order] = ids[text[order]] > np.repeat(least, np.diff(np.r_[first, len(order)]))
        bucket = (gram % np.uint64(buckets)).astype("int32")
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True])
        names, rows = [c.split()[0] for c in FILED.split(", ")], []
        for a, b in zip(cuts, cuts[1:]):
            at = order[a:b]
            used, local = np.unique(text[at], return_inverse=True)
            d, o = done[at], ~done[at]
            x, y = at[o], at[d]
            rows.append((
                int(bucket[at[0]]), ids[used].tobytes(), keys[used].tobytes(), planes(gram[x], 6), planes(content[x], 6), planes(local[o], 4), planes(start[x], 4), planes(size[x], 4),
                planes(local[d], 4), planes(start[y], 4), planes(size[y], 4),
            ))
            if len(rows) >= 64:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = f["doc_id"].to_numpy()
            keys = f["key"].to_numpy()
            parts, block, numbers, held, total = [], [], [], 0, 0
            for i, t in enumerate(f["text"]):
                t = t.encode()
                if len(t) >= length:
                    block.append(t)
                    numbers.append(i)
                    held += len(t)
                if block and (held >= BLOCK or i == len(f) - 1):
                    own = segments(block, length)
                    parts.append((own[0], own[1], np.array(numbers)[own[2]], own[3], own[4]))
                    total += held
                    block, numbers, held = [], [], 0
                if parts and total >= BATCH:
                    yield from pack(ids, keys, parts)
                    parts, total = [], 0
            if block:
                own = segments(block, length)
                parts.append((own[0], own[1], np.array(numbers)[own[2]], own[3], own[4]))
            if parts:
                yield from pack(ids, keys, parts)

    return run


MARKS = "key long, doc_id long, kind int, gram long, start int, size int"
REPEATED, COMPARE = 0, 1


def judge():
    """Segments of one bucket after the other: what is a repeat, and what must be compared as text."""

    def frame(keys, ids, kind, gram, start, size) -> pd.DataFrame:
        return pd.DataFrame({"key": keys, "doc_id": ids, "kind": np.broadcast_to(np.asarray(kind, "int32"), len(keys)), "gram": gram, "start": start.astype("int32"), "size": size.astype("int32")})

    def bucket(rows: list) -> Iterator[pd.DataFrame]:
        cols = []
        for r in rows:
            ids, keys = np.frombuffer(r.ids, "int64"), np.frombuffer(r.keys, "int64")
            if len(r.done_text):
                t = unplanes(r.done_text, 4)
                yield frame(keys[t], ids[t], REPEATED, np.zeros(len(t), "int64"), unplanes(r.done_start, 4), unplanes(r.done_size, 4))
            t = unplanes(r.text, 4)
            cols.append((unplanes(r.gram, 6), unplanes(getattr(r, "class_"), 6), ids[t], keys[t], unplanes(r.start, 4), unplanes(r.size, 4)))
        gram, content, ids, keys, start, size = (np.concatenate(c) for c in zip(*cols))
        order = np.argsort(gram, kind="stable")
        first = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1]])
        owners = np.maximum.reduceat(ids[order], first) > np.minimum.reduceat(ids[order], first)
        shared = order[np.repeat(owners, np.diff(np.r_[first, len(order)]))]
        if not len(shared):
            return
        gram, content, ids, keys, start, size = (x[shared] for x in (gram, content, ids, keys, start, size))
        order = np.lexsort((ids, content, gram))
        gram, content, ids, keys, start, size = (x[order] for x in (gram, content, ids, keys, start, size))
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new = new_gram | np.r_[True, content[1:] != content[:-1]]
        repeated = ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        classes = np.add.reduceat(new.astype("int64"), np.flatnonzero(new_gram))[np.cumsum(new_gram) - 1]
        yield frame(keys[repeated], ids[repeated], REPEATED, gram[repeated], start[repeated], size[repeated])
        ask = ~repeated & (classes > 1)
        yield frame(keys[ask], ids[ask], COMPARE, gram[ask], start[ask], size[ask])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []
        for f in frames:
            for r in f.rename(columns={"class": "class_"}).itertuples():
                if rows and r.bucket != now:
                    yield from bucket(rows)
                    rows = []
                now = r.bucket
                rows.append(r)
        if rows:
            yield from bucket(rows)

    return run


# --- Burrows-Wheeler transforms and their merge -------------------------------------------------------------------


def transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotations of a text (numbers below 256) in order of their first `depth` symbols; the transform with two symbols at a
    time, the last but one and the last before each rotation, as one number; and the place of the rotation one earlier."""
    n = len(text)
    rank = np.zeros(n, "int64")
    for j in range(7):
        rank = rank << 8 | np.roll(text, -j)
    have = 7
    while True:
        rank = np.unique(rank, return_inverse=True)[1].astype("int64")
        if have >= depth:
            break
        step = min(have, depth - have)
        rank = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        have += step
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, "int32")
    place[order] = np.arange(n, dtype="int32")
    return order, (text[order - 2] << 8 | text[order - 1]).astype("u2"), place[order - 1]


def merge(symbol: np.ndarray, earlier: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Refines an interleave of the shards' rotations. `symbol` and `earlier` are the shards' transforms and steps, end to
    end; `start` are the places of the rotations `depth` symbols behind the windows, shard by shard. Result: places of
    windows that share their text with others, in order of it, and for each the number of its interval of equal windows. A
    round takes two symbols; for an odd depth, the first takes one."""
    twice, at, interval, have = earlier[earlier], start, np.zeros(len(start), "int32"), 0
    while have < depth and len(at):
        one = (depth - have) % 2
        by = symbol[at] & 255 if one else symbol[at]
        order = np.argsort(by, kind="stable")
        at = (earlier if one else twice)[at[order]]
        by, below = by[order], interval[order]
        split = np.ones(len(at) + 1, bool)
        np.not_equal(by[1:], by[:-1], out=split[1:-1])
        split[1:-1] |= below[1:] != below[:-1]
        interval = np.cumsum(split[:-1], dtype="int32")
        have += 2 - one
        together = ~(split[:-1] & split[1:])  # a rotation whose common prefix with its neighbours has ended stays alone
        if have >= depth or np.count_nonzero(together) < 0.8 * len(at):
            at, interval = at[together], interval[together]
    return at, interval


def repeats(texts: list[bytes], ids: np.ndarray, length: int, shards: int = SHARDS) -> list[np.ndarray]:
    """For each text, which of its windows also start in a text with a smaller id."""
    size = np.array([len(t) for t in texts])
    ends = np.cumsum(size + 1)
    begin = ends - size - 1
    owner = np.repeat(np.arange(len(texts)), size + 1)
    # UTF-8 has no byte above 0xF4, so that there is room below for what ends a text.
    data = np.frombuffer(b"\0".join(texts) + b"\0", "u1").astype("int64") + 1
    data[ends - 1] = 0
    cuts = np.searchsorted(ends, np.arange(1, shards) * len(data) // shards) + 1
    edges = np.unique(np.r_[0, ends[np.minimum(cuts, len(texts)) - 1], len(data)])
    order, symbol, earlier = (np.concatenate(x) for x in zip(*((o + a, s, e + a) for a, b in zip(edges, edges[1:]) for o, s, e in [transform(data[a:b], length)])))
    place = np.empty(len(data), "int32")
    place[order] = np.arange(len(data), dtype="int32")
    whole = np.flatnonzero(np.arange(len(data)) + length < ends[owner])
    at, interval = merge(symbol, earlier.astype("int32"), np.sort(place[whole + length]), length)
    flat, at = np.zeros(len(data), bool), order[at]
    if len(at):
        doc = ids[owner[at]]
        first = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
        flat[at[doc > np.repeat(np.minimum.reduceat(doc, first), np.diff(np.r_[first, len(at)]))]] = True
    return [flat[b : b + max(0, n - length + 1)] for b, n in zip(begin.tolist(), size.tolist())]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return edge[::2], edge[1::2] - edge[::2]


FOUND = "key long, start int, size int"


def compare(length: int):
    """Segments sorted by gram, in collections of whole grams, to ranges of windows that are repeats."""

    def collection(f: pd.DataFrame) -> pd.DataFrame:
        keys, starts, sizes = [], [], []
        for key, at, flags in zip(f["key"], f["start"], repeats(f["segment"].tolist(), f["doc_id"].to_numpy(), length)):
            s, n = runs(flags)
            keys += [key] * len(s)
            starts += (s + at).tolist()
            sizes += n.tolist()
        return pd.DataFrame({"key": np.array(keys, "int64"), "start": np.array(starts, "int32"), "size": np.array(sizes, "int32")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        weight, last = 0, None
        for f in frames:
            if not len(f):
                continue
            gram, doc = f["gram"].to_numpy(), f["doc_id"].to_numpy()
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            lone = np.minimum.reduceat(doc, first) == np.maximum.reduceat(doc, first)  # these have nobody to share with
            lone[[0, -1]] = False  # the first and the last may go on in other batches
            keep = ~np.repeat(lone, np.diff(np.r_[first, len(gram)]))
            f, gram = f[keep], gram[keep]
            upto = np.cumsum(np.fromiter(map(len, f["segment"]), "int64", len(f)))
            opens = np.flatnonzero(np.r_[gram[0] != last, gram[1:] != gram[:-1]])
            begin, before, last = 0, 0, gram[-1]
            while True:  # a collection ends where a gram does and COLLECTION is reached
                full = int(np.searchsorted(upto, COLLECTION - weight + before)) + 1 if weight < COLLECTION else begin
                k = int(np.searchsorted(opens, full))
                cut = int(opens[k]) if k < len(opens) else len(f)
                held.append(f.iloc[begin:cut])
                if k == len(opens):
                    weight += int(upto[-1]) - before
                    break
                yield collection(pd.concat(held))
                held, weight, begin, before = [], 0, cut, int(upto[cut - 1]) if cut else 0
        if held:
            yield collection(pd.concat(held))

    return run


# --- texts ------------------------------------------------------------------------------------------------------

#: Marks come before their text; a text without a doc_id has the kind NAMELESS, and LAST as its id.
TEXT, NAMELESS = 9, 10


def squeezed(docs: DataFrame) -> DataFrame:
    """key, doc_id, kind, text (compressed UTF-8)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "doc_id": f["doc_id"], "kind": f["kind"], "text": [zlib.compress(t.encode(), 1) for t in f["text"]]})

    return docs.mapInPandas(run, "key long, doc_id long, kind int, text binary")


def beside_texts(marks: DataFrame, texts: DataFrame) -> DataFrame:
    """Marks and texts, those of a document together, marks first."""
    rows = texts.unionByName(marks, allowMissingColumns=True)
    return rows.repartition(common.partitions(texts.sparkSession), "key").sortWithinPartitions("key", "kind")


CUT = "key long, doc_id long, kind int, gram long, start int, size int, segment binary"
CUT_NAMES = [c.split()[0] for c in CUT.split(", ")]


def folded(strings: list[bytes], docs: list[int], keys: list[int], starts: list[int], grams: list[int], length: int) -> pd.DataFrame:
    """Strings to rows of CUT: of equal ones the smallest document's are to be compared, the others are repeats. Repeats that
    follow each other in a text become one row."""
    least: dict[bytes, int] = {}
    for s, d in zip(strings, docs):
        if least.setdefault(s, d) > d:
            least[s] = d
    again = np.fromiter((d > least[s] for s, d in zip(strings, docs)), bool, len(docs))
    key, doc, start, gram = (np.array(x, "int64") for x in (keys, docs, starts, grams))
    size = np.fromiter((len(s) - length + 1 for s in strings), "int64", len(strings))
    ask = np.flatnonzero(~again)
    k, d, at, n = key[again], doc[again], start[again], size[again]
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (at[1:] != at[:-1] + n[:-1])]) if len(k) else np.zeros(0, int)
    runs_of = np.add.reduceat(n, first) if len(k) else n
    parts = {"key": (key[ask], k[first]), "doc_id": (doc[ask], d[first]), "kind": (np.full(len(ask), COMPARE), np.full(len(first), REPEATED)), "gram": (gram[ask], np.zeros(len(first))), "start": (start[ask], at[first]), "size": (size[ask], runs_of)}
    made = pd.DataFrame({c: np.concatenate(x).astype("int32" if c in ("kind", "start", "size") else "int64") for c, x in parts.items()})
    return made.assign(segment=[*(strings[i] for i in ask.tolist()), *[b""] * len(first)])


def cut_segments(length: int):
    """Marks beside texts to the marked segments' bytes, filed by their smallest FINE-gram."""
    gram_size = min(FINE, length)

    def fine(asked: list[tuple[int, int, int, bytes]]) -> pd.DataFrame:
        keys, docs, starts, strings = zip(*asked)
        gram, _, text, start, size = segments(list(strings), length, gram_size)
        at, start = text.tolist(), start.tolist()
        parts = [strings[t][s : s + n - 1 + length] for t, s, n in zip(at, start, size.tolist())]
        return folded(parts, [docs[t] for t in at], [keys[t] for t in at], [starts[t] + s for t, s in zip(at, start)], gram.astype("int64"), length)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, asked = None, []
        for f in frames:
            out = []
            for key, doc_id, text, kind, start, size in zip(*(f[c].tolist() for c in ("key", "doc_id", "text", "kind", "start", "size"))):
                if key != now:
                    now, asked = key, []
                if kind < TEXT:
                    asked.append((int(doc_id), int(start), int(size)))
                elif asked:
                    whole = zlib.decompress(text)
                    out += [(key, i, s, whole[s : s + n - 1 + length]) for i, s, n in asked]
                    asked = []  # rows with the same key have the same text and id
            if out:
                yield fine(out)

    return run


def windows(length: int):
    """Segments to segments of one window each. Hashes of windows are negative and so never meet those of grams."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 2000):
                rows = [(s[i : i + length], d, k, at + i) for k, d, at, s in zip(*(f[c].iloc[a : a + 2000].tolist() for c in ("key", "doc_id", "start", "segment"))) for i in range(len(s) - length + 1)]
                strings, docs, keys, starts = map(list, zip(*rows))
                yield folded(strings, docs, keys, starts, [-1 - (int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little") >> 2) for s in strings], length)

    return run


def remove(length: int, with_kept: bool):
    """Repeated ranges beside texts to what is left of the texts."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, marks = None, []
        for f in frames:
            out = []
            for key, doc_id, text, kind, start, size in zip(*(f[c].tolist() for c in ("key", "doc_id", "text", "kind", "start", "size"))):
                if key != now:
                    now, marks = key, []
                if kind < TEXT:
                    marks.append((int(start), int(start + size) - 1 + length))
                    continue
                whole, kept, spans, upto = zlib.decompress(text), [], 0, -1
                marks.sort()
                for a, b in marks:
                    if a > upto:
                        kept.append(whole[max(upto, 0) : a])
                        spans += 1
                    upto = max(upto, b)
                left = b"".join([*kept, whole[max(upto, 0) :]])
                row = (None if kind == NAMELESS else int(doc_id), len(whole), len(whole) - len(left), spans, hashlib.sha256(left).hexdigest())
                out.append(row + (left,) * with_kept)
            made = pd.DataFrame(out, columns=names)
            yield made.assign(doc_id=pd.array([r[0] for r in out], "Int64"))

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_kept: bool = False, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_kept the bytes kept."""
    spark = docs.sparkSession
    common.prepare(spark)
    if length < GRAM:
        raise ValueError(f"windows must have {GRAM} bytes at least")
    n = common.partitions(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # pandas has no long with nulls but float64, which would round ids: no doc_id is null from here on, in texts or marks.
    kind = F.when(F.col("doc_id").isNull(), NAMELESS).otherwise(TEXT).alias("kind")
    base = base.select(common.row_key().alias("key"), F.coalesce(F.col("doc_id"), F.lit(int(LAST))).alias("doc_id"), kind, "text")
    filed = base.mapInPandas(file_segments(length, 4 * n), FILED)
    marks = filed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(judge(), MARKS)
    marks = common.materialise(marks, "repeat-marks")
    texts = squeezed(base)
    asked = marks.where(F.col("kind") != REPEATED)
    cut = common.materialise(beside_texts(asked, texts).mapInPandas(cut_segments(length), CUT), "repeat-segments")
    compared, repeat = cut.where(F.col("kind") == COMPARE), F.col("kind") == REPEATED
    crowds = common.materialise(compared.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("gram"), "crowded-grams")
    split = common.materialise(compared.join(crowds, "gram", "left_semi").select(*CUT_NAMES).mapInPandas(windows(length), CUT), "repeat-windows")
    met = compared.join(crowds, "gram", "left_anti").select(*CUT_NAMES).unionByName(split.where(~repeat))
    merged = met.repartition(n, "gram").sortWithinPartitions("gram").mapInPandas(compare(length), FOUND)
    found = ("key", "start", "size")
    repeated = marks.where(repeat).select(*found).unionByName(merged).unionByName(cut.where(repeat).select(*found)).unionByName(split.where(repeat).select(*found))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return beside_texts(repeated.withColumn("kind", F.lit(REPEATED)).withColumn("doc_id", F.lit(0).cast("long")), texts).mapInPandas(remove(length, with_kept), schema)
