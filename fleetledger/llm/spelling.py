"""Grouping of spelling variants: words of a corpus, the words one edit away from each, and the form each should have.

1. Words are runs of letters, counted over all texts; what is frequent and long enough is the vocabulary.
2. Two words one edit apart, the shorter of k code points, agree in all but one segment of it: words are filed by k, a segment
   [s, e) and what stands before and behind it, once as the shorter word and once as one that has a code point more. First the
   segments are the two halves. A file with more than CROWD words is filed again by the halves of its segment, and so on; files of
   a single code point hold what differs there, one or two code points of the alphabet, so that no file grows with the vocabulary.
3. Within a file the middles are a sorted list. For each word of k code points the list is scanned with the rows of its banded edit
   matrix: three cells a row, since one edit never leaves the next diagonals. An entry reuses the rows of the prefix that it
   shares with the entry before it; where all cells of a row exceed one edit, the whole range of entries with that prefix is skipped.
4. A pair belongs to the segment in which its first difference stands, so that it comes out once and no pair is dropped twice.
5. A word's form is its most frequent near word, if that is frequent enough; roots follow by doubling pointers.

Edge cases: null texts have no words and a null doc_id is the empty string in the hash that plants deletions; ties between forms go
to the smaller word in code-point order; repeated rows count again; words of any length are compared (files are named by digests, not by the
text); an empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed by the query's contract: what words are made of, and one run in DELETE loses a code point.
RUN, DELETE = "[A-Za-z\u00c0-\u00ff]", 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LENGTH, COUNT, TIMES = 5, 3, 2
#: Different words that a task counts before it passes them on.
HELD = 200_000
#: Words of a file that are compared at once; larger ones are filed again by halves of their segment.
CROWD = 200


def planted(run: str, start: int, delete: int | None) -> str:
    """The run, or without a code point if its hash, carried on from its document's, is one in `delete`."""
    h = zlib.crc32(run.encode("utf-8", "surrogatepass"), start)
    if delete is None or h % delete:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted(docs: DataFrame, length: int, delete: int | None) -> DataFrame:
    """word and n: words of at least `length` code points, counted by tasks (a word comes again where a task has held HELD others)."""
    runs, lower = re.compile(f"{RUN}{{{length},}}"), str.maketrans(UPPER, LOWER)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for f in frames:
            for doc_id, text in zip(f["id"], f["text"]):
                start = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(runs.findall(text.translate(lower))).items():
                    word = planted(run, start, delete)
                    if len(word) >= length:
                        seen[word] += n
                if len(seen) > HELD:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen.clear()
        if seen:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").where("text is not null")
    return texts.mapInPandas(count, "word string, n long")


def vocabulary(docs: DataFrame, length: int = LENGTH, count: int = COUNT, delete: int | None = DELETE) -> DataFrame:
    """word and n of the words of at least `length` code points that occur at least `count` times. One run in `delete`, by the hash of
    its document and itself, counts without one of its code points; None plants no deletions."""
    common.prepare(docs.sparkSession)
    return counted(docs, length, delete).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def filed(words: DataFrame, segments: Column) -> DataFrame:
    """Rows of words (word and others) under each of their segments (k, s, e): file, k, s, e, and the word's middle there."""
    rows = words.withColumn("at", F.explode(segments)).select("*", "at.*").drop("at")
    behind = F.col("k") - F.col("e")
    size = F.length("word")
    head, tail = F.substring(F.col("word"), F.lit(1), F.col("s")), F.substring(F.col("word"), size - behind + 1, behind)
    middle = F.substring(F.col("word"), F.col("s") + 1, size - behind - F.col("s"))
    # A digest of what is around; a collision would only put more words into a file than belong there: ends are compared again.
    name = F.xxhash64("k", "s", "e", head, tail)
    return rows.withColumns({"file": name, "middle": middle, "ends": F.substring(F.sha2(F.concat(head, F.lit(" "), tail), 256), 1, 32)})


def halves(k: Column, s: Column, e: Column) -> Column:
    """A segment's halves; one of a single code point has no others."""
    m = F.floor((s + e) / 2).cast("int")
    part = lambda a, b: F.struct(k.alias("k"), a.alias("s"), b.alias("e"))
    return F.array(part(s, m), part(m, e))


def first_files(words: DataFrame) -> DataFrame:
    """Each word by the halves of its own length, and of the length without one code point."""
    size, zero = F.length("word").cast("int"), F.lit(0)
    return filed(words, F.concat(halves(size, zero, size), halves(size - 1, zero, size - 1)))


def crowded(rows: DataFrame, crowd: int) -> DataFrame:
    """Files with more than `crowd` words and a segment that can still be halved."""
    return rows.where("e - s > 1").groupBy("file").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > crowd).select("file")


class Scan:
    """A sorted list of different words, and for each place the length of the prefix shared with the one before."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.shared = [0] * len(entries)
        for i in range(1, len(entries)):
            a, b = entries[i - 1], entries[i]
            n, most = 0, min(len(a), len(b))
            while n < most and a[n] == b[n]:
                n += 1
            self.shared[i] = n

    def skip(self, i: int, depth: int) -> int:
        """The place after the entries, from i on, that share the first `depth` code points of entry i."""
        prefix = self.entries[i][:depth]
        step, end, n = 1, i + 1, len(self.entries)
        while end < n and self.entries[end][:depth] == prefix:  # galloping: most ranges are short
            i, step = end, step * 2
            end = min(i + step, n)
        return bisect_left(self.entries, True, i + 1, end, key=lambda x: x[:depth] != prefix)

    def near(self, word: str, start: int = 0) -> Iterator[int]:
        """Places from start on of the entries exactly one edit from word.

        rows[d] holds cells d-1, d, d+1 of the matrix row after d code points of the entry: edits to word's prefixes of these
        lengths. Two stand for more than one."""
        m = len(word)
        rows = [(2, 0, 1 if m else 2)]
        i, n, known = start, len(self.entries), 0
        while i < n:
            entry = self.entries[i]
            del rows[known + 1 :]
            dead = 0
            for d in range(known + 1, len(entry) + 1):
                # Cells d-1, d, d+1 from d-2, d-1, d above; beyond the word's ends a cell is 2.
                low, same, high = rows[-1]
                c = entry[d - 1]
                if d == 1:
                    low = 1
                elif d - 1 > m:
                    low = 2
                else:
                    turn = low if word[d - 2] == c else low + 1
                    low = turn if turn <= same else same + 1
                if d > m:
                    same, high = 2, 2
                else:
                    turn = same if word[d - 1] == c else same + 1
                    step = high if high < low else low
                    same = turn if turn <= step else step + 1
                    if d + 1 > m:
                        high = 2
                    else:
                        turn = high if word[d] == c else high + 1
                        high = turn if turn <= same else same + 1
                rows.append((low, same, high))
                if low > 1 and same > 1 and high > 1:
                    dead = d
                    break
            if dead:
                i = self.skip(i, dead)
                known = min(self.common(entry, i), dead) if i < n else 0
                continue
            place = m - len(entry) + 1
            if 0 <= place <= 2 and rows[-1][place] == 1:
                yield i
            i += 1
            known = self.shared[i] if i < n else 0

    def common(self, entry: str, i: int) -> int:
        """Code points that entry i shares with an entry before it."""
        other, n = self.entries[i], 0
        for a, b in zip(entry, other):
            if a != b:
                break
            n += 1
        return n


def pairs_of(k: int, s: int, e: int, rows: list[tuple[str, str, int]]) -> Iterator[tuple]:
    """Near pairs of a file whose first difference stands in its segment; rows: middle, word, n. Of each pair the shorter word has k
    code points. Words of a file differ, and so do their middles."""
    rows.sort()
    scan = Scan([r[0] for r in rows])
    for i, (middle, word, n) in enumerate(rows):
        if len(word) != k:
            continue
        for j in scan.near(middle):
            _, other, count = rows[j]
            if len(other) == k and j < i:
                continue  # has come out from the other side
            first = 0
            while first < k and word[first] == other[first]:
                first += 1
            if s <= min(first, k - 1) < e:
                yield word, n, other, count


PAIR = "a string, n_a long, b string, n_b long"


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Each pair of different words (columns word, n) one edit apart, once: a, n_a, b, n_b."""
    spark = words.sparkSession
    common.prepare(spark)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by file; one file's rows, CROWD or so, are held at a time."""
        held: dict[tuple, list] = {}
        now, out = None, []

        def done() -> None:
            for (k, s, e, _), rows in held.items():
                if len(rows) > 1:
                    out.extend(pairs_of(k, s, e, rows))

        for f in frames:
            for name, *key, middle, word, n in zip(*(f[c].tolist() for c in ("file", "k", "s", "e", "ends", "middle", "word", "n"))):
                if name != now:
                    done()
                    held, now = {}, name
                held.setdefault(tuple(key), []).append((middle, word, n))
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=["a", "n_a", "b", "n_b"])
                    out = []
        done()
        if out:
            yield pd.DataFrame(out, columns=["a", "n_a", "b", "n_b"])

    compared, rows = [], first_files(words)
    while True:
        large = common.materialise(crowded(rows, crowd), "crowded-files")
        if large.isEmpty():
            compared.append(rows)
            break
        compared.append(rows.join(large, "file", "left_anti"))
        again = rows.join(large, "file", "left_semi").select("word", "n", F.col("k").alias("_k"), F.col("s").alias("_s"), F.col("e").alias("_e"))
        again = filed(again, halves(F.col("_k"), F.col("_s"), F.col("_e"))).drop("_k", "_s", "_e")
        rows = common.materialise(again, "files-again")
    columns = ["file", "k", "s", "e", "ends", "middle", "word", "n"]
    parts = [p.select(*columns).repartition(common.partitions(spark), "file").sortWithinPartitions("file") for p in compared]
    out = parts[0].mapInPandas(compare, PAIR)
    for p in parts[1:]:
        out = out.union(p.mapInPandas(compare, PAIR))
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word and root of rows (word, form), form not null: forms are followed to the last by doubling, a round for each doubling of the
    longest chain. A form occurs more often than its word, so that chains end."""
    at = common.materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = at.join(ahead, F.col("root") == F.col("_w"), "left")
        moved = common.materialise(step.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def group(words: DataFrame, times: int = TIMES, crowd: int = CROWD) -> DataFrame:
    """One row per word of a vocabulary (word, n): word, form, root, n, n_near, form_n."""
    words = common.materialise(words.select("word", "n"), "vocabulary")
    pairs = near_pairs(words, crowd)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("x")).select("x.*")
    # The most frequent, then the smallest: the least of (-n, word); strings compare by their bytes, which is code-point order.
    best = sides.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    strong = -F.col("best.m") >= times * F.col("n")
    named = best.select("word", "n_near", F.when(strong, F.col("best.w")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"))
    named = common.materialise(named, "forms")
    ends = roots(named.where("form is not null").select("word", "form"))
    return words.join(named, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
    )


def spelling_variants(docs: DataFrame, length: int = LENGTH, count: int = COUNT, times: int = TIMES, delete: int | None = DELETE) -> DataFrame:
    """Words of the documents with their forms: word, form, root, n, n_near, form_n."""
    return group(vocabulary(docs, length, count, delete), times)


def respell(docs: DataFrame, variants: DataFrame) -> DataFrame:
    """How often each document has words that have another root: doc_id, word, root, n."""
    runs = F.explode(F.split(F.translate(F.col("text"), UPPER, LOWER), RUN.replace("[", "[^", 1) + "+"))
    seen = docs.select(F.col("doc_id"), runs.alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(variants.where("root <> word").select("word", "root"), "word").select("doc_id", "word", "root", "n")
