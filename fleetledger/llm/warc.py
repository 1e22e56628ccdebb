"""WARC archives of pages, with revisit records for repeated payloads and an external merge of their capture indexes.

Writing: of pages with equal payloads of `least` bytes or more, that with the largest page_id is a response and the others
are revisits of it; smaller payloads are all responses. A record is a string that ends with the separator of Spark's text
sink, so the sink itself writes WARC/1.1 files with its usual commit protocol. Spark has no sink for raw bytes, so files are
gzip-compressed as a whole and not record by record. A block is an HTTP response whose body is the payload; a revisit has the
HTTP header alone. Records of up to LIGHT bytes go RECORDS to a file, heavier ones fewer, so that no file has over
RECORDS * LIGHT bytes but one that holds a single record.

Reading: files come whole and are parsed by Content-Length. Each file's captures, sorted by (URL key, timestamp, page), are a
run; a run is cut at common splitters, the slices of a range of keys meet in one task, and a loser tree merges them. There
are as many ranges as it takes for each to hold RANGE_ROWS captures or so, so that a task's memory does not grow with the
input. Ranges in order, with their rows in order, are the captures in global order. Splitters are a sample of the keys,
SAMPLED a range; they decide how even the ranges are, not what is in them.

Edge cases: a null html is an empty payload; a null url has an empty key and no target header; a null page_id can be a
response only if all its copies lack ids too; rows that repeat a page_id are records of their own (rows that share the
largest page_id of their payload are all responses); every record has its own WARC-Record-ID all the same; an empty table
gives no records; other columns are ignored. `captured` (a timestamp), where the pages have it, dates the captures; else
START plus page_id seconds (modulo a thousand million) does.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .url_filter import host_of, key_of

END = "\r\n\r\n"
RECORDS, LIGHT = 2_000, 64_000
START = "2024-01-01 00:00:00"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RANGE_ROWS, SAMPLED = 200_000, 8
#: Merged captures that a task hands on at a time.
AT_A_TIME = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

CAPTURE = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
NAMES = [c.split()[0] for c in CAPTURE.split(", ")]
#: Inside runs ids are text: in lists of structs, pandas would make a long beside nulls a float64 and round it.
RUN = f"run array<struct<{CAPTURE.replace('_id long', '_id string').replace('to long', 'to string').replace(' ', ':').replace(',:', ',')}>>"
IDS = [NAMES.index("page_id"), NAMES.index("refers_to")]


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string: 20 bits, that is five hex digits, give four characters."""
    digest, parts = F.sha1(text.cast("binary")), []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(ALPHABET), F.shiftright(bits, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def url_key(url: Column) -> Column:
    """Reversed host and what follows it: captures of a site and of a page sort together."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(url.contains("://"), F.concat(key_of(host_of(url)), F.lit(")"), rest)).otherwise(F.coalesce(url, F.lit("")))


def captures_of(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, captured, url_key, same (what equal payloads share), weight (bytes of a record, or more)."""
    if "captured" in pages.columns:
        at = F.col("captured").cast("timestamp")
    else:
        at = F.timestamp_seconds(F.unix_timestamp(F.lit(START).cast("timestamp")) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(1_000_000_000)))
    payload = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.octet_length(payload).alias("size"),
        F.date_format(F.coalesce(at, F.lit(START).cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        url_key(F.col("url")).alias("url_key"), F.unhex(F.sha2(payload, 256)).alias("same"),
        (F.octet_length(payload) + 4 * F.coalesce(F.octet_length("url"), F.lit(0)) + 1_000).cast("long").alias("weight"),
    )


def records_of(captures: DataFrame, owners: DataFrame, part: str) -> DataFrame:
    """The text of each record of a part of the archives, without its end, as `record`."""
    # A payload of very many pages is split by adaptive execution.
    judged = captures.join(owners, "same", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    if_any = lambda c: F.coalesce(c, F.lit(""))
    clean = lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    # The one response of a payload has a name that its revisits know; any other record has one by its place in the job.
    lone = F.col("owners") == 1
    response_of = F.concat(F.lit("<urn:page:"), F.col("owner").cast("string"), F.lit(":"), F.lower(F.hex("same")), F.lit(">"))
    by_place = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(f":{part}:"), F.monotonically_increasing_id().cast("string"), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.when(F.col("owner").isNotNull() & ~revisit & lone, response_of).otherwise(by_place)),
        line("WARC-Date", F.col("captured")),
        if_any(line("WARC-Target-URI", clean(F.col("url")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))),
        if_any(line("X-Page-ID", F.col("page_id").cast("string"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        line("X-URL-Key", clean(F.col("url_key"))),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))).otherwise(F.lit("")),
        F.when(revisit & lone, line("WARC-Refers-To", response_of)).otherwise(F.lit("")),
        F.when(revisit, line("X-Refers-To-Page", F.col("owner").cast("string"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.when(revisit, F.lit(0)).otherwise(F.col("size")) + len(HTTP)).cast("string")),
        F.lit("\r\n" + HTTP),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    # What goes into one file: of records between 2^c and 2^(c+1) bytes those of so many rows in a task that they fill no more than
    # RECORDS * LIGHT bytes.
    size_class = F.floor(F.log2("weight")).cast("int")
    share = F.greatest(F.lit(1), F.floor(F.lit(RECORDS * LIGHT) / F.pow(F.lit(2.0), size_class + 1))).cast("long")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    cut = F.concat(size_class.cast("string"), F.lit("-"), F.floor(place / share).cast("string"))
    return judged.select(record.alias("record"), cut.alias("cut"))


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Records stay where the search for equal payloads has dealt them, so that payloads are shuffled once."""
    captures = captures_of(pages)
    marks = common.materialise(captures.select("page_id", "size", "same", "weight"), "payload-marks")
    counted = marks.where(F.col("size") >= least).groupBy("same", "page_id").agg(F.count(F.lit(1)).alias("n"))
    owners = counted.where("page_id is not null").groupBy("same").agg(F.max("page_id").alias("owner"), F.max_by("n", "page_id").alias("owners"))
    heavy = (marks.agg(F.max("weight")).first()[0] or 0) > LIGHT
    part = lambda name, rows: records_of(rows, owners, name)
    light = part("light", captures.where(F.col("weight") <= LIGHT) if heavy else captures).select("record")
    light.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(f"{path}/light")
    if heavy:
        part("heavy", captures.where(F.col("weight") > LIGHT)).write.option("lineSep", END).option("compression", "gzip").partitionBy("cut").text(f"{path}/heavy")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of the records of a file."""
    at = 0
    while at < len(data):
        stop = data.index(END.encode(), at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record begins at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        begin = stop + 4
        end = begin + int(headers["Content-Length"])
        if data[end : end + 4] != END.encode():
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield headers, data[begin:end]
        at = end + 4


def number(text: str | None) -> int | None:
    return None if text is None else int(text)


def run_of(data: bytes) -> list[tuple]:
    """A file's captures in order. A response's length and digest are those of the payload that was read."""
    rows = []
    for h, block in parse(data):
        size, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
        if h["WARC-Type"] == "response":
            body = block[block.index(END.encode()) + 4 :]
            own = base64.b32encode(hashlib.sha1(body).digest()).decode()
            if own != digest:
                raise ValueError("a payload does not have the digest of its record")
            size, digest = len(body), own
        rows.append((h["X-URL-Key"], h["WARC-Date"], number(h.get("X-Page-ID")), size, digest, h["WARC-Type"], number(h.get("X-Refers-To-Page"))))
    return sorted(rows, key=order)


def order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


class LoserTree:
    """Merges sorted lists: inner nodes keep the losers, so that each row costs one path to the root."""

    def __init__(self, lists: list[list[tuple]]):
        self.lists, self.at, self.k = lists, [0] * len(lists), len(lists)
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.lists[a], self.lists[b]
        i, j = self.at[a], self.at[b]
        if i >= len(x) or j >= len(y):
            return i < len(x)
        return order(x[i]) <= order(y[j])

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            held = self.losers[node]
            if held < 0:  # the first to come waits for its opponent
                self.losers[node] = winner
                return
            if self._before(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        for _ in range(sum(map(len, self.lists))):
            winner = self.losers[0]
            yield self.lists[winner][self.at[winner]]
            self.at[winner] += 1
            self._play(winner)


def packed(row: tuple) -> dict:
    return {c: str(x) if i in IDS and x is not None else x for i, (c, x) in enumerate(zip(NAMES, row))}


def unpacked(c: dict) -> tuple:
    return tuple(number(c[x]) if i in IDS else c[x] for i, x in enumerate(NAMES))


def frame(rows: list[tuple]) -> pd.DataFrame:
    """Captures as a frame; ids stay exact beside nulls."""
    made = pd.DataFrame(rows, columns=NAMES)
    for i in IDS:
        made[NAMES[i]] = pd.array([r[i] for r in rows], "Int64")
    return made


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the archives under `path`: range and rank, their place in global order, and CAPTURE."""
    common.prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for data in f["content"]:
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                yield pd.DataFrame({"run": [[packed(r) for r in run_of(data)]]})

    stored = common.materialise(files.mapInPandas(parsed, RUN), "capture-runs")
    captures = stored.select(F.explode("run").alias("c")).select("c.url_key", "c.captured", "c.page_id")
    n = max(common.partitions(spark), -(-captures.count() // RANGE_ROWS))
    some = sorted(order((key, at, number(page))) for key, at, page in captures.orderBy(F.xxhash64("url_key", "captured", "page_id")).limit(SAMPLED * n).collect())
    splitters = [some[len(some) * i // n] for i in range(1, n)] if some else []

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for run in f["run"]:
                slices: dict[int, list] = {}
                for c in run:
                    slices.setdefault(bisect_right(splitters, order(unpacked(c))), []).append(c)
                if slices:
                    yield pd.DataFrame({"range": list(slices), "run": list(slices.values())})

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Slices sorted by range; those of a range, RANGE_ROWS captures or so, are held while they are merged."""
        now, lists = None, []

        def done() -> Iterator[pd.DataFrame]:
            rank, rows = 0, []
            for row in LoserTree(lists):
                rows.append(row)
                if len(rows) == AT_A_TIME:
                    yield frame(rows).assign(range=now, rank=range(rank, rank + len(rows)))
                    rank, rows = rank + len(rows), []
            if rows:
                yield frame(rows).assign(range=now, rank=range(rank, rank + len(rows)))

        for f in frames:
            for r, run in zip(f["range"].tolist(), f["run"]):
                if lists and r != now:
                    yield from done()
                    lists = []
                now = r
                lists.append([unpacked(c) for c in run])
        if lists:
            yield from done()

    sliced = stored.mapInPandas(cut, f"range int, {RUN}")
    dealt = sliced.repartition(n, "range").sortWithinPartitions("range")
    return dealt.mapInPandas(merged, f"{CAPTURE}, range int, rank long").select("range", "rank", *NAMES)


def round_trip(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Writes the pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or common.fresh_path(spark, "warc")
    write_archives(pages, path, least)
    return capture_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
