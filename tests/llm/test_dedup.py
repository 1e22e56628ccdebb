"""Deduplication, decontamination and URL and archive operators against brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetledger.llm import decontaminate, exact_dedup, simhash, suffix_dedup, url_filter, warc

LAST = 1 << 62


def key(row):
    return tuple((x is None, x) for x in row)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def pairs(docs):
    return [(r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()]


def test_exact_dedup(docs, no_docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    groups: dict = {}
    for i, t in pairs(docs):
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in pairs(docs):
        ids = groups[norm(t)]
        known = [x for x in ids if x is not None]
        keep = min(known) if known else None
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert rows(exact_dedup.exact_dedup(docs)) == sorted(want, key=key)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and {norm(t) for _, t in pairs(kept)} == set(groups)
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_drops_decide_by_row(spark):
    """Null ids and a repeated id beside copies of other rows; ids above 2^53."""
    big, long_ = 1 << 53, " ".join(f"w{n}" for n in range(60))
    own = [(big + 1, "copied"), (None, "copied"), (None, "unique without id"), (None, "twice without id"), (None, "twice  without id"), (5, long_), (7, "only under seven"), (7, long_), (big + 3, "one more")]
    docs = spark.createDataFrame(own, "doc_id long, text string").coalesce(1)
    for drop in (exact_dedup.drop_copies, simhash.drop_near_copies):
        got = [(i, " ".join(t.split())) for i, t in drop(docs).collect()]
        assert sorted(got, key=key) == sorted([(big + 1, "copied"), (None, "unique without id"), (None, "twice without id"), (5, long_), (7, "only under seven"), (big + 3, "one more")], key=key)


def test_cuckoo_index_lives_through_overflow_and_deletion():
    index, live, rng = exact_dedup.DigestIndex(buckets=2), {}, random.Random(2)
    for n in range(6000):
        d = hashlib.sha256(str(rng.randint(0, 1500)).encode()).digest()
        if rng.random() < 0.3:
            assert index.remove(d) == (d in live)
            live.pop(d, None)
        else:
            index.add(d, n, 1)
            live[d] = [min(live[d][0], n), live[d][1] + 1] if d in live else [n, 1]
    assert index.live == len(live) and index.size > 2
    assert all(index.find(d) == e for d, e in live.items())


def test_index_update(spark, docs):
    keyed = exact_dedup.with_digest(docs)
    index = exact_dedup.build_index(keyed)
    gone = index.where("group_size > 1").select("digest")
    after = exact_dedup.update_index(index, exact_dedup.with_digest(spark.createDataFrame([(1, "brand new"), (2, "a")], "doc_id long, text string")), gone)
    sizes = {bytes(r["digest"]): r["group_size"] for r in after.collect()}
    assert sizes[hashlib.sha256(b"brand new").digest()] == 1 and sizes[hashlib.sha256(b"a").digest()] == 2
    assert not {bytes(r[0]) for r in gone.collect()} & sizes.keys()


def by_hand(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def linked(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_simhash(docs, no_docs):
    fp = [(i, by_hand(t)) for i, t in pairs(docs)]
    root = linked({f for _, f in fp})
    least: dict = {}
    for i, f in fp:
        if i is not None:
            least[root[f]] = min(least.get(root[f], LAST), i)
    assert rows(simhash.near_dedup(docs)) == sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in fp), key=key)
    assert simhash.near_dedup(no_docs).count() == 0
    assert simhash.drop_near_copies(docs).columns == docs.columns


def test_null_ids_bridge_groups(spark, monkeypatch):
    """The middle fingerprint is a null id's: three bits from one, three from the other; a second group has no id at all."""
    fps = {"a": 0, "b": 7, "c": 63, "d": 511 << 48 | 1 << 30, "e": 511 << 48}
    monkeypatch.setattr(simhash, "with_fingerprint", lambda docs, words=3, *marks: docs.select("doc_id", F.element_at(F.create_map(*[F.lit(x) for p in fps.items() for x in p]), F.col("text")).cast("long").alias("fp"), *marks))
    docs = spark.createDataFrame([(9, "a"), (None, "b"), (4, "c"), (None, "d"), (None, "e")], "doc_id long, text string")
    assert rows(simhash.near_dedup(docs).select("doc_id", "component_id")) == sorted([(9, 4), (None, 4), (4, 4), (None, None), (None, None)], key=key)
    got = [tuple(r) for r in simhash.drop_near_copies(docs).collect()]
    assert len(got) == 2 and (4, "c") in got and {t for i, t in got if i is None} < {"d", "e"}


@pytest.mark.parametrize("errors", range(5))
def test_golay_keys_meet_within_three_errors(errors):
    rng = np.random.default_rng(errors)
    a = rng.integers(0, 1 << 64, 300, dtype="u8")
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, errors, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    filed = set(zip(*(x.tolist() for x in simhash.keys_of(a))))
    met = {r for r, k in zip(*(x.tolist() for x in simhash.keys_of(b))) if (r, k) in filed}
    assert errors > 3 or len(met) == len(a)


def test_links_chain_into_one_component(spark):
    """Every fingerprint is three bits from the one before it, over many buckets."""
    fp, rows_ = 0, []
    for n in range(40):
        rows_.append((fp - (1 << 64) if fp >> 63 else fp, 1000 - n))
        for b in range(3):
            fp ^= 1 << ((3 * n + b) * 7 % 64)
    classes = spark.createDataFrame(list(dict(rows_).items()), "fp long, node long")
    got = simhash.components(simhash.links(classes)).collect()
    root = linked({f & (1 << 64) - 1 for f, _ in dict(rows_).items()})
    node = {f & (1 << 64) - 1: n for f, n in dict(rows_).items()}
    least: dict = {}
    for f, r in root.items():
        least[r] = min(least.get(r, LAST), node[f])
    assert {r["node"]: r["root"] for r in got} == {node[f]: least[r] for f, r in root.items() if node[f] != least[r]}


def removed_by_hand(known, length):
    seen: dict = {}
    for i, b in sorted(known):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], i)
    out = []
    for i, b in known:
        cut = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] < i:
                cut[p : p + length] = True
        left = np.frombuffer(b, "u1")[~cut].tobytes()
        out.append((None if i == LAST else i, len(b), int(cut.sum()), len(suffix_dedup.runs(cut)[0]), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 3, 0])
def test_suffix_dedup(docs, no_docs, crowd):
    known = [(LAST if i is None else i, t.encode()) for i, t in pairs(docs)]
    assert rows(suffix_dedup.remove_repeats(docs, crowd=crowd)) == removed_by_hand(known, 50)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 3, 0])
def test_a_null_id_is_the_largest_in_suffix_dedup(spark, crowd):
    """Null-id texts share long passages with ids, also above 2^53, in one batch; windows differ in their surroundings."""
    rng, big = random.Random(8), 1 << 53
    made = lambda: "".join(rng.choice("abcdefgh ") for _ in range(200))
    a, b, c = made(), made(), made()
    own = [(None, a), (None, made() + b + made()), (3, made() + a), (big + 1, a), (big + 2, made() + b), (big + 3, b + made()), (None, c), (None, c + made()), (big + 5, made())]
    docs = spark.createDataFrame(own, "doc_id long, text string").coalesce(1)
    known = [(LAST if i is None else i, t.encode()) for i, t in own]
    assert rows(suffix_dedup.remove_repeats(docs, crowd=crowd)) == removed_by_hand(known, 50)


def test_merged_transforms_find_all_repeats():
    rng = random.Random(4)
    for _ in range(20):
        texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 9))]
        ids = np.array([rng.randint(0, 5) for _ in texts])
        got = suffix_dedup.repeats(texts, ids, 9, shards=3)
        for t, i, flags in zip(texts, ids, got):
            for p in range(len(t) - 8):
                assert flags[p] == any(t[p : p + 9] in u for u, j in zip(texts, ids) if j < i)


def test_decontamination(spark, docs, no_docs, texts):
    passage = texts[13].split()
    items = [(1, " ".join(passage[3:25])), (22, "a b"), (3, None), (3, ""), (4, " ".join(passage[:9] + ["other"])), (5, "same TEXT here"), (None, "a"), (5, "same text here")]
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, words int")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t in pairs(docs):
        w, hit, found = low(t), set(), set()
        for item, text in items:
            q = low(text)
            k = min(10, len(q))
            for s in range(len(q) - k + 1 if q else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == q[s : s + k]:
                        hit |= set(range(p, p + k))
                        found |= {item} - {None}
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    assert rows(decontaminate.contamination(docs, bench)) == sorted(want, key=key)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r[-1] for r in want)
    assert decontaminate.contamination(no_docs, bench).count() == 0
    none = decontaminate.contamination(docs, bench.limit(0))
    assert none.count() == len(want) and none.where("contaminated").count() == 0
    near = {(r["doc_id"], r["item_id"]) for r in decontaminate.proximity(docs, bench).collect()}
    assert (100 - 13, "1") in near


@pytest.mark.parametrize("window", [10, 4])
def test_proximity_finds_replaced_words(spark, docs, texts, window):
    """Items with a word that occurs nowhere, shuffled items and a long one, against brute force."""
    passage, rng = texts[13].split(), random.Random(3)
    mixed = rng.sample(passage[:8], 8)
    items = [(1, " ".join(passage[:4] + ["unseen"] + passage[5:9])), (2, " ".join(mixed)), (3, " ".join(passage + ["unseen"] + texts[8].split()[:40])), (4, "no such words at all here"), (None, None), (5, " ".join(["unseen", "unheard"] * 3 + passage[20:25]))]
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want: dict = {}
    for i, t in pairs(docs):
        at = low(t)
        for item, text in items:
            q = low(text)
            for o, x in enumerate(q):
                mine = set(q[max(0, o - window + 1) : o + window])
                for p in (p for p, y in enumerate(at) if y == x):
                    n = len(mine & set(at[max(0, p - window + 1) : p + window]))
                    if n >= 4:
                        want[i, str(item)] = max(want.get((i, str(item)), 0), n)
    got = decontaminate.proximity(docs, spark.createDataFrame(items, "item_id long, text string"), least=4, window=window).collect()
    assert {(r["doc_id"], r["item_id"]): r["shared"] for r in got} == want and (100 - 13, "1") in want


def test_url_filter(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x/", "block"), ("Example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "/", "block"), ("deep.sub.example.net", "", "allow")]
    hosts = ["net", "example.net", "www.Example.net", "a.deep.sub.example.net", "xnet", "example.com", "example.com.org", "a.org", "b.a.org", "org", "ba.org", ""]
    urls = [f"{s}{h}{p}" for s in ("http://", "x://y://", "") for h in hosts for p in ("", "/", "/en/", "/en/x/1?q=/fr/", "/de/#a", "/fr/z", "?/en/")] + [None, "", "://", "http://\n/"]
    pages = spark.createDataFrame([(i % 50 or None, u, "x", "y") for i, u in enumerate(urls * 2)], "page_id long, url string, html string, rule string")
    want = []
    for i, u in enumerate(urls * 2):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h) + len(q), len(h), h.lower() + q, v) for h, q, v in rules if host and f".{host}".endswith("." + h.lower()) and path.startswith(q)]
        best = max(fits, default=(0, 0, None, "allow"))
        want.append((i % 50 or None, host, path, best[2], best[3]))
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert rows(url_filter.judge(pages, frame)) == sorted(want, key=key)
    assert rows(url_filter.judge(pages, frame, most=0)) == sorted(want, key=key)
    assert url_filter.judge(pages.limit(0), frame).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, frame.limit(0), default="block").collect()} == {"block"}


def test_warc(spark):
    bodies = ["<p>x</p>", "same", None, "", "tricky\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "é漢", "long" * 5000, "same", "same", "same"]
    pages = [(i, f"http://h{i % 3}.example.com/p/{i % 4}\r\nx" if i % 5 else None, b, "z", 1) for i, b in enumerate(bodies)] + [(None, "http://n.net/", "alone", None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record string, rank int")
    for least in (0, 5):
        owner: dict = {}
        for i, _, b, *_ in pages:
            owner[b or ""] = max(owner.get(b or "", -1), -1 if i is None else i)
        want = []
        for i, _, b, *_ in pages:
            data = (b or "").encode()
            again = len(data) >= least and owner[b or ""] not in (i, -1)
            want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", owner[b or ""] if again else None))
        path = warc.common.fresh_path(spark, "warc")
        assert rows(warc.round_trip(df, least=least, path=path)) == sorted(want, key=key)
    history = [tuple(r)[2:] for r in warc.capture_index(spark, path).orderBy("range", "rank").collect()]
    assert history == sorted(history, key=warc.order) and len(history) == len(pages)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_one_heavy_page_leaves_the_others_their_files(spark):
    """Files are cut by what their own records weigh: a page of 30 MB beside 40 of 70 kB."""
    pages = spark.range(41).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.org/"), F.col("id").cast("string")).alias("url"), F.when(F.col("id") == 40, F.repeat(F.col("id").cast("string"), 15_000_000)).otherwise(F.concat(F.col("id").cast("string"), F.repeat(F.substring(F.col("id").cast("string"), 1, 1), 70_000))).alias("html"))
    pages = warc.common.materialise(pages.coalesce(1), "heavy-pages")
    path = warc.common.fresh_path(spark, "warc")
    warc.write_archives(pages, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").collect()
    assert len([f for f in files if "heavy" in f["path"]]) <= 4
    assert spark.read.text(path + "/heavy", lineSep=warc.END, recursiveFileLookup=True).where("value like 'WARC/1.1%'").count() == 41


def test_warc_ids_dates_and_bounds(spark, monkeypatch):
    """Ids beyond any date, a page_id that repeats with its payload, null ids: every record has its own id, and every name
    that a revisit refers to exists. Heavy records go to files of their own."""
    monkeypatch.setattr(warc, "LIGHT", 2000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 3)
    big = (1 << 62) + 1
    own = [(big, "http://a/", "x"), (big + 1, "http://b/", "x"), (big + 2, "http://c/", "y"), (big + 2, "http://c/", "y"), (7, "http://d/", "y"), (None, None, "z"), (None, None, "z"), (9, "http://e/", "w" * 9000)]
    pages = spark.createDataFrame(own, "page_id long, url string, html string")
    path = warc.common.fresh_path(spark, "warc")
    got = {(r["page_id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, path=path).collect()}
    assert got == {(big, 1): ("revisit", big + 1), (big + 1, 1): ("response", None), (big + 2, 1): ("response", None), (7, 1): ("revisit", big + 2), (None, 1): ("response", None), (9, 9000): ("response", None)}
    import gzip

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).collect()
    records = [h for f in files for h, _ in warc.parse(gzip.decompress(f["content"]))]
    names = [h["WARC-Record-ID"] for h in records]
    assert len(names) == len(set(names)) == len(own) and {h["WARC-Refers-To"] for h in records if "WARC-Refers-To" in h} <= set(names)
    assert any("/heavy/" in f["path"] for f in files)
    dated = pages.withColumn("captured", F.lit("2020-02-03 04:05:06").cast("timestamp"))
    assert {r["captured"] for r in (warc.write_archives(dated, path + "2"), warc.capture_index(spark, path + "2"))[1].collect()} == {"2020-02-03T04:05:06Z"}


def test_loser_tree():
    rng = random.Random(6)
    for k in range(1, 9):
        lists = [sorted((("k", str(rng.randint(10, 99)), rng.randint(0, 9)) for _ in range(rng.randint(0, 12))), key=warc.order) for _ in range(k)]
        assert list(warc.LoserTree(lists)) == sorted((x for y in lists for x in y), key=warc.order)


def test_few_dropped_rows_shuffle_no_text(spark, tmp_path):
    """Where little goes, the filters' last step joins without an exchange of the rows; where the bound is passed, it gives the same rows."""
    rows = [(i, f"text number {i % 40} of many " + " ".join(f"w{i % 40}x{k}" for k in range(30))) for i in range(60)] + [(None, "nameless"), (None, "nameless")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    benchmark = spark.createDataFrame([("i", rows[3][1])], "item_id string, text string")
    filters = [exact_dedup.drop_copies, simhash.drop_near_copies, lambda d: decontaminate.drop_contaminated(d, benchmark)]
    bound, found = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    try:
        for size in (bound, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
            made = [f(docs) for f in filters]
            plans = [m._jdf.queryExecution().executedPlan().toString() for m in made]
            assert [("BroadcastHashJoin" in p, "SortMergeJoin" in p) for p in plans] == [(size == bound, size != bound)] * 3
            found.append([sorted(map(tuple, m.collect()), key=repr) for m in made])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert found[0] == found[1] and len(found[0][0]) == 41 and len(found[0][2]) == 60
