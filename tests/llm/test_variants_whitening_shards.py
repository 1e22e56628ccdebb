"""Spelling variants, whitening and sharding against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetledger.llm import embedding_whitening, sharding, spelling


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words_by_hand(docs, delete=97):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % delete == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def groups_by_hand(words, times=2):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def written(spark):
    """Words over a small alphabet, accents, ties, letters that are no letters elsewhere, long words, nulls, repeated rows."""
    rng = random.Random(5)
    stock = ["".join(rng.choice("abÀé") for _ in range(rng.randint(4, 8))) for _ in range(260)] + ["Colour", "colOur", "color", "coloor", "×÷×÷×", "naïve", "naive", "ŒuvreŒ"]
    weights = [rng.random() ** 4 for _ in stock]
    rows = [(n, " ".join(rng.choices(stock, weights, k=rng.randint(0, 200))), "x") for n in range(60)]
    giant = "q" * 60_000
    rows += [(None, "colour colours", "x"), (7, None, None), (8, "", "x"), (9, giant), (10, giant), (11, f"{giant} {giant[1:]} {giant[1:]}."), (12, giant[1:])]
    rows = [(*r, None)[:3] for r in rows]
    return spark.createDataFrame(rows + rows[:3] + [rows[60]] * 3, "doc_id long, text string, word string").repartition(5)


def test_spelling_variants(written):
    docs = [(r[0], r[1]) for r in written.collect()]
    got = sorted((tuple(r) for r in spelling.spelling_variants(written).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    want = groups_by_hand(words_by_hand(docs))
    assert got == want
    assert any(len(w[0]) > 50_000 and w[4] == 1 for w in want) and any(w[1] and w[2] != w[1] for w in want)


def test_planted_deletions_follow_the_hash(written):
    docs = [(r[0], r[1]) for r in written.collect()]
    for delete in (2, 97, None):
        got = {r["word"]: r["n"] for r in spelling.vocabulary(written, delete=delete).collect()}
        assert got == words_by_hand(docs, delete or 1 << 40)
    assert words_by_hand(docs, 2) != words_by_hand(docs)


@pytest.mark.parametrize("crowd", [2, 40, 10**6])
def test_crowded_files_lose_no_pair(spark, crowd):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab\U0001f600") for _ in range(rng.randint(1, 7))) for _ in range(500)} | {"x", "xy", "y"})
    df = spark.createDataFrame([(w, 1 + len(w)) for w in words], "word string, n long")
    got = [tuple(sorted((r["a"], r["b"]))) for r in spelling.near_pairs(df, crowd).collect()]
    assert sorted(got) == sorted(tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b))


def test_scan_skips_and_finds():
    rng = random.Random(8)
    for turn in range(60):
        entries = sorted({"".join(rng.choice("ab" if turn % 2 else "abcé") for _ in range(rng.randint(0, 7))) for _ in range(60)})
        scan = spelling.Scan(entries)
        for word in [*entries, "", "zz"]:
            assert list(scan.near(word)) == [i for i, e in enumerate(entries) if one_edit(word, e)]


def test_roots_of_long_chains(spark):
    chain = [(f"w{n}", f"w{n + 1}") for n in range(37)] + [("a", "w0"), ("b", "c")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "c" if w == "b" else "w37" for w, _ in chain}


def test_no_words(spark, no_docs):
    assert spelling.spelling_variants(no_docs).count() == 0
    one = spelling.spelling_variants(spark.createDataFrame([(1, "alone alone alone")], "doc_id long, text string"), delete=None).collect()
    assert [tuple(r) for r in one] == [("alone", None, "alone", 3, 0, None)]


def test_respell(spark):
    docs = spark.createDataFrame([(1, "Colour colour colour colour colour colour colours"), (2, "colours colours"), (3, None)], "doc_id long, text string")
    found = spelling.spelling_variants(docs, delete=None)
    assert sorted(tuple(r) for r in spelling.respell(docs, found).collect()) == [(1, "colours", "colour", 1), (2, "colours", "colour", 2)]


def vectors(n, d, rng, scale):
    return (rng.standard_normal((n, d)) * scale).astype(np.float32)


def whitening_by_hand(rows, components=16):
    rows = [(i, [float(c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = max(Counter(len(v) for _, v in rows).items(), key=lambda x: x[::-1])[0]
    rows = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if len(v) == d]
    fit = np.array(sorted({tuple(x) for _, x in rows}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = ((n * fit - s) / n).astype(float)
    values, turn = np.linalg.eigh(c.T @ c / n)
    values, turn = values[::-1], turn[:, ::-1]
    out = {}
    for i, x in rows:
        off = n * np.array(x, dtype=object) - s
        out.setdefault(i, []).append((int((off**2).sum()), (off / n).astype(float) @ turn / np.sqrt(np.maximum(values, 1e-300))))
    return n, values, out


@pytest.mark.parametrize("d, decay", [(40, "flat"), (40, "steep"), (9, "flat")])
def test_whitening(spark, d, decay):
    rng = np.random.default_rng(d)
    v = vectors(700, d, rng, 1.0 if decay == "flat" else 0.8 ** np.arange(d))
    rows = [(n, x.tolist()) for n, x in enumerate(v)] + [(5000 + n, v[0].tolist()) for n in range(400)]
    bad = [(9001, None), (9002, [1.0] * (d - 1) + [None]), (9003, [math.nan] * d), (9004, [math.inf] + [0.0] * (d - 1)), (9005, []), (9006, [1.0, 2.0]), (None, v[1].tolist())]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows + bad], "vec_id long, embedding array<float>, x int").repartition(6)
    got = embedding_whitening.whiten(df).toPandas()
    n, values, want = whitening_by_hand(rows + [bad[-1]])
    k = min(16, d)
    assert len(got) == k * 1101 and got["vec_id"].isna().sum() == k and not got["vec_id"].isin(range(9001, 9007)).any()
    assert set(got["n"]) == {n} == {700} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    for c in range(1, k + 1):
        mine = got[(got["component"] == c) & got["vec_id"].notna()].set_index("vec_id").sort_index()
        theirs = np.array([want[i][0][1][c - 1] for i in mine.index])
        sign = np.sign(theirs @ mine["whitened"].to_numpy())
        assert np.abs(sign * theirs - mine["whitened"]).max() < 1e-7
        assert mine["explained"].iloc[0] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
        assert mine["deviation"].tolist() == [want[i][0][0] for i in mine.index]


def test_whitening_of_little(spark):
    schema = "vec_id string, embedding array<double>"
    empty = embedding_whitening.whiten(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.schema["vec_id"].dataType.simpleString() == "string"
    assert embedding_whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0])] * 3, schema)).count() == 0
    # Points on a line: one component; the other has no variance. One entry is as large as a long allows.
    line = [(str(n), [float(n), 2.0 * n]) for n in range(5)]
    got = embedding_whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1.0)
    wide = embedding_whitening.whiten(spark.createDataFrame([("a", [1e15, 0.0]), ("b", [-1e15, 0.0]), ("c", [1e300, 0.0])], schema)).collect()
    assert {(r["vec_id"], r["deviation"]) for r in wide} == {("a", None), ("b", None)}


def test_filter_finds_what_a_start_block_lacks(spark):
    """The certificate: pairs that are exact, but not the leading ones, are refused."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(vectors(400, 30, rng, np.linspace(3, 1, 30)))], "vec_id long, embedding array<double>")
    found = embedding_whitening.usable(df, "embedding")
    v = embedding_whitening.Covariance(embedding_whitening.packed(found, 30), 30)
    full = v.times(np.eye(30))
    values, turn = np.linalg.eigh(full)
    right, wrong = list(range(29, 25, -1)), [29, 28, 27, 25]
    assert embedding_whitening.unmissed(v, values[right], turn[:, right], 4, rng)
    assert not embedding_whitening.unmissed(v, values[wrong], turn[:, wrong], 4, rng)


def shard_by_hand(key, shards):
    mine = list(shards)
    for level in ("region", "rack", "shard"):
        children = {}
        for s in mine:
            children.setdefault(f"{level}:{s.generation}:{getattr(s, level)}", []).append(s)
        first = xxhash.xxh64(key.encode(), seed=42).intdigest()
        draw = lambda name, each: -math.log(((xxhash.xxh64(name.encode(), seed=first).intdigest() >> 11) + 0.5) / 2**53) / sum(s.weight for s in each)
        mine = min(children.items(), key=lambda c: draw(*c))[1]
    return mine[0].shard


def test_sharding(spark, docs, no_docs):
    got = sharding.assign(docs).collect()
    now, grown = sharding.topology(), sharding.topology(17)
    texts = Counter((i, t) for i, t in docs.select("doc_id", "text").collect())
    size = lambda t: len((t or "").encode()) + 1
    keyed = lambda i: "-" if i is None else str(i)
    want = Counter()
    for (i, t), n in texts.items():
        want[i, size(t), zlib.crc32((t or "").encode()), "key", shard_by_hand(keyed(i), now), shard_by_hand(keyed(i), grown)] += n
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.assign(no_docs).count() == 0


def test_growth_moves_rows_only_into_what_is_new(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    now = sharding.topology()
    moved = sharding.movement(sharding.assign(docs)).collect()
    assert {r["grown_shard"] for r in moved} == {16} and len({r["shard"] for r in moved}) == 16
    assert 20_000 / 17 * 0.85 < sum(r["n"] for r in moved) < 20_000 / 17 * 1.15
    within = [*now, sharding.Shard(16, "rack-0", "region-0", 1.0, 1)]  # beside old shards of a rack
    assert {r["grown_shard"] for r in sharding.movement(sharding.assign(docs, now, within)).collect()} == {16}
    # More weight for one shard: rows move into its region, and between racks and shards of it only toward it.
    heavier = [s._replace(weight=3.0) if s.shard == 5 else s for s in now]
    moves = sharding.movement(sharding.assign(docs, now, heavier)).collect()
    region = {s.shard: s.region for s in now}
    assert moves and {region[r["grown_shard"]] for r in moves} == {"region-1"}
    counts = {r["shard"]: r["n"] for r in sharding.assign(docs, heavier).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert 0.9 < counts[5] / (20_000 * 3 / 18) < 1.1 and all(0.8 < n / (20_000 / 18) < 1.2 for s, n in counts.items() if s != 5)


def test_shard_files(spark, docs, tmp_path):
    named = docs.withColumnRenamed("key", "a.b")
    sharding.write_shards(named, str(tmp_path / "shards"), rows_a_file=10)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert set(back.columns) == {*named.columns, "shard"} and back.count() == docs.count()
    assert {(r["doc_id"], r["shard"]) for r in back.select("doc_id", "shard").collect()} == {(r["doc_id"], r["shard"]) for r in sharding.assign(docs).collect()}
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(back, str(tmp_path / "again"))


def test_topologies_are_checked():
    with pytest.raises(ValueError):
        sharding.topology(3)
    with pytest.raises(ValueError):
        sharding.checked([sharding.Shard(0, "r", "g", 0.0)])
    with pytest.raises(ValueError):
        sharding.checked([sharding.Shard(0, "r", "g"), sharding.Shard(0, "r", "g")])
    assert sharding.topology(18)[:17] == sharding.topology(17)
