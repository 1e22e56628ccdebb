import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from paths import SF
from fleetledger.llm import byte_bpe, common, exact_dedup, simhash, toxicity

BAD = ["stupid", "idiot", "moronic", "worthless", "disgusting"]


def made(n, seed):
    """Invented prose; one in six documents has two to four bad words."""
    rng = random.Random(seed)
    part = ["ka", "lo", "mi", "ren", "tu", "sha", "po", "vel", "dor", "nim"]
    word = lambda: "".join(rng.choice(part) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 80))]
        bad = i % 6 == 0
        for _ in range(rng.randint(2, 4) if bad else 0):
            w.insert(rng.randint(0, len(w)), rng.choice(BAD))
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, np.array(labels, float)


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*made(1500, 1))


def test_held_out_accuracy_and_misspellings(model):
    texts, labels = made(600, 2)
    found = toxicity.score_texts(texts, model) >= 0.5
    assert (found == labels).mean() > 0.98
    assert toxicity.score_texts(["ka lo stupidd ren worthlesss mi"], model)[0] > toxicity.score_texts(["ka lo shamika ren velpo mi"], model)[0]
    assert (toxicity.score_texts(["", "...", " \n"], model) < 0.5).all()


@pytest.mark.parametrize("joint", ["", "_", ",", "/"])
def test_long_unspaced_runs_are_read_to_their_end(model, joint):
    clean = joint.join(["kalomi", "rentusha", "povel", "dornimka", "lotu"] * 8)
    assert len(clean) > 200 and toxicity.score_texts([clean + joint + "shapo"], model)[0] < 0.5
    for before, after in ((clean + joint, ""), (clean + joint, joint + clean), (clean[:200] + joint, joint + "nim")):
        assert toxicity.score_texts([f"{before}stupid{joint}worthless{after}"], model)[0] > 0.5
    run = "".join(chr(0x4E00 + i) for i in range(1000))
    assert all(any(run[i : i + 12] in w for w in toxicity.words(run)) for i in range(989))


def test_labels_of_one_kind_give_their_share():
    assert toxicity.score_texts(["a b"], toxicity.fit(["a", "b"], np.zeros(2)))[0] == pytest.approx(0.25)


def test_scores_and_filter(spark):
    texts, labels = made(400, 3)
    docs = spark.createDataFrame([(i, t, 9, 0.5) for i, t in enumerate(texts)] + [(None, None, 1, 0.1), (5, texts[5], 9, 0.5)], "doc_id long, text string, toxic int, score double")
    marks = spark.createDataFrame([(i, int(x), 0) for i, x in enumerate(labels)] + [(None, 1, 0), (7, 1 - int(labels[7]), 0)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in got)
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert toxicity.toxicity(docs.limit(0), marks.limit(0)).count() == 0


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


ODD = "doc_id long, text string, `a.b` string, _fl_key long, _fl_row string, key long, id string, `b``c` int, _fl_id long, fp string, size long"


def test_stages_take_any_extra_columns(spark):
    """Names with dots and backticks, and those that operators use themselves; nothing is lost or changed on the way."""
    docs = common.table(spark, SF, "documents").select("doc_id", "text").limit(60)
    odd = docs.select("doc_id", "text", *[F.lit(str(n)).alias(c) for n, c in enumerate(["a.b", "_fl_key", "_fl_row", "key", "id", "b`c", "_fl_id", "fp", "size"])])
    odd = common.materialise(spark.createDataFrame(odd.rdd.map(lambda r: (r[0], r[1], r[2], 3, r[4], 5, r[6], 7, 8, r[9], 10)), ODD), "odd")
    rows = {r["doc_id"]: tuple(r) for r in odd.collect()}
    now, plain = odd, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = common.materialise(stage(spark, now, SF), "odd-stage")
        if k < 4:
            assert now.columns == odd.columns and all(rows[r["doc_id"]] == tuple(r) for r in now.collect())
        plain = common.materialise(stage(spark, plain, SF), "plain-stage")
        assert sorted(r[0] for r in now.select("doc_id").collect()) == sorted(r[0] for r in plain.select("doc_id").collect())


def test_stages_of_nothing(spark):
    none = spark.createDataFrame([], ODD)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, none, SF)
        assert out.count() == 0 and (k == 4 or out.columns == none.columns)


def test_pipeline_stage_by_stage(spark):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    docs = common.table(spark, SF, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(common.materialise(stage(spark, kept[-1], SF), "test-stage"))
    ids = [[r[0] for r in k.select("doc_id").collect()] for k in kept]
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, common.table(spark, SF, "labels")).collect()}
    assert sorted(ids[1]) == sorted(i for i in ids[0] if not scores[i])
    assert sorted(ids[2]) == sorted(r["doc_id"] for r in exact_dedup.exact_dedup(kept[1]).where("kept").collect())
    assert sorted(ids[3]) == sorted({r["component_id"] for r in simhash.near_dedup(kept[2]).collect()})
    windows = set()
    for item in common.table(spark, SF, "benchmark").collect():
        words = words_of(item["text"])
        size = min(10, len(words))
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} - {()}
    sizes = {len(w) for w in windows}
    clean = lambda text: not any(tuple(words[i : i + n]) in windows for words in [words_of(text)] for n in sizes for i in range(len(words) - n + 1))
    assert sorted(ids[4]) == sorted(r["doc_id"] for r in kept[3].collect() if clean(r["text"])) and len(ids[4]) < len(ids[3])
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {r["doc_id"]: hashlib.sha256(np.asarray(own.encode_ordinary(r["text"]), "<u4").tobytes()).hexdigest() for r in kept[4].collect()}
    assert {r["doc_id"]: r["ids_sha256"] for r in kept[5].collect()} == want
    for k in kept[1:5]:
        assert k.columns == docs.columns


def test_registered(spark):
    names = [n for n in entry.queries() if n.startswith("op")]
    assert {n.split("_")[0] for n in names} == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()


def test_no_evidence_rejects_nothing(spark):
    """Without labels, or with toxic ones only, all documents stay; nullable integers beside the text stay exact."""
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "a b", None), (None, "c d", big + 2), (3, "e", 5)], "doc_id long, text string, extra long").coalesce(1)
    for marks in ([], [(big, 1), (3, 1)]):
        labels = spark.createDataFrame(marks, "doc_id long, toxic int")
        kept = toxicity.drop_toxic(docs, labels).collect()
        assert sorted(map(tuple, kept), key=str) == sorted(map(tuple, docs.collect()), key=str)
        assert {r["doc_id"] for r in toxicity.toxicity(docs, labels).collect()} == {big, None, 3}


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, *rest: seen.append(texts) or toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0, 0.0, -1.0))
    docs = spark.createDataFrame([(i % 300, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(600)] + [(1, "v" * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "ROW_BYTES", 2000)
    toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 5000)
    toxicity.train(docs, labels)
    whole, part = seen
    assert 200 < len(whole) < 300 and max(map(len, whole)) <= 2000  # one row an id, none held out
    assert 0 < sum(map(len, part)) <= 5000 and set(part) < set(whole)


@pytest.mark.parametrize("sf, recall, false", [("sf0.1", 0.9, 0.05)])
def test_held_out_labels(spark, sf, recall, false):
    """What the labels say of documents that did not train. Some labels are noise; on sf0.01 six held-out documents are toxic,
    too few for a bound."""
    path = f"/root/testdata/{sf}"
    known = toxicity.toxicity(common.table(spark, path, "documents"), common.table(spark, path, "labels")).where("held_out").join(common.table(spark, path, "labels"), "doc_id")
    rows = [(r["toxic"], r["predicted"]) for r in known.select("toxic", "predicted").collect()]
    toxic, clean = [p for y, p in rows if y == 1], [p for y, p in rows if y == 0]
    assert sum(toxic) >= recall * len(toxic) and sum(clean) <= false * len(clean)
