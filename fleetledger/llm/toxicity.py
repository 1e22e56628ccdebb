"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5, with marks at both ends) and itself, hashed to BUCKETS rows of an
embedding table; the bag's rows are averaged and go to a linear layer of two classes. A misspelling that was never seen
shares most n-grams with the word that was. An unspaced run of over LONG characters (text without spaces, joined words,
URLs) is read whole, in overlapping pieces that count as words, in training as in scoring. A document's logit is that of its TOP most toxic words, averaged, so that a
few words count in a long text as in a short one. Table, layer and the scale of document logits are trained together, in
numpy: first words against the labels of the documents that hold them, then also documents against their own labels.
For scoring, table and layer are multiplied out to one number a bucket, which is exact since averaging is linear.

The classifier is fitted on the driver on a sample of labelled documents: about TRAIN_ROWS of them, chosen by a hash of
the id, one row an id; of each only its different words are sent, TRAIN_BYTES of them together at most, and no document
trains whose different words have over ROW_BYTES. These three bound what reaches the driver whatever the input's size.

Edge cases: null and empty texts get the score of no evidence (below 0.5); null doc_ids are scored, and count as held
out by the rule that their text form is empty; rows without a label, or with labels that disagree, don't train; of rows
that repeat a labelled id, one trains; without any label, or with one kind only, there is no evidence and all scores are
the smoothed share of toxic labels, but NO_EVIDENCE at most, so that nothing is rejected; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 17
DIM = 8
TOP = 2
PART = 20_000
TRAIN_ROWS = 8_000
TRAIN_BYTES, ROW_BYTES = 16_000_000, 1_000_000
NO_EVIDENCE = 0.49
REMEMBERED = 400_000
#: Words over LONG characters are read in overlapping pieces of PIECE characters, one begun every PIECE // 2.
LONG, PIECE = 64, 24
EDGE = ".,;:!?\"'()[]{}<>|*_~`«»“”„…-"


def bags(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of whole words as (number of the word, bucket)."""
    marked = [f"<{w}>" for w in tokens]
    size = np.fromiter(map(len, marked), "int64", len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype("uint64")
    owner = np.repeat(np.arange(len(marked), dtype="int32"), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(owner))  # characters from here to the word's end
    after = np.r_[code, np.zeros(5, "uint64")]
    owners = [np.arange(len(marked), dtype="int32")]
    hashes = [np.fromiter((zlib.crc32(w.encode()) for w in marked), "uint64", len(marked))]
    h = code
    for n in range(2, 6):
        h = h * np.uint64(0x100000001B3) + after[n - 1 : n - 1 + len(h)]
        if n >= 3:
            good = left >= n
            owners.append(owner[good])
            hashes.append(h[good] * np.uint64(n))
    mixed = np.concatenate(hashes) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return np.concatenate(owners), (mixed % np.uint64(BUCKETS)).astype("int32")


def pieces(run: str) -> list[str]:
    """What stands for a word over LONG characters: pieces that overlap by half and reach its end, so that each string of
    up to PIECE // 2 characters is whole in one, and the words between its marks of punctuation."""
    step = PIECE // 2
    out = [run[at : at + PIECE] for at in range(0, len(run) - step, step)]
    return out + [w for w in re.split(r"[\W_]+", run) if w and len(w) <= LONG]


def words(text: str) -> list[str]:
    """Words at white space; of an unspaced run over LONG characters its pieces, each of which counts as a word."""
    own = text.lower().split()
    if max(map(len, own), default=0) <= LONG:
        return own
    return [w for x in own for w in ([x] if len(x) <= LONG else pieces(x))]


class Model:
    """One number a bucket, and the bias, scale and shift of document logits."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float, shift: float):
        self.weights, self.bias, self.scale, self.shift = weights, bias, scale, shift

    def logits(self, tokens: list[str]) -> np.ndarray:
        """Logits of words; a word of punctuation alone is no evidence."""
        bare = [w.strip(EDGE) for w in tokens]
        z = np.zeros(len(bare))
        for at in range(0, len(bare), PART):
            own = bare[at : at + PART]
            owner, bucket = bags(own)
            z[at : at + PART] = np.bincount(owner, self.weights[bucket], len(own)) / np.bincount(owner, minlength=len(own)) + self.bias
        return np.where(np.fromiter(map(bool, bare), bool, len(bare)), z, -20.0)

    def score(self, values: np.ndarray) -> float:
        """Probability of a document from the logits of its different words."""
        if not len(values):
            return 1 / (1 + np.exp(max(0.1, self.scale * 20 - self.shift)))
        top = np.partition(values, len(values) - TOP)[-TOP:] if len(values) > TOP else values
        return float(1 / (1 + np.exp(-np.clip(self.scale * top.mean() + self.shift, -60, 60))))


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 80, seed: int = 0) -> Model:
    """Texts (their different words are enough) and their labels. Memory is a few bytes for each subword of each
    different word."""
    share = min(NO_EVIDENCE, (toxic.sum() + 1) / (len(toxic) + 2))
    if not 0 < toxic.sum() < len(toxic):
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    vocab: dict[str, int] = {}
    ids, sizes = [], []
    for t in texts:
        own = [vocab.setdefault(w, len(vocab)) for x in dict.fromkeys(words(t)) if (w := x.strip(EDGE))]
        ids += own
        sizes.append(len(own))
    ids, sizes = np.array(ids, "int32"), np.array(sizes)
    # Subwords stay in parts of PART words each, so that no array of all of them is ever widened.
    known = list(vocab)
    parts = [bags(known[at : at + PART]) for at in range(0, len(known), PART)]
    del known
    length = np.concatenate([np.bincount(owner) for owner, _ in parts])
    doc = np.repeat(np.arange(len(sizes), dtype="int32"), sizes)
    pairs = np.unique(doc.astype("int64") * len(vocab) + ids)  # presence, not repeats
    seen_toxic = np.bincount(pairs % len(vocab), weights=toxic[pairs // len(vocab)], minlength=len(vocab))
    seen = np.bincount(pairs % len(vocab), minlength=len(vocab))
    aim, weight = seen_toxic / seen, np.sqrt(seen) / np.sqrt(seen).sum()

    rng = np.random.default_rng(seed)
    p = {"table": rng.normal(0, 0.1, (BUCKETS, DIM)), "layer": rng.normal(0, 0.5, (DIM, 2)), "bias": np.zeros(2), "scale": np.array(1.0), "shift": np.array(0.0)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    full = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[full]
    label = toxic[full]
    balance = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, rounds + 1):
        # Two classes: the softmax depends on the difference of the logits alone.
        way = p["layer"][:, 1] - p["layer"][:, 0]
        value = p["table"] @ way
        z = np.concatenate([np.bincount(owner, value[bucket]) for owner, bucket in parts]) / length + p["bias"][1] - p["bias"][0]
        dz = weight * (sigmoid(z) - aim)
        g_scale = g_shift = 0.0
        if step > rounds // 3:
            v = z[ids]
            best = np.maximum.reduceat(v, begin)
            at = np.flatnonzero(v == np.repeat(best, sizes[full]))
            at = at[np.unique(doc[at], return_index=True)[1]]
            v2 = v.copy()
            v2[at] = -np.inf
            other = np.maximum.reduceat(v2, begin)
            has = np.isfinite(other)
            mean = np.where(has, (best + np.where(has, other, 0)) / 2, best)
            err = balance * (sigmoid(p["scale"] * mean + p["shift"]) - label)
            g_scale, g_shift = (err * mean).sum(), err.sum()
            at2 = np.flatnonzero(v2 == np.repeat(np.where(has, other, np.inf), sizes[full]))
            at2 = at2[np.unique(doc[at2], return_index=True)[1]]
            pull = err * p["scale"] * np.where(has, 0.5, 1.0)
            dz = 0.3 * dz + np.bincount(ids[at], weights=pull, minlength=len(z)) + np.bincount(ids[at2], weights=pull[has], minlength=len(z))
        each, per = dz / length, np.zeros(BUCKETS)
        for k, (owner, bucket) in enumerate(parts):
            per += np.bincount(bucket, each[PART * k : PART * (k + 1)][owner], BUCKETS)
        up, db = per @ p["table"], dz.sum()
        grad = {"table": per[:, None] * way, "layer": np.stack([-up, up], 1), "bias": np.array([-db, db]), "scale": g_scale, "shift": g_shift}
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * np.square(g)
            p[k] = p[k] - 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-5)
    way = p["layer"][:, 1] - p["layer"][:, 0]
    return Model((p["table"] @ way).astype("float32"), float(p["bias"][1] - p["bias"][0]), float(p["scale"]), float(p["shift"]))


_known: dict[str, float] = {}
_known_model: list = [None]


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    """Scores of whole texts. A worker remembers the logits of REMEMBERED words from one batch to the next."""
    mark = (zlib.crc32(model.weights.tobytes()), model.bias)
    if _known_model[0] != mark:
        _known.clear()
        _known_model[0] = mark
    out = np.zeros(len(texts))
    for at in range(0, len(texts), 256):
        own = [set(words(t)) for t in texts[at : at + 256]]
        new = set().union(*own) - _known.keys()
        if len(_known) + len(new) > REMEMBERED:
            _known.clear()
            new = set().union(*own)
        if new:
            new = list(new)
            _known.update(zip(new, model.logits(new).tolist()))
        for k, w in enumerate(own):
            out[at + k] = model.score(np.fromiter(map(_known.__getitem__, w), "float32", len(w)))
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on labelled documents that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_fl_max"))
    known = known.where((F.col("toxic") == F.col("_fl_max")) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_fl_id"), "toxic")
    share = min(1.0, rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("_fl_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    text = docs.select(F.col("doc_id").alias("_fl_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    met = text.join(known, "_fl_id").select("_fl_id", "toxic", F.array_join(F.array_distinct(F.split("text", r"\s+")), " ").alias("words")).where(F.octet_length("words") <= ROW_BYTES)
    met = met.groupBy("_fl_id").agg(F.min("toxic").alias("toxic"), F.min("words").alias("words"))
    met = common.materialise(met.select(F.xxhash64("_fl_id").alias("mark"), "toxic", "words"), "training-words")
    # A window over the sample's marks and sizes alone: some TRAIN_ROWS rows of two numbers.
    upto = F.sum(F.octet_length("words")).over(Window.orderBy("mark").rangeBetween(Window.unboundedPreceding, 0))
    past = met.select("mark", upto.alias("upto")).where(F.col("upto") > TRAIN_BYTES).agg(F.min("mark")).first()[0]
    got = (met if past is None else met.where(F.col("mark") < past)).orderBy("mark").toPandas()
    texts, toxic = got["words"].tolist(), got["toxic"].to_numpy("float64")
    del got
    return fit(texts, toxic)


def scorer(spark: SparkSession, model: Model):
    """A column function from a text to its score. Texts alone go to the workers, so that no other column is changed on the
    way. The model is broadcast: BUCKETS numbers."""
    common.prepare(spark)
    sent = spark.sparkContext.broadcast((model.weights, model.bias, model.scale, model.shift))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts.tolist(), Model(*sent.value)))

    return lambda text: score(F.coalesce(text, F.lit("")))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    score = scorer(docs.sparkSession, model)
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text")).alias("score"))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    return scores(docs, train(docs, labels, rows))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that score below 0.5, all columns as they were."""
    score = scorer(docs.sparkSession, train(docs, labels, rows))
    return docs.where(score(docs["text"]) < 0.5)
