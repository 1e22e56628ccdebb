"""Tokenizers against the public libraries, on edge cases and random strings."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from fleetledger.llm import byte_bpe, token_counts, token_output

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def fuzz(n=400):
    rng = random.Random(1)
    letters = list("ab' srelvmtd1\n\t.,;é漢   <s>▁\x00\r{\x1c\x85\u3000ÉσΣİ") + ["e\u0301", "<|endoftext|>"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(n)] + ["a" * 3000, "ab" * 900, " " * 90 + "x", "▁" * 33]


def key(row):
    return tuple((x is None, x) for x in row)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_byte_bpe_as_tiktoken(docs, no_docs):
    ranks = byte_bpe.load_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for t in fuzz():
        want = own.encode_ordinary(t)
        assert np.frombuffer(enc.ids(enc.pieces(t)), "<u4").tolist() == want
        for chunk, overlap in ((7, 4), (40, 9), (16, 1)):
            parts = [(k, byte_bpe.starts_of(t[k : k + chunk + overlap], enc)) for k in range(0, len(t), chunk)]
            assert not t or byte_bpe.stitch(parts, t, enc) == enc.pieces(t)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = own.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    for chunk in (byte_bpe.CHUNK, 100):
        assert rows(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, byte_bpe.DIGESTS, chunk=chunk, overlap=20)) == sorted(want, key=key)
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert sorted(bytes(r["decoded"]).decode() for r in back.collect()) == sorted(r[0] or "" for r in docs.select("text").collect())
    assert byte_bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_new_pieces_are_merged_together(monkeypatch):
    """As tiktoken and the heap have them, over forgotten memories too; the heap is left with long pieces."""
    rng = random.Random(2)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    words = ["".join(rng.choices(letters, k=rng.randint(1, 63))) for letters in ("a", "ab", "etaoinshr", "éüßñ", "漢字書", "😀é", "-=\x00", "0123456789") for _ in range(60)]
    spelt = [w.encode() for w in words]
    assert byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN).joins.merge(spelt) == [np.asarray(byte_bpe.merge(b, own._mergeable_ranks), "<u4").tobytes() for b in spelt]
    texts = ["", *fuzz(), " ".join(words), "x" * 64, "ab" * 3000]
    calls, heap = [], byte_bpe.merge
    monkeypatch.setattr(byte_bpe, "merge", lambda piece, ranks: calls.append(piece) or heap(piece, ranks))
    for remembered, at_a_time, places in ((300_000, 2_000_000, 1 << 19), (50, 400, 100)):
        monkeypatch.setattr(byte_bpe, "REMEMBERED", remembered)
        monkeypatch.setattr(byte_bpe, "AT_A_TIME", at_a_time)
        monkeypatch.setattr(byte_bpe, "PLACES", places)
        enc = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
        got = list(enc.encode(map(enc.pieces, texts)))
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == [own.encode_ordinary(t) for t in texts]
        assert calls and all(len(p.decode()) >= byte_bpe.LONG for p in calls)
    monkeypatch.setattr(byte_bpe, "DECODED", 7)
    assert [byte_bpe.decode_ids(b, RANKS).decode() for b in got] == texts


def test_token_counts_as_sentencepiece(docs, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    some = fuzz()
    assert token_counts.count_texts(some, PIECES) == [len(x) for x in sp.encode(some)]
    want = [(r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 100) for r in docs.select("doc_id", "text").collect()]
    assert rows(token_counts.token_counts(docs, PIECES, limit=100)) == sorted(want, key=key)
    assert token_counts.token_counts(no_docs, PIECES).count() == 0


def test_token_output_as_tokenizers(spark, docs, no_docs, monkeypatch):
    lib = Tokenizer.from_file(WORDS)
    some = fuzz()
    found = [np.frombuffer(b, "<u2").tolist() for b in token_output.WordEncoder(WORDS).encode(some)]
    assert found == [x.ids for x in lib.encode_batch(some, add_special_tokens=False)]
    known = sorted(((r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for i, t in known:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    path = token_output.common.fresh_path(spark, "ids")
    assert rows(token_output.token_output(docs, WORDS, path=path)) == sorted(want, key=key)
    hit = {r["doc_id"]: list(r["ids"]) for r in token_output.lookup(spark, path, [100 - 5, 100 - 8, 12345]).collect()}
    assert hit == {95: [*lib.encode("a b", add_special_tokens=False).ids, 1], 92: [*lib.encode(dict(known)[92], add_special_tokens=False).ids, 1]}
    assert token_output.token_output(no_docs, WORDS).count() == 0


def test_perfect_hash():
    ids = [None, None, 5, 5, *range(100, 5000, 7), -(2**62)]
    h = token_output.key_hash(ids, token_output.ordinals_of(ids))
    hashed = token_output.PerfectHash.build(h)
    assert sorted(hashed.slots(h).tolist()) == list(range(len(ids)))
    file = token_output.pack(0, 0, 2, ids, [b"\1\0"] * len(ids))
    read = token_output.IdFile(type("Row", (), file))
    strangers = list(range(10_000, 12_000))
    assert (read.find(strangers, np.zeros(2000, "int64"))[0] == -1).all()


def test_ids_stay_exact_beside_nulls(spark):
    """Ids above 2^53 and null ids in one batch, short and long texts: every operator keeps all 64 bits."""
    big = 1 << 60
    own = [(big + 1, "a b"), (None, "c"), (big + 3, "d e " * 40), (None, "f g " * 50), (big + 5, None), (7, "h")]
    docs = spark.createDataFrame(own, "doc_id long, text string").coalesce(1)
    want = sorted((i for i, _ in own), key=lambda i: (i is None, i))
    for chunk in (byte_bpe.CHUNK, 64):
        raw = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=16)
        assert {(r["doc_id"], bytes(r["decoded"]).decode()) for r in byte_bpe.decode(raw, RANKS).collect()} == {(i, t or "") for i, t in own}
    for made in (token_counts.token_counts(docs, PIECES), token_output.token_output(docs, WORDS)):
        assert sorted((r["doc_id"] for r in made.collect()), key=lambda i: (i is None, i)) == want


def test_a_document_longer_than_a_file(spark, monkeypatch):
    monkeypatch.setattr(token_output, "FILE_BYTES", 300)
    docs = spark.createDataFrame([(i, "word " * n) for i, n in ((1, 3), (2, 900), (3, 2), (None, 400))], "doc_id long, text string")
    path = token_output.common.fresh_path(spark, "ids")
    got = {r["doc_id"]: (r["start"], r["n_tokens"]) for r in token_output.token_output(docs, WORDS, path=path).collect()}
    assert got == {None: (0, 401), 1: (401, 4), 2: (405, 901), 3: (1306, 3)} and token_output.read_files(spark, path).count() >= 1
