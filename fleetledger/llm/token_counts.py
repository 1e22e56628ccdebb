"""Token counts under a sentencepiece BPE model, by merging ragged arrays of symbols rank by rank.

No piece of the model joins a non-space to a following space, and none holds a line feed (both are asserted), so
merges never cross those places: texts are cut there into pre-tokens. The distinct new pre-tokens of a batch are
laid end to end in one array. In each round every sequence finds its pair of lowest rank and merges all its
occurrences, in all sequences at once; where one merge would make a pair that comes before the rest, the rest
waits for the next round. What survives is counted; a character without a piece counts as its UTF-8 bytes.

Edge cases: a null text counts as empty: no bytes, no tokens; null and repeated doc_ids are allowed; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
NONE = np.int64(1) << 40
PRE_TOKEN = re.compile(" *[^ \n]+| +|\n")
REMEMBERED = 400_000
#: Characters of text that are cut into pre-tokens at a time.
AT_A_TIME = 1_000_000


class Pieces:
    """The model's pieces: character ids, and for each pair of pieces that joins to a piece its rank and id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        names = {sp.id_to_piece(i): i for i in plain}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in names):
            raise ValueError("a piece crosses the places where texts are cut")
        self.width = sp.vocab_size()
        self.chars = {(" " if p == SPACE else p): i for p, i in names.items() if len(p) == 1}
        scores = np.array([sp.get_score(i) for i in range(self.width)])
        rank = np.unique(-scores, return_inverse=True)[1].astype("int64")
        pairs = [(names[a] * self.width + names[b], rank[i], i) for p, i in names.items() for k in range(1, len(p)) if (a := p[:k]) in names and (b := p[k:]) in names]
        keys, ranks, ids = (np.array(x, "int64") for x in zip(*pairs))
        order = np.argsort(keys)
        self.keys, self.ranks, self.ids = keys[order], ranks[order], ids[order]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the two don't join) and id of each pair; negative ids join to nothing."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.ranks[at], NONE), self.ids[at]

    def count(self, tokens: list[str]) -> np.ndarray:
        """Number of symbols that survive in each pre-token (no token may be empty)."""
        symbols, weight = [], np.zeros(len(tokens), "int64")
        for k, t in enumerate(tokens):
            own = [self.chars.get(c, -1) for c in t]
            if -1 in own:
                weight[k] = sum(len(c.encode()) - 1 for c, i in zip(t, own) if i < 0)
            symbols.append(own)
        sizes = np.fromiter(map(len, symbols), "int64", len(symbols))
        sym = np.fromiter((i for own in symbols for i in own), "int64", int(sizes.sum()))
        seq = np.repeat(np.arange(len(tokens)), sizes)
        while len(sym):
            inside = np.zeros(len(sym), bool)
            inside[:-1] = seq[:-1] == seq[1:]
            rank, joined = np.full(len(sym), NONE), np.zeros(len(sym), "int64")
            rank[:-1], joined[:-1] = self.pair(sym[:-1], sym[1:])
            rank[~inside] = NONE
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            size = np.diff(np.r_[first, len(sym)])
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            open_ = least < NONE
            if not open_.all():
                weight += np.bincount(seq[~open_], minlength=len(tokens))
                sym, seq, rank, joined, least = sym[open_], seq[open_], rank[open_], joined[open_], least[open_]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == least)
            run = np.r_[True, at[1:] != at[:-1] + 1]
            place = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[place % 2 == 0]  # of overlapping occurrences every other one, from the left
            made = joined[at]
            n = len(sym)
            touching = np.r_[False, (at[1:] == at[:-1] + 2) & (seq[at[1:]] == seq[at[:-1]])]
            left = np.where(touching, np.r_[0, made[:-1]], sym[np.maximum(at - 1, 0)])
            left = np.where((at > 0) & (seq[np.maximum(at - 1, 0)] == seq[at]), left, -1)
            after = np.minimum(at + 2, n - 1)
            right = np.where((at + 2 < n) & (seq[after] == seq[at]), sym[after], -1)
            sooner = np.minimum(self.pair(left, made)[0], self.pair(made, right)[0]) <= least[at]
            before = np.cumsum(sooner) - sooner
            starts = np.r_[True, seq[at[1:]] != seq[at[:-1]]]
            before = before - before[np.flatnonzero(starts)[np.cumsum(starts) - 1]]
            at, made = at[before == 0], made[before == 0]
            sym[at] = made
            keep = np.ones(n, bool)
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
        return weight


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


_known: dict[str, dict[str, int]] = {}


def count_texts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text."""
    model, known = pieces(path), _known.setdefault(path, {})
    cut = [PRE_TOKEN.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
    new = set().union(*cut) - known.keys()
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = set().union(*cut)
    if new:
        new = list(new)
        known.update(zip(new, model.count(new).tolist()))
    return [sum(map(known.__getitem__, c)) for c in cut]


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens above `limit`) of every row."""
    common.prepare(docs.sparkSession)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        counts, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= AT_A_TIME:
                counts += count_texts(held, path)
                held, size = [], 0
        return pd.Series(counts + count_texts(held, path), dtype="int64")

    # Texts alone go to the workers: ids stay as they are, nulls among them too.
    text = F.coalesce(F.col("text"), F.lit(""))
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return made.withColumn("over_limit", F.col("n_tokens") > limit)
