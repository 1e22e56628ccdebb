"""Whitening of embeddings by a Chebyshev-filtered subspace iteration.

Vectors become integers x = floor(scale * c) + shift. The fit list holds each distinct x vector once; the covariance V = X'X / n
of its centred vectors is never formed. A pass multiplies it with a block Q: every task centres its vectors, multiplies them
with Q and back, and the partial sums (dimensions by block) are added up over the tasks. One step of the iteration applies to the
block a Chebyshev polynomial of V that is small on the unwanted part of the spectrum, [0, smallest Ritz value], by the three-term
recurrence, one pass a degree; QR and Rayleigh-Ritz follow. It ends when the residuals |VQ - Q theta| of all wanted components are
at rounding level and a fresh random block, filtered in the same way and kept orthogonal to the found ones, shows no larger
eigenvalue than theirs.

The fit list is stored as blocks of packed integers, so that a pass reads numbers and not rows. What comes to the driver is as large
as the dimensions by the block, whatever the number of vectors.

Edge cases: rows whose vector is null, is empty, or holds null or non-finite entries are dropped, and those whose vector has not
the commonest length (of equally common lengths the largest stays); repeated rows and null or repeated ids are rows like others; an
empty table gives an empty result; other columns of the input are ignored. A component whose variance is zero beside the largest
(below RANK of it) cannot be scaled and is left out, so a fit list of one vector gives no rows. Deviations beyond a long are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COMPONENTS = 16
#: Vectors beside the wanted ones in a block: the spectrum behind them is what the filter must damp.
GUARD = 12
DEGREE = 16
#: How much more a filter may lift the first wanted component than the last; beyond it the first drowns the others in rounding.
LIFT = 1e8
#: Steps at most; without certificate the last step's pairs are an error, not a result.
STEPS = 60
#: Residuals beside the largest eigenvalue.
RESIDUAL = 2e-14
RANK = 1e-12
#: Fixed by the query's contract: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries from here on do not fit a long with the shift; rows that hold such are dropped like those with infinities.
MOST = 2.0**62
#: Vectors in a packed block.
BLOCK_ROWS = 4096


class Fit(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # dimensions by components
    trace: float
    identity_error: float
    passes: int


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows (all columns of rows, and x, an array of longs) whose vector has only finite entries and the commonest length."""
    c = F.col(vector)
    # NaN is larger than any number.
    fine = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & (F.abs(v.cast("double")) * SCALE < MOST))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long") + SHIFT)
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("x", x)


def dimension(found: DataFrame) -> int:
    top = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def packed(found: DataFrame, d: int) -> DataFrame:
    """The distinct x vectors in blocks: n, block (n by d little-endian longs)."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), BLOCK_ROWS):
                part = np.stack(f["x"].to_numpy()[at : at + BLOCK_ROWS]).astype("<i8")
                yield pd.DataFrame({"n": [len(part)], "block": [part.tobytes()]})

    return found.where(F.size("x") == d).select("x").distinct().mapInPandas(pack, "n long, block binary")


def unpack(block: bytes, d: int) -> np.ndarray:
    return np.frombuffer(block, "<i8").reshape(-1, d)


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: as longs where these suffice, else as Python's integers."""
    if n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums)) < 1 << 63:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, rounded once or twice: n*x - S is exact."""
    return offsets(x, n, sums).astype(np.float64) / n


def summed(blocks: DataFrame, d: int, k: int, of) -> np.ndarray:
    """The sum of of(block), d by k numbers, over all blocks: one partial sum a task, added element by element."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, k))
        for f in frames:
            for block in f["block"]:
                total += of(block)
        yield pd.DataFrame({"i": np.arange(d * k, dtype=np.int32), "v": total.ravel()})

    sums = blocks.select("block").mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(d * k)
    for row in sums.collect():  # d by k rows, whatever the input
        out[row["i"]] = row["v"]
    return out.reshape(d, k)


class Covariance:
    """V of a stored fit list, as a product with a block."""

    def __init__(self, blocks: DataFrame, d: int):
        self.blocks, self.d, self.passes = blocks, d, 0

        def integer_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for block in f["block"]:
                    x = unpack(block, d)
                    high = (x >> 31).sum(axis=0).tolist(), (x & (1 << 31) - 1).sum(axis=0).tolist()  # neither can overflow
                    yield pd.DataFrame({"i": np.arange(d, dtype=np.int32), "v": [str((a << 31) + b) for a, b in zip(*high)]})

        self.n = blocks.agg(F.sum("n")).first()[0] or 0
        by = blocks.select("block").mapInPandas(integer_sums, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        found = {r["i"]: int(r["v"]) for r in by.collect()}
        self.sums = [found.get(i, 0) for i in range(d)]

    def worker(self):
        """What a task needs to centre blocks, without the session."""
        n, sums, d = self.n, self.sums, self.d
        return lambda block: centred(unpack(block, d), n, sums)

    def trace(self) -> float:
        centre = self.worker()
        return float(summed(self.blocks, self.d, 1, lambda b: (centre(b) ** 2).sum(axis=0)[:, None]).sum()) / self.n

    def times(self, q: np.ndarray) -> np.ndarray:
        self.passes += 1
        centre = self.worker()

        def of(block: bytes) -> np.ndarray:
            x = centre(block)
            return x.T @ (x @ q)

        return summed(self.blocks, self.d, q.shape[1], of) / self.n


def filtered(v: Covariance, q: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V, times q: at most one on [0, cut], growing above; scaled so that it stays near one at top."""
    e = cut / 2
    sigma = e / (top - e)
    tau, before = 2 / sigma, q
    now = (v.times(q) - e * q) * (sigma / e)
    for _ in range(1, degree):
        after = 1 / (tau - sigma)
        now, before = (v.times(now) - e * now) * (2 * after / e) - before * (sigma * after), now
        sigma = after
    return now


def degree(first: float, last: float, cut: float) -> int:
    """The highest degree up to DEGREE that lifts `first` no more than LIFT times as much as `last`: T_m(x) grows as cosh(m acosh x)."""
    apart = np.arccosh(2 * first / cut - 1) - np.arccosh(2 * last / cut - 1)
    return DEGREE if apart * DEGREE <= np.log(LIFT) else max(1, int(np.log(LIFT) / apart))


def rayleigh_ritz(v: Covariance, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, their vectors, and their residuals."""
    w = v.times(q)
    values, turn = np.linalg.eigh((q.T @ w + w.T @ q) / 2)
    order = np.argsort(-values)
    values, turn = values[order], turn[:, order]
    q, w = q @ turn, w @ turn
    return values, q, np.linalg.norm(w - q * values, axis=0)


def eigenpairs(v: Covariance, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenpairs of V, certified."""
    d, rng = v.d, np.random.default_rng(12)
    k = min(components, d)
    size = min(d, k + GUARD)
    orthogonal = lambda y: np.linalg.qr(y)[0]
    values, q, residual = rayleigh_ritz(v, orthogonal(rng.standard_normal((d, size))))
    for _ in range(STEPS):
        if values[0] <= 0 or size == d:  # no variance, or the block is the whole space and the first step was exact
            break
        # Pairs at zero beside the first have no direction of their own to converge to: they are left out of the result.
        settled = (residual <= RESIDUAL * values[0]) | (values <= RANK * values[0])
        if settled[:k].all() and unmissed(v, values, q[:, :k], k, rng):
            break
        cut = max(values[-1], 1e-3 * values[k - 1], 1e-9 * values[0])
        cut = min(cut, 0.999 * values[0])
        y = filtered(v, q, cut, values[0], degree(values[0], max(values[k - 1], cut), cut))
        values, q, residual = rayleigh_ritz(v, orthogonal(orthogonal(y / np.linalg.norm(y, axis=0))))
    else:
        raise ArithmeticError(f"no certificate after {STEPS} steps: residuals {residual[:k] / values[0]}")
    return values[:k], q[:, :k]


def unmissed(v: Covariance, values: np.ndarray, found: np.ndarray, k: int, rng: np.random.Generator) -> bool:
    """Whether a fresh block, filtered beside the found vectors, shows nothing above the last of them."""
    out = lambda y: y - found @ (found.T @ y)
    fresh = np.linalg.qr(out(rng.standard_normal((v.d, min(4, v.d - k)))))[0]
    cut = min(max(values[k - 1], 1e-9 * values[0]), 0.999 * values[0])
    probe = np.linalg.qr(out(filtered(v, fresh, cut, values[0], degree(values[0], values[k - 1], cut))))[0]
    top = rayleigh_ritz(v, probe)[0][0]
    return top <= values[k - 1] + 1e-9 * values[0]


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """The whitening of the distinct vectors of rows; None where there are none."""
    common.prepare(rows.sparkSession)
    return fit_usable(usable(rows, vector), components)


def fit_usable(found: DataFrame, components: int) -> Fit | None:
    d = dimension(found)
    if not d:
        return None
    blocks = common.materialise(packed(found, d), "whitening-blocks")
    v = Covariance(blocks, d)
    values, vectors = eigenpairs(v, components)
    some = values > RANK * max(values[0], 0) if values[0] > 0 else np.zeros(len(values), bool)
    values, vectors = values[some], vectors[:, some]
    return Fit(v.n, v.sums, values, vectors, v.trace(), identity_error(v, values, vectors), v.passes)


def identity_error(v: Covariance, values: np.ndarray, vectors: np.ndarray) -> float:
    """The largest entry of whitened's covariance beside the identity: its mean first, then the centred products."""
    k = len(values)
    if not k:
        return 0.0
    centre, turn = v.worker(), vectors / np.sqrt(values)
    mean = summed(v.blocks, k, 1, lambda b: (centre(b) @ turn).sum(axis=0)[:, None])[:, 0] / v.n

    def products(block: bytes) -> np.ndarray:
        w = centre(block) @ turn - mean
        return w.T @ w

    return float(np.abs(summed(v.blocks, k, k, products) / v.n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n*x - S)^2; None beyond a long."""
    off = offsets(x, n, sums)
    if off.dtype != object and float(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
        return (off * off).sum(axis=1).tolist()
    exact = [sum(int(a) * int(a) for a in row) for row in off]
    return [e if e < 1 << 63 else None for e in exact]


OUT = "vec_id string, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(found: DataFrame, made: Fit, vec_id: str) -> DataFrame:
    """A row for each row of found and each component."""
    d, k = len(made.sums), len(made.values)
    n, sums, error = made.n, made.sums, made.identity_error
    turn, explained = made.vectors / np.sqrt(made.values), made.values / made.trace

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), BLOCK_ROWS):
                part = f.iloc[at : at + BLOCK_ROWS]
                x = np.stack(part["x"].to_numpy()).astype(np.int64)
                rows = len(x)
                yield pd.DataFrame(
                    {
                        "vec_id": np.repeat(part["vec_id"].to_numpy(), k),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows),
                        "n": n,
                        "deviation": pd.array(np.repeat(np.array(deviations(x, n, sums), object), k), "Int64"),
                        "whitened": (centred(x, n, sums) @ turn).ravel(),
                        "explained": np.tile(explained, rows),
                        "identity_error": error,
                    }
                )

    rows = found.where(F.size("x") == d).select(F.col(vec_id).cast("string").alias("vec_id"), "x")
    return rows.mapInPandas(project, OUT)


def whiten(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    common.prepare(rows.sparkSession)
    kind = rows.schema[vec_id].dataType
    found = usable(rows.select(vec_id, vector), vector)
    made = fit_usable(found, components)
    if made is None or not len(made.values):
        return rows.sparkSession.createDataFrame([], OUT).withColumn("vec_id", F.col("vec_id").cast(kind))
    return whitened(found, made, vec_id).withColumn("vec_id", F.col("vec_id").cast(kind))
