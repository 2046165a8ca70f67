"""Whitening of embeddings from an exact scatter matrix in residue numbers.

Vectors become integers, floor(256 * c). Of the distinct ones (the fit list) Spark sums entries and products exactly: each partition takes its centred vectors modulo several primes
and multiplies them by floating-point GEMMs over so few rows that every product is exact; sums of residues meet in Spark, and Chinese remaindering gives
the integers. Centred means n * x - S, which needs no division. The covariance is then rounded once; eigh in doubles gives its eigenvectors, which two
refining steps in extended precision make exact to double precision even where eigenvalues differ by many orders of magnitude.

What reaches the driver is sums: the square of the dimension for each prime, whatever the number of rows.

A vector that is null or holds a null, NaN or infinite entry is dropped; a null vec_id stays. Equal vectors count once in the fit list, and each row has its own results; a hot vector
is merged before the exchange. Vectors shorter than the longest have zeros behind them. Entries beyond a 64-bit integer take its bound. A component without variance (fewer distinct vectors than
dimensions) has no whitened value (null); equal eigenvalues share their plane in the order that eigh gives. deviation is null where it exceeds a 64-bit integer. An empty table, or one of empty
vectors, gives an empty result. Further columns have no influence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netglean.llm.shared import forget, save

SCALE, COMPONENTS = 256, 4
#: Residues are below 2**20 in size, so products of ROWS of them add up below 2**53.
ROWS, MOST_PRIME = 1 << 13, 1 << 21
_BATCH = 1 << 22  # entries of the matrices that are worked on at once


def primes(bound: int) -> list[int]:
    """The greatest primes below MOST_PRIME whose product exceeds bound."""
    out, product, p = [], 1, MOST_PRIME - 1
    while product <= bound:
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def reconstruct(residues: list[int], moduli: list[int]) -> int:
    """The integer of least size with these residues."""
    x, m = 0, 1
    for r, p in zip(residues, moduli):
        x += m * ((r - x) * pow(m, -1, p) % p)
        m *= p
    return x - m if x > m // 2 else x


def _matrices(batches: Iterator[pa.RecordBatch], column: str, width: int, kind: type) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches in pieces, each with its vectors as one matrix, shorter ones filled up with zeros."""
    for b in batches:
        for at in range(0, b.num_rows, max(1, _BATCH // max(width, 1))):
            piece = b.slice(at, max(1, _BATCH // max(width, 1)))
            v = piece.column(column)
            size = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.zeros((len(size), width), kind)
            out[np.arange(width) < size[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
            yield piece, out


def integers(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding) with x, without the rows that can't be used."""
    c = F.col("embedding")
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.where(c.isNotNull() & ~F.coalesce(bad, F.lit(True))).select("vec_id", F.transform(c, lambda e: F.floor(e.cast("double") * SCALE)).alias("x"))


def _modular(x: np.ndarray, n: int, total: np.ndarray, p: int) -> np.ndarray:
    """n * x - total modulo p, by its residues of least size, as doubles."""
    y = ((n % p) * (x % p) - total) % p
    return np.where(y > p // 2, y - p, y).astype(np.float64)


def _summed(fit: DataFrame, width: int, moduli: list[int], centre: tuple[int, list[int]] | None) -> dict[tuple[int, int], list[int]]:
    """Sums over the fit list: without a centre of its vectors, as row 0; with one (n, S), of products of n * x - S, a row for each dimension. Each is reconstructed from residues."""
    residues = [[s % p for s in centre[1]] for p in moduli] if centre else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((width if centre else 1, width), np.int64) for _ in moduli]
        for _, x in _matrices(batches, "x", width, np.int64):
            for k, p in enumerate(moduli):
                if centre is None:
                    sums[k][0] = (sums[k][0] + (x % p).sum(axis=0)) % p
                    continue
                for at in range(0, len(x), ROWS):
                    y = _modular(x[at : at + ROWS], centre[0], np.array(residues[k], np.int64), p)
                    sums[k] = (sums[k] + (y.T @ y).astype(np.int64)) % p
        for k, s in enumerate(sums):
            i, j = np.nonzero(np.tri(len(s), width, dtype=bool).T if len(s) == width and centre else np.ones_like(s, bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], ["k", "i", "j", "r"])

    got: dict[tuple[int, int], list[int]] = {}
    for k, i, j, r in fit.mapInArrow(run, "k int, i int, j int, r long").groupBy("k", "i", "j").agg(F.sum("r").alias("r")).collect():  # width squared for each prime
        got.setdefault((i, j), [0] * len(moduli))[k] = r
    return {at: reconstruct([r % p for r, p in zip(rs, moduli)], moduli) for at, rs in got.items()}


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors as columns of a symmetric matrix in extended precision.

    eigh's vectors are refined twice: with X the vectors, R = I - X'X and S = X'VX, X gets the first-order correction of both, pairs of nearly equal eigenvalues only R's.
    """
    v = v.astype(np.longdouble)
    x = np.linalg.eigh(v.astype(np.float64))[1][:, ::-1].astype(np.longdouble)
    e = np.diag(x.T @ v @ x).copy()
    for _ in range(2):
        r, s = np.eye(len(v), dtype=np.longdouble) - x.T @ x, x.T @ v @ x
        e = np.diag(s) / (1 - np.diag(r))
        gap = e[None, :] - e[:, None]
        near = np.abs(gap) <= 1e-14 * np.abs(e).max(initial=0)
        fix = np.where(near, r / 2, (s + e[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ fix
        x /= np.sqrt((x * x).sum(axis=0))
    e = ((v @ x) * x).sum(axis=0)
    order = np.argsort(-e, kind="stable")
    return e[order], x[:, order]


@dataclass(frozen=True)
class Whitening:
    """A fitted model: number of distinct vectors, their sums, components (as columns), eigenvalues (falling) and the covariance's trace."""

    n: int
    total: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.values > 1e-17 * max(self.trace, 0) if len(self.values) else np.zeros(0, bool)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n as doubles; n * x - S is exact where it fits a 64-bit integer."""
        if max([0, *map(abs, self.total)]) + self.n * int(np.abs(x.astype(np.float64)).max(initial=0)) < 2**62:
            return (self.n * x - np.array(self.total, np.int64)) / self.n
        return x - np.array([s / self.n for s in self.total])

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(np.where(self.usable, self.values, np.nan))

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of (n * x - S)**2, exact; integers modulo 2**64 give it where it is below 2**63, and null stands elsewhere."""
        wrap = np.array([s % 2**64 for s in self.total], np.uint64)
        y = x.astype(np.uint64) * np.uint64(self.n % 2**64) - wrap
        rough = (self.n * x.astype(np.float64) - np.array(self.total, np.float64)) ** 2
        return pa.array((y * y).sum(axis=1, dtype=np.uint64).astype(np.int64), mask=rough.sum(axis=1) >= 2.0**63 * (1 - 1e-9))


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The model of distinct vectors x; None without any."""
    n, most = distinct.agg(F.count("*"), F.max(F.array_max(F.transform("x", lambda e: F.abs(e.cast("decimal(20,0)")))))).first()
    if not n or not width:
        return None
    most = int(most or 0)
    total = _summed(distinct, width, primes(2 * n * most), None)
    total = [total[0, j] for j in range(width)]
    found = _summed(distinct, width, primes(2 * n * (2 * n * most) ** 2), (n, total))
    scatter = np.empty((width, width), np.longdouble)
    for (i, j), s in found.items():
        q, r = divmod(s, n**3)  # the covariance is the scatter of n * x - S over n**3
        scatter[i, j] = scatter[j, i] = np.longdouble(q) + np.longdouble(r / n**3)
    e, u = eigen(scatter)
    few = min(components, width)
    return Whitening(n, total, u[:, :few].astype(np.float64), e[:few].astype(np.float64), float(np.trace(scatter)))


def identity_error(distinct: DataFrame, model: Whitening, width: int) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the identity, in size. Each batch is centred by its own mean before it is multiplied, and batches are merged about their common mean."""
    keep = np.flatnonzero(model.usable)
    if not len(keep):
        return None

    def merged(a: tuple | None, b: tuple) -> tuple:
        if a is None:
            return b
        n, d = a[0] + b[0], b[1] - a[1]
        return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for _, x in _matrices(batches, "x", width, np.int64):
            w = model.project(x)[:, keep]
            mean = w.mean(axis=0)
            state = merged(state, (len(w), mean, (w - mean).T @ (w - mean)))
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([state[0]]), pa.array([state[1].tolist()]), pa.array([state[2].ravel().tolist()])], ["n", "mean", "scatter"])

    state = None
    for r in distinct.mapInArrow(run, "n long, mean array<double>, scatter array<double>").collect():  # a row for each partition
        state = merged(state, (r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(len(keep), -1)))
    return float(np.abs(state[2] / state[0] - np.eye(len(keep))).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For each usable row of vectors (vec_id, embedding) and component: vec_id, component, n, deviation, whitened, explained and identity_error."""
    rows = integers(vectors)
    distinct = save(rows.groupBy("x").agg(F.lit(1).alias("_one")).select("x"), "whitening-fit")
    width = distinct.agg(F.max(F.size("x"))).first()[0] or 0
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = out.replace("vec_id long", f"vec_id {rows.schema['vec_id'].dataType.simpleString()}")
    model = fit(distinct, width, components)
    if model is None:
        forget(distinct)
        return vectors.sparkSession.createDataFrame([], out)
    error = identity_error(distinct, model, width)
    forget(distinct)
    explained = (model.values / model.trace).tolist() if model.trace > 0 else [None] * len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = len(model.values)
        for b, x in _matrices(batches, "x", width, np.int64):
            at = pa.array(np.repeat(np.arange(len(x)), few))
            w = model.project(x).ravel()
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, few + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), model.n)), model.deviation(x).take(at), pa.array(w, mask=np.isnan(w)), pa.array(explained * len(x), pa.float64()), pa.array([error] * len(at), pa.float64())], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, out)
