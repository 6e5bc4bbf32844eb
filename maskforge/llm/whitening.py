"""Embedding whitening: blockwise QR, Householder bidiagonalisation, dqds and twisted factorisations.

Entries become fixed-point integers, so sums and deviations are exact.  Centred rows are reduced to
one triangular factor R: every task factorises its rows in blocks, then factors are combined in
groups of ``FAN`` tasks until one is left.  R is brought to upper bidiagonal form by Householder
reflections; dqds finds the squared singular values, which are the eigenvalues of the covariance
times the number of rows; twisted factorisations of B'B give the eigenvectors, and the reflections
carry them back.  Only R, with as many rows as a vector has entries, reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskforge.llm.common import ready, staged

SCALE, OFFSET = 1024, 100000
COMPONENTS = 8
#: triangular factors that one task combines
FAN = 16
#: entries at or beyond this have no exact fixed-point form; their vectors are dropped like infinite ones
LARGEST = float(1 << 40)
#: eigenvalues nearer than this, relatively, form a cluster whose vectors are made orthogonal
CLUSTER = 1e-3
EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    """Fit of ``n`` rows: integer sums, eigenvalues (falling), unit vectors (one per row) and trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None


# --- dense kernels -----------------------------------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal ``a`` and superdiagonal ``b`` of B and the orthogonal V with R = U B V'."""
    r = r.copy()
    d = len(r)
    v = np.eye(d)

    def reflector(x):
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            return None
        w = x.copy()
        w[0] += math.copysign(norm, w[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        w = reflector(r[k:, k])
        if w is not None:
            r[k:, k:] -= 2 * np.outer(w, w @ r[k:, k:])
        if k < d - 2:
            w = reflector(r[k, k + 1:])
            if w is not None:
                r[k:, k + 1:] -= 2 * np.outer(r[k:, k + 1:] @ w, w)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(r).copy(), np.diag(r, 1).copy(), v


def _shifted(q: list[float], e: list[float], s: float) -> tuple[list[float], list[float], float] | None:
    """One dqds transform with shift ``s`` and its least d; None where the shift is too large."""
    qq, ee = [0.0] * len(q), [0.0] * len(e)
    d = least = q[0] - s
    for i in range(len(e)):
        if d < 0:
            return None
        qq[i] = d + e[i]
        t = q[i + 1] / qq[i]
        ee[i] = e[i] * t
        d = d * t - s
        least = min(least, d)
    if d < 0:
        return None
    qq[-1] = d
    return qq, ee, least


def _trailing(q: list[float], e: list[float]) -> float:
    """Smaller eigenvalue of the trailing two by two block of B'B."""
    x, y, z = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
    half = (x + y) / 2
    return max((x * y - z) / (half + math.sqrt(max((x - y) ** 2 / 4 + z, 0.0))) if half else 0.0, 0.0)


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling, each to high relative accuracy."""
    blocks = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    found = []
    while blocks:
        q, e, sigma = blocks.pop()
        if len(q) == 1:
            found.append(q[0] + sigma)
            continue
        if q[0] < q[-1]:  # the same singular values, graded the way the shifts want
            q, e = q[::-1], e[::-1]
        guess = None
        for turn in range(200 * len(q)):
            small = [i for i, x in enumerate(e) if x <= EPS * EPS * (sigma + min(q[i], q[i + 1])) or x < 1e-290]
            if small:
                i = small[-1]
                blocks.append((q[:i + 1], e[:i], sigma))
                blocks.append((q[i + 1:], e[i + 1:], sigma))
                break
            s = _trailing(q, e) if guess is None else guess
            step = None
            for _ in range(4):
                if s <= EPS * sigma:
                    break
                step = _shifted(q, e, s * (1 - 4 * EPS))
                if step is not None:
                    s *= 1 - 4 * EPS
                    break
                s /= 4
            if step is None:
                s = 0.0
                step = _shifted(q, e, 0.0)
            q, e, least = step
            sigma += s
            guess = None if turn % 2 == 0 else min(least, _trailing(q, e))
        else:
            raise RuntimeError("dqds did not converge")
    return np.sort(np.array(found))[::-1]


class Twisted:
    """Twisted factorisation of B'B - value * I at the place where its pivot is least."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float):
        n = len(a)
        q, e, x = a * a, b * b, a[:-1] * b
        tiny = max(EPS * EPS * (np.max(q) + value), 1e-300)
        s, plus, self.down = np.empty(n), np.empty(n), np.empty(max(n - 1, 0))
        s[0] = -value
        for i in range(n):
            plus[i] = s[i] + q[i] or tiny
            if i < n - 1:
                self.down[i] = x[i] / plus[i]
                s[i + 1] = e[i] * s[i] / plus[i] - value
        p, minus, self.up = np.empty(n), np.empty(n), np.empty(max(n - 1, 0))
        p[-1] = q[-1] - value
        for i in range(n - 2, -1, -1):
            minus[i + 1] = e[i] + p[i + 1] or tiny
            self.up[i] = x[i] / minus[i + 1]
            p[i] = p[i + 1] * q[i] / minus[i + 1] - value
        gamma = s + p + value
        gamma[~np.isfinite(gamma)] = np.inf
        self.k = int(np.argmin(np.abs(gamma)))
        self.pivots = np.r_[plus[:self.k], gamma[self.k] or tiny, minus[self.k + 1:]]

    def _back(self, w: np.ndarray) -> np.ndarray:
        z = w.copy()
        for i in range(self.k - 1, -1, -1):
            z[i] -= self.down[i] * z[i + 1]
        for i in range(self.k, len(w) - 1):
            z[i + 1] -= self.up[i] * z[i]
        return z / np.linalg.norm(z)

    def vector(self) -> np.ndarray:
        w = np.zeros(len(self.pivots))
        w[self.k] = 1
        return self._back(w)

    def solve(self, r: np.ndarray) -> np.ndarray:
        """Direction of (B'B - value * I)^-1 r: a step of inverse iteration."""
        w = r.copy()
        k, n = self.k, len(r)
        for i in range(1, k + 1):
            w[i] -= self.down[i - 1] * w[i - 1]
        for i in range(n - 2, k, -1):
            w[i] -= self.up[i] * w[i + 1]
        if k < n - 1:
            w[k] -= self.up[k] * w[k + 1]
        return self._back(w / self.pivots)


def leading_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B'B, a row for each of the leading ``values``.

    Values of a cluster share their space: each next vector is made orthogonal to the cluster's
    earlier ones, from an inverse iteration where little of it is left.
    """
    out: list[np.ndarray] = []
    begin = 0
    rng = np.random.default_rng(0)
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * values[j - 1]:
            begin = j
        twisted = Twisted(a, b, float(value))
        z = twisted.vector()

        def rest(v):
            for _ in range(2):
                for u in out[begin:]:
                    v = v - (u @ v) * u
            return v

        for _ in range(8):
            left = rest(z)
            norm = np.linalg.norm(left)
            if norm > 0.5 or not np.isfinite(norm):
                break
            start = rest(rng.standard_normal(len(a)))
            z = twisted.solve(rest(twisted.solve(start / np.linalg.norm(start))))
        out.append(left / norm)
    return np.array(out).reshape(len(values), len(a))


def triangle(*rows: np.ndarray) -> np.ndarray:
    """Square triangular factor of stacked rows."""
    r = np.linalg.qr(np.vstack(rows), mode="r")
    out = np.zeros((r.shape[1], r.shape[1]))
    out[:len(r)] = r[:r.shape[1]]
    return out


# --- tables ------------------------------------------------------------------------------

def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """``(id, v ARRAY<DOUBLE>)`` of vectors without null, non-finite or over-large entries and with
    the commonest length (of equals the longer), and that length (0: none)."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(good, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = length[0]["d"] if length else 0
    return rows.where(F.size("v") == d), d


def _fixed(column: pa.Array, d: int) -> np.ndarray:
    """Fixed-point rows of a batch."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(SCALE * c).astype(np.int64) + OFFSET


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, from whole and broken part of the means."""
    whole = np.array([s // n for s in sums], np.int64)
    broken = np.array([(s % n) / n for s in sums])
    return (x - whole) - broken


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over entries of (n * x - sums)^2, exact; null where it has more than 38 digits."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    off = x - whole
    most = int(np.abs(off).max(initial=0)) + 1
    if (most * n) ** 2 * len(sums) < 1 << 63:
        return pa.array(((n * off - rest) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = [sum((n * o - r) ** 2 for o, r in zip(row, rest.tolist())) for row in off.tolist()]
    return pa.array([Decimal(v) if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0))


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = _fixed(batch["v"], d)
            n += len(x)
            high, low = (x >> 20).sum(axis=0), (x & 0xFFFFF).sum(axis=0)
            total = [t + (int(h) << 20) + int(l) for t, h, l in zip(total, high, low)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
                 pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["k", "n", "s"])

    parts = rows.select("v").mapInArrow(run, "k int, n bigint, s decimal(38,0)")
    got = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    by_entry = {r["k"]: r for r in got}  # one row for each entry of a vector
    return (by_entry[0]["n"] if got else 0), [int(by_entry[k]["s"]) for k in range(d)] if got else []


def _factor(rows: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """Triangular factor of all centred rows, combined ``FAN`` at a time."""
    def packed(r):
        return pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["r"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            if batch.num_rows:
                r = triangle(r, _centred(_fixed(batch["v"], d), n, sums))
        if len(r):
            yield packed(r)

    def of_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for k in range(batch.num_rows):
                r = triangle(r, batch["r"][k].values.to_numpy().reshape(d, d))
        if len(r):
            yield packed(r)

    factors = staged(rows.select("v").mapInArrow(of_rows, "r array<double>"), "whitening-factors")
    left = factors.count()
    while left > 1:
        width = -(-left // FAN)
        factors = staged(factors.repartition(width).mapInArrow(of_factors, "r array<double>"), "whitening-factors")
        left = min(width, factors.count())
    return np.array(factors.first()["r"]).reshape(d, d)


def _identity_error(rows: DataFrame, d: int, fit: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity."""
    m = len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((m, m)), np.zeros(m)
        for batch in batches:
            w = _whitened(_fixed(batch["v"], d), fit)
            total += w.T @ w
            first += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(m * m + m), pa.int32()), pa.array(np.r_[total.ravel(), first])],
                                         ["k", "s"])

    got = rows.select("v").mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    flat = np.zeros(m * m + m)
    for r in got:
        flat[r["k"]] = r["s"]
    mean = flat[m * m:] / fit.n
    return float(np.abs(flat[:m * m].reshape(m, m) / fit.n - np.outer(mean, mean) - np.eye(m)).max(initial=0))


def _whitened(x: np.ndarray, fit: Whitening) -> np.ndarray:
    return _centred(x, fit.n, fit.sums) @ fit.vectors.T / np.sqrt(fit.values)


def fit_whitening(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit over ``usable`` rows; None without any.  Components whose variance is zero to working
    precision are left out, so there may be fewer than ``components``."""
    if not d:
        return None
    n, sums = _sums(rows, d)
    r = _factor(rows, d, n, sums)
    scale = float(np.abs(r).max(initial=0))
    if scale == 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((0, d)), 0.0, 0.0)
    a, b, v = bidiagonal(r / scale)
    squares = dqds(a, b)
    rank = int((np.sqrt(squares) > 8 * d * EPS * math.sqrt(squares[0])).sum())
    squares = squares[:min(rank, components)]
    found = leading_vectors(a, b, squares) @ v.T
    found *= np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])[:, None]
    fit = Whitening(n, sums, squares * scale * scale / n, found, float(((r / scale) ** 2).sum()) * scale * scale / n)
    fit.identity_error = _identity_error(rows, d, fit)
    return fit


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                        components: int = COMPONENTS) -> DataFrame:
    """Per usable vector and component: ``vec_id, component, n, deviation, whitened, explained,
    identity_error``.

    Dropped: null and empty vectors, those with null, non-finite or over-large entries, and those
    that have not the commonest length.  Repeated rows count and are returned again; null ids stay.
    An empty table, or rows that are all equal, give no rows.
    """
    spark = ready(vectors)
    rows, d = usable(vectors, id_col, vec_col)
    kind = rows.schema["id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    fit = fit_whitening(rows, d, components)
    if fit is None or not len(fit.values):
        return spark.createDataFrame([], schema)
    m = len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _fixed(batch["v"], d)
            k = len(x)
            each = pa.array(np.repeat(np.arange(k), m))
            yield pa.RecordBatch.from_arrays([
                batch["id"].take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                pa.array(np.full(k * m, fit.n)), _deviation(x, fit.n, fit.sums).take(each),
                pa.array(_whitened(x, fit).ravel()), pa.array(np.tile(fit.values / fit.trace, k)),
                pa.array(np.full(k * m, fit.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
