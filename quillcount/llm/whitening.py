"""Embedding whitening: streamed Welford moments, merged over partitions, and a symmetric QR eigen-solve.

Entries become integers, floor(256 * c). Each task streams the distinct vectors
and keeps a count, exact sums, a mean and the sum of outer products of
deviations, to which every vector adds one rank-one update; states of tasks are
merged by the parallel update formula in rounds of fixed fan-in, so what one
task or the driver holds is one state, however many partitions there are. The
covariance is made tridiagonal by reflections and diagonal by implicitly
shifted QR steps. Rows are whitened in a last pass without a shuffle.

Defined results: rows whose vector is null or empty or holds null, non-finite
or, times 256, out-of-range entries go, as do vectors shorter than the longest,
which count as holding nulls; repeated vectors are fitted once and returned for
each row; null and repeated ids are rows like others; other columns are not
read; an empty table, or one without a usable vector, gives an empty table. A
component without variance (beyond the rank of the fit list) has whitened 0.0
on every row and is left out of identity_error; ties between eigenvalues are in
an order that is the same for all rows. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType

from .common import configured, discard, fresh, staged, table

SCALE = 256
#: Components that the query returns.
COMPONENTS = 4
#: Columns that whitening adds.
ADDED = ("component", "n", "deviation", "whitened", "explained", "identity_error")
#: States that one task merges.
FAN_IN = 32
_STATE = "n long, sums array<string>, mean array<double>, scatter array<double>"


class Moments:
    """Count, exact sums, mean and scatter (sum of outer products of deviations) of a stream of vectors."""

    def __init__(self, width: int):
        self.n, self.sums = 0, [0] * width
        self.mean, self.scatter = np.zeros(width), np.zeros((width, width))
        self._buffer = np.empty((width, width))

    def add(self, rows: np.ndarray) -> None:
        """One rank-one update for each row."""
        for x in rows:
            self.n += 1
            delta = x - self.mean
            self.mean += delta / self.n
            np.multiply.outer(delta, delta * ((self.n - 1) / self.n), out=self._buffer)
            self.scatter += self._buffer

    def add_exactly(self, rows: np.ndarray) -> None:
        """As ``add``, for integers, with their sums in full."""
        high, low = (rows >> 32).sum(axis=0), (rows & 0xFFFFFFFF).sum(axis=0)
        self.sums = [s + (int(h) << 32) + int(x) for s, h, x in zip(self.sums, high, low, strict=True)]
        self.add(rows.astype(float))

    def merge(self, other: Moments) -> None:
        """The parallel update formula."""
        n = self.n + other.n
        if not other.n:
            return
        delta = other.mean - self.mean
        self.mean = self.mean + delta * (other.n / n)
        self.scatter = self.scatter + other.scatter + np.multiply.outer(delta, delta) * (self.n * other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    def batch(self) -> pa.RecordBatch:
        row = {"n": self.n, "sums": [str(s) for s in self.sums], "mean": self.mean.tolist(), "scatter": self.scatter.ravel().tolist()}
        return pa.RecordBatch.from_pylist([row], schema=_ARROW_STATE)

    @classmethod
    def of(cls, row: dict) -> Moments:
        out = cls(len(row["mean"]))
        out.n, out.sums = row["n"], [int(s) for s in row["sums"]]
        out.mean, out.scatter = np.array(row["mean"]), np.array(row["scatter"]).reshape(len(row["mean"]), -1)
        return out


_ARROW_STATE = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.list_(pa.float64())), ("scatter", pa.list_(pa.float64()))])


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(vectors: DataFrame, column: str, width: int, exact: bool) -> Moments:
    """Moments of a column of equally long vectors; the driver gets one state."""

    def stream(batches):
        state = Moments(width)
        for batch in batches:
            (state.add_exactly if exact else state.add)(_matrix(batch.column(0)))
        if state.n:
            yield state.batch()

    def merge(batches):
        state = Moments(width)
        for batch in batches:
            for row in batch.to_pylist():
                state.merge(Moments.of(row))
        if state.n:
            yield state.batch()

    states = staged(vectors.select(column).mapInArrow(stream, _STATE), "whitening-states")
    left = states.count()
    while left > 1:
        after = math.ceil(left / FAN_IN)
        merged = staged(states.repartition(after).mapInArrow(merge, _STATE), "whitening-states")
        discard(states)
        states, left = merged, merged.count()
    rows = states.collect()
    discard(states)
    return Moments.of(rows[0].asDict()) if rows else Moments(width)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and orthogonal q with a = q t q', by reflections."""
    a, n = np.array(a, dtype=float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if not np.any(x[1:]) or size == 0:
            continue
        v = x.copy()
        v[0] += math.copysign(size, x[0])
        v /= np.linalg.norm(v)
        part = a[k + 1 :, k + 1 :]
        p = part @ v
        w = 2 * (p - (v @ p) * v)
        part -= np.multiply.outer(v, w) + np.multiply.outer(w, v)
        a[k + 1, k] = a[k, k + 1] = -math.copysign(size, x[0])
        a[k + 2 :, k] = a[k, k + 2 :] = 0.0
        q[:, k + 1 :] -= np.multiply.outer(q[:, k + 1 :] @ v, 2 * v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Implicit QR steps with Wilkinson's shift chase a bulge down the part of the
    tridiagonal matrix that is not split yet; an entry beside the diagonal that
    rounding would lose is set to zero and splits it.
    """
    n = len(a)
    d, e, q = tridiagonal(a)
    rows = np.ascontiguousarray(q.T)  # an eigenvector to a row, so that rotations touch whole rows
    hi, left = n - 1, steps * max(n, 1)
    while hi > 0:
        small = np.abs(e[:hi]) <= np.finfo(float).eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if e[hi - 1] == 0.0:
            hi -= 1
            continue
        split = np.flatnonzero(e[: hi - 1] == 0.0)
        lo = int(split[-1]) + 1 if len(split) else 0
        left -= 1
        if left < 0:
            raise ArithmeticError("the QR iteration does not converge")
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            rows[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ rows[[k, k + 1]]
    order = np.argsort(-d, kind="stable")
    return d[order], rows[order].T


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: exact count and sums, eigenvalues and eigenvectors of the covariance."""

    n: int
    sums: tuple
    values: np.ndarray
    vectors: np.ndarray  # a component to a column
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def scales(self, components: int) -> np.ndarray:
        """1 / sqrt(e) of the first components; 0 where rounding hides whether there is any variance."""
        e = self.values[:components]
        floor = max(self.width, 1) * np.finfo(float).eps * max(self.values[0] if len(self.values) else 0.0, 0.0)
        return np.where(e > floor, 1 / np.sqrt(np.where(e > floor, e, 1.0)), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in double precision, exact while it fits 53 bits."""
        if self._narrow(x):
            return (self.n * x - np.array(self.sums, dtype=np.int64)).astype(float)
        return np.array([[float(self.n * int(v) - s) for v, s in zip(row, self.sums, strict=True)] for row in x]).reshape(x.shape)

    def _narrow(self, x: np.ndarray) -> bool:
        largest = max(int(np.abs(x).max(initial=0)), 1) if x.size else 1
        return self.n * largest + max((abs(s) for s in self.sums), default=0) < 2**62

    def deviation(self, x: np.ndarray) -> list:
        """Sums of (n * x - S)^2, exact; null beyond 64 bits."""
        rough = (self.centred(x) ** 2).sum(axis=1)
        if rough.max(initial=0.0) < 2.0**62 and self._narrow(x):
            off = self.n * x - np.array(self.sums, dtype=np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v < 2**63 else None for v in exact]

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        return (self.centred(x) / self.n) @ self.vectors[:, :components] * self.scales(components)


def quantised(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``, floor(256 * c) of each entry as array<long>, without rows that have none."""
    v = F.col(column).cast("array<double>")
    scaled = F.transform(v, lambda c: F.floor(c * F.lit(float(SCALE))).cast("long"))
    most = F.lit(float(2**62))
    usable = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c * F.lit(float(SCALE))) < most), F.lit(False)))
    return df.where(v.isNotNull() & (F.size(v) > 0) & usable).withColumn(out, scaled)


def fit(distinct: DataFrame, width: int) -> Whitening:
    """Fit on a table of one column of array<long>, all ``width`` long."""
    m = moments(distinct, distinct.columns[0], width, exact=True)
    covariance = m.scatter / max(m.n, 1)
    values, vectors = symmetric_qr((covariance + covariance.T) / 2)
    return Whitening(m.n, tuple(m.sums), values, vectors, float(np.trace(covariance)))


def identity_error(distinct: DataFrame, model: Whitening, components: int) -> float:
    """Largest entry of the covariance of whitened distinct vectors minus the identity, over components with variance."""
    live = np.flatnonzero(model.scales(components))
    if not len(live):
        return 0.0

    def run(batches):
        for batch in batches:
            w = model.whitened(_matrix(batch.column(0)), components)[:, live]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))], names=["w"])

    m = moments(distinct.mapInArrow(run, "w array<double>"), "w", len(live), exact=False)
    return float(np.abs(m.scatter / m.n - np.eye(len(live))).max())


def whitened(df: DataFrame, column: str, components: int | None = None) -> DataFrame:
    """Usable rows of ``df``, a row to a component: its other columns, then ``ADDED``.

    Without ``components``, all of them are returned. Columns of ``df`` that have a name of ``ADDED`` are left out.
    """
    spark = configured(df.sparkSession)
    keep = [c for c in df.columns if c != column and c.lower() not in ADDED]
    x = fresh(df, "x")
    rows = quantised(df, column, x)
    distinct = staged(rows.select(x).distinct(), "whitening-distinct")
    width = distinct.agg(F.max(F.size(x)).alias("w")).collect()[0]["w"] or 0
    schema = df.select(*keep).schema
    for name, kind in zip(ADDED, (IntegerType(), LongType(), LongType(), DoubleType(), DoubleType(), DoubleType()), strict=True):
        schema = schema.add(name, kind)
    if not width:
        discard(distinct)
        return spark.createDataFrame([], schema)
    full = distinct.where(F.size(x) == width)
    model = fit(full, width)
    k = min(components or width, width)
    error = identity_error(full, model, k)
    discard(distinct)
    share = [float(max(e, 0.0) / model.trace) if model.trace > 0 else 0.0 for e in model.values[:k]]

    def run(batches):
        for batch in batches:
            v = _matrix(batch.column(len(keep)))
            n = len(v)
            at = pa.array(np.repeat(np.arange(n), k))
            columns = [batch.column(i).take(at) for i in range(len(keep))]
            columns += [
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n, dtype=np.int64)), pa.array(model.deviation(v), pa.int64()).take(at),
                pa.array(model.whitened(v, k).ravel()), pa.array(np.tile(share, n)), pa.array(np.full(n * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *ADDED])

    return rows.where(F.size(x) == width).select(*keep, x).mapInArrow(run, schema)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", COMPONENTS)
