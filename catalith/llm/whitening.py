"""Embedding whitening with an exact integer scatter.

An entry c becomes the integer y = floor(64 c), which is x = y + SHIFT less the
shift; covariances don't depend on the shift. Each task multiplies blocks of
rows, with a column of ones before them, so that one product holds the number of
rows, the sums S and the cross-products. Every factor is under 2**20 and every
block has at most 4,096 rows, so the products are whole numbers that doubles hold
exactly; larger entries are split into digits of 20 bits. Tasks send their
totals in digits of 30 bits, which Spark adds as longs. The driver gets only
these (d+1)**2 / 2 sums, forms n XᵀX - S Sᵀ in integers of any length and converts
to floats only then. eigh gives the eigenvectors; a few Jacobi rotations in
extended precision make small eigenvalues as exact as large ones.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry
are left out, as are rows whose vector is empty or of another length than most
(of lengths that are equally frequent the greater counts). Rows that repeat a
vec_id, and a null vec_id, are rows like others. deviation is null where it does
not fit a long; deviation_exact has its digits always. Components without
variance come last, with whitened and explained 0; identity_error is over those
with variance (0 if none has). An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import slices

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
_DIGIT, _BLOCK, _LIMB = 20, 4_096, 30
_MOST_BLOCKS = 512
#: Jacobi rotations smaller than this (against the two variances) are left out; the most sweeps.
_SMALL, _SWEEPS = 1e-18, 8
#: A variance below this part of the greatest entry that went into it is rounding.
_NOTHING = 1e-25
_WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums (of y), unit components as columns by falling variance, and trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        """Components over the root of their variance; 0 without variance."""
        good = self.variances > 0
        return self.vectors * np.where(good, 1 / np.sqrt(np.where(good, self.variances, 1)), 0)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that count."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    most = lengths.first()
    return rows.where(F.size("embedding") == (most["d"] if most else 0))


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    """y = floor(64 c) of each row: whole numbers as doubles."""
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(batch.num_rows, -1) * SCALE)


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """Parts with y = part0 + part1 * 2**20 + ..., each under 2**20."""
    parts = []
    while True:
        high = np.trunc(y / (1 << _DIGIT))
        parts.append(y - high * (1 << _DIGIT))
        if not high.any():
            return parts
        y = high


class _Scatter:
    """Exact sums of cross-products of rows that begin with a one."""

    def __init__(self, width: int) -> None:
        self.total = np.zeros((width, width), object)
        self.open: dict[int, np.ndarray] = {}
        self.blocks = 0

    def add(self, y: np.ndarray) -> None:
        parts = _digits(np.hstack([np.ones((len(y), 1)), y]))
        for a, left in enumerate(parts):
            for b, right in enumerate(parts):
                product = (left.T @ right).astype(np.int64)
                self.open[a + b] = self.open[a + b] + product if a + b in self.open else product
        self.blocks += len(parts)  # so many products at most share a place
        if self.blocks >= _MOST_BLOCKS:
            self.close()

    def close(self) -> np.ndarray:
        for place, product in self.open.items():
            self.total = self.total + product.astype(object) * (1 << (_DIGIT * place))
        self.open, self.blocks = {}, 0
        return self.total


def _scatter(batches):
    held = None
    for batch in slices(batches, _BLOCK):
        y = _entries(batch)
        if held is None:
            held = _Scatter(y.shape[1] + 1)
        held.add(y)
    if held is None:
        return
    total, cells, limbs, values = held.close(), [], [], []
    for i in range(len(total)):
        for j in range(i, len(total)):
            rest, limb = abs(int(total[i, j])), 0
            while rest:
                part = rest & ((1 << _LIMB) - 1)
                cells.append(i * len(total) + j)
                limbs.append(limb)
                values.append(-part if total[i, j] < 0 else part)
                rest, limb = rest >> _LIMB, limb + 1
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(limbs, pa.int32()), pa.array(values, pa.int64())], ["cell", "limb", "value"])


def scatter(rows: DataFrame, d: int) -> np.ndarray:
    """Exact (d+1) x (d+1) sums over usable rows: n, the sums of y, and the cross-products of y, as Python integers."""
    sums = rows.select("embedding").mapInArrow(_scatter, "cell long, limb int, value long").groupBy("cell", "limb").agg(F.sum("value").alias("value"))
    out = np.zeros((d + 1, d + 1), object)
    for r in sums.collect():  # (d+1)**2 / 2 cells of a few digits
        i, j = divmod(r.cell, d + 1)
        out[i, j] += r.value << (_LIMB * r.limb)
    return np.triu(out) + np.triu(out, 1).T


def _extended(top: int, below: int) -> np.longdouble:
    high = top / below
    return np.longdouble(high) + np.longdouble(float(Fraction(top, below) - Fraction(high)))


def eigen(top: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of the integer matrix top over below."""
    d = len(top)
    v = np.array([[_extended(int(top[i, j]), below) for j in range(d)] for i in range(d)], np.longdouble)
    q = np.linalg.eigh(v.astype(np.float64))[1].astype(np.longdouble)
    for _ in range(2):  # columns made orthogonal to extended precision
        q = q @ (1.5 * np.eye(d, dtype=np.longdouble) - 0.5 * (q.T @ q))
    b = q.T @ v @ q
    for _ in range(_SWEEPS):
        turned = False
        for i in range(d - 1):
            for j in range(i + 1, d):
                if abs(b[i, j]) <= _SMALL * np.sqrt(abs(b[i, i] * b[j, j])) or b[i, j] == 0:
                    continue
                turned = True
                t = (b[j, j] - b[i, i]) / (2 * b[i, j])
                t = (1 if t >= 0 else -1) / (abs(t) + np.hypot(t, 1))
                c = 1 / np.hypot(t, 1)
                turn = np.array([[c, t * c], [-t * c, c]])
                b[[i, j], :] = turn.T @ b[[i, j], :]
                b[:, [i, j]] = b[:, [i, j]] @ turn
                q[:, [i, j]] = q[:, [i, j]] @ turn
        if not turned:
            break
    values = np.diag(b)
    order = np.argsort(-values, kind="stable")
    values, q = values[order], q[:, order]
    values = np.where(values > _NOTHING * d * max(values.max(), 0), values, 0)
    return values.astype(np.float64), (q / np.sqrt((q * q).sum(axis=0))).astype(np.float64)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable rows; None if there are none."""
    first = rows.select(F.size("embedding").alias("d")).first()
    if first is None:
        return None
    total = scatter(rows, first.d)
    n, sums = total[0, 0], total[0, 1:]
    top = n * total[1:, 1:] - np.outer(sums, sums)
    values, vectors = eigen(top, n * n)
    k = min(components, first.d)
    return Whitening(n, tuple(map(int, sums)), vectors[:, :k], values[:k], int(np.trace(top)) / (n * n))


def _centred(y: np.ndarray, w: Whitening) -> np.ndarray:
    """n y - S as exact integers: longs where squares fit, else of any length."""
    most = w.n * (int(np.abs(y).max(initial=0))) + max(map(abs, w.sums))
    if most * most * len(w.sums) < 1 << 63:
        return w.n * y.astype(np.int64) - np.array(w.sums, np.int64)
    whole = np.array([[int(c) for c in row] for row in y], object).reshape(y.shape)
    return w.n * whole - np.array(w.sums, object)


def _white(y: np.ndarray, w: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(whitened rows, exact deviation of each row)."""
    v = _centred(y, w)
    if v.dtype == object:
        flat = np.array([[c / w.n for c in row] for row in v], np.float64).reshape(v.shape)
    else:
        flat = v / w.n
    return flat @ w.scaled, (v * v).sum(axis=1)


def _moments(w: Whitening):
    """Cross-products of whitened rows about their task's mean, and what the means add."""

    def run(batches):
        k = len(w.variances)
        n, mean, about = 0, np.zeros(k), np.zeros((k, k))
        for batch in slices(batches, _BLOCK):
            part = _white(_entries(batch), w)[0]
            own = part.mean(axis=0)
            part -= own
            step = own - mean
            about += part.T @ part + np.outer(step, step) * (n * len(part) / (n + len(part)))
            n += len(part)
            mean += step * (len(part) / n)
        if n:
            cells = [(i, j) for i in range(k) for j in range(i, k)] + [(-1, i) for i in range(k)]
            rows = [(i, j, about[i, j], n * mean[i] * mean[j]) if i >= 0 else (i, j, n * mean[j], 0.0) for i, j in cells]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], ["i", "j", "within", "between"])

    return run


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest entry, without sign, of the covariance of the whitened rows minus the identity."""
    found = rows.select("embedding").mapInArrow(_moments(w), "i int, j int, within double, between double")
    cells = {(r.i, r.j): (r.within, r.between) for r in found.groupBy("i", "j").agg(F.sum("within").alias("within"), F.sum("between").alias("between")).collect()}
    mean = {j: v[0] / w.n for (i, j), v in cells.items() if i < 0}
    worst = [abs(sum(v) / w.n - mean[i] * mean[j] - (i == j)) for (i, j), v in cells.items() if i >= 0 and w.variances[i] > 0 and w.variances[j] > 0]
    return float(max(worst, default=0.0))


def _rows(w: Whitening, error: float):
    k = len(w.variances)
    explained = w.variances / w.trace if w.trace else np.zeros(k)

    def run(batches):
        for batch in slices(batches, _BLOCK):
            white, deviation = _white(_entries(batch), w)
            at = np.repeat(np.arange(batch.num_rows), k)
            fits = [int(x) if x < 1 << 63 else None for x in deviation.tolist()]
            arrays = [
                batch.column("vec_id").take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                pa.array(np.full(len(at), w.n, np.int64)),
                pa.array(fits, pa.int64()).take(pa.array(at)),
                pa.array(white.ravel()),
                pa.array(np.tile(explained, batch.num_rows)),
                pa.array(np.full(len(at), error)),
                pa.array([str(x) for x in deviation.tolist()], pa.string()).take(pa.array(at)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row and component: (vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact)."""
    rows = usable(embeddings)
    w = fit(rows, components)
    if w is None:
        return embeddings.sparkSession.createDataFrame([], _WHITE)
    return rows.mapInArrow(_rows(w, identity_error(rows, w)), _WHITE)


def whitened_vectors(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, whitened array<double>): the vectors themselves, for what follows in a pipeline."""
    rows = usable(embeddings)
    w = fit(rows, components)

    def run(batches):
        for batch in slices(batches, _BLOCK):
            white = _white(_entries(batch), w)[0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], ["vec_id", "whitened"])

    return embeddings.sparkSession.createDataFrame([], "vec_id long, whitened array<double>") if w is None else rows.mapInArrow(run, "vec_id long, whitened array<double>")
