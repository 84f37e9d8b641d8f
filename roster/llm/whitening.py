"""Embedding whitening by Chebyshev-filtered subspace iteration (operator 11).

Entries become whole numbers, x = floor(1024 c) + 100000, so that counts and sums are exact; the vectors are written once
and read again in every pass. The covariance V is never formed: a pass multiplies it with a block Q of some 24 columns as
the sum of c (c'Q) over the centred vectors c, one partial product a task, summed cell by cell with map-side partial sums.

1. ``LANCZOS`` passes with one vector give a lower end of the spectrum (a guess that is too high only costs cycles).
2. A cycle multiplies the block ``DEGREE`` times by the scaled Chebyshev recurrence that stays below one on the unwanted
   interval, from that lower end to the block's smallest Ritz value, and grows fast above it. QR makes the block
   orthonormal again, and Rayleigh-Ritz turns it to the eigenvectors within its span.
3. It ends once the residual norms |Vq - eq| of all wanted pairs are below ``RESIDUAL`` times the largest eigenvalue, or
   stay at rounding level. A residual bounds the error of its eigenvalue, and over the gap that of its eigenvector.
   ``FRESH`` columns are drawn anew each cycle, so that a direction the first draw missed comes in. If a block of the
   wanted size spans all dimensions, Rayleigh-Ritz alone is exact.

The driver holds only matrices of dimensions x block. Passes don't depend on the number of rows but each reads all of them.

Defined cases: vectors that are null or empty, or hold a null, a non-finite entry or one of 2**44/1024 or more (no exact
sums), are left out; so are those of another length than most vectors (of equally frequent lengths the larger counts).
Equal vectors and repeated ids are rows of their own, and a null id stays null. Directions without variance are no
components, so vectors that are all equal, and a single one, have none. An empty table gives an empty result. Equal
eigenvalues: any orthonormal basis of their space. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roster.llm.shared import pin

COMPONENTS = 8
GUARD = 16              # columns of the block beyond the wanted ones
FRESH = 2               # of them, drawn anew each cycle
DEGREE = 10
LANCZOS = 12
CYCLES = 100
RESIDUAL = 1e-13
SCALE, SHIFT = 1024, 100_000
LIMIT = float(1 << 44)
_ROWS = 4096


@dataclass(frozen=True)
class Fit:
    """What the fit list gives: exact counts and sums, and the components by falling eigenvalue."""
    n: int
    sums: list[int]
    low: int                    # least and largest entry
    high: int
    trace: float
    values: np.ndarray          # eigenvalues
    vectors: np.ndarray         # dimensions x components
    residual: float             # largest residual norm over the largest eigenvalue
    passes: int
    identity_error: float

    @property
    def components(self) -> int:
        return len(self.values)

    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def fixed_point(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, x: array of long) of the vectors that count, written once."""
    entry = F.col("entries")
    typed = vectors.select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("entries"))
    sound = typed.filter((F.size(entry) > 0) & F.forall(entry, lambda c: F.coalesce(F.abs(c * SCALE) < LIMIT, F.lit(False))))
    x = F.transform(entry, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    found = pin(sound.select("id", x.alias("x")), "vectors")
    usual = found.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).select("size")
    sizes = usual.collect()         # one row at most
    return found.filter(F.size("x") == sizes[0].size) if sizes else found


def _matrices(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            lists = batch.column(column).slice(at, _ROWS)
            yield lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _moments(x: DataFrame) -> tuple[int, list[int], int, int]:
    """Count, exact sums a dimension, least and largest entry."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, None, [], []
        for m in _matrices(batches, 0):
            part = [int(s) for s in m.sum(axis=0)]      # 4096 entries below 2**45 fit in 64 bits
            sums = part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
            n += len(m)
            low.append(int(m.min()))
            high.append(int(m.max()))
        if n:
            d = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0)),
                 pa.array([min(low)] * d, pa.int64()), pa.array([max(high)] * d, pa.int64())], names=["cell", "n", "s", "low", "high"])

    parts = x.select("x").mapInArrow(run, "cell int, n long, s decimal(38,0), low long, high long")
    rows = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"),
                                     F.max("high").alias("high")).orderBy("cell").collect()      # one row a dimension
    if not rows:
        return 0, [], 0, 0
    return rows[0].n, [int(r.s) for r in rows], min(r.low for r in rows), max(r.high for r in rows)


class _Centre:
    """x - S/n, as an exact difference of whole numbers less a fraction."""

    def __init__(self, n: int, sums: list[int]):
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.part = np.array([(s % n) / n for s in sums])

    def __call__(self, m: np.ndarray) -> np.ndarray:
        return (m - self.whole).astype(np.float64) - self.part


class _Covariance:
    """Passes over the centred vectors."""

    def __init__(self, x: DataFrame, n: int, sums: list[int]):
        self.x, self.n, self.passes, self.centre = x.select("x"), n, 0, _Centre(n, sums)

    def total(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum of ``of`` (centred rows) over all vectors."""
        centre = self.centre

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for m in _matrices(batches, 0):
                value = of(centre(m))
                total = value if total is None else total + value
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

        self.passes += 1
        rows = self.x.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(shape)
        for r in rows:
            out.flat[r.cell] = r.value
        return out

    def times(self, block: np.ndarray) -> np.ndarray:
        return self.total(lambda c: c.T @ (c @ block), block.shape) / self.n


def lower_end(times: Callable[[np.ndarray], np.ndarray], d: int, rng: np.random.Generator) -> float:
    """A lower end of the spectrum by Lanczos: the least Ritz value less the last residual, at least 0."""
    q, before, beta = rng.standard_normal(d), np.zeros(d), 0.0
    q /= np.linalg.norm(q)
    basis, alphas, betas = [], [], []
    for _ in range(min(LANCZOS, d)):
        basis.append(q)
        w = times(q[:, None])[:, 0]
        alphas.append(float(q @ w))
        w = w - alphas[-1] * q - beta * before
        w -= np.array(basis).T @ (np.array(basis) @ w)
        beta = float(np.linalg.norm(w))
        if beta <= 1e-12 * max(map(abs, alphas)):
            break
        betas.append(beta)
        before, q = q, w / beta
    off = betas[:len(alphas) - 1]
    ritz = np.linalg.eigvalsh(np.diag(alphas) + np.diag(off, 1) + np.diag(off, -1))
    return max(0.0, float(ritz[0]) - beta)


def filtered(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, first: np.ndarray, low: float, high: float,
             top: float) -> np.ndarray:
    """The Chebyshev polynomial of degree ``DEGREE`` that damps [low, high], scaled by its value at ``top``, of V times the
    block; ``first`` is V times the block."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = one = half / (top - middle)
    x, y = block, (first - middle * block) * (sigma / half)
    for _ in range(DEGREE - 1):
        new = 1 / (2 / one - sigma)
        x, y = y, (times(y) - middle * y) * (2 * new / half) - (sigma * new) * x
        sigma = new
    return y


def eigenpairs(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues, their eigenvectors, and the largest residual norm over the largest eigenvalue."""
    rng = np.random.default_rng(11)
    k = min(d, wanted + GUARD)
    low = lower_end(times, d, rng) if k < d else 0.0
    q = np.linalg.qr(rng.standard_normal((d, k)))[0]
    last = np.inf
    for _ in range(CYCLES):
        vq = times(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        if values[0] <= 0:
            return np.zeros(0), np.zeros((d, 0)), 0.0
        error = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / values[0])
        if error <= RESIDUAL or (error <= 100 * RESIDUAL and error > last / 2):
            break
        last = error
        high = max(float(values[k - 1 - FRESH]), low + 1e-12 * values[0])
        if high >= values[0]:
            high = (low + float(values[0])) / 2
        y = filtered(times, q, vq, low, high, float(values[0]))
        y[:, k - FRESH:] = rng.standard_normal((d, FRESH))
        q = np.linalg.qr(y / np.linalg.norm(y, axis=0))[0]
    else:
        raise ArithmeticError(f"no convergence in {CYCLES} cycles: the residual is {error:.1e} of the largest eigenvalue")
    # What rounding leaves of a direction without variance is no component.
    real = values[:wanted] > 1e-12 * values[0]
    return values[:wanted][real], q[:, :wanted][:, real], error


def fit(x: DataFrame, components: int = COMPONENTS) -> Fit:
    """The components of (id, x) vectors, all of which count."""
    n, sums, low, high = _moments(x)
    if not n or low == high:
        return Fit(n, sums, low, high, 0.0, np.zeros(0), np.zeros((len(sums), 0)), 0.0, 0, 0.0)
    v, d = _Covariance(x, n, sums), len(sums)
    trace = float(v.total(lambda c: (c * c).sum(axis=0), (d,)).sum()) / n
    values, vectors, residual = (eigenpairs(v.times, d, min(components, d)) if trace > 0
                                 else (np.zeros(0), np.zeros((d, 0)), 0.0))
    k, whiten = len(values), vectors / np.sqrt(values)
    error = 0.0
    if k:
        def products(c: np.ndarray) -> np.ndarray:
            w = c @ whiten
            return np.vstack([w.T @ w, w.sum(axis=0)])

        sums_of = v.total(products, (k + 1, k)) / n
        error = float(np.abs(sums_of[:k] - np.outer(sums_of[k], sums_of[k]) - np.eye(k)).max())
    return Fit(n, sums, low, high, trace, values, vectors, residual, v.passes, error)


def whiten(x: DataFrame, model: Fit) -> DataFrame:
    """One row per vector: id, whitened (array, a value a component) and deviation, the exact sum over dimensions of
    (n x - S) squared (null beyond 38 digits)."""
    kind = x.schema["id"].dataType.simpleString()
    if not model.n:
        return x.select("id", F.array().cast("array<double>").alias("whitened"), F.lit(None).cast("decimal(38,0)").alias("deviation"))
    centre = _Centre(model.n, model.sums)
    project = model.vectors / np.sqrt(model.values)
    n, sums = model.n, model.sums
    short = (n * (model.high - model.low)) ** 2 * len(sums) < 1 << 62 and n * max(abs(model.low), abs(model.high)) < 1 << 62

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                m = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                w = centre(m) @ project
                if short:
                    moved = n * m - np.array(sums, dtype=np.int64)
                    deviation = pa.array((moved * moved).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    exact = (((n * m.astype(object)) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
                    deviation = pa.array([Decimal(int(e)) if e < 10 ** 38 else None for e in exact], pa.decimal128(38, 0))
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(w.ravel())), deviation],
                                                 names=["id", "whitened", "deviation"])

    return x.select("id", "x").mapInArrow(run, f"id {kind}, whitened array<double>, deviation decimal(38,0)")
