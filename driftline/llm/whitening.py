"""Whitening embeddings by their leading principal components, found by LOBPCG.

Entries c become whole numbers x = floor(256 c). The covariance V of the distinct x vectors is never formed: each round
asks for its product with a block of directions, which tasks sum over centred rows and a small tree adds up, and a
Rayleigh-Ritz step on an orthonormal basis of iterate, previous directions and preconditionless residuals gives the next
iterate. The block is wider than the components asked for (``GUARD`` more), so close eigenvalues don't slow it down. It
ends once fresh products certify that the residuals are at the level of rounding, and raises if they never get there.

Rows whose vector is null or holds null or non-finite entries take no part, nor do empty vectors. If lengths differ, those of
the commonest length count (of equally common ones, the longest). Null ids and repeated rows stay rows of their own, but
equal x vectors count once in the fit. Components without variance (at most ``FLAT`` of the trace) aren't returned, so equal
vectors only, a single one or an empty table give no rows. An entry of which 256 c doesn't fit 53 bits raises.

Matrices in the driver have the vectors' dimension by a few times the block; nothing else grows there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import alone, checkpoint, only, sliced

COMPONENTS, GUARD, ROUNDS = 4, 16, 300
#: Residuals relative to the largest eigenvalue: the aim, and what is accepted once rounding stops all progress.
TOLERANCE, ACCEPTED = 1e-14, 1e-11
#: A component with at most this share of the trace has no variance.
FLAT = 1e-13


@dataclass(frozen=True)
class Fit:
    """What whitening needs: counts, sums and the components (as columns) with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    rounds: int
    identity_error: float = 0.0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def valid(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that take part, and the length of x (0: none do)."""
    rows = only(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    # comparisons with null and NaN are never below the bound, so they count as unfit
    fit = F.coalesce(F.forall("c", lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False))), F.lit(False))
    rows = rows.where(fit & (F.size("c") > 0))
    lengths = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    whole = F.transform("c", lambda c: F.when(F.abs(c) <= 2.0**45, F.floor(c * 256)).otherwise(F.raise_error(F.lit("an entry of an embedding is too large"))).cast("long"))
    return rows.where(F.size("c") == d).select("vec_id", whole.alias("x")), d


def _partial(batches: Iterator[pa.RecordBatch], task) -> Iterator[pa.RecordBatch]:
    """One row for each partition that has rows: its place and the sum of task(x) over it, as bytes."""
    from pyspark import TaskContext

    alone()
    total = None
    for batch in sliced(batches, 8192):
        if batch.num_rows:
            part = task(batch.column("x"))
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "sum"])


def _added(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    """The sum of all rows of a partition, added in order of place, so that reruns add alike."""
    rows = sorted((p, s) for b in batches for p, s in zip(b.column("part").to_pylist(), b.column("sum").to_pylist()))
    if rows:
        total = sum(np.frombuffer(s, dtype) for _, s in rows)
        yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "sum"])


def summed(fit: DataFrame, task, shape: tuple[int, ...], dtype: str = "float64") -> np.ndarray:
    """The sum of task(x) over all rows: in each task, then in about as many as the root of their number, then here."""
    parts = fit.select("x").mapInArrow(partial(_partial, task=task), "part long, sum binary")
    width = max(1, math.isqrt(fit.rdd.getNumPartitions()))
    rows = parts.repartition(width, F.expr(f"part % {width}")).mapInArrow(partial(_added, dtype=dtype), "part long, sum binary").collect()
    if not rows:
        return np.zeros(shape, dtype)
    return sum(np.frombuffer(r["sum"], dtype) for r in sorted(rows)).reshape(shape)


def _sums(column: pa.Array, d: int) -> np.ndarray:
    """Sums by dimension in 32-bit halves, so that no task's sum runs over."""
    x = matrix(column, d)
    return np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])


def _centred(column: pa.Array, mean: np.ndarray) -> np.ndarray:
    return matrix(column, len(mean)).astype(float) - mean


def _product(column: pa.Array, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    c = _centred(column, mean)
    return (c.T @ (c @ block)).ravel()


def _square(column: pa.Array, mean: np.ndarray) -> np.ndarray:
    return np.array([(_centred(column, mean) ** 2).sum()])


def _whitened(column: pa.Array, mean: np.ndarray, scaled: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Sums of whitened rows, or, given their mean, of their centred products."""
    w = _centred(column, mean) @ scaled
    return w.sum(axis=0) if at is None else ((w - at).T @ (w - at)).ravel()


def _basis(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of the block's columns, apart from ``against``; directions that vanish are left out."""
    for _ in range(2):
        if against is not None and against.shape[1]:
            block = block - against @ (against.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8 * s[0]]
    return block


def lobpcg(product, d: int, wanted: int, trace: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Leading eigenvalues and eigenvectors of the operator ``product`` (block to block), their worst residual and the rounds.

    The basis of each round is orthonormal before the operator meets it, so that what it gives can be carried along in
    the same combinations; a result counts only with residuals from a fresh product.
    """
    m = min(d, wanted + GUARD)
    x = _basis(np.random.default_rng(seed).normal(size=(d, m)))
    vx, p, vp = product(x), np.zeros((d, 0)), np.zeros((d, 0))
    best, since, fresh = math.inf, 0, True
    for rounds in range(1, ROUNDS + 1):
        e, c = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        order = np.argsort(-e)
        e, x, vx = e[order], x @ c[:, order], vx @ c[:, order]
        r = vx - x * e
        norms = np.linalg.norm(r[:, :wanted], axis=0) / max(e[0], np.finfo(float).tiny)
        worst = float(norms.max())
        done = worst <= TOLERANCE or (since >= 3 and best <= ACCEPTED) or x.shape[1] == d
        if done and fresh:
            return e[:wanted], x[:, :wanted], worst, rounds
        if done:
            x = _basis(x)
            vx, p, vp, fresh = product(x), p[:, :0], vp[:, :0], True
            continue
        best, since = (worst, 0) if worst < best / 2 else (min(best, worst), since + 1)
        s = _basis(r, np.hstack([x, p]))
        if not s.shape[1] and not p.shape[1]:
            since = 3
            continue
        q = np.hstack([x, p, s])
        vq = np.hstack([vx, vp, product(s)]) if s.shape[1] else np.hstack([vx, vp])
        fresh = False
        g, c = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        c = c[:, np.argsort(-g)[:m]]
        step = c.copy()
        step[: x.shape[1]] = 0
        step = _basis(step, c)  # the part that leaves the last iterate, apart from the new one
        x, vx, p, vp = q @ c, vq @ c, q @ step, vq @ step
    raise ArithmeticError(f"residuals of {best:g} after {ROUNDS} rounds")


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Fit | None:
    """The fit over the distinct x vectors of (vec_id, x); None if there are none or they don't vary."""
    if not d:
        return None
    distinct = checkpoint(rows.select("x").distinct())
    high, low = summed(distinct, partial(_sums, d=d), (2, d), "int64")
    n, sums = distinct.count(), tuple((int(h) << 32) + int(v) for h, v in zip(high, low))
    if n < 2:
        return None
    mean = np.array([s / n for s in sums])  # of whole numbers: rounded once
    trace = float(summed(distinct, partial(_square, mean=mean), (1,))[0]) / n
    if not trace > 0:
        return None
    product = lambda block: summed(distinct, partial(_product, mean=mean, block=block), block.shape) / n
    values, vectors, residual, rounds = lobpcg(product, d, min(d, components), trace)
    keep = values > FLAT * trace
    values, vectors = values[keep], vectors[:, keep]
    k = len(values)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(k)])
    scaled = vectors / np.sqrt(values)
    at = summed(distinct, partial(_whitened, mean=mean, scaled=scaled), (k,)) / n
    spread = summed(distinct, partial(_whitened, mean=mean, scaled=scaled, at=at), (k, k)) / n
    return Fit(n, sums, values, vectors, trace, residual, rounds, float(np.abs(spread - np.eye(k)).max()))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum of (n x - S)^2 of each row, exact; None where it doesn't fit 64 bits."""
    s = np.array(sums, object)
    far = max(abs(int(v)) for v in (x.max(), x.min())) * n + max(map(abs, sums))
    if far * far * len(sums) < 1 << 62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    out = ((n * x.astype(object) - s) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in out]


def _apply(batches: Iterator[pa.RecordBatch], of: Fit) -> Iterator[pa.RecordBatch]:
    alone()
    k, mean = len(of.values), np.array([s / of.n for s in of.sums])
    scaled = of.vectors / np.sqrt(of.values)
    for batch in sliced(batches, 8192):
        if not batch.num_rows:
            continue
        x = matrix(batch.column("x"), len(of.sums))
        rows = len(x)
        columns = [
            batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
            pa.array(np.full(rows * k, of.n)),
            pa.array([v for v in deviations(x, of.n, of.sums) for _ in range(k)], pa.int64()),
            pa.array(((x.astype(float) - mean) @ scaled).ravel()),
            pa.array(np.tile(of.values / of.trace, rows)),
            pa.array(np.full(rows * k, of.identity_error)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each row that takes part and component.

    ``deviation`` is the exact sum of (n x - S)^2 over the dimensions, null where it doesn't fit 64 bits.
    """
    rows, d = valid(vectors)
    of = fit(rows, d, components)
    if of is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    return rows.mapInArrow(partial(_apply, of=of), SCHEMA)
