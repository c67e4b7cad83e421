"""Whitening of vectors: principal components by pivoted Cholesky of the centred scatter and one-sided Jacobi on its factor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papergraph.llm.common import discard, saved

#: Rows are worked on in blocks of so many cells.
BLOCK_CELLS = 1_000_000
#: Directions with less than this share of the largest diagonal entry of the scatter count as none.
RANK_TOLERANCE = 1e-13


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """A factor f of the rank of a, with f @ f.T == a for a symmetric, positive semidefinite a.

    The rows of f are in the order of a; sorted by the order of the pivots they make a lower triangle.
    """
    n, f, rest = len(a), np.zeros_like(a, dtype=np.float64), np.diag(a).astype(np.float64).copy()
    least, left = RANK_TOLERANCE * max(rest.max(initial=0.0), 0.0), np.ones(n, bool)
    for j in range(n):
        pivot = int(np.argmax(np.where(left, rest, -np.inf)))
        if not left[pivot] or rest[pivot] <= least:
            return f[:, :j]
        left[pivot] = False
        f[pivot, j] = np.sqrt(rest[pivot])
        f[left, j] = (a[left, pivot] - f[left, :j] @ f[pivot, :j]) / f[pivot, j]
        rest[left] -= f[left, j] ** 2
    return f


def jacobi(f: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (as columns) of f @ f.T, the largest first: columns of f are turned until all are orthogonal.

    The columns meet as in a round-robin tournament, so the turns of a round touch columns of their own and go together.
    """
    f = f.astype(np.float64).copy()
    r = f.shape[1]
    players = list(range(r + r % 2))
    for _ in range(sweeps if r > 1 else 0):
        turned = False
        for _ in range(len(players) - 1):
            half = len(players) // 2
            met = np.array([(a, b) for a, b in zip(players[:half], reversed(players[half:]), strict=True) if max(a, b) < r]).reshape(-1, 2)
            p, q = f[:, met[:, 0]], f[:, met[:, 1]]
            alpha, beta, gamma = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            off = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if off.any():
                turned = True
                zeta = (beta - alpha)[off] / (2 * gamma[off])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s, p, q = c * t, p[:, off], q[:, off]
                f[:, met[off, 0]], f[:, met[off, 1]] = c * p - s * q, s * p + c * q
            players = [players[0], players[-1], *players[1:-1]]
        if not turned:
            break
    norms = np.sqrt((f * f).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, f[:, order] / norms[order]


def _matrix(column: pa.Array, scale: float, offset: int, width: int) -> np.ndarray:
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))
    if len(x) and np.abs(x).max() >= 2.0**53:
        raise OverflowError("a component beyond 2^53: floor(scale * component) is not exact in doubles")
    return x.astype(np.int64) + offset


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each row and each of the first k components.

    A component c of a vector counts as the integer x = floor(scale * c) + offset. With n vectors and sums S by dimension,
    the scatter of x - S / n, summed up by task, is factored on the driver: it has the size of the dimensions squared, not
    of the rows. deviation is the sum of (n x - S)^2 over the dimensions, exact in 64 bits; whitened the centred vector on
    the component over the root of its eigenvalue; explained the eigenvalue's share; identity_error the largest entry of
    the covariance of all whitened values less the identity, the same in all rows.

    Vectors that are null or empty, or hold a null or non-finite entry, are dropped. Repeated rows, and null ids, are
    vectors of their own. Directions without variance are no components, so equal vectors alone, or none, give an empty
    result. Vectors of different lengths, and deviations beyond 64 bits, are errors. Other columns are not read.
    """
    x = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), x.alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    kind = rows.schema["vec_id"].dataType.simpleString()
    empty = vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    width, longest = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if width is None:
        return empty
    if width != longest:
        raise ValueError("vectors of different lengths")

    def blocks(batches):
        step = max(1, BLOCK_CELLS // width)
        for batch in batches:
            for first in range(0, len(batch), step):
                part = batch.slice(first, step)
                yield part.column(0), _matrix(part.column(1), scale, offset, width)

    def table(values, name):
        values = np.asarray(values)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", name])

    def summed(batches):
        total, n = np.zeros(width, object), 0
        for _, x in blocks(batches):
            total, n = total + x.sum(axis=0), n + len(x)
        if n:
            yield table(np.append(total, n).astype(np.int64), "amount")

    sums = {r.place: r.amount for r in rows.mapInArrow(summed, "place long, amount long").groupBy("place").agg(F.sum("amount").alias("amount")).collect()}
    n, total = sums[width], np.array([sums[i] for i in range(width)], np.int64)
    upper = np.triu_indices(width)

    def differences(x):
        """n x - S, exact."""
        if n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + int(np.abs(total).max()) >= 2**63:
            raise OverflowError("n x - S beyond 64 bits")
        return n * x - total

    def scattered(batches):
        scatter, some = np.zeros((width, width)), False
        for _, x in blocks(batches):
            d = differences(x) / n
            scatter, some = scatter + d.T @ d, True
        if some:
            yield table(scatter[upper], "amount")

    cells = {r.place: r.amount for r in rows.mapInArrow(scattered, "place long, amount double").groupBy("place").agg(F.sum("amount").alias("amount")).collect()}
    scatter = np.zeros((width, width))
    scatter[upper] = [cells[i] for i in range(len(upper[0]))]
    scatter = scatter + np.triu(scatter, 1).T
    values, components = jacobi(pivoted_cholesky(scatter))
    values, components, trace = values[:k] / n, components[:, :k], np.trace(scatter) / n
    if not len(values):
        return empty

    def projected(batches):
        for ids, x in blocks(batches):
            d = differences(x)
            if (d.astype(np.float64) ** 2).sum(axis=1).max(initial=0) >= 2.0**63 * (1 - 1e-9):
                raise OverflowError("a deviation beyond 64 bits")
            w = (d / n) @ components / np.sqrt(values)
            yield pa.RecordBatch.from_arrays([ids, pa.array((d * d).sum(axis=1)), pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    whitened = saved(rows.mapInArrow(projected, f"vec_id {kind}, deviation long, w array<double>"), "whitened")
    means = list(whitened.agg(*[F.avg(F.col("w")[i]) for i in range(len(values))]).first())
    centred = [F.col("w")[i] - F.lit(m) for i, m in enumerate(means)]
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    found = whitened.agg(*[F.avg(centred[i] * centred[j]) for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, found, strict=True))
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    each = whitened.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(float(error)).alias("identity_error"))
