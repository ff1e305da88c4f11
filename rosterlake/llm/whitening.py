"""Embedding whitening: principal components of all distinct vectors, and every vector's coordinates on them.

Entries become whole numbers x = floor(SCALE * c) + SHIFT.  The fit list is each
distinct x vector once: n of them with sums S, all exact.  The covariance V of
the list is never built.  Matrix-free block subspace iteration: each Spark pass
computes X'(X Q) / n of the centred rows for a block Q of directions (every
partition adds up its own rows; the sums meet by (dimension, direction)), and V Q
joins those of earlier blocks.  Rayleigh-Ritz over the subspace that all blocks
span gives the leading components, and a QR of their residuals, made orthogonal
to the subspace, is the next block.  When every residual is at most TOLERANCE of
the largest eigenvalue, all k components are certified.  A subspace that has
grown to MOST blocks is cut down to its leading 2 k Ritz vectors, so the driver
holds a few blocks of the dimension and never rows.

Defined cases: vectors that are null or hold null or non-finite entries, or
whose x doesn't fit in a long, take no part; empty vectors too.  Vectors must be
of one length, else the call fails.  Components without variance (eigenvalue
below FLAT of the largest) can't be whitened and are left out, so a table of
equal vectors gives no rows; rows that repeat are each whitened, but counted
once in the fit.  A deviation beyond a long is null.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Directions of a block, and blocks of the subspace.
BLOCK, MOST = 24, 8
TOLERANCE, FLAT = 1e-13, 1e-11
ROUNDS = 500


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x: array<long>) of the usable rows."""
    c = F.col("embedding")
    usable = F.coalesce(F.size(c) > 0, F.lit(False)) & F.forall(c, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) < 2.0**53), F.lit(False)))
    return vectors.filter(usable).select("vec_id", F.transform(c, lambda e: (F.floor(e.cast("double") * SCALE) + SHIFT).cast("long")).alias("x"))


def _rows(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def added_up(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], kind: str) -> np.ndarray:
    """The sum over all rows' blocks of the matrix ``of`` a block of x vectors; each partition adds up first."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=dtype)
        for batch in batches:
            if batch.num_rows:
                total += of(_rows(batch.column("x")))
        cells = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "value"])

    sums = fit.select("x").mapInArrow(run, f"cell long, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(shape[0] * shape[1], dtype=dtype)
    for row in sums.toLocalIterator():  # a block of the dimension
        out[row["cell"]] = row["value"]
    return out.reshape(shape)


class Centre:
    """n and S of a fit list, and rows centred by them in exact arithmetic before they become doubles."""

    def __init__(self, fit: DataFrame):
        told = fit.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
        if told["low"] != told["high"]:
            raise ValueError(f"vectors of {told['low']} and {told['high']} entries")
        self.n, self.size = told["n"], told["low"] or 0
        sums = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).collect() if self.n else []
        self.sums = [0] * self.size
        for r in sums:
            self.sums[r["i"]] = int(r["s"])
        self.base = np.array([s // max(1, self.n) for s in self.sums], dtype=np.int64)
        self.rest = np.array([s % max(1, self.n) for s in self.sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part is taken off first."""
        return (x - self.base).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2 of each row, exactly; null beyond a long."""
        whole = x - self.base
        most = int(np.abs(whole).max(initial=0)) + 1
        if (most * self.n) ** 2 * max(1, self.size) < 1 << 63:
            return ((whole * self.n - self.rest) ** 2).sum(axis=1).tolist()
        exact = [sum((int(w) * self.n - int(r)) ** 2 for w, r in zip(row, self.rest, strict=True)) for row in whole]
        return [e if e < 1 << 63 else None for e in exact]


def _against(block: np.ndarray, basis: np.ndarray, floor: float) -> np.ndarray:
    """An orthonormal basis of what ``block`` has outside ``basis``; directions shorter than ``floor`` go."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    q, s, _ = np.linalg.svd(block, full_matrices=False)
    q = q[:, s > floor]
    for _ in range(2):
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0] if q.shape[1] else q
    return q


def components(fit: DataFrame, centre: Centre, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """The k leading eigenvalues, their unit eigenvectors (columns) and the trace of the covariance of ``fit`` (x)."""
    d = centre.size

    def product(q: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            rows = centre.centred(x)
            return rows.T @ (rows @ q)

        return added_up(fit, of, (d, q.shape[1]), "double") / centre.n

    trace = float(added_up(fit, lambda x: (centre.centred(x) ** 2).sum(keepdims=True).reshape(1, 1), (1, 1), "double")[0, 0]) / centre.n
    if trace == 0:
        return np.zeros(0), np.zeros((d, 0)), 0.0
    k = min(k, d)
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((d, min(d, max(BLOCK, k)))))[0]
    image = product(basis)
    for _ in range(ROUNDS):
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = basis @ turn, image @ turn
        residuals = images[:, :k] - vectors[:, :k] * values[:k]
        largest = max(values[0], 0.0)
        if basis.shape[1] >= k and np.linalg.norm(residuals, axis=0).max() <= TOLERANCE * largest:
            return values[:k], vectors[:, :k], trace
        if basis.shape[1] == d:  # the subspace is whole: only rounding is left
            return values[:k], vectors[:, :k], trace
        if basis.shape[1] + BLOCK > max(MOST * BLOCK, 4 * k):
            keep = min(d, 2 * k)
            basis, image = vectors[:, :keep], images[:, :keep]
        more = images[:, :BLOCK] - vectors[:, :BLOCK] * values[: min(BLOCK, len(values))]
        q = _against(more, basis, 1e-15 * largest)
        if not q.shape[1]:
            q = _against(np.random.default_rng(basis.shape[1]).standard_normal((d, min(BLOCK, d - basis.shape[1]))), basis, 0.0)
        basis, image = np.hstack([basis, q]), np.hstack([image, product(q)])
    raise RuntimeError(f"components: not certified after {ROUNDS} passes")


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Each usable row's whitened coordinates, a row for each component.

    (vec_id, component, n, deviation, whitened, explained, identity_error):
    component from 1 by falling eigenvalue; explained: its share of the
    variance; identity_error: the largest entry of the whitened fit list's
    covariance less the identity.
    """
    rows = whole_numbers(vectors)
    fit = written(rows.select("x").dropDuplicates())
    centre = Centre(fit)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    values, directions, trace = components(fit, centre, k) if centre.n else (np.zeros(0), np.zeros((0, 0)), 0.0)
    used = int((values > FLAT * values[0]).sum()) if len(values) else 0
    if not used:
        return vectors.sparkSession.createDataFrame([], schema)
    scaled = directions[:, :used] / np.sqrt(values[:used])
    share = values[:used] / trace

    def spread(x: np.ndarray) -> np.ndarray:
        z = centre.centred(x) @ scaled
        return np.vstack([z.T @ z, z.sum(axis=0)])

    sums = added_up(fit, spread, (used + 1, used), "double") / centre.n
    covariance = sums[:used] - np.outer(sums[used], sums[used])
    error = float(np.abs(covariance - np.eye(used)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column("x"))
            z = centre.centred(x) @ scaled
            m = len(x)
            each = np.repeat(np.arange(m), used)
            deviation = pa.array(centre.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, used + 1, dtype=np.int32), m)), pa.array(np.full(m * used, centre.n, dtype=np.int64)),
                 deviation.take(pa.array(each)), pa.array(z.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * used, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
