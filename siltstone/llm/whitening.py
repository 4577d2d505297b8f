"""Whitening of vectors on their leading principal components, by Chebyshev-filtered subspace iteration.

Entries become integers, so counts, sums and squared deviations are exact. The covariance V is never formed:
each pass over the vectors returns V times a narrow block, as sums of centred products that Spark adds up by
dimension. A few passes on one vector bound the spectrum from both sides; then a Chebyshev polynomial of V, by its
three-term recurrence of one pass a degree, damps the unwanted part of the spectrum against the wanted one, QR
makes the block orthonormal and Rayleigh-Ritz turns it into approximate eigenvectors. Those whose residual is
small are locked from the top; the rest is filtered again until the wanted ones are locked, and a
last pass certifies all of them together.

The driver holds blocks of dimensions × (components + guard), never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import work_dir

#: An entry c becomes the integer floor(SCALE * c); a constant added to all of them would cancel in every result.
SCALE = 1024
COMPONENTS = 8
#: Columns that are iterated beside the wanted ones.
GUARD = 8
#: Steps of the recurrence that bounds the spectrum, and the highest degree of a filter.
BOUND_STEPS, DEGREE = 12, 24
#: A filter amplifies its largest eigenvalue at most so much more than the unwanted ones, so that rounding loses no other.
AMPLIFY = 1e10
#: Residual, as a share of the largest eigenvalue, below which a vector is an eigenvector to double precision.
TOLERANCE = 1e-13
#: Residual that is accepted where rounding allows no smaller one after this many rounds; above it the job fails.
ACCEPTED, ROUNDS = 1e-11, 60
#: Eigenvalues below this share of the largest are taken for zero: such components cannot be whitened.
RANK = 1e-10
#: Bytes of integers in a block of the written table.
BLOCK_BYTES = 2_000_000
#: Entries of this size and more have no exact integer; their rows are left out like non-finite ones.
LIMIT = 2.0**40


def usable(vector: str) -> F.Column:
    """Whether a vector is there and all its entries are finite numbers in range; an empty one is not."""
    c = F.col(vector)
    fine = F.forall(c, lambda v: F.coalesce(F.abs(v.cast("double")) < LIMIT, F.lit(False)))
    return F.coalesce((F.size(c) > 0) & fine, F.lit(False))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, vector of one length) as blocks: ids, integers, the sums of the columns and the largest size of an entry."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("vector")
        x = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE).astype(np.int64).reshape(batch.num_rows, -1)
        step = max(1, BLOCK_BYTES // (8 * x.shape[1]))
        for k in range(0, len(x), step):
            part = x[k : k + step]
            small = np.abs(part).max() < 2**31
            data = part.astype(np.int32 if small else np.int64).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("vec_id").slice(k, step).to_pylist()], pa.list_(pa.int64())),
                    pa.array([4 if small else 8], pa.int32()),
                    pa.array([data], pa.binary()),
                    pa.array([part.sum(axis=0).tolist()], pa.list_(pa.int64())),
                    pa.array([int(np.abs(part).max())], pa.int64()),
                ],
                ["ids", "width", "data", "sums", "most"],
            )


@dataclass
class Centre:
    """Exact sums of the integers: n rows, and per dimension S = n * whole + rest with 0 <= rest < n."""

    n: int
    dims: int
    whole: np.ndarray
    rest: np.ndarray
    most: int

    def centred(self, data: bytes, width: int) -> np.ndarray:
        return self._less(data, width).astype(np.float64) - self.rest / self.n

    def _less(self, data: bytes, width: int) -> np.ndarray:
        return np.frombuffer(data, np.int32 if width == 4 else np.int64).reshape(-1, self.dims).astype(np.int64) - self.whole

    def deviation(self, data: bytes, width: int) -> list[int]:
        """The sum of (n * x - S)² over the dimensions of each row, exact."""
        less = self._less(data, width)
        bound = self.n * (2 * self.most + 1)
        if self.dims * bound * bound >= 2**63:
            less = less.astype(object)
        far = self.n * less - self.rest
        return (far * far).sum(axis=1).tolist()


class Blocks:
    """The usable vectors as a written table of blocks, with their exact centre."""

    def __init__(self, spark: SparkSession, rows: DataFrame, vec_id: str, vector: str, folder: str):
        self.spark = spark
        good = rows.where(usable(vector)).select(
            F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
        )
        lengths = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        self.dims = lengths["d"] if lengths else 0
        if self.dims:
            same = good.where(F.size("vector") == self.dims)
            packed = same.mapInArrow(_packed, "ids array<long>, width int, data binary, sums array<long>, most long")
            packed.write.parquet(folder)
            self.table = spark.read.parquet(folder)
            of = self.table.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
            sums = [int(r["s"]) for r in of.orderBy("i").collect()]
            sizes = self.table.agg(F.sum(F.size("ids")).alias("n"), F.max("most").alias("most")).first()
            n = int(sizes["n"])
            whole, rest = zip(*(divmod(s, n) for s in sums))
            self.centre = Centre(n, self.dims, np.array(whole, np.int64), np.array(rest, np.int64), int(sizes["most"]))

    def sums_of(self, make, columns: int) -> np.ndarray:
        """The sum over all vectors of ``make(centred block)``, a matrix with ``columns`` columns, added up by row of the matrix."""
        centre = self.centre

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for width, data in zip(batch.column("width").to_pylist(), batch.column("data")):
                    part = make(centre.centred(data.as_buffer(), width))
                    total = part if total is None else total + part
            if total is not None:
                names = ["i", *(f"c{k}" for k in range(columns))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *map(pa.array, np.ascontiguousarray(total.T))], names)

        schema = ", ".join(["i int", *(f"c{k} double" for k in range(columns))])
        read = self.table.select("width", "data").mapInArrow(partial, schema)
        added = read.groupBy("i").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(columns)))
        table = added.toArrow().sort_by("i")
        return np.column_stack([table.column(f"c{k}").to_numpy() for k in range(columns)])

    def times(self, q: np.ndarray) -> np.ndarray:
        """V Q, one pass."""
        return self.sums_of(lambda x: x.T @ (x @ q), q.shape[1]) / self.centre.n

    def variances(self) -> np.ndarray:
        return self.sums_of(lambda x: (x * x).sum(axis=0)[:, None], 1)[:, 0] / self.centre.n


def bounds(times, dims: int, steps: int, rng: np.random.Generator) -> tuple[float, float]:
    """Bounds of the spectrum of a symmetric matrix from a few steps of the Lanczos recurrence on one vector."""
    v = rng.standard_normal(dims)
    basis = [v / np.linalg.norm(v)]
    alpha, beta = [], []
    for _ in range(min(steps, dims)):
        w = times(basis[-1][:, None])[:, 0]
        alpha.append(float(basis[-1] @ w))
        for _ in range(2):
            w = w - np.column_stack(basis) @ (np.column_stack(basis).T @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)):
            break
        basis.append(w / beta[-1])
    values = np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1))
    return max(0.0, values[0] - beta[-1]), values[-1] + beta[-1]


def chebyshev(times, x: np.ndarray, first: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """A polynomial of the matrix applied to x that is small on [low, high] and 1 at ``top``; ``first`` is the matrix times x."""
    half, centre = (high - low) / 2, (high + low) / 2
    sigma = half / (top - centre)
    twice = 2 / sigma
    before, now = x, (first - centre * x) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (twice - sigma)
        before, now = now, (times(now) - centre * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


@dataclass
class Eigen:
    """Leading eigenvalues, largest first, unit eigenvectors as columns, and the largest residual as a share of the first eigenvalue."""

    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int


def leading(times, dims: int, wanted: int, guard: int = GUARD, seed: int = 1) -> Eigen:
    """The ``wanted`` largest eigenvalues of a positive semidefinite matrix given by its products with blocks."""
    passes = 0

    def counted(q):
        nonlocal passes
        passes += 1
        return times(q)

    rng = np.random.default_rng(seed)
    wanted = min(wanted, dims)
    locked, values = np.empty((dims, 0)), np.empty(0)
    width = min(dims, wanted + guard)
    block = np.eye(dims) if width == dims else np.linalg.qr(rng.standard_normal((dims, width)))[0]
    low = bounds(counted, dims, BOUND_STEPS, rng)[0] if width < dims else 0.0

    def free(q):
        """An orthonormal basis of the block outside the locked vectors."""
        for _ in range(2):
            q = np.linalg.qr(q - locked @ (locked.T @ q))[0]
        return q

    for round_ in range(ROUNDS + 1):
        block = free(block)
        image = counted(block)
        ritz, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        largest = max(values[0] if len(values) else ritz[0], np.finfo(float).tiny)
        inside = image - locked @ (locked.T @ image)
        off = np.linalg.norm(inside - block * ritz, axis=0) / largest
        done = 0
        limit = TOLERANCE if round_ < ROUNDS else ACCEPTED
        while done < len(ritz) and len(values) + done < wanted and (off[done] <= limit or width == dims):
            done += 1
        locked, values = np.column_stack((locked, block[:, :done])), np.append(values, ritz[:done])
        block, image, ritz = block[:, done:], image[:, done:], ritz[done:]
        if len(values) == wanted:
            break
        if round_ == ROUNDS:
            raise ArithmeticError(f"residual {off[done]:.1e} after {ROUNDS} rounds")
        high = max(ritz[-1], 1e-9 * largest)
        low_now = min(low, high * (1 - 1e-3))
        top = max(ritz[0], high * (1 + 1e-6))
        centre = (high + low_now) / 2
        # Locked eigenvectors are moved into the middle of what the filter damps.
        moved = lambda q: counted(q) - locked @ ((values - centre)[:, None] * (locked.T @ q))
        first = image - locked @ ((values - centre)[:, None] * (locked.T @ block))
        growth = np.arccosh(max((top - centre) / ((high - low_now) / 2), 1 + 1e-12))
        degree = int(np.clip(np.log(AMPLIFY) / growth, 2, DEGREE))
        block = chebyshev(moved, block, first, degree, low_now, high, top)

    # All wanted vectors together: one more projection orders them and measures their residuals.
    q = np.linalg.qr(locked)[0]
    image = counted(q)
    ritz, turn = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
    ritz, turn = ritz[::-1], turn[:, ::-1]
    vectors = q @ turn
    residual = float(np.linalg.norm(image @ turn - vectors * ritz, axis=0).max() / max(ritz[0], np.finfo(float).tiny))
    if residual > ACCEPTED:
        raise ArithmeticError(f"eigenvectors with a residual of {residual:.1e}")
    return Eigen(ritz, vectors, residual, passes)


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(
    spark: SparkSession, rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per usable vector and component: n, deviation, whitened, explained and identity_error.

    Left out are rows whose vector is null, empty, holds null, non-finite or out-of-range entries, or has another
    length than most (of lengths equally frequent the longest counts). Rows without an id and repeated rows are kept
    and count. Components with a variance of zero do not exist: an empty table, a single vector and equal vectors give no
    row. The deviation is exact up to 38 digits. Extra columns play no part.
    """
    blocks = Blocks(spark, rows, vec_id, vector, work_dir(spark, "vectors"))
    if not blocks.dims:
        return spark.createDataFrame([], SCHEMA)
    trace = float(blocks.variances().sum())
    if trace == 0:
        return spark.createDataFrame([], SCHEMA)
    found = leading(blocks.times, blocks.dims, components)
    k = int((found.values > RANK * found.values[0]).sum())
    values, centre = found.values[:k], blocks.centre
    # A component's sign is that of its largest entry.
    vectors = found.vectors[:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    scaled = vectors / np.sqrt(values)

    def moments(x):
        w = x @ scaled
        return np.vstack((w.T @ w, w.sum(axis=0)))

    sums = blocks.sums_of(moments, k) / centre.n
    error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, width, data in zip(batch.column("ids"), batch.column("width").to_pylist(), batch.column("data")):
                raw = data.as_buffer()
                w = centre.centred(raw, width) @ scaled
                far, ids = pa.array(centre.deviation(raw, width), pa.decimal128(38, 0)), ids.values
                for at in range(0, len(w), 2_000):
                    part = w[at : at + 2_000]
                    m = len(part)
                    of = pa.array(np.repeat(np.arange(at, at + m), k))
                    columns = [
                        ids.take(of),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, centre.n)),
                        far.take(of),
                        pa.array(part.reshape(-1)),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return blocks.table.select("ids", "width", "data").mapInArrow(project, SCHEMA)
