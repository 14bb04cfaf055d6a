"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries become whole numbers ``floor(64 * c) + 1000000``; the covariance is that of the
distinct vectors, centred before multiplying, divisor n. Its leading eigenvectors come
from a block Q of vectors that only ever meets the data as a distributed pass for XᵀXQ of
the centred X; the covariance matrix itself is never formed:

1. a Chebyshev polynomial of degree ``degree`` is applied to Q by its three-term
   recurrence, a pass a term. It stays small on the unwanted part of the spectrum, from 0
   to the least Ritz value of the block, and grows fast above;
2. QR makes the columns orthonormal, and a Rayleigh-Ritz step (one more pass) turns them
   into the block's best eigenvector estimates;
3. both repeat until every wanted residual ``|Vq - eq|`` is below ``tolerance`` times the
   largest eigenvalue, or no longer falls for rounding. A last pass over the whitened
   rows certifies them: the largest entry of their covariance less the identity.

A pass sums d x m products in every task and adds them up by row of the block; the driver
holds blocks of d x m numbers, of the model's size, whatever the number of rows. Distinct
vectors are found by one exchange that combines copies before they move.

Defined results: rows whose vector is NULL or empty, holds a NULL, NaN or infinity, or is
of another length than most (ties: the longer) are left out, as are rows with an entry
beyond 2**38, too large to add up exactly. Components whose eigenvalue is below
``LEAST_SHARE`` of the largest carry only rounding and are not returned, so there are
fewer than asked where vectors span less, and none where all are equal. ``deviation`` is
NULL where it passes 64 bits. Rows that repeat are whitened alike, each for itself. Other
columns of any name are ignored unless kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.llm.batches import fresh
from heatline.operators.scale import written

COMPONENTS = 16
#: Columns of the block beyond the wanted ones; more of them take fewer passes.
GUARD = 32
DEGREE = 10
MOST_ROUNDS = 60
#: Certified residual, of the largest eigenvalue. Rounding of a pass is about 1e-15.
TOLERANCE = 1e-14
#: A residual above it is an error, not rounding.
LOOSEST = 1e-9
LEAST_SHARE = 1e-10
SCALE, SHIFT = 64, 1_000_000
MOST = float(1 << 44)
#: Rows a numpy step works on.
STEP = 4096


@dataclass(frozen=True)
class Model:
    """Sums, eigenvectors (columns) and eigenvalues of a covariance, largest first."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


def _whole(column: pa.Array, length: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that count, and their entries as whole numbers (rows x length)."""
    column = column.cast(pa.large_list(pa.float64()))
    valid = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(False)
    lengths = np.where(valid, column.value_lengths().fill_null(0).to_numpy(False), 0)
    rows = np.flatnonzero(valid & (lengths == length if length is not None else lengths > 0))
    if not len(rows):
        return rows, np.zeros((0, length or 0), np.int64)
    starts = column.offsets.to_numpy()[rows]
    values = column.values
    entries = values.fill_null(np.nan).to_numpy(False)[starts[:, None] + np.arange(length or 1)]
    scaled = entries * SCALE
    with np.errstate(invalid="ignore"):
        exact = (np.abs(scaled) <= MOST).all(axis=1)
    return rows[exact], np.floor(scaled[exact]).astype(np.int64) + SHIFT


def _length(df: DataFrame, vector: str) -> int | None:
    size = F.size(vector)
    found = df.filter(size > 0).groupBy(size.alias("length")).count()
    row = found.orderBy(F.desc("count"), F.desc("length")).first()
    return row["length"] if row else None


def distinct_vectors(df: DataFrame, vector: str, length: int) -> DataFrame:
    """Each vector of whole numbers once, as bytes (``x``), in a written table."""
    schema = T.StructType([T.StructField("x", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _whole(batch[0], length)
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([packed], names=["x"])

    return written(df.select(vector).mapInArrow(pack, schema).distinct(), "vectors")


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    for batch in batches:
        column = batch[0]
        for at in range(0, len(column), STEP):
            data = b"".join(column[at : at + STEP].to_pylist())
            if data:
                yield np.frombuffer(data, np.int64).reshape(-1, length)


def _summed(fit: DataFrame, length: int, shape: tuple[int, int], work) -> np.ndarray:
    """Sum over all rows of ``work(x)``, a matrix of ``shape``, added up row by row."""
    rows, columns = shape
    names = [f"c{j}" for j in range(columns)]
    schema = T.StructType(
        [T.StructField("i", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in _blocks(batches, length):
            total += work(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(rows, dtype=np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in total.T]],
            names=["i", *names],
        )

    found = fit.mapInArrow(run, schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    out = np.zeros(shape)
    for row in found.collect():
        out[row[0]] = row[1:]
    return out


def _counts(fit: DataFrame, length: int) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums of each dimension."""
    schema = T.StructType(
        [T.StructField("i", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(length, object)
        for x in _blocks(batches, length):
            n, total = n + len(x), total + x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(length, dtype=np.int32)), pa.array([n] * length, pa.int64()), pa.array(list(map(str, total)))],
            names=["i", "n", "s"],
        )

    decimal = "decimal(38,0)"
    sums = fit.mapInArrow(run, schema).groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast(decimal)).alias("s")
    )
    found = {row["i"]: (row["n"], int(row["s"])) for row in sums.collect()}
    if not found:
        return 0, np.zeros(length, object)
    return found[0][0], np.array([found[i][1] for i in range(length)], object)


def _centre(n: int, sums: np.ndarray):
    """A function from whole numbers to ``x - S / n``: first the whole part, then the rest."""
    whole = np.array([int(s) // n for s in sums], np.int64)
    rest = np.array([(int(s) % n) / n for s in sums])
    return lambda x: (x - whole) - rest


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS,
        guard: int = GUARD, degree: int = DEGREE, tolerance: float = TOLERANCE,
        seed: int = 12) -> Model | None:
    """The leading components of the distinct vectors; None where there is none."""
    length = _length(df, vector)
    if length is None:
        return None
    table = distinct_vectors(df, vector, length)
    n, sums = _counts(table, length)
    if not n:
        return None
    centre = _centre(n, sums)
    trace = _summed(table, length, (1, 1), lambda x: np.square(centre(x)).sum(keepdims=True))[0, 0] / n
    passes = 3

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def work(x: np.ndarray) -> np.ndarray:
            z = centre(x)
            return z.T @ (z @ block)

        return _summed(table, length, block.shape, work) / n

    width = min(length, components + guard)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((length, width)))[0]
    values, vectors, image = _ritz(block, product(block))
    best, stuck = np.inf, 0
    for _ in range(MOST_ROUNDS):
        wanted = min(components, int((values > LEAST_SHARE * max(values[0], 0)).sum()))
        gaps = np.linalg.norm(image - vectors * values, axis=0)[:wanted]
        residual = float(gaps.max(initial=0) / values[0]) if wanted else 0.0
        stuck = 0 if residual < best / 2 else stuck + 1
        best = min(best, residual)
        if residual <= tolerance or width == length or (stuck > 2 and residual < LOOSEST):
            break
        block = _filtered(vectors, image, product, degree, max(values[-1], LEAST_SHARE * values[0]), values[0])
        block = np.linalg.qr(block)[0]
        values, vectors, image = _ritz(block, product(block))
    if residual > LOOSEST:
        raise RuntimeError(f"whitening: residual {residual:.1e} after {passes} passes")
    vectors, values = vectors[:, :wanted], values[:wanted]

    def spread(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ (vectors / np.sqrt(values))
        return w.T @ w

    error = 0.0
    if wanted:
        passes += 1
        error = float(np.abs(_summed(table, length, (wanted, wanted), spread) / n - np.eye(wanted)).max())
    return Model(n, sums, vectors, values, float(trace), residual, error, passes)


def _ritz(block: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (largest first), Ritz vectors, and the covariance times them."""
    small = block.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], block @ turn, image @ turn


def _filtered(block, image, product, degree: int, cut: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of the covariance times ``block``.

    Small on [0, cut], and 1 at ``top``. ``image`` is the covariance times ``block``.
    """
    half = cut / 2
    ratio = first = half / (half - top) if top != half else -1.0
    earlier, latest = block, (image - half * block) * (ratio / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - ratio)
        latest, earlier = (
            (product(latest) - half * latest) * (2 * following / half) - earlier * (ratio * following),
            latest,
        )
        ratio = following
    return latest


def whitened(df: DataFrame, model: Model | None, vector: str = "embedding", keep: list[str] = ()) -> DataFrame:
    """A row for each counted row and component, with the columns ``keep``."""
    kept = [df.schema[c] for c in keep]
    names = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()),
             ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    taken = df.select(*keep)
    schema = T.StructType([*kept, *[T.StructField(fresh(taken, name), kind) for name, kind in names]])
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    n, sums = model.n, model.sums
    centre, length = _centre(n, sums), len(sums)
    turn = model.vectors / np.sqrt(model.values)
    wanted, shares = len(model.values), model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _whole(batch[0], length)
            for at in range(0, len(rows), STEP):
                some = x[at : at + STEP]
                # Rows of their own keep a row's result apart from those beside it.
                w = np.einsum("ij,jk->ik", centre(some), turn)
                times = np.repeat(rows[at : at + STEP], wanted)
                count = len(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[column.take(pa.array(times)) for column in batch.columns[1:]],
                        pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), count)),
                        pa.array(np.full(count * wanted, n, np.int64)),
                        pa.array(_deviations(some, n, sums)).take(pa.array(np.repeat(np.arange(count), wanted))),
                        pa.array(w.reshape(-1)),
                        pa.array(np.tile(shares, count)),
                        pa.array(np.full(count * wanted, model.identity_error)),
                    ],
                    names=schema.names,
                )

    return df.select(vector, *keep).mapInArrow(run, schema)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum of (n x - S)**2 of each row, exactly; NULL beyond 64 bits."""
    low, high = [int(s) // n for s in sums], np.abs(x).max(initial=0)
    bound = max(abs(int(high)), *[abs(v) for v in low]) * n
    if bound < 1 << 62:
        off = x * n - np.array([int(s) for s in sums], np.int64)
        if int(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return pa.array((off * off).sum(axis=1))
    off = x.astype(object) * n - sums
    total = (off * off).sum(axis=1)
    return pa.array([v if v < 1 << 63 else None for v in total], pa.int64())
