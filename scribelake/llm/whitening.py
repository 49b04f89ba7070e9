"""Whitening of embeddings along their leading principal components.

Entries become integers (``floor(scale * c) + offset``), so sums are exact whatever the order of tasks. The fit list holds each distinct
integer vector once. Three passes over it follow: sums per dimension; products of vectors centred on the nearest integer of the mean
(centred before multiplying; what is left of the mean, half a unit at most, is taken off the sums exactly); and, once the components
are known, the covariance of the whitened vectors, which says how far they are from the identity. What reaches the driver is bounded
by the number of dimensions d: d sums, d * (d + 1) / 2 products, k * (k + 1) / 2 checks.

On the driver the d x d covariance becomes tridiagonal by Householder reflections, Sturm counts bisect the leading eigenvalues, inverse
iteration finds their vectors (those of close eigenvalues are kept orthogonal to each other), and the reflections carry them back. The k
components ride to the tasks with the projection: k * d doubles.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType

from scribelake.session import shared_folder

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Vectors a task holds as doubles at a time.
BLOCK = 4_096


# --- eigenpairs of a symmetric matrix ------------------------------------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit reflection vectors (the k-th acts on rows k + 1 and below)."""
    a = np.array(matrix, np.float64)
    n = len(a)
    vectors = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.sqrt(x @ x)
        v = x.copy()
        v[0] += size if v[0] >= 0 else -size
        norm = np.sqrt(v @ v)
        if norm == 0:
            vectors.append(v)
            continue
        v /= norm
        vectors.append(v)
        below = a[k + 1 :, k + 1 :]
        p = below @ v
        w = p - (v @ p) * v
        below -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = x - 2 * (v @ x) * v
    return np.diag(a).copy(), np.array([a[i + 1, i] for i in range(n - 1)]), vectors


def _below(diagonal: np.ndarray, squares: np.ndarray, at: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each value of ``at``."""
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for d, s in zip(diagonal[1:], squares):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d - at - s / q
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected down to neighbouring doubles or a few of them."""
    n = len(diagonal)
    radius = np.abs(np.concatenate((off, [0.0]))) + np.abs(np.concatenate(([0.0], off)))
    low, high = float((diagonal - radius).min()), float((diagonal + radius).max())
    reach = max(abs(low), abs(high), np.finfo(float).tiny)
    squares, tiny = off * off, np.finfo(float).eps * reach * 1e-3
    wanted = n - 1 - np.arange(k)  # so many eigenvalues lie below the one looked for
    a, b = np.full(k, low - 1e-12 * reach), np.full(k, high + 1e-12 * reach)
    while True:
        mid = a + (b - a) / 2
        open_ = (mid > a) & (mid < b) & (b - a > 2 * np.finfo(float).eps * np.maximum(np.abs(a), np.abs(b)))
        if not open_.any():
            return mid
        under = _below(diagonal, squares, mid, tiny) > wanted
        b, a = np.where(open_ & under, mid, b), np.where(open_ & ~under, mid, a)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """``(T - shift) x = right`` by elimination with row exchanges; a vanishing pivot counts as ``tiny``."""
    n = len(diagonal)
    main, up, up2 = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    x, sub = right.tolist(), off.tolist()
    for i in range(n - 1):
        below = sub[i]
        if abs(below) > abs(main[i]):
            f = main[i] / below
            main[i], main[i + 1], up[i] = below, up[i] - f * main[i + 1], main[i + 1]
            up2[i], up[i + 1] = up[i + 1], -f * up[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
        else:
            f = below / (main[i] or tiny)
            main[i + 1] -= f * up[i]
            x[i + 1] -= f * x[i]
    for i in range(n - 1, -1, -1):
        rest = x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (up2[i] * x[i + 2] if i + 2 < n else 0.0)
        pivot = main[i] if abs(main[i]) > tiny else (tiny if main[i] >= 0 else -tiny)
        x[i] = rest / pivot
    return np.array(x)


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as rows."""
    n = len(matrix)
    k = min(k, n)
    size = float(np.abs(matrix).max()) if k else 0.0
    if not size:
        return np.zeros(k), np.eye(n)[:k]
    diagonal, off, reflections = tridiagonal(matrix / size)
    values = leading_values(diagonal, off, k)
    reach = max(float(np.abs(values).max()), np.finfo(float).tiny)
    tiny = np.finfo(float).eps * reach
    found: list[np.ndarray] = []
    start = 0  # first of the eigenvalues that lie close together
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * reach:
            start = i
        x = np.random.default_rng(i).standard_normal(n)
        for _ in range(5):
            for _ in range(2):  # twice is enough for orthogonality to rounding
                for v in found[start:]:
                    x -= (v @ x) * v
            x /= np.sqrt(x @ x)
            x = _solved(diagonal, off, value, x, tiny)
            x /= np.abs(x).max()
        for _ in range(2):
            for v in found[start:]:
                x -= (v @ x) * v
            x /= np.sqrt(x @ x)
        found.append(x)
    vectors = np.array(found)
    for m in range(len(reflections) - 1, -1, -1):
        v = reflections[m]
        vectors[:, m + 1 :] -= 2 * np.outer(vectors[:, m + 1 :] @ v, v)
    return values * size, vectors


# --- vectors in tasks ----------------------------------------------------------------------------------------------------------------


def _whole(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of an Arrow list column hold finite numbers that fit (and ``width`` of them), all entries, starts and lengths of rows."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    flat = vectors.flatten()
    entries = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    good = (lengths > 0) if width is None else (lengths == width) & (lengths > 0)
    fits = np.abs(entries) < 2.0**62 / SCALE  # false for NaN and infinities
    if not fits.all():
        bad = np.concatenate(([0], np.cumsum(~fits)))
        good &= bad[ends] == bad[ends - lengths]
    return good, entries, ends - lengths, lengths


def _integers(entries: np.ndarray) -> np.ndarray:
    return np.floor(entries * SCALE).astype(np.int64) + OFFSET


def _vectors_of(rows: DataFrame, vector: Column) -> DataFrame:
    kind = rows.select(vector).schema[0].dataType
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, (FloatType, DoubleType, ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"Embeddings are arrays of numbers, not {kind.simpleString()}")
    return rows


def integer_vectors(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``x``: the distinct integer vectors of the rows that hold whole ones. Equal vectors meet in tasks first."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, entries, _, lengths = _whole(batch.column(0))
            if not good.any():
                continue
            x = _integers(entries if good.all() else entries[np.repeat(good, lengths)])
            offsets = np.concatenate(([0], np.cumsum(lengths[good])))
            out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([out], ["x"])

    plain = _vectors_of(rows, F.col(vector_col)).select(F.col(vector_col).alias("x"))
    return plain.mapInArrow(convert, "x array<bigint>").distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _summed(fit: DataFrame, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """A fixed-size sum over all vectors: one array of doubles per task, added by Spark entry by entry."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = start(), False
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                any_ = True
                add(total, _matrix(batch.column(0).slice(at, BLOCK)))
        if any_:
            values = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int64)), pa.array(values)], ["at", "v"])

    kind = "bigint" if start().dtype == np.int64 else "double"
    sums = fit.mapInArrow(partial, f"at bigint, v {kind}").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)") if kind == "bigint" else F.col("v")).alias("v"))
    out = start().astype(object if kind == "bigint" else np.float64)
    flat = out.ravel()
    for row in sums.toLocalIterator():
        flat[row["at"]] = int(row["v"]) if kind == "bigint" else row["v"]
    return out


class Fit:
    """What the fit list says: its size, sums, leading eigenpairs, shares of the trace, and the error of the whitened covariance."""

    def __init__(self, fit: DataFrame, components: int = COMPONENTS):
        # The dimension: the commonest length of a vector, of equally common ones the larger.
        lengths = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        self.n, self.d = (int(lengths["count"]), int(lengths["d"])) if lengths else (0, 0)
        self.values, self.explained, self.vectors, self.identity_error = np.zeros(0), np.zeros(0), np.zeros((0, self.d)), 0.0
        self.sums = [0] * self.d
        if not self.n:
            return
        d, n = self.d, self.n
        fit = fit.where(F.size("x") == d)

        def add_entries(total: np.ndarray, x: np.ndarray) -> None:
            # High and low halves apart: neither overflows in a task of less than 2 ** 31 vectors.
            total[0] += (x >> 32).sum(axis=0)
            total[1] += (x & 0xFFFFFFFF).sum(axis=0)

        halves = _summed(fit, lambda: np.zeros((2, d), np.int64), add_entries)
        self.sums = [int(h) * 2**32 + int(low) for h, low in zip(*halves)]
        centre = np.array([(2 * s + n) // (2 * n) for s in self.sums], np.int64)
        left = np.array([(s - int(c) * n) / n for s, c in zip(self.sums, centre)])
        upper = np.triu_indices(d)

        def add_products(total: np.ndarray, x: np.ndarray) -> None:
            y = (x - centre).astype(np.float64)
            total += (y.T @ y)[upper]

        products = _summed(fit, lambda: np.zeros(len(upper[0])), add_products)
        covariance = np.zeros((d, d))
        covariance[upper] = products / n - left[upper[0]] * left[upper[1]]
        covariance = covariance + np.triu(covariance, 1).T
        trace = float(np.trace(covariance))
        values, vectors = leading_pairs(covariance, components)
        # No variance along a component, to rounding: it cannot be whitened.
        kept = values > d * np.finfo(float).eps * trace
        self.values, self.vectors = values[kept], vectors[kept]
        self.explained = self.values / trace if trace > 0 else self.values
        self.centre, self.left = centre, left
        if kept.any():
            self.identity_error = self._checked(fit)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(np.float64) - self.left) @ (self.vectors.T / np.sqrt(self.values))

    def _checked(self, fit: DataFrame) -> float:
        k = len(self.values)

        def add(total: np.ndarray, x: np.ndarray) -> None:
            w = self.whitened(x)
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)

        sums = _summed(fit, lambda: np.zeros((k + 1, k)), add) / self.n
        return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of ``n * x - S`` per row, exactly; none where it is no long."""
        far = max(int(np.abs(x - self.centre).max(initial=0)) + 1, 1) * self.n
        if far * far * self.d < 2**63:
            rest = np.array([s - int(c) * self.n for s, c in zip(self.sums, self.centre)], np.int64)
            off = (x - self.centre) * self.n - rest
            return (off * off).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]


def fitted(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Fit:
    """The fit of all rows; the distinct vectors are written once to the shared folder."""
    spark = rows.sparkSession
    at = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
    integer_vectors(rows, vector_col).write.parquet(at)
    return Fit(spark.read.parquet(at), components)


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for every row with a whole vector and every component.

    Rows whose vector is null, empty, or holds a null, non-finite or too large entry (beyond 2 ** 56) have no result, nor have rows of
    another length than most distinct vectors. Repeated rows and null ids are rows like any other, but a vector counts once in the fit.
    Directions without variance are no components, so equal vectors alone give no rows; an empty table gives none. ``deviation`` is null
    where the exact sum is no long. Other columns are not read.
    """
    fit = fitted(rows, vector_col, components)
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, deviation bigint, w array<double>"
    plain = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"))
    if not len(fit.values):
        plain = plain.where("false")
    d, k = fit.d, len(fit.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                good, entries, starts, _ = _whole(part.column(1), d)
                if not good.any():
                    continue
                x = _integers(entries[starts[good][:, None] + np.arange(d)])
                w = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(x) + 1) * k, k, dtype=np.int32)), pa.array(fit.whitened(x).ravel()))
                ids = part.column(0).filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([ids, pa.array(fit.deviation(x), pa.int64()), w], ["id", "deviation", "w"])

    out = plain.mapInArrow(project, schema).select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(v)) for v in fit.explained]) if k else F.array(F.lit(0.0))
    return out.select(
        "id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(fit.identity_error).alias("identity_error"),
    )
