"""Whitening of embeddings by QDWH spectral divide and conquer.

Entries become whole numbers, so that counts, sums and squared deviations are exact. The fit is on distinct
vectors: their number and sums come first, then the products of the centred entries, each task adding up a
matrix of its own and Spark adding up the rows of these matrices. Only d x d numbers reach the driver, d being the
length of a vector.

There the symmetric covariance is split without an eigenvalue routine: the orthogonal polar factor U of
V - s I, by dynamically weighted Halley iterations, has the eigenvalues 1 and -1, so (U + I) / 2 projects on the
components above the shift s. An orthonormal basis of its range and one of its complement make two smaller covariances,
and each is split again until every subspace is one component. Of subspaces that lie below the components
wanted nothing more is computed. The components are broadcast as a d x k matrix, and each row is projected where it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_mapped, discard, written

SCALE = 256
COMPONENTS = 4
#: Shifts to try, in standard deviations of the eigenvalues from their mean: an eigenvalue at the shift belongs to neither side.
SHIFTS = (0.0, 0.29, -0.29, 0.57, -0.57, 0.11, -0.11, 0.83, -0.83)
#: How far a projector may be from its own square, and a spectrum from a single value.
PROJECTS, FLAT = 1e-10, 1e-14


def polar(a: np.ndarray, rounds: int = 12) -> np.ndarray:
    """The orthogonal polar factor of a square matrix: Halley iterations with dynamic weights (QR form while the weights are large, then Cholesky form)."""
    n = len(a)
    eye = np.eye(n)
    size = np.sqrt(np.abs(a).sum(axis=0).max() * np.abs(a).sum(axis=1).max())  # no less than the largest singular value
    x, low = a / size, 1e-16
    for _ in range(rounds):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            y = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            half = np.linalg.cholesky(eye + wc * (x.T @ x))
            y = wb / wc * x + (wa - wb / wc) * np.linalg.solve(half.T, np.linalg.solve(half, x.T)).T
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        moved, x = np.abs(y - x).max(), y
        if low > 1 - 1e-15 and moved < 1e-15 * n:
            break
    return x


def split(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the subspaces of a symmetric matrix above and below a shift; None where all its eigenvalues are one. size is the norm of the whole matrix."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if spread <= FLAT * size:
        return None
    start = np.random.default_rng(n).standard_normal((n, n))
    for shift in SHIFTS:
        u = polar(a - (mean + shift * spread) * np.eye(n))
        c = (u + u.T) / 4 + np.eye(n) / 2
        rank = round(float(np.trace(c)))
        if 0 < rank < n and np.linalg.norm(c @ c - c) <= PROJECTS * n:
            q = np.linalg.qr(c @ start[:, :rank])[0]
            q = np.linalg.qr(c @ q, mode="complete")[0]
            return q[:, :rank], q[:, rank:]
    return None  # no shift parts them to double precision


def components(v: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the `count` largest of a symmetric matrix, by falling eigenvalue."""
    v = (v + v.T) / 2
    size = np.linalg.norm(v)
    found: list[tuple[float, np.ndarray]] = []
    stack = [np.eye(len(v))]  # the topmost holds the largest eigenvalues that are left
    while stack and len(found) < count:
        basis = stack.pop()
        own = basis.T @ v @ basis
        own = (own + own.T) / 2
        halves = split(own, size) if basis.shape[1] > 1 and size > 0 else None
        if halves is None:
            found += sorted(((float(own[k, k]), basis[:, k] / np.linalg.norm(basis[:, k])) for k in range(basis.shape[1])), key=lambda e: -e[0])
        else:
            stack += [basis @ halves[1], basis @ halves[0]]
    found = found[:count]
    if not found:
        return np.zeros(0), np.zeros((len(v), 0))
    return np.array([e for e, _ in found]), np.stack([x for _, x in found], axis=1)


def whole_numbers(vector: str) -> Column:
    """floor(SCALE * entry) of each entry, or null where the vector or an entry is null, or an entry isn't finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(F.col(vector).isNotNull() & fine, F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double"))))


def matrix_of(column: pa.Array, d: int) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix of width d; shorter lists end in zeros."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), d), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    out[row, np.arange(offsets[0], offsets[-1]) - offsets[row]] = flat[offsets[0] : offsets[-1]]
    return out


def products(fit: DataFrame, d: int, of, width: int) -> np.ndarray:
    """The sum over all fit vectors of the outer product of `of` of their matrix with itself: a width x width matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = of(matrix_of(batch.column("x"), d))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    rows = arrow_mapped(fit.select("x"), run, "i int, row array<double>").groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(width)])
    out = np.zeros((width, width))
    for r in rows.collect():  # one row for each dimension
        out[r[0]] = r[1:]
    return out


def totals(fit: DataFrame, d: int, of, width: int, kind: str) -> np.ndarray:
    """The sum of `of` over all fit vectors."""
    arrow = {"long": pa.int64(), "double": pa.float64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = of(matrix_of(batch.column("x"), d)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(y, arrow)], ["i", "s"])

    out = [0] * width
    for r in arrow_mapped(fit.select("x"), run, f"i int, s {kind}").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r["i"]] = r["s"]
    return np.array(out)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row with a whole vector and each of its first `count` components.

    Rows whose vector is null or holds null or non-finite entries go; repeated rows and ids, null ids included, each stay with the
    same values; vectors shorter than the longest count as if they ended in zeros, and an
    empty table gives an empty result, as do vectors without entries. Of components with no variance (fewer distinct vectors than dimensions, one vector
    only) whitened is 0, and so it is of their part of identity_error -1; explained is 0 where no component has any.
    Eigenvalues that are equal to double precision have any orthonormal basis of theirs as components. deviation is null where it doesn't fit a long.
    Only the two columns named are read.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), whole_numbers(vector_col).alias("x")).filter("x IS NOT NULL")
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = written(rows.select("x").distinct(), "whitening-fit")
    d = fit.agg(F.max(F.size("x"))).first()[0] or 0
    if not d:
        discard(fit)
        return df.sparkSession.createDataFrame([], schema)
    if fit.filter(F.size("x") < d).head(1):  # vectors that zeros make equal are one
        short, fit = fit, written(fit.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))).alias("x")).distinct(), "whitening-fit")
        discard(short)
    n = fit.count()
    sums = totals(fit, d, lambda x: x, d, "long")
    mean = sums / n
    covariance = products(fit, d, lambda x: x - mean, d) / n
    values, vectors = components(covariance, min(count, d))
    variance = float(np.trace(covariance))
    some = values > FLAT * max(variance, 0.0)
    into = np.where(some, 1 / np.sqrt(np.where(some, values, 1.0)), 0.0)
    project = vectors * into  # d x count: what the closures below carry to the executors
    k = len(values)
    middle = totals(fit, d, lambda x: (x - mean) @ project, k, "double") / n
    error = float(np.abs(products(fit, d, lambda x: (x - mean) @ project - middle, k) / n - np.eye(k)).max())
    explained = values / variance if variance > 0 else np.zeros(k)
    discard(fit)
    total = [int(s) for s in sums]

    def deviations(x: np.ndarray) -> list[int | None]:
        most = max(max(map(abs, total)), int(np.abs(x).max(initial=0)) * n)
        if 4 * d * most * most < 1 << 63:
            return list(((x * n - sums) ** 2).sum(axis=1))
        exact = (sum((n * c - s) ** 2 for c, s in zip(row, total, strict=True)) for row in x.tolist())
        return [e if e < 1 << 63 else None for e in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column("x"), d)
            m = len(x)
            again = pa.array(np.repeat(np.arange(m), k))
            each = lambda values: pa.array(np.tile(values, m), pa.float64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)), pa.array(deviations(x), pa.int64()).take(again),
                pa.array(((x - mean) @ project).ravel()), each(explained), each(np.full(k, error)),
            ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return arrow_mapped(rows, run, schema)
