"""Embedding whitening by QDWH spectral divide and conquer.

Vectors are taken in steps of 1/256 as whole numbers. Their covariance, over distinct vectors, is summed by Spark: first
the sums of each dimension, exactly, then the products of what is left when the mean is taken away. The components come
from the covariance, a matrix whose size is the dimension and not the number of rows, by polar decompositions: with
the unitary polar factor U of the shifted matrix, (U + I) / 2 projects on the components whose eigenvalues are above the shift.
A basis of what it projects on and one of the rest split the matrix in two, and both parts are split again, until
each has one component, or several of one eigenvalue. The polar factor is the limit of the dynamically weighted Halley
iteration, which takes QR decompositions. The components are sent to all tasks, which whiten the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.shared import cut, table

#: Steps of a unit.
SCALE = 256
#: Components of the query.
COMPONENTS = 4
#: Partial sums that are added in one group.
DEALT = 64
EPS = np.finfo(np.float64).eps
#: Splits that are tried before the best of them is taken.
SHIFTS = 6


# --- the components of a symmetric matrix


def polar(x: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix."""
    n = len(x)
    x = x / max(np.linalg.norm(x), np.finfo(np.float64).tiny)  # the Frobenius norm is a bound of the largest singular value
    low, eye = EPS, np.eye(n)  # and this one of the smallest; below it, shifts are refused
    for _ in range(20):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        a = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        new = (b / c) * x + (a - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (a + b * square) / (1 + c * square))
        if moved <= np.cbrt(EPS) * n**0.5 and abs(1 - low) < 10 * EPS:
            break
    return x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Bases of the components of `a` above and below the shift, and what is left between the two; None if one is empty."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(np.trace(projector)))
    if not 0 < k < n:
        return None
    start = np.random.default_rng(n).standard_normal((n, k))
    basis, _ = np.linalg.qr(projector @ start)
    basis, _ = np.linalg.qr(projector @ basis, mode="complete")
    above, below = basis[:, :k], basis[:, k:]
    return above, below, float(np.linalg.norm(above.T @ a @ below))


def components(a: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix; at least the first `most`. Parts that hold
    none of these are not split further. Of each vector the entry of the largest size is positive."""
    n = len(a)
    a = (a + a.T) / 2
    scale = np.linalg.norm(a)
    values, vectors = [], []
    parts = [(np.eye(n), a)]  # from the largest eigenvalues down
    while parts and (most is None or len(values) < most):
        basis, part = parts.pop()
        m = len(part)
        middle = np.trace(part) / m
        if m == 1 or np.linalg.norm(part - middle * np.eye(m)) <= m * EPS * scale:
            values += list(np.diag(part))
            vectors += list(basis.T)
            continue
        spread = np.linalg.norm(part - middle * np.eye(m)) / m**0.5
        best = None
        for shift in [float(np.median(np.diag(part))), *(middle + spread * f for f in (0.0, 0.3, -0.3, 0.6, -0.6))][:SHIFTS]:
            found = split(part, shift)
            if found and (best is None or found[2] < best[2]):
                best = found
            if best and best[2] <= m * EPS * scale:
                break
        if best is None:  # a shift strictly between the ends always parts them, but for rounding: one eigenvalue
            values += list(np.diag(part))
            vectors += list(basis.T)
            continue
        for half in (best[1], best[0]):
            inner = half.T @ part @ half
            parts.append((basis @ half, (inner + inner.T) / 2))
    vectors = np.array(vectors).reshape(-1, n).T
    vectors, _ = np.linalg.qr(vectors) if len(values) > 1 else (vectors, None)  # orthogonal to the last bit
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values[:most], (vectors * np.where(signs == 0, 1, signs))[:, :most]


# --- sums over rows


def steps_of(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is whole (not null, and no entry null, NaN or infinite), with x, the vector in steps."""
    c = F.col(column)
    whole = c.isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.where(whole).withColumn("x", F.transform(c, lambda v: F.floor(v.cast("double") * SCALE)))


def matrix(column, dimension: int | None = None) -> np.ndarray:
    """An Arrow column of lists of longs as rows of a matrix; shorter ones are filled up with zeros."""
    lengths = np.asarray(column.value_lengths())
    width = dimension if dimension is not None else int(lengths.max(initial=0))
    flat = np.asarray(column.flatten())
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def exact_sums(x: np.ndarray) -> list[int]:
    if len(x) and len(x) * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) >= 1 << 62:
        return [sum(c) for c in x.T.tolist()]
    return x.sum(0).tolist()


def sums_of(distinct: DataFrame) -> tuple[int, list[int]]:
    """The number of rows, and the sum of each dimension."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, sums = 0, []
        for batch in batches:
            x = matrix(batch.column(0))
            got = exact_sums(x)
            n += len(x)
            short = max(len(got) - len(sums), 0)
            sums = [a + b for a, b in zip(sums + [0] * short, got + [0] * (len(sums) - len(got)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(sums))], pa.int32()), pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(38, 0))], names=["i", "v"])

    rows = distinct.select("x").mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()  # a row for each dimension
    found = {r["i"]: int(r["v"]) for r in rows}
    return found.pop(-1, 0), [found[i] for i in range(len(found))]


def added(parts: DataFrame) -> np.ndarray:
    """The sum of matrices that tasks give row by row (i, task, row): in groups of so many tasks first, then of those."""

    def add(group):
        import pyarrow as pa

        total = np.vstack([np.asarray(c.flatten()).reshape(len(c), -1) for c in group.column("row").chunks]).sum(0)
        return pa.table({"i": group.column("i").slice(0, 1), "task": pa.array([0], pa.int32()), "row": pa.array([total], pa.list_(pa.float64()))})

    kind = "i int, task int, row array<double>"
    some = parts.withColumn("task", F.pmod("task", F.lit(DEALT))).groupBy("i", "task").applyInArrow(add, kind)
    rows = some.groupBy("i").applyInArrow(add, kind).collect()  # as many rows as the vectors have dimensions
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


def covariance(distinct: DataFrame, n: int, sums: list[int], weights: np.ndarray | None = None) -> np.ndarray:
    """Of the rows' x, or of x without its mean times weights; centred before multiplying, divisor n."""
    d = len(sums)
    mean = np.array([float(Decimal(s) / n) for s in sums])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        total = None
        for batch in batches:
            x = matrix(batch.column(0), d) - mean
            x = x if weights is None else x @ weights
            total = x.T @ x + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(total), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "task", "row"])

    return added(distinct.select("x").mapInArrow(run, "i int, task int, row array<double>")) / n


# --- the operator


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with the sums of their dimensions; eigenvalues and components (columns) of their covariance, its trace,
    and the largest deviation from the identity of the whitened vectors' covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float

    @property
    def weights(self) -> np.ndarray:
        """What a centred vector is multiplied by; NaN for components without variance."""
        return self.vectors / np.sqrt(np.where(self.values > 0, self.values, np.nan))


def fit(steps: DataFrame, most: int | None = None) -> tuple[Whitening, DataFrame]:
    """The whitening of the distinct x of steps_of()'s rows, and these. Components whose eigenvalue is nothing but rounding
    have the value 0. Vectors shorter than the longest are filled up with zeros."""
    distinct = cut(steps.select("x").distinct(), "vectors")  # copies are dropped before the shuffle
    n, sums = sums_of(distinct)
    if not n or not sums:
        return Whitening(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0, 0.0), distinct
    v = covariance(distinct, n, sums)
    values, vectors = components(v, most)
    values = np.where(values > len(v) * EPS * np.trace(v), values, 0.0)
    found = Whitening(n, sums, values, vectors, float(np.trace(v)), 0.0)
    if (real := values > 0).any():
        check = covariance(distinct, n, sums, found.weights[:, real])
        found = Whitening(n, sums, values, vectors, found.trace, float(np.abs(check - np.eye(len(check))).max()))
    return found, distinct


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - sum)^2, exact; null where it is more than a long holds."""
    bound = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
    if bound * bound * max(x.shape[1], 1) < 1 << 63:
        y = x * n - np.array(sums, dtype=np.int64)
        return np.einsum("ij,ij->i", y, y).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, key: str, column: str, most: int | None = None) -> tuple[DataFrame, Whitening]:
    """key, deviation and whitened (an entry for each component) of every row with a whole vector, and the whitening.

    Rows with a null vector, or with a null, NaN or infinite entry, are left out. A row with a null or repeated key
    is a row like any other; other columns are ignored. Equal vectors count once in the covariance. Vectors shorter than the longest
    are filled up with zeros. Along a component without variance (as when all vectors are one) whitened is null. An empty
    table, or vectors of no dimension, give no components. A deviation that a long can't hold is null.
    """
    rows = steps_of(vectors, column)
    found, _ = fit(rows, most)
    mean = np.array([float(Decimal(s) / found.n) for s in found.sums])
    d, weights, n, sums = len(found.sums), found.weights, found.n, found.sums

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(1), d)
            white = (x - mean) @ weights
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)  # NaN is null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(x, n, sums), pa.int64()), lists], names=[key, "deviation", "whitened"])

    kind = vectors.schema[key].dataType.simpleString()
    return rows.select(F.col(key), "x").mapInArrow(run, f"`{key}` {kind}, deviation long, whitened array<double>"), found


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", COMPONENTS)
    share = [float(v / found.trace) if found.trace > 0 else None for v in found.values]
    shares = F.array(*(F.lit(s).cast("double") for s in share)).cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(found.error).alias("identity_error"))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
#: SQL has no eigenvectors; a test holds the query against plain code.
ORACLE_SQL: dict[str, str] = {}
