"""Whitening of embeddings by a cyclic Jacobi eigensolver.

1. One scan sums the fit list: number of vectors and the sum of each dimension, in whole numbers.
2. A second scan centres each vector by the means and sums the products of all pairs of dimensions (the scatter matrix), a
   partial matrix a task, added up by a shuffle of its entries.
3. The driver, which holds that one matrix (dimensions squared, at most MOST_DIMS of them), applies Jacobi rotations, one
   for each pair of dimensions and sweep, until nothing stands off the diagonal. Rotations act on the matrix itself and not
   on a reduced form, so small eigenvalues keep their relative accuracy.
4. Eigenvectors, sorted by falling eigenvalue and divided by its root, are the whitening matrix, which goes to the tasks. A
   third scan takes the covariance of what it makes of the fit list, the last one returns it.

An entry c becomes floor(SCALE * c) + SHIFT, a whole number. Components whose eigenvalue is within the rounding of the matrix
(no variance at all: repeated or constant dimensions) have no direction and are left out, so fewer may come than are asked for.

Handling of odd input: null vectors and vectors with null, NaN or infinite entries, or entries beyond 2**53, are dropped; of
vectors of several lengths, those of the most frequent length stay (of equally frequent ones, the longest); repeated rows and null ids are rows like others; a table
without vectors, or without variance, gives an empty result; a deviation that does not fit 64 bits is null; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm import common

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Dimensions at most: the driver holds a few matrices of their square (2,048: 32 MB each). More of them raise an error.
MOST_DIMS = 2048
#: Rows that are turned into a matrix at a time.
ROWS = 4096
SWEEPS = 60


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors in columns) of a symmetric matrix, by falling eigenvalue.

    The pairs of a sweep come in rounds of disjoint ones, as of a tournament, so that a round is one product of matrices.
    """
    a = np.array(matrix, dtype=np.float64)
    a = (a + a.T) / 2
    d = len(a)
    v = np.eye(d)
    if d < 2:
        return np.diag(a).copy(), v
    players = list(range(d + d % 2))
    rounds = []
    for _ in range(len(players) - 1):
        pairs = [(min(p), max(p)) for p in zip(players[: len(players) // 2], reversed(players[len(players) // 2 :]), strict=True) if max(p) < d]
        rounds.append(np.array(pairs, dtype=np.int64).T)
        players = [players[0], players[-1], *players[1:-1]]
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds:
            apq, app, aqq = a[p, q], a[p, p], a[q, q]
            # A pair is done when its product is below the rounding of its own two diagonal entries, not of the largest.
            on = np.abs(apq) > np.finfo(float).eps / 4 * np.sqrt(np.abs(app * aqq))
            if not on.any():
                continue
            turned = True
            p, q, apq, app, aqq = p[on], q[on], apq[on], app[on], aqq[on]
            with np.errstate(over="ignore"):
                tau = (aqq - app) / (2 * apq)
                t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.sqrt(1 + tau * tau))
            c = 1 / np.sqrt(1 + t * t)
            s = t * c
            for m in (a, v):
                left, right = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            up, low = a[p, :].copy(), a[q, :].copy()
            a[p, :], a[q, :] = c[:, None] * up - s[:, None] * low, s[:, None] * up + c[:, None] * low
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
        if not turned:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    v = v[:, order]
    return values[order], v / np.linalg.norm(v, axis=0)


def _sound(vectors: pa.ListArray, dims: int | None = None) -> np.ndarray:
    """Which rows of a list column hold finite numbers only (and ``dims`` of them)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    entries = pc.list_flatten(vectors)
    x = entries.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = ~(np.abs(np.floor(SCALE * x)) < 2.0**53) if len(x) else np.zeros(0, bool)
    ok = size > 0 if dims is None else size == dims
    if bad.any():
        ok = ok.copy()
        ok[pc.list_parent_indices(vectors).to_numpy()[bad]] = False
    return ok


def _matrices(batches, dims: int):
    """(rows of the batch that stay, their whole-number vectors) a few thousand rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            vectors = part.column("embedding")
            part = part.filter(pa.array(_sound(vectors, dims)))
            if part.num_rows:
                c = pc.list_flatten(part.column("embedding")).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
                yield part, np.floor(SCALE * c).astype(np.int64) + SHIFT


def _sums(batches):
    """Per vector length of a task: number of vectors and sum of each dimension (whole numbers; in text where they pass 64 bits)."""
    held: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        vectors = batch.column("embedding")
        ok = _sound(vectors)
        sizes = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
        for dims in np.unique(sizes[ok]).tolist():
            for _, x in _matrices([batch], dims):
                n, s = held.get(dims, (0, [0] * dims))
                # 2**53 a number and 4,096 rows may pass 63 bits: high and low halves are summed apart.
                high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
                held[dims] = n + len(x), [a + (h << 32) + b for a, h, b in zip(s, high, low, strict=True)]
    for dims, (n, s) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(list(map(str, s)))], names=["dims", "i", "n", "s"])


def fit_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(n, S) of the vectors of the most frequent length; (0, []) of none."""
    made = vectors.mapInArrow(_sums, "dims int, i int, n long, s string").groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    best = made.groupBy("dims").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if best is None:
        return 0, []
    if best.dims > MOST_DIMS:
        raise ValueError(f"vectors of {best.dims} dimensions, {MOST_DIMS} at most are taken")
    rows = made.where(F.col("dims") == best.dims).orderBy("i").collect()
    return int(best.n), [int(r.s) for r in rows]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n in doubles, from the whole part and the rest of the mean apart, so that a mean of any size costs no digits."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n / n for s in sums], dtype=np.float64)
    return (x - whole) - rest


def _scattered(n: int, sums: list[int], matrix: np.ndarray | None):
    """Upper triangle of the products of centred vectors (times ``matrix``, if there is one), and their sums in row -1."""
    dims = len(sums)

    @common.task("whitening")
    def run(batches):
        total, first = None, None
        for _, x in _matrices(batches, dims):
            y = _centred(x, n, sums)
            y = y if matrix is None else y @ matrix
            total = y.T @ y if total is None else total + y.T @ y
            first = y.sum(0) if first is None else first + y.sum(0)
        if total is not None:
            i, j = np.triu_indices(len(total))
            i, j, v = np.concatenate([i, np.full(len(first), -1)]), np.concatenate([j, np.arange(len(first))]), np.concatenate([total[np.triu_indices(len(total))], first])
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(v)], names=["i", "j", "v"])

    return run


def covariance(vectors: DataFrame, n: int, sums: list[int], matrix: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the fit list, divisor n, or of what ``matrix`` makes of its centred vectors."""
    width = len(sums) if matrix is None else matrix.shape[1]
    got = vectors.mapInArrow(_scattered(n, sums, matrix), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (got.column(c).to_numpy() for c in ("i", "j", "v"))
    out, mean, own = np.zeros((width, width)), np.zeros(width), i >= 0
    out[i[own], j[own]] = v[own]
    mean[j[~own]] = v[~own] / n
    out = out + np.triu(out, 1).T
    return out / n - np.outer(mean, mean)  # what rounding left of the mean


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> dict | None:
    """n, sums, matrix (dimensions x components), explained, identity_error; None where no component has variance."""
    n, sums = fit_sums(vectors)
    if n == 0:
        return None
    cov = covariance(vectors, n, sums)
    values, directions = jacobi(cov)
    trace = float(np.trace(cov))
    real = (values > np.finfo(float).eps * len(sums) * max(trace, 0.0))[:components]
    keep = np.flatnonzero(real)
    if not len(keep):
        return None
    matrix = directions[:, keep] / np.sqrt(values[keep])
    error = float(np.abs(covariance(vectors, n, sums, matrix) - np.eye(len(keep))).max())
    return {"n": n, "sums": sums, "matrix": matrix, "explained": values[keep] / trace, "identity_error": error}


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)**2, exact; None beyond 64 bits."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s % n for s in sums]
    far = x - whole  # n*x - S = n*far - rest
    bound = n * (int(np.abs(far).max()) + 1)
    if bound * bound * len(sums) < 2**63:
        y = n * far - np.array(rest, dtype=np.int64)
        return (y * y).sum(1).tolist()
    exact = (sum((n * f - r) ** 2 for f, r in zip(row, rest, strict=True)) for row in far.tolist())
    return [e if e < 2**63 else None for e in exact]


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, fit: dict) -> DataFrame:
    """A row per vector that stays and component, numbered from 1."""
    n, sums, matrix, explained, error = (fit[k] for k in ("n", "sums", "matrix", "explained", "identity_error"))
    shared = vectors.sparkSession.sparkContext.broadcast((matrix, explained))
    k = matrix.shape[1]

    @common.task("whitening")
    def run(batches):
        matrix, explained = shared.value
        for part, x in _matrices(batches, len(sums)):
            y = _centred(x, n, sums) @ matrix
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)), pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each)), pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, OUT)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fits all vectors and returns what the whitening makes of them."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    fit = fitted(rows, components)
    return vectors.sparkSession.createDataFrame([], OUT) if fit is None else whitened(rows, fit)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
