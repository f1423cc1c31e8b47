"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The fit list (each distinct integer vector once) lies in packed blocks.  Right vectors v, one entry a dimension, are
held by the driver; left vectors u have an entry for every row of the fit list and are never stored: a task finds
its rows' entries again from the right vectors and the coefficients, u_j = (X v_j - sum of c_ij u_i) / a_j.  A step is one
distributed pass over p = X v less what X'u tells of the earlier u's (beta times the last): it gives p's products with
all earlier u's, which reorthogonalise it in full, and X'p, which so becomes X'u.  Right vectors are orthogonalised
twice against all earlier ones.
The singular value decomposition of the small matrix of coefficients (bidiagonal but for rounding and restarts)
gives components and deviations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studybank.llm.common import stored
from studybank.llm.topk import quantised, usable

#: Bytes of a packed block of the fit list (one row at least).
BLOCK_BYTES = 1 << 22
#: Steps after a restart before its chain may show that no component was overlooked.
PROBE = 8

_EPS = np.finfo(np.float64).eps


def _padded(q, width: int):
    """Shorter vectors filled with 0."""
    return F.when(F.size(q) < width, F.concat(q, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(q)))).otherwise(q)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of rows as binary (int64)."""
    at_most = max(1, BLOCK_BYTES // (8 * width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            m = _matrix(b.column("q"), width)
            for lo in range(0, len(m), at_most):
                held.append(m[lo:lo + at_most])
                size += len(held[-1])
                if size >= at_most:
                    all_rows = np.concatenate(held)
                    yield pa.RecordBatch.from_pydict({"block": [all_rows[:at_most].tobytes()]})
                    held, size = [all_rows[at_most:]], size - at_most
        if size:
            yield pa.RecordBatch.from_pydict({"block": [np.concatenate(held).tobytes()]})

    return rows.mapInArrow(pack, "block binary")


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for b in batches:
        for block in b.column("block"):
            yield np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(-1, width)


def _totals(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for x in _blocks(batches, width):
            n += len(x)
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high, low)]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(-1, width), pa.int32()), "part": [str(s) for s in [n] + sums]})

    rows = (blocks.mapInArrow(add, "at int, part string").groupBy("at")
            .agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect())
    found = {r["at"]: int(r["s"]) for r in rows}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def _summed(blocks: DataFrame, width: int, mean: np.ndarray, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all blocks of ``of(centred block)``, an array of ``size`` numbers: added up in each task, then by Spark."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x in _blocks(batches, width):
            total += of(x - mean)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(size), pa.int32()), "part": pa.array(total)})

    out = np.zeros(size)
    for r in blocks.mapInArrow(add, "at int, part double").groupBy("at").agg(F.sum("part").alias("s")).collect():
        out[r["at"]] = r["s"]
    return out


class _Lefts:
    """Entries of the left vectors for the rows of a block, from right vectors and coefficients."""

    def __init__(self, rights: np.ndarray, source: list[int], coefficients: np.ndarray):
        self.rights, self.source, self.coefficients = rights, source, coefficients

    def of(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.rights[:, self.source]
        c = self.coefficients[:, self.source]
        for j in range(y.shape[1]):
            y[:, j] = (y[:, j] - y[:, :j] @ c[:j, j]) / c[j, j]
        return y


def _bidiagonalised(blocks: DataFrame, width: int, n: int, mean: np.ndarray, size2: float, want: int) -> tuple[np.ndarray, np.ndarray]:
    """(``want`` leading right singular vectors as columns, their singular values) of the centred rows.

    Stops when the leading values have converged to rounding and a further chain from a random vector orthogonal to
    all earlier ones, which finds what the first could not reach (equal singular values), has changed none of them."""
    rng = np.random.default_rng(12)
    norm = math.sqrt(size2)
    tiny = 16 * _EPS * max(1.0, math.sqrt(width)) * norm
    rights, products = np.zeros((width, 0)), np.zeros((width, 0))   # v's; X'u's
    source: list[int] = []                                          # the v of each u
    coefficients = np.zeros((0, 0))                                 # u' X v
    start, settled = 0, None

    def orthogonal(w: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(2):
            w = w - rights @ (rights.T @ w)
        return w, float(np.linalg.norm(w))

    def random_right() -> np.ndarray | None:
        if rights.shape[1] >= width:
            return None
        w, size = orthogonal(rng.standard_normal(width))
        w, size = orthogonal(w / size)
        return w / size

    def leading():
        p, s, qt = np.linalg.svd(coefficients, full_matrices=False)
        return p, s, qt.T

    v, chained = random_right(), False
    while v is not None and norm > 0:
        lefts, k = _Lefts(rights, list(source), coefficients), len(source)
        c1 = products.T @ v     # u' X v as known from X'u: the last beta, and rounding

        def step(x, v=v, lefts=lefts, c1=c1):
            u = lefts.of(x)
            p = x @ v - u @ c1
            return np.concatenate((u.T @ p, x.T @ p, [p @ p]))

        got = _summed(blocks, width, mean, step, k + width + 1)
        c2, xp, pp = got[:k], got[k:k + width], got[-1]
        left2 = pp - c2 @ c2
        alpha = math.sqrt(left2) if left2 > 0 else 0.0
        rights = np.column_stack((rights, v))
        coefficients = np.column_stack((coefficients, c1 + c2))
        if alpha <= tiny:       # X v lies in the span of the earlier u's
            if not chained:     # so does every direction left
                break
            v, chained = random_right(), False
            continue
        coefficients = np.vstack((coefficients, np.zeros(coefficients.shape[1])))
        coefficients[-1, -1] = alpha
        source.append(rights.shape[1] - 1)
        u_x = (xp - products @ c2) / alpha
        products = np.column_stack((products, u_x))
        w, beta = orthogonal(u_x)
        if beta <= tiny:
            v, chained = random_right(), False
            start = rights.shape[1]
            continue
        v, chained = w / beta, True
        p, s, _ = leading()
        m = min(want, len(s))
        if m == want and np.all(beta * np.abs(p[-1, :m]) <= 4 * _EPS * s[0]):
            if settled is None:
                settled = s[:m]
            elif rights.shape[1] - start < PROBE:
                continue
            elif np.allclose(settled, s[:m], rtol=1e-12, atol=0):
                break
            else:
                settled = s[:m]
            v, chained = random_right(), False
            start = rights.shape[1]
    if not source:
        return np.zeros((width, 0)), np.zeros(0)
    _, s, q = leading()
    m = int(np.sum(s[:want] > tiny))
    return rights @ q[:, :m], s[:m]


def _oriented(w: np.ndarray) -> np.ndarray:
    """Signs chosen so that the largest entry of each column is positive."""
    if w.shape[1]:
        top = np.abs(w).argmax(axis=0)
        w = w * np.where(w[top, np.arange(w.shape[1])] < 0, -1.0, 1.0)
    return w


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of each row, exact; null beyond a long."""
    span = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if span * span * max(1, len(sums)) < 2 ** 63:
        t = n * x - np.array(sums, dtype=np.int64)
        return (t * t).sum(axis=1).tolist()
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return [e if e < 2 ** 63 else None for e in exact]


def whitened(vectors: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row of ``vectors`` (vec_id, embedding).

    Vectors become integers floor(256 x).  Components are the leading eigenvectors of the covariance of the distinct
    vectors; those without variance (fewer distinct vectors or dimensions than ``components``) give no rows.  Rows whose vector
    is null or holds a null or non-finite entry are dropped.  Rows with null vec_id and repeated rows stay, the latter
    counted once in the fit.  Shorter (or empty) vectors are filled with 0 to the longest.  ``deviation`` is null where it
    passes a long.  An empty table gives no rows; other columns are ignored."""
    ready = vectors.filter(usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding")).alias("q"))
    width = ready.agg(F.max(F.size("q")).alias("w")).first()["w"] or 0
    fields = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return vectors.sparkSession.createDataFrame([], fields)
    rows = ready.select(F.col("vec_id").cast("long").alias("vec_id"), _padded(F.col("q"), width).alias("q"))
    blocks = stored(_packed(rows.select("q").distinct(), width), "whitening-blocks")
    n, sums = _totals(blocks, width)
    mean = np.array([s / n for s in sums])
    size2 = float(_summed(blocks, width, mean, lambda x: np.array([np.einsum("ij,ij->", x, x)]), 1)[0])
    w, s = _bidiagonalised(blocks, width, n, mean, size2, components)
    w, m = _oriented(w), len(s)
    scale = math.sqrt(n) / s
    explained = (s * s / size2).tolist()

    def moments(x):
        z = (x @ w) * scale
        return np.concatenate((z.sum(axis=0), (z.T @ z).ravel()))

    error = 0.0
    if m:
        got = _summed(blocks, width, mean, moments, m + m * m) / n
        error = float(np.abs(got[m:].reshape(m, m) - np.outer(got[:m], got[:m]) - np.eye(m)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("q"), width)
            z = ((x - mean) @ w) * scale
            at = np.repeat(np.arange(len(x)), m)
            deviation = _deviations(x, n, sums) if m else []
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("vec_id").take(pa.array(at)),
                "component": pa.array(np.tile(np.arange(1, m + 1), len(x)), pa.int32()),
                "n": pa.array(np.full(len(at), n), pa.int64()),
                "deviation": pa.array([d for d in deviation for _ in range(m)], pa.int64()),
                "whitened": pa.array(z.ravel(), pa.float64()),
                "explained": pa.array(explained * len(x), pa.float64()),
                "identity_error": pa.array(np.full(len(at), error), pa.float64())})

    return rows.mapInArrow(project, fields)
