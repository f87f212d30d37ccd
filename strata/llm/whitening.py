"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers ``x = floor(64 * c) + 1000000``.  Then, over all
vectors that remain:

1. count and per-dimension sums, exact;
2. the scatter of the centred vectors: each task centres its rows, multiplies
   them block by block and gives one d x d matrix, and Spark adds these cell by
   cell; the covariance is the sum over n;
3. pivoted Cholesky of the covariance, ``V = G G'`` with one column of G per
   rank, the largest remaining diagonal entry first; it ends where the
   remaining diagonal is rounding noise, which gives the rank;
4. one-sided Jacobi on the columns of G: rotations make them orthogonal, and
   as ``V = (G J)(G J)'`` for any rotation J, the squared norms of the rotated
   columns are V's eigenvalues and the normalised columns its eigenvectors;
   V is not built again and its condition enters only as a root;
5. each row's projections over the root of the eigenvalue; the covariance of
   these, measured in a pass of its own, gives ``identity_error``.

The driver holds d x d numbers (d the dimension), never rows.  All passes are
``mapInArrow`` over the scan.

Cases: rows whose vector is null, empty, holds null or non-finite entries, or
entries that 64 times over don't fit 2**52, are dropped, and so are vectors
shorter than the table's longest; null or repeated vec_id are returned like
any other; components of zero variance (beyond the rank) are not returned, so
equal vectors and an empty table give no rows; a deviation beyond a long is
null; extra columns are not read.  An eigenvector's sign is that which makes
its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import prepare, written
from strata.sources.tables import read_table

SCALE, OFFSET = 64, 1_000_000
ROWS = 1024             # rows that are worked on at once
LARGEST = 2.0 ** 52     # of 64 * c: beyond, a double is no exact whole number plus a fraction


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: the vectors that remain, as whole numbers."""
    c = F.col(vector_col)
    scaled = F.transform(c, lambda e: e.cast("double") * SCALE)
    fits = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) * SCALE <= LARGEST))
    # not by F.floor: cast after the filter, on entries that are known to fit
    return vectors.filter((F.size(c) > 0) & fits).select(
        F.col(id_col).alias("vec_id"), F.transform(scaled, lambda e: F.floor(e) + OFFSET).alias("x"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """The list column as rows x dim whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            if part.num_rows:
                yield _matrix(part.column("x"), dim), part.column("vec_id")


def exact_sums(rows: DataFrame) -> tuple[int, int, list[int]]:
    """``dim, n, S``: the dimension, the vectors of that dimension and their sums, exact."""
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not dim:
        return 0, 0, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, dtype=object)
        for x, _ in _blocks(batches, dim):
            n += len(x)
            # a block's sums fit: ROWS entries of 2**52 at most
            total += x.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, dim), pa.int32()),
                                              "v": pa.array([str(v) for v in [n, *total]], pa.string())})

    got = rows.filter(F.size("x") == dim).mapInArrow(run, "i int, v string").groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    by = {r.i: int(r.v) for r in got}
    return dim, by[-1], [by[i] for i in range(dim)]


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Rows ``i, v`` (arrays) of all tasks, added place by place."""
    cells = parts.select("i", F.posexplode("v").alias("j", "c")).groupBy("i", "j").agg(F.sum("c").alias("c"))
    rows = cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "c"))).getField("c").alias("v"))
    return {r.i: np.array(r.v) for r in rows.collect()}


@dataclass(frozen=True)
class Centre:
    """The mean as a whole number and the rest, so that centring loses nothing of a large mean."""
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, sums: list[int], n: int) -> Centre:
        whole = [s // n for s in sums]
        return cls(np.array(whole, dtype=np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole)]))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest


def covariance(rows: DataFrame, centre: Centre, n: int, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the vectors or, with ``project`` (d x k), of their projections; divisor n.

    Projections of centred vectors have the mean zero up to rounding; what is
    left of it is measured along and taken off.
    """
    dim = len(centre.whole)
    size = dim if project is None else project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean, seen = np.zeros((size, size)), np.zeros(size), False
        for x, _ in _blocks(batches, dim):
            z = centre.centred(x)
            z = z if project is None else z @ project
            total += z.T @ z
            mean += z.sum(axis=0)
            seen = True
        if seen:
            rows = [mean, *total]
            ends = np.arange(len(rows) + 1, dtype=np.int32) * size
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, size), pa.int32()),
                                              "v": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))})

    got = _added(rows.mapInArrow(run, "i int, v array<double>"))
    mean = got[-1] / n
    return np.stack([got[i] for i in range(size)]) / n - np.outer(mean, mean)


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``G`` (d x rank) with ``G @ G.T = v``: the rows of a triangular factor in pivot order, put back in place."""
    d = len(v)
    rest = np.diag(v).astype(np.float64).copy()
    g = np.zeros((d, d))
    noise = d * np.finfo(np.float64).eps * max(rest.max(initial=0.0), 0.0)
    left = np.ones(d, dtype=bool)
    for k in range(d):
        p = int(np.argmax(np.where(left, rest, -np.inf)))
        if rest[p] <= noise:
            return g[:, :k]
        column = v[:, p] - g[:, :k] @ g[p, :k]
        g[p, k] = np.sqrt(rest[p])
        left[p] = False
        g[left, k] = column[left] / g[p, k]
        rest[left] -= g[left, k] ** 2
    return g


def one_sided_jacobi(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``G J`` with orthogonal columns: rounds of disjoint pairs, each turned until it is orthogonal.

    The rounds of a sweep meet every pair once (all columns but the first move
    on by one place).  Ends when no pair's cosine is above rounding.
    """
    g = g.copy()
    r = g.shape[1]
    places = list(range(r + r % 2))
    tiny = np.finfo(np.float64).eps * np.sqrt(max(len(g), 1))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(places) - 1):
            half = len(places) // 2
            pairs = [(a, b) for a, b in zip(places[:half], places[:half - 1:-1]) if a < r and b < r]
            places = [places[0], places[-1], *places[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            a, b = g[:, i], g[:, j]
            alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            cosine = np.abs(gamma) / np.sqrt(np.maximum(alpha * beta, np.finfo(np.float64).tiny))
            worst = max(worst, float(cosine.max()))
            turn = cosine > tiny
            zeta = (beta - alpha) / np.where(turn, 2.0 * gamma, 1.0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1.0 / np.hypot(1.0, t)
            s = c * t
            g[:, i], g[:, j] = c * a - s * b, s * a + c * b
        if worst <= tiny:
            return g
    raise ArithmeticError(f"Jacobi sweeps end with a cosine of {worst:.2e}")


def principal_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a covariance, zero ones left out."""
    scale = float(np.sqrt(np.diag(v).max(initial=0.0)))
    if scale == 0.0:
        return np.zeros(0), np.zeros((len(v), 0))
    turned = one_sided_jacobi(pivoted_cholesky(v / scale ** 2)) * scale
    norms = np.sqrt((turned ** 2).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    units = turned[:, order] / norms[order]
    largest = units[np.abs(units).argmax(axis=0), np.arange(units.shape[1])]
    return norms[order] ** 2, units * np.sign(largest)


def _deviations(x: np.ndarray, centre: Centre, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2 of each row, exact; null beyond a long."""
    shifted = np.array([s - int(w) * n for s, w in zip(sums, centre.whole)], dtype=object)
    y = x - centre.whole
    if float(n) * (float(np.abs(y).max()) + 1.0) * np.sqrt(x.shape[1]) < 2.0 ** 31:
        d = n * y - shifted.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = ((n * y.astype(object) - shifted) ** 2).sum(axis=1)
    return [int(e) if e < 1 << 63 else None for e in exact]


def whitened(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining vector and component (1 to ``components``, by falling eigenvalue).

    Columns: vec_id, component, n, deviation, whitened, explained,
    identity_error; the last is one value for the table, the largest entry of
    the whitened values' covariance minus the identity.
    """
    spark = vectors.sparkSession
    prepare(spark)
    id_type = vectors.select(F.col(id_col).alias("vec_id")).schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = written(whole_vectors(vectors, id_col, vector_col), "vectors")
    dim, n, sums = exact_sums(rows)
    empty = spark.createDataFrame([], schema)
    if not n:
        return empty
    rows = rows.filter(F.size("x") == dim)
    centre = Centre.of(sums, n)
    v = covariance(rows, centre, n)
    values, vectors_ = principal_components(v)
    explained = values / np.trace(v)
    count = min(components, len(values))
    if not count:
        return empty
    project = vectors_[:, :count] / np.sqrt(values[:count])
    error = float(np.abs(covariance(rows, centre, n, project) - np.eye(count)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, ids in _blocks(batches, dim):
            m = len(x)
            yield pa.RecordBatch.from_pydict({
                "vec_id": ids.take(pa.array(np.repeat(np.arange(m), count))),
                "component": pa.array(np.tile(np.arange(1, count + 1), m), pa.int32()),
                "n": pa.array(np.full(m * count, n), pa.int64()),
                "deviation": pa.array(_deviations(x, centre, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), count))),
                "whitened": pa.array((centre.centred(x) @ project).ravel(), pa.float64()),
                "explained": pa.array(np.tile(explained[:count], m), pa.float64()),
                "identity_error": pa.array(np.full(m * count, error), pa.float64())})

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings, whitened on their first 32 components."""
    return whitened(read_table(spark, sf_dir, "embeddings"))
