"""Standardise, k-means sweep, silhouette, cluster assignment.

Vectors stay ``array<double>`` columns transformed with higher-order
functions (JVM side); MLlib's ``KMeans`` does the clustering.  Per-dimension
statistics are a scalar subquery whose size is the vector length, not the
row count.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from strata.operators import lloyd
from strata.operators.evaluate import sample_rows
from strata.session import even_rows, materialize, ship_package

SAMPLE = 2_000      # rows of the source's silhouette
BLOCK = 256         # sampled rows that are met with the whole sample at once
PANEL_BYTES = 8 << 20       # rows that all tasks meet with theirs at once
TASK_ROWS = (20_000, 1_000_000)     # rows of a task of one k-means iteration


# ------------------------------------------------------------------ M12

def dimension_stats(df: DataFrame, vec: str) -> DataFrame:
    """Per-dimension mean and population std (one row per dimension).

    One pass over the vectors as they are; the summarizer's sample variance
    is rescaled to the population's.
    """
    double = F.transform(vec, lambda x: x.cast("double"))
    m = df.filter(F.col(vec).isNotNull()).select(Summarizer.metrics("mean", "variance", "count").summary(
        array_to_vector(double)).alias("m"))
    n = F.col("m.count")
    arrays = m.select(F.posexplode(F.arrays_zip(vector_to_array("m.mean").alias("mean"), vector_to_array("m.variance").alias("var"))), n.alias("n"))
    return arrays.select(F.col("pos").alias("dim"), F.col("col.mean").alias("mean"),
                         F.sqrt(F.col("col.var") * (F.col("n") - 1) / F.col("n")).alias("std"))


def standardize(df: DataFrame, vec: str, out: str = "z") -> DataFrame:
    """Zero mean, unit population std per dimension; a zero std counts as 1.

    The mean/std arrays come from a scalar subquery over the per-dimension
    statistics (as many rows as dimensions) and are applied with
    ``transform``, so rows are never exploded or joined.
    """
    stats = dimension_stats(df, vec)
    packed = stats.select(F.array_sort(F.collect_list(F.struct("dim", "mean", "std")))
                          .alias("s")).scalar()

    def z(x, i):
        s = F.element_at(F.col("_stats"), i + 1)
        sd = F.when(s["std"] > 0, s["std"]).otherwise(F.lit(1.0))
        return (x.cast("double") - s["mean"]) / sd

    # bind the subquery to a column first: subqueries may not sit inside a lambda
    return (df.withColumn("_stats", packed)
            .withColumn(out, F.transform(F.col(vec), z)).drop("_stats"))


def scaler_model(df: DataFrame, vec: str) -> dict:
    """Mean/std per dimension as plain lists (stored with a model to score new rows)."""
    rows = dimension_stats(df, vec).orderBy("dim").collect()  # one row per dimension
    return {"mean": [r["mean"] for r in rows],
            "std": [r["std"] if r["std"] and r["std"] > 0 else 1.0 for r in rows]}


def apply_scaler(df: DataFrame, vec: str, scaler: dict, out: str = "z") -> DataFrame:
    mean = F.array(*[F.lit(float(v)) for v in scaler["mean"]])
    std = F.array(*[F.lit(float(v)) for v in scaler["std"]])
    return df.withColumn(out, F.transform(
        F.col(vec), lambda x, i: (x.cast("double") - F.element_at(mean, i + 1))
        / F.element_at(std, i + 1)))


# ------------------------------------------------------------------ M14

def _score(df: DataFrame, cluster: str) -> float | None:
    """Silhouette of rows with a vector ``_v``; None with fewer than two clusters."""
    labels = df.filter(F.col(cluster).isNotNull()).select(F.col(cluster).cast("double").alias("_c"), "_v")
    if len(labels.select("_c").distinct().limit(2).collect()) < 2:
        return None
    return ClusteringEvaluator(featuresCol="_v", predictionCol="_c").evaluate(labels)


def silhouette(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Mean silhouette of all rows, from squared Euclidean distances.

    MLlib needs one pass for each cluster's count, vector sum and sum of
    squared norms, and one that scores every row against these, so the work
    is rows x clusters however many rows there are.  Rows without a cluster
    don't count; with fewer than two clusters the value is NULL.
    """
    value = _score(df.select(array_to_vector(vec).alias("_v"), F.col(cluster).alias("cluster")), "cluster")
    return df.sparkSession.createDataFrame([(value,)], "silhouette double")


def plain_silhouette(df: DataFrame, id_col: str, vec: str, cluster: str, n: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(silhouette, n_rows): plain Euclidean distances among ``n`` seeded rows, as the source samples.

    The sample (the ``n`` smallest hash keys of rows with a cluster and a
    vector) has a fixed bound, so it travels to the tasks whole; every task
    meets blocks of it with all of it by one matrix product.  A row alone in
    its cluster counts 0; with fewer than two clusters the value is NULL.
    """
    rows = df.filter(F.col(cluster).isNotNull() & F.col(vec).isNotNull()).select(
        F.col(id_col).alias("_id"), F.transform(vec, lambda x: x.cast("double")).alias("_x"), F.col(cluster).cast("string").alias("_c"))
    sample = materialize(sample_rows(rows, "_id", n, seed), "silhouette-sample")
    return _plain_score(sample)


def _plain_score(sample: DataFrame) -> DataFrame:
    """:func:`plain_silhouette` of a bounded table (_id, _x, _c)."""
    spark = sample.sparkSession
    ship_package(spark)
    got = sample.select("_x", "_c").toPandas()
    names, codes = np.unique(got["_c"].to_numpy(dtype=str), return_inverse=True)
    x = np.stack(got["_x"].to_numpy()).astype(np.float64) if len(got) else np.zeros((0, 1))
    if len(names) < 2:
        return spark.createDataFrame([(None, len(got))], "silhouette double, n_rows long")
    one_hot = np.eye(len(names))[codes]
    sent = spark.sparkContext.broadcast((x, one_hot))

    def run(batches):
        x, member = sent.value
        sizes, norms = member.sum(axis=0), (x * x).sum(axis=1)
        for b in batches:
            for at in b["block"]:
                i = slice(at * BLOCK, (at + 1) * BLOCK)
                square = norms[i, None] + norms[None, :] - 2.0 * (x[i] @ x.T)
                far = np.sqrt(np.maximum(square, 0.0))
                far[np.arange(len(far)), np.arange(at * BLOCK, at * BLOCK + len(far))] = 0.0
                total, own = far @ member, member[i] > 0
                alone = sizes[None, :][np.zeros(len(far), dtype=int)][own] < 2
                a = total[own] / np.maximum(sizes[None, :] - 1, 1).repeat(len(far), 0)[own]
                nearest = np.where(own, np.inf, total / sizes).min(axis=1)
                wide = np.maximum(a, nearest)
                s = np.where(alone | (wide == 0), 0.0, (nearest - a) / np.where(wide == 0, 1.0, wide))
                yield pd.DataFrame({"s": [s.sum()]})

    blocks = spark.range(0, -(-len(x) // BLOCK), 1, -(-len(x) // BLOCK)).select(F.col("id").alias("block"))
    return blocks.mapInPandas(run, "s double").agg((F.sum("s") / len(x)).alias("silhouette"),
                                                    F.lit(len(x)).cast("long").alias("n_rows"))


def plain_silhouettes(rows, fits: list) -> list:
    """Mean silhouette of all rows in plain Euclidean distances, for each fit's centres (:func:`lloyd.matrices` of the rows).

    Every row is met with every other once for all fits, which is quadratic by
    nature.  The rows come to the tasks in panels of PANEL_BYTES, one job each;
    beside its rows a task keeps their sums of distances to every cluster, so memory
    is bounded by the rows of a task and a panel.  None for fewer than two clusters.
    """
    if not fits:
        return []
    sizes, centres = [len(c) for c in fits], np.concatenate(fits)
    starts = np.concatenate([[0], np.cumsum(sizes)])

    def labelled(blocks):
        for x in blocks:
            yield x, np.stack([label + at for at, (label, _) in zip(starts, lloyd.nearest(x, centres, sizes))]), np.zeros((len(x), starts[-1]))

    state = rows.mapPartitions(labelled).persist(lloyd.KEPT)
    members = state.map(lambda b: np.bincount(b[1].ravel(), minlength=starts[-1])).fold(np.zeros(starts[-1]), lambda a, b: a + b)
    panel_rows = max(1, PANEL_BYTES // (8 * sum(centres.shape)))
    counts = state.mapPartitions(lambda blocks: [[len(x) for x, *_ in blocks]]).collect()
    old, sent = [], []
    for part, sizes_of in enumerate(counts):
        for first, last in _panels(sizes_of, panel_rows):
            # few partitions are read for a panel: only its own
            got = state.mapPartitionsWithIndex(lambda p, blocks, part=part, first=first, last=last: (
                (x, label) for i, (x, label, _) in enumerate(blocks) if p == part and first <= i < last))
            panel = state.context.runJob(got, list, [part])
            panel = np.concatenate([x for x, _ in panel]), np.concatenate([label for _, label in panel], axis=1)
            sent.append(state.context.broadcast(panel))
            new = state.mapPartitions(lambda blocks, panel=sent[-1]: _with_distances(blocks, panel.value, int(starts[-1]))).persist(lloyd.KEPT)
            new.foreach(lambda b: None)
            old.append(state)
            state = new
            while len(old) > 1:
                old.pop(0).unpersist()

    def values(blocks):
        out = np.zeros(len(sizes))
        for x, label, total in blocks:
            for f, (a, b) in enumerate(zip(starts, starts[1:])):
                own, n = label[f], members[a:b]
                rows_at, there = np.arange(len(x)), n > 0
                inside = total[rows_at, own] / np.maximum(members[own] - 1, 1)
                mean = np.where(there, total[:, a:b] / np.maximum(n, 1), np.inf)
                mean[rows_at, own - a] = np.inf
                other = mean.min(axis=1)
                wide = np.maximum(inside, other)
                zero = (members[own] < 2) | (wide == 0) | ~np.isfinite(other)
                out[f] += np.where(zero, 0.0, (other - inside) / np.where(zero, 1.0, wide)).sum()
        yield out
    got = state.mapPartitions(values).reduce(lambda a, b: a + b)
    for rdd in (*old, state):
        rdd.unpersist()
    for b in sent:
        b.destroy()
    return [float(v / members[a:b].sum()) if (members[a:b] > 0).sum() > 1 else None for v, a, b in zip(got, starts, starts[1:])]


def _panels(sizes, most: int):
    """(first, last) of runs of blocks that have at most ``most`` rows, or one block."""
    first, n = 0, 0
    for i, size in enumerate(sizes):
        if n and n + size > most:
            yield first, i
            first, n = i, 0
        n += size
    if n:
        yield first, len(sizes)


def _with_distances(blocks, panel, clusters: int):
    """The blocks with the distances from every row to the panel's rows added, by cluster."""
    others, labels = panel
    norms = (others * others).sum(axis=1)
    member = np.zeros((len(others), clusters))
    for label in labels:
        member[np.arange(len(others)), label] = 1.0
    for x, label, total in blocks:
        total = total.copy()
        step = max(16, lloyd.CELLS // max(1, len(others)))
        for i in range(0, len(x), step):
            mine = x[i:i + step]
            own = (mine * mine).sum(axis=1)[:, None]
            far = mine @ others.T
            far *= -2.0
            far += own
            far += norms
            far *= far > 1e-13 * own        # what rounding leaves of equal rows
            np.sqrt(far, out=far)
            total[i:i + step] += far @ member
        yield x, label, total


# ------------------------------------------------------------------ M13, M15, M16

def mllib_tolerance(df: DataFrame, vec: str, tol: float = 1e-4):
    """k -> MLlib tolerance equivalent to a relative k-means tolerance.

    The source's rule stops when the summed squared centre shift is at most
    ``tol`` x mean per-dimension variance; MLlib stops when every centre
    moves at most ``t``.  With ``t = sqrt(tol * mean_var / k)`` the MLlib stop
    implies the source's (sum over k centres <= k * t^2).  The variance
    comes from the per-dimension statistics (one row per dimension).
    """
    mean_var = dimension_stats(df, vec).agg(F.avg(F.col("std") * F.col("std"))).first()[0]
    mean_var = mean_var or 1.0
    return lambda k: math.sqrt(tol * mean_var / k)


def _fit(data: DataFrame, k: int, seed: int, max_iter: int, tol: float):
    # blocks: the vectors are cached as matrices once, not decoded row by row in every iteration
    km = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="_v",
                predictionCol="cluster", solver="block")
    model = km.fit(data)
    return model, model.summary.trainingCost


def _vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """The rows' ids, and their vectors as ``_v``, persisted in even partitions.

    Every iteration of every fit is a job over all rows, so its tasks are as
    few and as even as the cores allow, whatever files the rows come from.
    MLlib keeps costs beside the rows by their place, so the rows of a
    partition have an order.  Both go by the id: the last bits of a
    standardised entry may differ between runs and must not move a row.
    """
    rows = df.select(id_col, F.col(vec).alias("_x"))
    even = even_rows(rows, rows.count(), *TASK_ROWS, id_col).sortWithinPartitions(id_col, "_x")
    return even.select(id_col, array_to_vector("_x").alias("_v")).persist(StorageLevel.MEMORY_AND_DISK)


def _threads(data: DataFrame) -> int:
    """Concurrent fits: their tasks are twice the cores (a fit waits between its jobs); 3 to 32.

    Every running fit caches the vectors in blocks of its own, so large fits run few at a time.
    """
    cores = data.sparkSession.sparkContext.defaultParallelism
    return max(3, min(32, 2 * cores // max(1, data.rdd.getNumPartitions())))


def best_of_restarts(data: DataFrame, k: int, restarts: int, seed: int = 42,
                     max_iter: int = 300, tol: float = 1e-4, threads: int | None = None):
    """Fit ``restarts`` seeds (concurrent Spark jobs) and keep the lowest cost.

    ``tol`` here is MLlib's absolute centre-shift tolerance.
    """
    threads = threads or _threads(data)
    with ThreadPoolExecutor(max_workers=threads) as ex:
        fits = list(ex.map(lambda r: _fit(data, k, seed + r, max_iter, tol), range(restarts)))
    return min(fits, key=lambda f: f[1])


def kmeans_search(df: DataFrame, id_col: str, vec: str, ks=range(2, 9), restarts: int = 10,
                  final_restarts: int = 20, seed: int = 42, tol: float = 1e-4, euclidean: bool = True):
    """Sweep k, choose k by the silhouette of all rows, fit the final model.

    Returns ``(sweep, k, model)``; the sweep has the silhouette in squared distances
    and, with ``euclidean``, in plain distances between all rows
    (:func:`plain_silhouettes`; NULL without).  10 and 20 seeded k-means|| starts are
    the source's settings.  All (k, restart) fits go through the rows together
    (``lloyd.py``).  The final fit keeps the best of ``final_restarts`` seeds at the
    chosen k and reuses the sweep's fits.  ``tol`` is the source's relative
    tolerance (see :func:`mllib_tolerance`).
    """
    spark = df.sparkSession
    data = _vectors(df, id_col, vec)
    tol_for = mllib_tolerance(data.select(vector_to_array("_v").alias("_x")), "_x", tol)
    rows = lloyd.matrices(data.select(vector_to_array("_v").alias("_x")), "_x")

    def run(jobs):
        return dict(zip(jobs, lloyd.fit_all(rows, [(k, seed + r) for k, r in jobs], tol_for)))

    def mllib(centres):
        return lloyd.to_mllib(spark, centres, "_v", "cluster", seed)

    try:
        fits = run([(k, r) for k in ks for r in range(restarts)])
        best = {k: min((fits[(k, r)] for r in range(restarts)), key=lambda f: f[1]) for k in ks}
        labelled = [mllib(best[k][0]).transform(data) for k in ks]
        with ThreadPoolExecutor(max_workers=_threads(data)) as ex:
            sils = dict(zip(ks, ex.map(lambda df: _score(df, "cluster"), labelled)))
        plain = dict(zip(ks, plain_silhouettes(rows, [best[k][0] for k in ks]) if euclidean else [None] * len(ks)))
        table = [(int(k), float(best[k][1]), None if sils[k] is None else float(sils[k]), plain[k]) for k in ks]
        sweep = spark.createDataFrame(table, "k int, inertia double, silhouette double, silhouette_euclidean double")
        scored = [r for r in table if r[2] is not None]
        k_best = (max(scored, key=lambda r: (r[2], -r[0]))[0] if scored else table[0][0])
        model = None
        if final_restarts:
            if final_restarts > restarts:
                fits.update(run([(k_best, r) for r in range(restarts, final_restarts)]))
            model = mllib(min((fits[(k_best, r)] for r in range(max(restarts, final_restarts))), key=lambda f: f[1])[0])
    finally:
        rows.unpersist()
        data.unpersist()
    return sweep, k_best, model


def kmeans_sweep(df: DataFrame, id_col: str, vec: str, ks=range(2, 9), restarts: int = 10,
                 seed: int = 42) -> DataFrame:
    """Per k: inertia of the best restart and its silhouettes over all rows."""
    return kmeans_search(df, id_col, vec, ks, restarts, 0, seed)[0]


def choose_k(sweep: DataFrame, by: str = "silhouette") -> DataFrame:
    """k with the largest silhouette (smallest k on ties), by either kind."""
    return sweep.orderBy(F.desc_nulls_last(by), "k").limit(1)


def assign_clusters(df: DataFrame, id_col: str, vec: str, k: int, restarts: int = 1,
                    seed: int = 42, tol: float = 1e-4):
    """Final fit (best of restarts); returns (rows with ``cluster``, model).

    ``tol`` is the relative tolerance of the source (see :func:`mllib_tolerance`).
    """
    data = df.withColumn("_v", array_to_vector(vec))
    fitted = _vectors(df, id_col, vec)
    try:
        tol_for = mllib_tolerance(fitted.select(vector_to_array("_v").alias("_x")), "_x", tol)
        model, _ = best_of_restarts(fitted, k, restarts, seed, tol=tol_for(k))
    finally:
        fitted.unpersist()
    return model.transform(data).drop("_v"), model
