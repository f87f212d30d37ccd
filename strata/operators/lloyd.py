"""k-means fits that go through the rows together: k-means|| starts and Lloyd's iterations.

The rows are cached once as matrices.  An iteration is one job for all fits that
still move: a task meets its rows with the centres of all fits by one matrix
product and sends each fit's sums, sizes and cost, so a sweep of many k and
restarts takes as many jobs as its slowest fit.  The driver holds centres and sums
only, whose size is that of the models.  Starts and stops are MLlib's: k-means||
with two steps and weighted k-means++ on its candidates; a fit ends when no centre
moves by more than its tolerance, and an empty cluster keeps its centre.
"""

from __future__ import annotations

import json
import pickle
import time
import uuid

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from strata.session import scratch_path, ship_package

BLOCK_ROWS = 1 << 14        # rows of a cached matrix
CELLS = 1 << 20             # distances that a task holds at once
STEPS = 2                   # of k-means||
KEPT = StorageLevel.MEMORY_AND_DISK_DESER


def matrices(df, vec: str):
    """An RDD of the rows' vectors as matrices, one or more a partition, persisted."""
    ship_package(df.sparkSession)

    def run(batches):
        for b in batches:
            for i in range(0, len(b), BLOCK_ROWS):
                yield pd.DataFrame({"block": [pickle.dumps(np.stack(b["x"].iloc[i:i + BLOCK_ROWS].to_numpy()).astype(np.float64), protocol=5)]})
    blocks = df.selectExpr(f"`{vec}` AS x").mapInPandas(run, "block binary").rdd
    return blocks.map(lambda r: pickle.loads(r[0])).persist(KEPT)


# ------------------------------------------------------------------ in the tasks

def nearest(x, centres, sizes):
    """For every fit the number of each row's nearest centre (the first of equal ones) and its squared distance.

    ``centres`` has those of all fits one after the other, ``sizes`` how many each has.
    """
    norms, own = (centres * centres).sum(axis=1), (x * x).sum(axis=1)
    far = norms[:, None] - 2.0 * (centres @ x.T)
    at = 0
    for k in sizes:
        best, label = far[at].copy(), np.zeros(len(x), dtype=np.int32)
        for j in range(1, k):
            closer = far[at + j] < best
            np.copyto(label, j, where=closer)
            np.minimum(best, far[at + j], out=best)
        yield label, np.maximum(best + own, 0.0)
        at += k


def parts_of(blocks, n_centres: int):
    """(number, rows) of pieces whose distances to all centres fit into CELLS."""
    step, i = max(64, CELLS // max(1, n_centres)), 0
    for x in blocks:
        for at in range(0, len(x), step):
            yield i, x[at:at + step]
            i += 1


def sums_of(blocks, centres, sizes):
    """One (sums, counts, costs) of a task: of each centre's rows, and of each fit."""
    sums, counts, costs = np.zeros(centres.shape), np.zeros(len(centres)), np.zeros(len(sizes))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for _, x in parts_of(blocks, len(centres)):
        member = np.zeros(len(centres) * len(x))
        rows = np.arange(len(x))
        for f, (label, cost) in enumerate(nearest(x, centres, sizes)):
            member[(label + starts[f]) * len(x) + rows] = 1.0
            costs[f] += cost.sum()
        member = member.reshape(len(centres), len(x))
        sums += member @ x
        counts += member.sum(axis=1)
    yield sums, counts, costs


def drawn(part: int, blocks, centres, sizes, shares, seeds, step: int):
    """(fit, row) of the rows that k-means|| draws: with ``shares`` x their cost for each fit."""
    for i, x in parts_of(blocks, len(centres)):
        for f, (_, cost) in enumerate(nearest(x, centres, sizes)):
            for row in np.flatnonzero(np.random.default_rng((*seeds[f], step, part, i)).random(len(x)) < shares[f] * cost):
                yield f, x[row]


# ------------------------------------------------------------------ on the driver

def _add(a, b):
    return tuple(x + y for x, y in zip(a, b))


def totals(data, centres: list):
    """(sums, counts, cost) for each fit, from one job."""
    sizes = [len(c) for c in centres]
    sent = data.context.broadcast(np.concatenate(centres))
    try:
        sums, counts, costs = data.mapPartitions(lambda blocks: sums_of(blocks, sent.value, sizes)).reduce(_add)
    finally:
        sent.destroy()
    ends = np.cumsum(sizes)
    return [(sums[e - k:e], counts[e - k:e], cost) for e, k, cost in zip(ends, sizes, costs)]


def plus_plus(points, weights, k: int, rng, rounds: int = 30):
    """``k`` centres of a few weighted points: k-means++ and Lloyd's iterations."""
    centres = [points[rng.choice(len(points), p=weights / weights.sum())]]
    cost = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        chance = weights * cost
        # with fewer distinct points than centres some repeat
        at = rng.choice(len(points), p=chance / chance.sum()) if chance.sum() > 0 else len(centres) % len(points)
        centres.append(points[at])
        cost = np.minimum(cost, ((points - centres[-1]) ** 2).sum(axis=1))
    centres, before = np.array(centres), None
    for _ in range(rounds):
        (label, _), = nearest(points, centres, [k])
        if before is not None and (label == before).all():
            break
        before = label
        for j in range(k):
            if weights[label == j].sum() > 0:
                centres[j] = np.average(points[label == j], axis=0, weights=weights[label == j])
    return centres


def starts(data, fits: list) -> list:
    """k-means|| for every (k, seed): candidates by cost in STEPS passes, and k of them by weight."""
    counts = data.mapPartitions(lambda blocks: [sum(len(x) for x in blocks)]).collect()
    if not sum(counts):
        raise ValueError("no rows to cluster")
    seeds, ends = [(seed, k) for k, seed in fits], np.cumsum(counts)
    first: dict[int, set] = {}
    asked = []
    for seed in seeds:
        row = int(np.random.default_rng((*seed, 0)).integers(ends[-1]))
        part = int(np.searchsorted(ends, row, side="right"))
        asked.append((part, row - (int(ends[part]) - counts[part])))
        first.setdefault(part, set()).add(asked[-1][1])

    def rows(part, blocks):
        wanted, at = sorted(first.get(part, ())), 0
        for x in blocks:
            for row in wanted:
                if at <= row < at + len(x):
                    yield (part, row), x[row - at]
            at += len(x)
    got = dict(data.mapPartitionsWithIndex(rows).collect())
    candidates = [[got[a]] for a in asked]
    for step in range(1, STEPS + 1):
        now = [np.array(c) for c in candidates]
        costs = [cost for *_, cost in totals(data, now)]
        shares = [2.0 * k / cost if cost > 0 else 0.0 for (k, _), cost in zip(fits, costs)]
        sent, sizes = data.context.broadcast(np.concatenate(now)), [len(c) for c in now]
        more = data.mapPartitionsWithIndex(lambda p, blocks: drawn(p, blocks, sent.value, sizes, shares, seeds, step)).collect()
        sent.destroy()
        for f, row in more:
            candidates[f].append(row)
    now = [np.unique(np.array(c), axis=0) for c in candidates]
    return [plus_plus(c, n, k, np.random.default_rng((*seed, STEPS + 1)))
            for c, (_, n, _), (k, _), seed in zip(now, totals(data, now), fits, seeds)]


def fit_all(data, fits: list, tolerance, max_iter: int = 300) -> list:
    """(centres, cost) for every (k, seed); ``tolerance`` gives the most that a centre of k may still move."""
    centres = starts(data, fits)
    moving = list(range(len(fits)))
    for _ in range(max_iter):
        if not moving:
            break
        still = []
        for f, (sums, counts, _) in zip(moving, totals(data, [centres[f] for f in moving])):
            after = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1.0)[:, None], centres[f])
            if ((after - centres[f]) ** 2).sum(axis=1).max() > tolerance(fits[f][0]) ** 2:
                still.append(f)
            centres[f] = after
        moving = still
    return [(c, float(cost)) for c, (*_, cost) in zip(centres, totals(data, centres))]


def to_mllib(spark: SparkSession, centres, features: str, prediction: str, seed: int) -> KMeansModel:
    """The centres as MLlib's model, by way of its saved tables."""
    km = KMeans(k=len(centres), seed=seed, featuresCol=features, predictionCol=prediction)
    about = {"class": "org.apache.spark.ml.clustering.KMeansModel", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
             "uid": f"KMeans_{uuid.uuid4().hex[:12]}", "paramMap": {p.name: km.getOrDefault(p) for p in km.params if km.isSet(p)},
             "defaultParamMap": {p.name: km.getOrDefault(p) for p in km.params if km.hasDefault(p) and not km.isSet(p) and p.name != "seed"}}
    path = scratch_path(spark, f"models/kmeans-{uuid.uuid4().hex}")
    schema = T.StructType([T.StructField("clusterIdx", T.IntegerType(), False), T.StructField("clusterCenter", VectorUDT())])
    spark.createDataFrame([(i, Vectors.dense(c)) for i, c in enumerate(centres)], schema).coalesce(1).write.parquet(f"{path}/data")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return KMeansModel.load(path)
