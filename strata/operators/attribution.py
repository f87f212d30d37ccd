"""Exact per-row, per-feature attributions of a tree ensemble.

Path-dependent tree attribution decomposes over leaves.  For one leaf with
value v, let D be the distinct features on its path, ``(lo_j, hi_j]`` the
interval the path allows for feature j, and z_j the product of
child-cover / parent-cover over the path's splits on j.  The expected leaf
contribution given the features in S is

    v(S) = v * prod_{j in S} [lo_j < x_j <= hi_j] * prod_{j in D \\ S} z_j

whose Shapley value for i is

    phi_i = v * (a_i - z_i) * sum_k w(k) * c_k,   w(k) = k! (d-k-1)! / d!

with c_k the t^k coefficient of prod_{j != i} (z_j + a_j t) and a_j the
interval indicator.  Since a is binary, each leaf has at most 2^d input
patterns (d <= depth), so a table pattern -> phi answers a leaf for all rows.

Rows are not compared with thresholds leaf by leaf.  Each value becomes its
rank among the thresholds that the model has for the feature, once for all
leaves.  Consecutive leaves, mostly those of one subtree, share thresholds:
as long as the ranks among their own thresholds have few states together, they
form a group with one table (feature, state) of their summed phi.  A row's
state in a group is a sum of one gathered number per feature, and its phi one
gathered value per feature, so a tree of depth 6 costs some nine lookups a
feature and not 64.  Leaves are padded to one number of features with a feature
that always holds (z = 1, a = 1), whose phi is 0 and which changes no other.

Blocks of groups are built in the task.  Those that fit into ``TABLE_BYTES`` are
kept for the task's later chunks of rows, the others are built again for each, so
memory is bounded whatever the number of trees.  base + sum(phi) equals the margin for
every row (tested).  The work is one ``mapInPandas`` stage; the leaves travel
as a Spark broadcast (their size is that of the model, whatever the data).
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import direction
from strata.operators.boost import sentinel_for
from strata.session import even_rows, scratch_path, ship_package


# ------------------------------------------------------------------ model -> leaves

def model_nodes(model) -> dict:
    """Tree nodes of a fitted tree-ensemble model, read from its saved data.

    The node table has at most trees x (2^(depth+1) - 1) rows, independent
    of the data size.
    """
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, f"models/gbt-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    rows = (spark.read.parquet(f"{path}/data")
            .select("treeID", "nodeData.id", "nodeData.prediction",
                    F.element_at("nodeData.impurityStats", 1).alias("cover"),
                    "nodeData.leftChild", "nodeData.rightChild",
                    "nodeData.split.featureIndex",
                    F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("thr"))
            .collect())
    trees: dict[int, dict[int, tuple]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = (
            r["prediction"], r["cover"], r["leftChild"], r["rightChild"], r["featureIndex"],
            r["thr"])
    return {"trees": trees, "weights": list(model.treeWeights)}


def leaf_paths(nodes: dict):
    """(value, features, lo, hi, z) per leaf; value already times the tree weight."""
    out = []
    for tid, tree in nodes["trees"].items():
        w = nodes["weights"][tid]
        stack = [(0, {})]
        while stack:
            nid, path = stack.pop()
            pred, cover, left, right, feat, thr = tree[nid]
            if left < 0:
                feats = sorted(path)
                out.append((pred * w, np.array(feats, dtype=np.int64),
                            np.array([path[f][0] for f in feats]),
                            np.array([path[f][1] for f in feats]),
                            np.array([path[f][2] for f in feats])))
                continue
            for child, is_left in ((left, True), (right, False)):
                lo, hi, z = path.get(feat, (-np.inf, np.inf, 1.0))
                ratio = tree[child][1] / cover if cover > 0 else 0.0
                p2 = dict(path)
                p2[feat] = ((lo, min(hi, thr), z * ratio) if is_left
                            else (max(lo, thr), hi, z * ratio))
                stack.append((child, p2))
    return out


BLOCK_BYTES = 200_000       # of the pattern tables of one block of leaves: about a tree of depth 6; a group's states follow from it
TABLE_BYTES = 96 << 20      # of the blocks that a task keeps
ROWS = 8_192                # rows that are worked on at once
CHUNK_CELLS = 4_000_000     # values of the rows that one pass over the blocks scores
TASK_ROWS = (2_000, 200_000)        # rows of a task


@dataclass(frozen=True)
class LeafArrays:
    """All leaves, padded to ``width`` features: rows of numpy arrays, in tree order."""
    value: np.ndarray       # (leaves,)
    feature: np.ndarray     # (leaves, width); the number of features where padded
    low: np.ndarray         # (leaves, width): a value is inside if low < x <= high
    high: np.ndarray
    share: np.ndarray       # (leaves, width): product of the cover ratios

    @classmethod
    def of(cls, leaves, n_features: int) -> LeafArrays:
        width = max((len(f) for _, f, *_ in leaves), default=0)

        def padded(rows, fill):
            out = np.full((len(leaves), width), fill, dtype=np.asarray(fill).dtype)
            for i, r in enumerate(rows):
                out[i, :len(r)] = r
            return out
        _, feats, lo, hi, z = zip(*leaves) if leaves else ((), (), (), (), ())
        return cls(np.array([v for v, *_ in leaves], dtype=np.float64), padded(feats, np.int64(n_features)),
                   padded(lo, -np.inf), padded(hi, np.inf), padded(z, 1.0))

    @property
    def width(self) -> int:
        return self.feature.shape[1]

    def part(self, i: int, j: int) -> LeafArrays:
        return LeafArrays(*(a[i:j] for a in (self.value, self.feature, self.low, self.high, self.share)))


def pattern_tables(leaves: LeafArrays) -> np.ndarray:
    """phi of every leaf, padded feature and indicator pattern: (leaves, width, 2^width)."""
    d = leaves.width
    bits = ((np.arange(1 << d) >> np.arange(d)[:, None]) & 1).astype(np.float64)    # (d, patterns)
    w = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
    z = leaves.share
    table = np.empty((len(z), d, 1 << d))
    for i in range(d):
        # coefficients of prod (z_j + a_j t) over the other features, each (leaves, patterns)
        coef = [np.ones((len(z), 1 << d))]
        for j in range(d):
            if j != i:
                coef.append(coef[-1] * bits[j])
                for k in range(len(coef) - 2, -1, -1):
                    coef[k] *= z[:, j, None]
                    if k:
                        coef[k] += coef[k - 1] * bits[j]
        table[:, i] = leaves.value[:, None] * (bits[i] - z[:, i, None]) * sum(c * x for c, x in zip(coef, w))
    return table


def thresholds_of(leaves: LeafArrays, n_features: int) -> list[np.ndarray]:
    """Sorted thresholds of each feature; a value's rank is how many lie below it."""
    out = []
    for f in range(n_features):
        at = leaves.feature == f
        ends = np.concatenate([leaves.low[at], leaves.high[at]])
        out.append(np.unique(ends[np.isfinite(ends)]))
    return out


class LeafGroup:
    """Leaves whose features have few states together: one table lookup per row and feature for all of them.

    A feature's state is its rank among the leaves' own thresholds for it; the
    states of all the group's features make one number, which names the column
    of ``table`` (features, states), the leaves' phi added up.
    """

    def __init__(self, leaves: LeafArrays, phi: np.ndarray, thresholds: list[np.ndarray], cuts: dict[int, list], most: int):
        self.features = sorted(cuts)
        d, width = len(self.features), leaves.width
        at = np.full(len(thresholds) + 1, d)
        at[self.features] = np.arange(d)
        place = at[leaves.feature]      # (leaves, places); d where padded
        sizes = [len(cuts[f]) + 1 for f in self.features]
        kind = np.int32 if max(sizes) > 32_000 else np.int16
        first, last = np.zeros(place.shape, dtype=kind), np.zeros(place.shape, dtype=kind)      # states inside; 0 where padded
        whole = math.prod(sizes) <= most
        self.index, stride = [], 1
        for k, f in enumerate(self.features):
            own, here = np.array(cuts[f]), place == k
            low, high = (np.searchsorted(own, ends[here], side=side) for ends, side in ((leaves.low, "right"), (leaves.high, "left")))
            ranks = np.searchsorted(np.searchsorted(thresholds[f], own) + 1, np.arange(len(thresholds[f]) + 1), side="right")
            if not whole:       # one leaf alone: inside or not
                ranks, sizes[k] = ((ranks >= low[0]) & (ranks <= high[0])).astype(ranks.dtype), 2
                low = high = 1
            first[here], last[here] = low, high
            self.index.append(np.ascontiguousarray(ranks * stride, dtype=np.intp))
            stride *= sizes[k]
        states = np.zeros((d + 1, stride), dtype=kind)
        for k, size in enumerate(sizes):
            states[k] = np.arange(stride) // math.prod(sizes[:k]) % size
        table = np.zeros((d + 1, stride))
        for i in range(len(place)):
            got = states[place[i]]
            inside = (got >= first[i, :, None]) & (got <= last[i, :, None])
            pattern = np.packbits(inside, axis=0, bitorder="little").astype(np.intp)    # (bytes, states)
            pattern = sum(part << 8 * k for k, part in enumerate(pattern))
            for j in range(width):
                table[place[i, j]] += phi[i, j].take(pattern)
        self.table = table[:-1]         # a padded place adds 0

    @property
    def bytes(self) -> int:
        return self.table.nbytes + sum(a.nbytes for a in self.index)

    def add_to(self, phi: np.ndarray, ranks: list[np.ndarray]) -> None:
        """``phi`` and ``ranks`` feature by feature; every index is in its table by construction."""
        state = sum(a.take(ranks[f], mode="clip") for f, a in zip(self.features, self.index))
        for f, row in zip(self.features, self.table):
            phi[f] += row.take(state, mode="clip")


class LeafBlock:
    """Scores one block of leaves from the ranks of the rows' values: consecutive leaves, mostly of one subtree, in groups."""

    def __init__(self, leaves: LeafArrays, thresholds: list[np.ndarray]):
        phi, n = pattern_tables(leaves), len(leaves.value)
        most = max(2, BLOCK_BYTES // (32 * max(1, leaves.width)))       # states of a group
        self.groups, start, cuts = [], 0, {}
        for i in range(n + 1):
            more = {}
            if i < n:
                for f, *ends in zip(leaves.feature[i], leaves.low[i], leaves.high[i]):
                    if f < len(thresholds):
                        more[int(f)] = {*cuts.get(int(f), ()), *(float(x) for x in ends if math.isfinite(x))}
            if i == n or (i > start and math.prod(len(c) + 1 for c in (cuts | more).values()) > most):
                if cuts:
                    self.groups.append(LeafGroup(leaves.part(start, i), phi[start:i], thresholds, {f: sorted(c) for f, c in cuts.items()}, most))
                start, cuts = i, {}
                more = {f: {float(x) for x in (leaves.low[i][leaves.feature[i] == f].tolist() + leaves.high[i][leaves.feature[i] == f].tolist())
                            if math.isfinite(x)} for f in more}
            cuts |= more
        self.bytes = sum(g.bytes for g in self.groups)

    def add_to(self, phi: np.ndarray, ranks: list[np.ndarray]) -> None:
        for g in self.groups:
            g.add_to(phi, ranks)


class RankScorer:
    """Attributions of batches of rows; holds at most TABLE_BYTES of blocks."""

    def __init__(self, leaves: LeafArrays, n_features: int):
        self.leaves, self.n_features = leaves, n_features
        self.thresholds = thresholds_of(leaves, n_features)
        self.step = max(1, BLOCK_BYTES // (8 * max(leaves.width, 1) << leaves.width))
        self.kept: list[LeafBlock] = []

    def blocks(self):
        yield from self.kept
        room = TABLE_BYTES - sum(b.bytes for b in self.kept)
        for i in range(len(self.kept) * self.step, len(self.leaves.value), self.step):
            block = LeafBlock(self.leaves.part(i, i + self.step), self.thresholds)
            # blocks are kept in order, without gaps
            if block.bytes <= room and i == len(self.kept) * self.step:
                self.kept.append(block)
                room -= block.bytes
            yield block

    def phi(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n_features, len(x)))
        if self.leaves.width:
            ranks = [np.searchsorted(t, x[:, f], side="left") for f, t in enumerate(self.thresholds)]
            for block in self.blocks():
                for i in range(0, len(x), ROWS):
                    block.add_to(out[:, i:i + ROWS], [r[i:i + ROWS] for r in ranks])
        return out.T


def expected_value(leaves) -> float:
    """Base value: sum over leaves of value x product of cover ratios."""
    return float(sum(v * np.prod(z) for v, _, _, _, z in leaves))


# ------------------------------------------------------------------ M7

def chunks(batches, rows: int):
    """The batches put together, until there are ``rows`` rows: blocks that are not kept are built once for each chunk."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def attribute(model, df: DataFrame, id_col: str, features, composites=(),
              logodds: bool = True) -> DataFrame:
    """Wide attributions: id, one phi per feature, base_value, base_plus_phi.

    ``logodds`` scales MLlib's margin (p = 1/(1+e^-2F)) to log-odds, the
    unit of the source analysis.
    """
    features = list(features)
    spark = df.sparkSession
    ship_package(spark)
    leaves = leaf_paths(model_nodes(model))
    scale = 2.0 if logodds else 1.0
    base = expected_value(leaves) * scale
    sentinels = np.array([sentinel_for(c, composites) for c in features])
    nf = len(features)
    sent = spark.sparkContext.broadcast(LeafArrays.of(leaves, nf))

    def run(it):
        scorer = RankScorer(sent.value, nf)
        for pdf in chunks(it, CHUNK_CELLS // max(1, nf)):
            x = pdf[features].to_numpy(dtype=np.float64, na_value=np.nan)
            x = np.where(np.isnan(x), sentinels[None, :], x)
            phi = scorer.phi(x) * scale
            out = pd.DataFrame(phi, columns=features)
            out.insert(0, id_col, pdf[id_col].to_numpy())
            out["base_value"] = base
            out["base_plus_phi"] = base + phi.sum(axis=1)
            yield out

    schema = T.StructType([df.schema[id_col]]
                          + [T.StructField(c, T.DoubleType()) for c in features]
                          + [T.StructField("base_value", T.DoubleType()),
                             T.StructField("base_plus_phi", T.DoubleType())])
    # a row takes as long as the model has leaves, so tasks of equal size end together
    return even_rows(df.select(id_col, *features), df.count(), *TASK_ROWS).mapInPandas(run, schema)


def to_long(wide: DataFrame, id_col: str, features, extra=()) -> DataFrame:
    """(id, [extra], feature, phi) long form of wide attributions."""
    return wide.unpivot([id_col, *extra], list(features), "feature", "phi")


# ------------------------------------------------------------------ M9 - M11, M17

def driver_importance(long: DataFrame, n: int = 30) -> DataFrame:
    """Mean |phi| per feature, top ``n`` with rank (grouped rows only are ranked)."""
    g = long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    top = g.orderBy(F.desc("mean_abs_phi"), "feature").limit(n)
    w = Window.orderBy(F.desc("mean_abs_phi"), "feature")  # over <= n rows
    return top.select(F.row_number().over(w).alias("rank"), "feature", "mean_abs_phi")


def driver_direction(long: DataFrame, n: int = 20) -> DataFrame:
    """Mean signed phi of the top-``n`` features by mean |phi|, with a sign tag."""
    g = long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"),
                                    F.avg("phi").alias("mean_phi"))
    top = g.orderBy(F.desc("mean_abs_phi"), "feature").limit(n)
    return top.select("feature", "mean_phi", direction("mean_phi").alias("net_effect"))


def beeswarm_points(wide: DataFrame, values: DataFrame, id_col: str, features,
                    n: int = 15) -> DataFrame:
    """Per row and top-``n`` feature: phi and the min-max normalised feature value.

    The wide attributions and the wide feature values are joined on the id
    (one row per record on each side) and only then unpivoted to the top
    features, so the join never carries one row per (record, feature).  The
    top names (at most ``n``) and the per-feature min/max (at most ``n`` rows,
    from a partially aggregated group-by) are bounded.
    """
    top = [r["feature"] for r in
           driver_importance(to_long(wide, id_col, features), n).select("feature").collect()]
    vals = values.select(id_col, *[F.col(c).cast("double").alias(f"_x_{c}") for c in top])
    j = wide.select(id_col, *top).join(vals, id_col)
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("phi"),
                             F.col(f"_x_{c}").alias("value")) for c in top])
    long = j.select(id_col, F.explode(arr).alias("p")).select(id_col, "p.*")
    mm = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    norm = F.when(F.col("_hi") > F.col("_lo"),
                  (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return long.join(F.broadcast(mm), "feature").select(id_col, "feature", "phi",
                                                        norm.alias("value_scaled"))


def cluster_drivers(wide: DataFrame, clusters: DataFrame, id_col: str, features,
                    cluster: str = "cluster", n: int = 10) -> DataFrame:
    """Top-``n`` features by mean |phi| per cluster, with direction (up/down).

    Cluster ids join the wide attributions on the id (one row per record),
    then the rows are unpivoted and aggregated per (cluster, feature) with
    partial aggregation; the ranking window runs over those grouped rows
    (clusters x features).
    """
    long = to_long(wide.join(clusters.select(id_col, cluster), id_col), id_col, features,
                   extra=(cluster,))
    g = long.groupBy(cluster, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"),
                                             F.avg("phi").alias("mean_phi"))
    w = Window.partitionBy(cluster).orderBy(F.desc("mean_abs_phi"), "feature")
    return (g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select(cluster, "rank", "feature", "mean_abs_phi",
                    direction("mean_phi", "▲", "▼").alias("direction")))
