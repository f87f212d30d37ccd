"""Boosting with patience and attribution by threshold ranks."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import attribution, boost, rounds
from strata.operators.boost import BoostConfig, best_round, first_trees, fit_boosted, fit_with_patience, impute, score


def test_best_round_outlasts_a_bump():
    # a noisy curve: round 4 is worse than 3, round 9 is the best, then none better
    losses = [1.0, 0.9, 0.8, 0.82, 0.81, 0.79, 0.8, 0.78, 0.7, 0.71, 0.72, 0.75, 0.74, 0.76]
    assert best_round(losses, 1) == (3, True)           # as a tolerance of 0 would
    assert best_round(losses, 4) == (9, True)
    assert best_round(losses, 30) == (9, False)
    assert best_round([0.5, 0.5, 0.5], 2) == (1, True)  # equal is not better
    assert best_round([3.0, 2.0, 1.0], 1) == (3, False)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = []
    for i in range(900):
        a, b, c, e = rnd.randint(1, 4), rnd.randint(1, 3), rnd.random() * 10, rnd.randint(0, 1)
        y = int(a + 2 * e + c / 5 + rnd.gauss(0, 1.5) > 5)
        data.append((i, float(a) if i % 9 else None, float(b), c, float(e), y, 1.0 + rnd.random(), i % 4 == 0))
    return spark.createDataFrame(data, "id long, a double, b double, c double, e double, y int, w double, val boolean")


FEATS = ["a", "b", "c", "e"]


def test_patience_goes_on_where_tolerance_stops(spark, rows):
    config = BoostConfig(max_iter=40, first_rounds=5, patience=8, max_depth=3, step_size=0.3, feature_subset="0.5", subsample=0.6)
    model, losses = fit_with_patience(rows, FEATS, "y", "w", "val", config)
    keep, settled = best_round(losses, config.patience)
    assert model.getNumTrees == keep and (settled or len(losses) == 40) and len(losses) > 5
    early = fit_boosted(rows, FEATS, "y", "w", "val", config)
    assert early.getNumTrees <= keep and min(losses) <= losses[early.getNumTrees - 1]
    # the cut model scores as its rounds say: its loss is the curve's smallest
    got = score(model, rows.filter("val"), FEATS).collect()
    w = sum(r.w for r in got)
    loss = sum(r.w * 2 * math.log1p(math.exp(-(1 if r.y else -1) * math.log(r.p_high / (1 - r.p_high)))) for r in got) / w
    assert abs(loss - losses[keep - 1]) < 1e-9
    assert first_trees(model, keep) is model


def test_rank_scorer_equals_subset_enumeration_and_stays_in_its_bound(spark, rows, monkeypatch):
    monkeypatch.setattr(attribution, "BLOCK_BYTES", 4096)       # several blocks, some of them not kept
    monkeypatch.setattr(attribution, "TABLE_BYTES", 12_000)
    monkeypatch.setattr(attribution, "ROWS", 7)
    model = fit_boosted(rows, FEATS, "y", "w", "val", BoostConfig(max_iter=5, max_depth=4, subsample=1.0, feature_subset="all"))
    leaves = attribution.leaf_paths(attribution.model_nodes(model))
    x = np.array([[r[c] for c in FEATS] for r in impute(rows, FEATS).limit(25).collect()])
    x[0] = [leaves[0][3][0]] * 4        # a value that is a threshold itself
    scorer = attribution.RankScorer(attribution.LeafArrays.of(leaves, 4), 4)
    got = scorer.phi(x)
    assert np.array_equal(got, scorer.phi(x)) and 0 < len(scorer.kept) * scorer.step < len(leaves)
    assert sum(b.bytes for b in scorer.kept) <= 12_000

    def value(row, known):
        out = 0.0
        for v, feats, lo, hi, z in leaves:
            for f, a, b, s in zip(feats, lo, hi, z):
                v *= (a < row[f] <= b) if f in known else s
            out += v
        return out
    for row, phi in zip(x, got):
        for i in range(4):
            others = [j for j in range(4) if j != i]
            want = sum(math.factorial(k) * math.factorial(3 - k) / 24 * (value(row, {*s, i}) - value(row, set(s)))
                       for k in range(4) for s in itertools.combinations(others, k))
            assert abs(phi[i] - want) < 1e-9


def test_scorer_without_splits():
    leaves = [(0.25, np.array([], dtype=np.int64), np.array([]), np.array([]), np.array([]))]
    assert not attribution.RankScorer(attribution.LeafArrays.of(leaves, 3), 3).phi(np.ones((4, 3))).any()
    assert attribution.expected_value(leaves) == 0.25


def test_boosting_and_attribution_work_on_even_partitions(spark):
    # a stored table that is read unevenly: nearly all rows lie in one of five partitions
    big = spark.range(0, 60_000, 1, 1).union(spark.range(60_000, 60_100, 1, 4)).selectExpr(
        "id", "double(id % 7) a", "double(id % 3) b", "int(id % 2) y", "1.0 + id % 5 w", "id % 4 = 0 val")
    sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    got = boost._prepared(big, ["a", "b"], "y", "w", "val", BoostConfig(), ()).filter("not val")
    n = sizes(got)
    assert sum(n) == big.filter("not val").count() and len(n) == 4 and max(n) < 1.2 * sum(n) / len(n)
    # made again, a partition has the same rows in the same order
    place = lambda: got.select(F.spark_partition_id(), F.monotonically_increasing_id(), "_features", "_label", "_w").collect()
    assert place() == place()
    model = fit_boosted(big, ["a", "b"], "y", "w", "val", BoostConfig(max_iter=2, max_depth=2))
    out = attribution.attribute(model, big, "id", ["a", "b"])
    n = sizes(out)
    assert sum(n) == big.count() and max(n) < 1.2 * sum(n) / len(n)


def test_rounds_are_mllib_s_trees_and_none_is_trained_twice(spark, rows):
    config = BoostConfig(max_iter=24, first_rounds=3, patience=24, max_depth=3, step_size=0.3, feature_subset="all", subsample=1.0)
    rows = rows.withColumn("c", F.floor("c").cast("double"))        # codes, not more than there are bins
    spark.sparkContext.setJobGroup("rounds", "")
    try:
        model, losses = fit_with_patience(rows, FEATS, "y", "w", "val", config)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # a job for each level of each of the 24 rounds; fits of 3, 12 and 24 rounds took 39 rounds and more than 170 jobs
    assert len(losses) == 24 and 24 * 3 <= jobs < 24 * 3 + 40
    assert model.getNumTrees == best_round(losses, config.patience)[0]
    prepared = boost._prepared(rows, FEATS, "y", "w", "val", config, ())
    other = boost._classifier(config).fit(prepared.filter("not val"))
    assert np.allclose(losses, list(other.evaluateEachIteration(prepared.filter("val"))), rtol=1e-9)
    other = first_trees(other, model.getNumTrees)
    ours, theirs = (score(m, rows, FEATS).orderBy("id").toPandas()["p_high"] for m in (model, other))
    assert np.allclose(ours, theirs, rtol=1e-9)
    # covers and impurities are saved as MLlib saves them
    tables = [attribution.model_nodes(m)["trees"][0] for m in (model, other)]
    assert [len(t) for t in tables][0] == len(tables[1])
    for i, node in tables[0].items():
        assert np.allclose([float(v) for v in node if v is not None], [float(v) for v in tables[1][i] if v is not None], rtol=1e-9)


def test_cuts_and_draws(spark):
    df = spark.range(5000).selectExpr("double(id % 4) few", "double(id) many", "double(7) one")
    few, many, one = boost.feature_cuts(df, ["few", "many", "one"], 16)
    assert few.tolist() == [0.5, 1.5, 2.5] and len(one) == 0
    assert len(many) == 15 and np.abs(many - np.arange(1, 16) * 5000 / 16).max() < 5
    assert [boost.columns_drawn(s, 19) for s in ("all", "0.8", "sqrt", "3", "onethird")] == [19, 16, 5, 3, 7]


def test_level_sums_are_those_of_every_column_and_node():
    rng = np.random.default_rng(5)
    sizes, n = [3, 300, 2, 7, 24], 4000
    codes = np.stack([rng.integers(0, s, n) for s in sizes]).astype(np.int32)
    groups = rounds.joint_columns(sizes)
    assert sorted(sum(groups, [])) == [0, 1, 2, 3, 4] and [1] in groups and len(groups) < 5
    y, w, val, margin = rng.choice([-1, 1], n), rng.random(n), rng.random(n) < 0.2, rng.normal(size=n)
    tree = rounds.Tree.empty(2, 0.1)
    tree.feature[:], tree.cut[:] = [3, -1, 4, -1, -1, -1, -1], [2, 0, 11, 0, 0, 0, 0]     # the left child is a leaf
    block = (codes, rounds.joint_codes(codes, sizes, groups), y, w, val, margin)
    (sums, totals, _), = rounds.level_sums(0, [block], tree.feature, tree.cut, 2, sizes, (1, 1), 1.0, False, True)
    g = w * 4.0 * y / (1.0 + np.exp(2.0 * y * margin))
    for node in range(4):
        here = ~val & (codes[3] > 2) & ((codes[4] > 11) == (node == 3)) & (node >= 2)
        want = [w[here].sum(), g[here].sum(), (g[here] ** 2 / w[here]).sum(), here.sum()]
        assert np.allclose(totals[:, node], want)
        start = 0
        for code, size in zip(codes, sizes):
            got = sums[:, node, start:start + size]
            start += size
            for k, x in enumerate((w, g, g * g / w, np.ones(n))):
                assert np.allclose(got[k], np.bincount(code[here], x[here], size))


def random_leaves(rng, features: int, trees: int, depth: int):
    """Leaves of random trees over real values: paths repeat features, and end early at times."""
    def grow(nodes, d, cover):
        at = len(nodes)
        nodes[at] = (float(rng.normal()), cover, -1, -1, -1, None)
        if d and rng.random() < 0.95:
            share = float(rng.uniform(0.1, 0.9))
            left, right = grow(nodes, d - 1, cover * share), grow(nodes, d - 1, cover * (1 - share))
            nodes[at] = (0.0, cover, left, right, int(rng.integers(features)), round(float(rng.uniform()), 1))
        return at
    out = {"trees": {t: {} for t in range(trees)}, "weights": [0.1] * trees}
    for t in out["trees"].values():
        grow(t, depth, 1.0)
    return attribution.leaf_paths(out)


@pytest.mark.parametrize("depth,block", [(6, 200_000), (6, 600), (9, 200_000)])
def test_leaves_are_looked_up_in_groups(depth, block, monkeypatch):
    monkeypatch.setattr(attribution, "BLOCK_BYTES", block)      # with 600 no two leaves fit into a group
    monkeypatch.setattr(attribution, "ROWS", 7)
    rng = np.random.default_rng(depth)
    leaves = random_leaves(rng, 8, 3, depth)
    x = rng.integers(-1, 12, (20, 8)) / 10      # many values are thresholds
    scorer = attribution.RankScorer(attribution.LeafArrays.of(leaves, 8), 8)
    got, want = scorer.phi(x), np.zeros((20, 8))
    groups = sum(len(b.groups) for b in scorer.blocks())
    # one lookup for each leaf before
    assert groups <= len(leaves) and (block < 1000 or depth > 6 or groups < len(leaves) / 3)
    for value, feats, lo, hi, z in leaves:
        inside, d = (x[:, feats] > lo) & (x[:, feats] <= hi), len(feats)
        for i in range(d):
            coef = np.zeros((len(x), d))
            coef[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    coef[:, 1:], coef[:, 0] = coef[:, 1:] * z[j] + coef[:, :-1] * inside[:, j, None], coef[:, 0] * z[j]
            w = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
            want[:, feats[i]] += value * (inside[:, i] - z[i]) * (coef @ w)
    assert np.allclose(got, want, atol=1e-12)


def test_chunks_put_batches_together():
    import pandas as pd
    got = list(attribution.chunks(iter([pd.DataFrame({"a": range(n)}) for n in (3, 0, 4, 2, 9, 1)]), 6))
    assert [len(b) for b in got] == [7, 11, 1] and got[1]["a"].tolist() == [0, 1, *range(9)]
    assert list(attribution.chunks(iter([]), 6)) == []


def test_blocks_carry_joint_codes_only_and_walk_by_them():
    import pandas as pd
    import pickle
    rng = np.random.default_rng(9)
    sizes, n = [2, 24, 5, 8, *[3] * 7, *[6] * 8], 5000
    codes = np.stack([rng.integers(0, s, n) for s in sizes])
    rows = pd.DataFrame({"x": list(codes.T.astype(float)), "label": rng.integers(0, 2, n), "weight": rng.random(n), "val": rng.random(n) < 0.2})
    (block,) = [pickle.loads(b) for f in rounds.to_blocks([rows], [np.arange(1, s) - 0.5 for s in sizes]) for b in f["block"]]
    # what each of a tree's jobs reads of a row: 43 bytes when the codes of all 19 columns went along
    assert len(pickle.dumps(block, protocol=5)) < 26 * n
    feature = rng.integers(-1, 19, 127)
    feature[63:], feature[0] = -1, 1
    for i in range(1, 127):
        feature[i] = -1 if feature[(i - 1) // 2] < 0 else feature[i]
    cut = np.array([rng.integers(0, sizes[f]) if f >= 0 else 0 for f in feature])
    got = rounds.Walk(feature, cut, sizes).places(block[1])
    for row in range(0, n, 50):
        at = 0
        while feature[at] >= 0:
            at = 2 * at + 1 + int(codes[feature[at], row] > cut[at])
        assert got[row] == at
