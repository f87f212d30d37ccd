"""Running sums, quantiles and correlations against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strata.operators.prefix import in_ranges, quantile_table, running_sums
from strata.operators.tables import cluster_medians, correlation_pairs


@pytest.fixture()
def plain_ranges(spark):
    """Ranges as the partitioner makes them, not joined by AQE."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_running_sums_in_groups(spark, plain_ranges):
    rnd = random.Random(2)
    # one group holds half of all rows; null is a group; values tie
    data = [("big" if i % 2 else rnd.choice(["a", "b", None]), rnd.randint(0, 40), i, rnd.randint(-5, 9)) for i in range(600)]
    df = spark.createDataFrame(data, "g string, x long, id long, v long")
    got = {r.id: (r.cum_v, r.total_v) for r in running_sums(df, "x", ["v"], tie_col="id", by=["g"], total=True).collect()}
    groups = {}
    for g, x, i, v in sorted(data, key=lambda t: t[1:3]):
        groups[g] = groups.get(g, 0) + v
        assert got[i][0] == groups[g]
    assert all(got[i][1] == groups[g] for g, _, i, _ in data) and len(got) == 600


def test_a_hot_group_spreads_over_ranges(spark, plain_ranges):
    df = spark.range(20_000).selectExpr("'one' AS g", "id AS x")
    sizes = [r["count"] for r in in_ranges(df, ["g", "x"], 10).groupBy("_part").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 4000
    assert running_sums(df.selectExpr("*", "1L AS v"), "x", ["v"], by=["g"]).filter("cum_v <> x + 1").count() == 0


def test_range_lookup_does_not_grow_with_the_ranges(spark):
    plan = running_sums(spark.range(100).selectExpr("id AS x", "1L AS v"), "x", ["v"], buckets=50)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "filter(" not in plan


def test_quantile_table_of_groups_and_columns(spark, plain_ranges):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        g = None if i % 11 == 0 else int(rng.integers(0, 3)) if i % 2 else 9
        rows.append((g, float(rng.normal()), None if g == 1 else float(rng.integers(0, 4)), float(i) * 1e9))
    df = spark.createDataFrame(rows, "g int, x double, y double, z double")
    probs = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {(r.g, r.variable): r.q for r in quantile_table(df, ["x", "y", "z"], probs, by=["g"]).collect()}
    keys = {(r[0], c) for r in rows for j, c in enumerate("xyz", 1) if r[j] is not None}
    assert set(got) == keys and (1, "y") not in got
    for g, c in keys:
        v = [r["xyz".index(c) + 1] for r in rows if r[0] == g and r["xyz".index(c) + 1] is not None]
        assert np.allclose(got[g, c], np.quantile(v, probs), rtol=1e-12)
    medians = {(r.g, r.variable): r.median for r in cluster_medians(df, "g", ["x", "y", "missing"]).collect()}
    assert medians[1, "y"] is None and medians[9, "x"] == round(got[9, "x"][2], 1) and len(medians) == 10
    assert quantile_table(df.limit(0), ["x"], probs, by=["g"]).collect() == []


def test_gram_correlations_of_large_magnitudes(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=400)
    cols = {"a": 1e9 + a, "b": -1e9 + 0.5 * a + rng.normal(size=400), "c": rng.integers(0, 3, size=400) * 1.0, "k": np.full(400, 0.1), "n": np.full(400, np.nan)}
    cols["b"][::7] = np.nan
    cols["c"][:200] = 1.0
    cols["c"][200:] = np.where(np.arange(200) % 2, 2.0, np.nan)
    rows = [tuple(None if np.isnan(cols[c][i]) else float(cols[c][i]) for c in cols) for i in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = {(r.v1, r.v2): (r.n, r.r) for r in correlation_pairs(df, list(cols), 9).collect()}
    assert set(got) == {(x, y) for i, x in enumerate("abck") for y in "abck"[i + 1:]}       # n has no values at all
    for (x, y), (n, r) in got.items():
        both = ~np.isnan(cols[x]) & ~np.isnan(cols[y])
        assert n == both.sum()
        if "k" in (x, y):
            assert r is None
        else:
            assert abs(r - np.corrcoef(cols[x][both], cols[y][both])[0, 1]) < 1e-6
    # constant on the common rows, though not in the table
    only = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 6.0)], "a double, b double")
    assert correlation_pairs(only, ["a", "b"]).first().r is None
    assert correlation_pairs(only.limit(0), ["a", "b"]).collect() == []
