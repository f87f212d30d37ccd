"""Properties checked against brute force on small inputs."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window

from strata.operators import evaluate
from strata.operators.prefix import running_sums


def test_running_sums_match_brute_force(spark):
    random.seed(3)
    data = [(float(i) + random.random(), random.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(data, "s double, v long")
    got = {r.s: r.cum_v for r in running_sums(df, "s", ["v"], buckets=7).collect()}
    acc = 0
    for s, v in sorted(data):
        acc += v
        assert got[s] == acc


def test_auc_symmetry_and_brute_force(spark):
    random.seed(5)
    data = [(i, random.randint(0, 20), random.randint(0, 1)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, s long, y int")
    auc = evaluate.roc_auc(df, "s", "y").first().auc
    neg = evaluate.roc_auc(df.withColumn("s", -F.col("s")), "s", "y").first().auc
    assert math.isclose(auc + neg, 1.0, abs_tol=1e-12)
    pos = [s for _, s, y in data if y == 1]
    negs = [s for _, s, y in data if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in negs) / (len(pos) * len(negs))
    assert math.isclose(auc, brute, abs_tol=1e-12)


def test_stratified_split_equals_row_number_definition(spark):
    rnd = random.Random(7)
    data = [(i, rnd.choice([0, 0, 1])) for i in range(2000)]
    df = spark.createDataFrame(data, "id long, y int")
    got = evaluate.stratified_split(df, "id", "y", 0.2, 42, prefix_len=2)
    h = evaluate.hash_key("id", 42)
    w = Window.partitionBy("y").orderBy(h, "id")
    n = F.count(F.lit(1)).over(Window.partitionBy("y"))
    ref = df.select("id", (F.row_number().over(w) <= F.bround(F.lit(0.2) * n, 0)).alias("t"))
    a = {r.id: r.is_test for r in got.collect()}
    b = {r.id: r.t for r in ref.collect()}
    assert a == b
    sizes = got.groupBy("y").agg(F.sum(F.col("is_test").cast("int")).alias("k"),
                                 F.count(F.lit(1)).alias("n")).collect()
    for r in sizes:
        assert r.k == round(0.2 * r.n)


def test_split_with_an_id_that_holds_half_of_all_rows(spark):
    # id 3 has 1000 rows of class 1, 400 of them equal in every column; others are single
    rows = [(3, 1, None if k < 400 else k) for k in range(1000)] + [(k, k % 2, k) for k in range(10, 1010)] + [(None, 0, k) for k in range(5)]
    df = spark.createDataFrame(rows, "id long, y int, v long")
    for seed in (42, 1, 2, 3):      # orders with the hot id before, at and after the cut
        for share in (0.2, 0.5):
            got = evaluate.stratified_split(df.repartition(6), "id", "y", share, seed)
            sizes = {r.y: (r.k, r.n) for r in got.groupBy("y").agg(F.sum(F.col("is_test").cast("int")).alias("k"), F.count(F.lit(1)).alias("n")).collect()}
            assert sizes == {y: (round(share * n), n) for y, n in ((0, 505), (1, 1500))}
            # ids but the one at the cut lie on one side, as by definition
            key = {r.id: r.h for r in df.select("id", F.coalesce(evaluate.hash_key("id", seed), F.lit("")).alias("h")).distinct().collect()}
            seen = got.filter("y = 1").select("id", "is_test").distinct().collect()
            inside, outside = ({key[r.id] for r in seen if r.is_test == t} for t in (True, False))
            assert max(inside) <= min(outside) and len(inside & outside) <= 1
    spread = running_sums(df.filter("id = 3").withColumn("u", F.monotonically_increasing_id()).withColumn("one", F.lit(1)), "one", ["one"], 8, tie_col="u")
    assert sorted(r.cum_one for r in spread.collect()) == list(range(1, 1001))      # copies of one id number through, whatever their ranges


def test_sample_rows_is_exact_and_deterministic(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = [r.k for r in evaluate.sample_rows(df, "k", 37).collect()]
    b = [r.k for r in evaluate.sample_rows(df.repartition(7), "k", 37).collect()]
    assert len(a) == 37 and sorted(a) == sorted(b)


def test_rate_table_independent_of_partitioning(spark):
    from strata.operators.tables import rate_by
    rnd = random.Random(1)
    data = [(rnd.randint(1, 5), rnd.randint(0, 1)) for _ in range(3000)]
    df = spark.createDataFrame(data, "c int, y int")
    a = sorted(tuple(r) for r in rate_by(df, "c", "y").collect())
    b = sorted(tuple(r) for r in rate_by(df.repartition(13), "c", "y").collect())
    assert a == b
    assert sum(r[1] for r in a) == 3000


def test_silhouette_matches_brute_force(spark):
    from strata.operators.cluster import silhouette
    rnd = np.random.default_rng(0)
    pts = rnd.normal(size=(60, 3)) + np.repeat(np.array([[0, 0, 0], [3, 0, 0], [0, 3, 0]]), 20, 0)
    lab = np.repeat([0, 1, 2], 20)
    df = spark.createDataFrame([(i, [float(x) for x in p], int(l)) for i, (p, l) in
                                enumerate(zip(pts, lab))], "id long, v array<double>, c int")
    got = silhouette(df, "v", "c").first().silhouette
    d = ((pts[:, None] - pts[None]) ** 2).sum(-1)
    s = []
    for i in range(60):
        own = lab == lab[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == k].mean() for k in set(lab) if k != lab[i])
        s.append((b - a) / max(a, b))
    assert math.isclose(got, float(np.mean(s)), abs_tol=1e-9)


def test_kmeans_rows_at_nearest_centroid(spark):
    from strata.operators.cluster import assign_clusters
    rnd = np.random.default_rng(1)
    pts = rnd.normal(size=(200, 2)) + np.repeat(np.array([[0, 0], [5, 5]]), 100, 0)
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)],
                               "id long, v array<double>")
    out, model = assign_clusters(df, "id", "v", 2, restarts=3)
    cents = np.array([list(c) for c in model.clusterCenters()])
    for r in out.collect():
        d = ((cents - np.array(r.v)) ** 2).sum(1)
        assert r.cluster == int(np.argmin(d))


def test_attribution_equals_brute_force_shapley(spark):
    """Fast per-leaf attribution vs enumeration of all feature subsets."""
    from strata.operators.attribution import attribute, leaf_paths, model_nodes
    from strata.operators.boost import BoostConfig, fit_boosted
    rnd = random.Random(11)
    data = []
    for i in range(400):
        a, b, c, e = (rnd.randint(1, 4), rnd.randint(1, 3), rnd.random() * 10, rnd.randint(0, 1))
        y = int(a + 2 * e + c / 5 + rnd.random() * 2 > 5)
        data.append((i, float(a), float(b), c, float(e), y, 1.0 + rnd.random(), i % 5 == 0))
    df = spark.createDataFrame(data, "id long, a double, b double, c double, e double, y int, "
                                     "w double, val boolean")
    feats = ["a", "b", "c", "e"]
    model = fit_boosted(df, feats, "y", "w", "val",
                        BoostConfig(max_iter=4, max_depth=3, validation_tol=0.0, subsample=1.0,
                                    feature_subset="all"))
    nodes = model_nodes(model)
    attr = {r.id: r for r in attribute(model, df, "id", feats, logodds=False).collect()}
    sample = [row for row in data[:12]]

    def expval(tree, nid, x, S):
        pred, cover, left, right, feat, thr = tree[nid]
        if left < 0:
            return pred
        if feat in S:
            return expval(tree, left if x[feat] <= thr else right, x, S)
        cl, cr = tree[left][1], tree[right][1]
        return (cl * expval(tree, left, x, S) + cr * expval(tree, right, x, S)) / cover

    def value(x, S):
        return sum(w * expval(nodes["trees"][t], 0, x, S) for t, w in enumerate(nodes["weights"]))

    m = len(feats)
    for row in sample:
        x = list(row[1:5])
        for i in range(m):
            phi = 0.0
            others = [j for j in range(m) if j != i]
            for k in range(m):
                for S in itertools.combinations(others, k):
                    wgt = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                    phi += wgt * (value(x, set(S) | {i}) - value(x, set(S)))
            assert math.isclose(attr[row[0]][feats[i]], phi, abs_tol=1e-9), (row[0], i)
    base = value([0, 0, 0, 0], set())
    assert math.isclose(attr[0].base_value, base, abs_tol=1e-9)
    assert len(leaf_paths(nodes)) > 0


def test_auc_single_class_is_null_not_error(spark):
    df = spark.createDataFrame([(1, 0.3, 1), (2, 0.5, 1)], "id long, s double, y int")
    assert evaluate.roc_auc(df, "s", "y").first().auc is None
    assert [r.fpr for r in evaluate.roc_curve(df, "s", "y").collect()] == [None, None]


def test_train_validation_test_modes(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(i, rnd.randint(0, 1)) for i in range(1000)], "id long, y int")
    three = evaluate.train_validation_test(df, "id", "y")
    r = three.agg(F.sum(F.col("is_test").cast("int")).alias("t"),
                  F.sum(F.col("is_val").cast("int")).alias("v"),
                  F.sum((F.col("is_test") & F.col("is_val")).cast("int")).alias("both")).first()
    assert r.t == 200 and 155 <= r.v <= 165 and r.both == 0
    parity = evaluate.train_validation_test(df, "id", "y", early_stop_on="test")
    assert parity.filter(F.col("is_test") != F.col("is_val")).count() == 0


def test_split_keeps_rows_without_a_label(spark):
    from strata.operators.evaluate import stratified_split
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i % 2) for i in range(100)], "id long, y int")
    got = stratified_split(df, "id", "y", 0.2).collect()
    assert len(got) == 100 and sum(r.is_test for r in got if r.y is None) == 2


def test_exact_quantiles_interpolate(spark):
    from strata.operators.prefix import exact_quantiles
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=997), 2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    got = exact_quantiles(df, "x", (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)).first().q
    assert np.allclose(got, np.quantile(x, (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)))
    assert exact_quantiles(df.limit(0), "x", (0.5,)).first().q is None


def test_intake_scores_valid_forms_only(spark):
    from strata.streaming import intake
    rows = [(1, "40", "Employed full-time", "Strong support", "2 years 6 months", ""), (2, "n/a", "Employed full-time", "Strong support", "1 year", ""),
            (3, "160", "Not currently employed", "Little or no support", "30 months", "")]
    forms = spark.createDataFrame(rows, intake.INTAKE_SCHEMA)
    assert [r.duration_years for r in intake.parse_intake(forms).orderBy("intake_id").collect()] == [2.5, 1.0, 2.5]
    model = intake.IntakeModel({"mean": [40.0, 2.0, 2.0, 3.0], "std": [24.0, 0.8, 0.8, 2.5]}, [[-1.0, 0, -1.2, 0], [1.2, 0.8, 1.1, 0]],
                               intake.match_profiles([[-1.0, 0, -1.2, 0], [1.2, 0.8, 1.1, 0]]))
    got = {r.intake_id: r for r in intake.score_intake(model, forms).collect()}
    assert got[2].cluster is None and got[2].profile_name is None and got[2].top_factors is None
    assert got[3].profile_name == "Solo Caregiver, High Risk" and got[1].profile_name != got[3].profile_name


def test_intake_fit_parses_each_form_once(spark):
    from strata.streaming import intake
    n = 400
    parsed = spark.sparkContext.accumulator(0)
    hours = F.udf(lambda x: parsed.add(1) or x, "string")
    forms = spark.range(n).select(
        F.col("id").alias("intake_id"), hours((F.col("id") % 90).cast("string")).alias("care_hours"),
        F.element_at(F.array(*map(F.lit, intake.EMPLOYMENT)), (F.col("id") % 3 + 1).cast("int")).alias("employment_status"),
        F.element_at(F.array(*map(F.lit, intake.SUPPORT)), (F.col("id") % 2 + 1).cast("int")).alias("support_network"),
        F.concat((F.col("id") % 7 + 1).cast("string"), F.lit(" years")).alias("care_duration"), F.lit("").alias("notes"))
    model = intake.fit_intake_model(forms)
    # a plan may ask for the hours twice, in its filter and for the vector, but only one plan does
    assert len(model.centroids) == 5 and n <= parsed.value <= 2 * n
