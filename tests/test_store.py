"""Stored results, the population cube, intake records and the plain silhouette."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from strata.sources import store
from tests.conftest import SF_SMALL


def jobs(spark, group, run):
    """Jobs that ``run`` starts."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return out, len(sc.statusTracker().getJobIdsForGroup(group))


def test_a_second_session_answers_without_a_fit(spark, monkeypatch):
    from strata.operators import boost
    from strata.plans import model_queries as M
    from strata.plans.registry import reset_caches
    store.remember()
    monkeypatch.setattr(M, "CONFIG", boost.BoostConfig(max_iter=6, first_rounds=6, max_depth=3, seed=977))
    reset_caches(keep_stored=True)
    first = [tuple(r) for r in M.driver_importance(spark, SF_SMALL).collect()]
    curve = [tuple(r) for r in M.boosting_curve(spark, SF_SMALL).collect()]
    reset_caches(keep_stored=True)          # what a new session on the same folder knows
    monkeypatch.setattr(M, "fit_with_patience", None)
    monkeypatch.setattr(M.attribution, "attribute", None)
    again, n = jobs(spark, "second", lambda: [tuple(r) for r in M.driver_importance(spark, SF_SMALL).collect()])
    assert again == first and n < 15
    assert [tuple(r) for r in M.boosting_curve(spark, SF_SMALL).collect()] == curve
    assert sum(r[2] for r in curve) == 1 and len(curve) == 6
    # another configuration or a cold run is a miss
    called = []
    monkeypatch.setattr(M, "fit_with_patience", lambda *a: called.append(1) or 1 / 0)
    for change in (lambda: monkeypatch.setattr(M, "CONFIG", boost.BoostConfig(max_iter=7)), store.forget):
        reset_caches(keep_stored=True)
        change()
        try:
            M.boosting_curve(spark, SF_SMALL)
        except ZeroDivisionError:
            pass
    assert len(called) == 2
    store.remember()
    reset_caches(keep_stored=True)


def test_changed_input_misses_and_writers_agree(spark, tmp_path):
    store.remember()
    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    made = []

    def total():
        def build():
            made.append(1)
            return spark.read.parquet(source).agg(F.sum("id").alias("s"))
        return store.stored_table(spark, "total", (store.input_stamp(spark, source),), build).first().s
    assert total() == total() == 3 and len(made) == 1
    spark.range(10, 11).write.mode("append").parquet(source)
    assert total() == 13 and len(made) == 2
    # two writers of one key: both read the name that sorts first
    key = ("both",)
    paths = {store.stored(spark, "race", key, lambda p: spark.range(1).write.parquet(p)) for _ in range(2)}
    assert len(paths) == 1


def test_population_cube_has_every_filter_view(spark):
    from strata.operators import clean, tables
    from strata.plans import survey_queries as SQ
    frame = SQ.adf(spark, SF_SMALL)
    cube = {tuple(r[c] for c in ("sex", "marstat", "prv", "famincg1")) + (r.all_flags,): r for r in SQ.population_cube(spark, SF_SMALL).collect()}
    whole = cube[None, None, None, None, "1111"]
    assert whole.n_view == frame.count()
    for filters, key in (({}, (None,) * 4 + ("1111",)), ({"sex": 1, "marstat": 2}, (1, 2, None, None, "0011")), ({"prv": 3}, (None, None, 3, None, "1101"))):
        k = tables.kpis(clean.filter_population(frame, filters), SQ.LABEL, SQ.SCORE, "flexibility_score").first()
        assert tuple(cube[key][c] for c in ("n_view", "n_high", "pct_high", "mean_score", "mean_flex")) == tuple(k)
    # a missing code and "All" are different rows
    df = spark.createDataFrame([(1, None, 1, 0.5, 2), (None, None, 0, 0.1, None)], "a int, b int, y int, s double, f int")
    got = {(r.a, r.b, r.all_flags): (r.n_view, r.n_high, r.mean_flex) for r in tables.population_cube(df, ["a", "b"], "y", "s", "f").collect()}
    assert got[None, None, "11"] == (2, 1, 2.0) and got[None, None, "00"] == (1, 0, None) and got[None, None, "10"] == (2, 1, 2.0) and len(got) == 6
    assert tables.population_cube(df.limit(0), ["a", "b"], "y", "s", "f").collect() == []


def test_broken_records_go_to_their_own_sink_over_a_restart(spark, tmp_path):
    from strata.plans import intake_queries as IQ
    from strata.streaming import intake
    model = IQ.intake_model(spark, SF_SMALL)
    src, sink, rejects, ckpt = (str(tmp_path / n) for n in ("src", "sink", "rejects", "ckpt"))
    good = [json.dumps({"intake_id": i, "care_hours": "30", "employment_status": "Employed part-time", "support_network": "Some support",
                        "care_duration": "2 years", "notes": "é"}) for i in range(40)]
    bad = ['{"intake_id": 7, "care_hours"', "not json", '{"intake_id": "seven"}', "[1, 2"]
    lines = spark.createDataFrame([(t,) for t in [*good[:25], *bad[:2]]], "value string")
    lines.write.text(src)
    scores, broken = intake.run_stream_with_rejects(spark, model, src, sink, rejects, ckpt)
    assert scores.count() == 25 and {r.raw for r in broken.collect()} == set(bad[:2])
    spark.createDataFrame([(t,) for t in [*good[25:], *bad[2:], bad[0]]], "value string").write.mode("append").text(src)
    scores, broken = intake.run_stream_with_rejects(spark, model, src, sink, rejects, ckpt)
    assert sorted(r.raw for r in broken.collect()) == sorted([*bad, bad[0]])
    records = intake.read_records(spark, src).cache()
    batch = intake.score_intake(model, intake.whole_records(records))
    key = ["intake_id", "cluster", "profile_name"]
    assert sorted(map(tuple, scores.select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect())) and scores.count() == 40
    assert sorted(r.raw for r in intake.broken_records(records).collect()) == sorted([*bad, bad[0]])
    assert all(r.file_name.startswith("part-") for r in broken.collect())


def test_guidance_by_profile_and_factors(spark):
    from strata.streaming import intake
    scored = spark.createDataFrame([(1, "P", ["A", "B"]), (2, "Q", ["B", "C"]), (3, None, None)], "intake_id int, profile_name string, top_factors array<string>")
    rows = [("next_step", "P", 2, "p2"), ("next_step", "P", 1, "p1"), ("next_step", "B", 1, "b"), ("next_step", "A", 1, "p1"),
            ("resource", "Q", 1, "line"), ("resource", "B", 1, "line")]
    got = {r.intake_id: (r.next_steps, r.resources) for r in intake.with_guidance(scored, spark.createDataFrame(rows, intake.GUIDANCE_SCHEMA)).collect()}
    assert got == {1: (["p1", "p2", "b"], ["line"]), 2: (["b"], ["line"]), 3: ([], [])}
    none = intake.with_guidance(scored, spark.createDataFrame([], intake.GUIDANCE_SCHEMA)).first()
    assert none.next_steps == [] == none.resources


def test_plain_silhouette_equals_brute_force(spark, monkeypatch):
    import numpy as np
    from strata.operators import cluster, evaluate
    monkeypatch.setattr(cluster, "BLOCK", 16)
    rng = np.random.default_rng(2)
    c = [int(i) for i in rng.integers(0, 3, size=90)] + [7, None]
    x = rng.normal(size=(92, 4)) + np.array([v or 0 for v in c])[:, None]
    df = spark.createDataFrame([(i, x[i].tolist(), c[i]) for i in range(92)] + [(200, None, 1)], "id long, v array<double>, c int")

    def brute(ids):
        out = []
        for i in ids:
            to = {k: [np.linalg.norm(x[i] - x[j]) for j in ids if c[j] == k and j != i] for k in {c[j] for j in ids}}
            a, b = to[c[i]], min(np.mean(v) for k, v in to.items() if k != c[i])
            out.append(0.0 if not a else (b - np.mean(a)) / max(np.mean(a), b))
        return float(np.mean(out))
    got = cluster.plain_silhouette(df, "id", "v", "c").first()
    assert got.n_rows == 91 and abs(got.silhouette - brute(range(91))) < 1e-9
    ids = [r.id for r in evaluate.sample_rows(df.filter("c is not null and v is not null"), "id", 40).collect()]
    assert abs(cluster.plain_silhouette(df, "id", "v", "c", n=40).first().silhouette - brute(ids)) < 1e-9
    assert cluster.plain_silhouette(df.filter("c = 1"), "id", "v", "c").first().silhouette is None
    assert cluster.plain_silhouette(df.limit(0), "id", "v", "c").first().silhouette is None
    sweep = cluster.kmeans_sweep(df.filter("v is not null"), "id", "v", range(2, 4)).collect()
    assert all(-1 <= r.silhouette_euclidean <= 1 for r in sweep)


def test_report_header(spark):
    from strata.plans import catalog, report  # noqa: F401  (the catalog registers the sections)
    h = report.header(spark, SF_SMALL).first()
    assert len(h.generated) == 16 and h.threshold > 0 and h.valid_rows > 0
