"""Registered queries: differential check vs DuckDB, model and streaming properties."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def entry_module():
    import __spark_entry__ as E
    return E


@pytest.fixture(scope="module")
def survey(entry_module):
    """The survey queries and their SQL; the corpus queries have their own tests."""
    entry_module.queries()
    from strata.plans.registry import ORACLE, QUERIES
    return QUERIES, ORACLE


def test_entry_smoke(spark, entry_module):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["category", "n", "high_pct"]


def test_every_sql_query_matches_duckdb(spark, survey):
    from tests.oracle_check import check
    names = list(survey[1])
    res = check(spark, SF_SMALL, names, verbose=False)
    bad = {k: v for k, v in res.items() if v[0] != "OK"}
    assert not bad, bad


def test_oracle_keys_are_registered(entry_module):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_attributions_add_up_to_the_model_margin(spark):
    from strata.operators.boost import assemble
    from strata.plans import model_queries as M
    model = M.trained(spark, SF_SMALL)
    frame = M.split_frame(spark, SF_SMALL)
    margin = model.transform(assemble(frame, M.FEATURES, M.COMPOSITES, model.getFeaturesCol())) \
        .select("pumfid", (vector_to_array("rawPrediction")[1] * 2).alias("logodds"))
    a = M.attributions_wide(spark, SF_SMALL).join(margin, "pumfid")
    r = a.agg(F.max(F.abs(F.col("base_plus_phi") - F.col("logodds"))).alias("d"),
              F.count(F.lit(1)).alias("n")).first()
    assert r.n == frame.count() and r.d < 1e-9


def test_model_split_sizes_are_exact(spark):
    from strata.plans import model_queries as M
    f = M.split_frame(spark, SF_SMALL)
    for r in f.groupBy("burnout_high").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("is_test").cast("int")).alias("t")).collect():
        assert r.t == round(0.2 * r.n)
    assert f.filter(F.col("is_test") & F.col("is_val")).count() == 0


def test_intake_stream_equals_batch(spark, entry_module):
    q = entry_module.queries()
    cols = ["intake_id", "valid", "cluster", "profile_name", "top_factors"]
    b = sorted(tuple(map(str, r)) for r in q["score_intake"](spark, SF_SMALL).select(*cols).collect())
    s = sorted(tuple(map(str, r)) for r in
               q["score_intake_stream"](spark, SF_SMALL).select(*cols).collect())
    assert b == s and len(b) > 0


def test_driver_tables(spark, entry_module):
    q = entry_module.queries()
    imp = q["driver_importance"](spark, SF_SMALL).collect()
    assert [r["rank"] for r in imp] == list(range(1, len(imp) + 1))
    assert all(imp[i].mean_abs_phi >= imp[i + 1].mean_abs_phi for i in range(len(imp) - 1))
    dr = q["driver_direction"](spark, SF_SMALL).collect()
    assert all((r.mean_phi > 0) == (r.net_effect == "Raises risk") for r in dr)


def test_beeswarm_and_cluster_driver_shapes(spark, entry_module):
    from strata.plans import model_queries as M
    q = entry_module.queries()
    n = M.split_frame(spark, SF_SMALL).count()
    b = q["beeswarm_points"](spark, SF_SMALL)
    r = b.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("feature").alias("f"),
              F.min("value_scaled").alias("lo"), F.max("value_scaled").alias("hi")).first()
    assert r.rows == n * r.f and r.f == 15 and r.lo >= 0.0 and r.hi <= 1.0
    cd = q["cluster_drivers"](spark, SF_SMALL).collect()
    by = {}
    for x in cd:
        by.setdefault(x.cluster, []).append(x["rank"])
    assert by and all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 10
                      for v in by.values())


def test_filter_commutes_with_decode_and_bracket_shares_add_up(spark):
    from strata.operators import clean, decode, tables
    from strata.plans import survey_queries as SQ
    from strata.spec import EXPENSE_RANGES
    frame = SQ.adf(spark, SF_SMALL)
    codes = SQ.demo_codes(spark, SF_SMALL)
    a = decode.decode(clean.filter_population(frame, {"sex": 1}), "prv", codes)
    b = clean.filter_population(decode.decode(frame, "prv", codes), {"sex": 1})
    key = ["pumfid", "prv", "prv_label"]
    assert sorted(map(tuple, a.select(*key).collect())) == sorted(map(tuple, b.select(*key).collect()))
    exp = list(SQ.SPEC.expenses)
    br = tables.bracket_distribution(frame, exp, SQ.LABEL, EXPENSE_RANGES).collect()
    for col in exp:
        rows = [r for r in br if r.variable == col]
        answered = frame.filter(F.col(col).isNotNull()).count()
        assert sum(r.n for r in rows) == answered
        assert abs(sum(r.pct_answers for r in rows) - 100.0) <= 0.05 * len(rows) + 1e-9


def test_intake_stream_restarts_from_its_checkpoint(spark, tmp_path):
    """Second available-now run on the same checkpoint picks up only new files."""
    from strata.plans import intake_queries as IQ
    from strata.streaming import intake
    rows = IQ.intake_rows(spark, SF_SMALL)
    model = IQ.intake_model(spark, SF_SMALL)
    src, sink, ckpt = (str(tmp_path / n) for n in ("src", "sink", "ckpt"))
    rows.filter(F.col("intake_id") % 2 == 0).write.json(src)
    first = intake.run_stream(spark, model, src, sink, ckpt).count()
    rows.filter(F.col("intake_id") % 2 == 1).write.mode("append").json(src)
    both = intake.run_stream(spark, model, src, sink, ckpt)
    batch = intake.score_intake(model, rows)
    key = ["intake_id", "cluster", "profile_name"]
    assert 0 < first < both.count() == rows.count()
    assert both.select("intake_id").distinct().count() == rows.count()
    assert sorted(map(tuple, both.select(*key).collect())) == \
        sorted(map(tuple, batch.select(*key).collect()))


def test_every_rows_only_query_runs(spark, survey):
    q, o = survey
    counts = {name: fn(spark, SF_SMALL).count() for name, fn in q.items() if name not in o}
    assert all(n > 0 for n in counts.values()), counts
