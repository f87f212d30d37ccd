"""Hand cases for the semantic traps (literal rows) and small properties."""

import math

from pyspark.sql import functions as F

from strata.functions import columns as C
from strata.operators import clean, decode, profile, tables
from strata.sources.codebook import clean_answer_codes, inline_codes, variable_descriptions
from strata.spec import SurveySpec, coded_spec


def rows(df, order=None):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_row_sum_min_count_and_negative_flag(spark):
    # T4: all positives NULL -> NULL even when the negative flag is 1
    df = spark.createDataFrame([(None, None, 1), (1, None, 1), (0, 0, None)],
                               "a int, b int, neg int")
    out = df.select((C.row_sum(["a", "b"], 1) - F.coalesce("neg", F.lit(0))).alias("s"))
    assert [r.s for r in out.collect()] == [None, 0, 0]


def test_row_mean_over_present_items_only(spark):
    # T5
    df = spark.createDataFrame([(1.0, None, 0.0), (None, None, None)], "a double, b double, c double")
    assert [r.m for r in df.select(C.row_mean(["a", "b", "c"]).alias("m")).collect()] == [0.5, None]


def test_recode_outside_map_is_null(spark):
    # T6
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "x int")
    out = df.select(C.recode("x", {1: 1.0, 2: 0.0}).alias("y"))
    assert [r.y for r in out.collect()] == [1.0, 0.0, None, None]


def test_threshold_is_exact_linear_median_and_inclusive(spark):
    # Median of {2,3,5,1} is 2.5 (approximate percentile would say 2)
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 5.0), (4, 1.0), (5, None)],
                               "id int, s double")
    out = clean.threshold_label(df, "s", "y", "median")
    assert dict((r.id, r.y) for r in out.collect()) == {1: 0, 2: 1, 3: 1, 4: 0, 5: None}
    fixed = clean.threshold_label(df, "s", "y", "fixed_3.0")
    assert dict((r.id, r.y) for r in fixed.collect())[2] == 1  # >= is inclusive


def test_unknown_policy_raises(spark):
    df = spark.createDataFrame([(1.0,)], "s double")
    try:
        clean.threshold_value(df, "s", "tercile")
    except ValueError:
        return
    raise AssertionError("expected ValueError")


def test_bround_is_half_even(spark):
    # 52.25 -> 52.2 (numpy style), not 52.3
    df = spark.createDataFrame([(0.5225,)], "x double")
    assert df.select(C.pct("x").alias("p")).first().p == 52.2


def test_nan_becomes_null_at_the_source(spark, tmp_path):
    # T3
    from strata.sources.survey import read_microdata
    p = str(tmp_path / "m.parquet")
    spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id int, w double").write.parquet(p)
    got = sorted(rows(read_microdata(spark, p)))
    assert got == [(1, None), (2, 3.0)]


def test_reserve_global_vs_per_column(spark):
    # Width-blind global list destroys legitimate code 6; per-column keeps it
    df = spark.createDataFrame([(6, 6), (9, 1)], "marstat int, item int")
    g = clean.null_reserve(df, ["marstat", "item"], codes=(6, 9))
    assert rows(g) == [(None, None), (None, 1)]
    spec = SurveySpec(id_col="id", weight_col=None, features=(), strain_items=(),
                      strain_recode=None, fwa_pos=(), fwa_neg="", ite_pos=(), ite_neg="",
                      reserve={"marstat": (96, 99), "item": (6, 9)})
    p = clean.null_reserve(df, ["marstat", "item"], spec=spec)
    assert rows(p) == [(6, None), (9, 1)]


def test_null_reserve_is_idempotent(spark):
    df = spark.createDataFrame([(6,), (1,), (99,), (None,)], "x int")
    once = clean.null_reserve(df, ["x"], codes=(6, 9, 99))
    twice = clean.null_reserve(once, ["x"], codes=(6, 9, 99))
    assert rows(once) == rows(twice)


def test_population_filter_on_raw_codes_equals_filter_on_cleaned(spark):
    spec = coded_spec()
    df = spark.createDataFrame([(1, 6), (1, 2), (2, 2), (1, None)], "sex int, marstat int")
    cleaned = clean.null_reserve(df, ["sex", "marstat"], spec=spec)
    for flt in ({"sex": 1, "marstat": 2}, {"marstat": 6}, {"sex": 1}):
        a = sorted(rows(clean.filter_population(cleaned, flt)), key=str)
        b = sorted(rows(clean.null_reserve(clean.filter_raw_codes(df, flt, spec),
                                           ["sex", "marstat"], spec=spec)), key=str)
        assert a == b, flt


def test_decode_falls_back_to_code_and_merges_shared_labels(spark):
    # Code 3 has no label -> "3"; codes 1 and 2 share a label -> one group
    codes = inline_codes(spark, {"v": {1: "Yes", 2: "Yes", 4: "No"}})
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (None, 1)], "v int, y int")
    out = tables.rate_by(df, "v", "y", codes=codes)
    assert sorted(rows(out)) == [("3", 1, 100.0), ("No", 1, 0.0), ("Yes", 2, 50.0)]
    d = decode.decode(df, "v", codes)
    assert sorted((r.v, r.v_label) for r in d.collect() if r.v is not None) == [
        (1, "Yes"), (2, "Yes"), (3, "3"), (4, "No")]


def test_value_counts_keeps_null_last(spark):
    # T16
    df = spark.createDataFrame([(2,), (None,), (1,), (2,)], "x int")
    assert rows(profile.value_counts(df, "x")) == [(1, 1), (2, 2), (None, 1)]


def test_prevalence_top_two_vs_strict(spark):
    # 2/3 >= 0.667 is False, so the strict variant counts only code 1
    items = spark.createDataFrame([(1.0,), (2 / 3,), (1 / 3,), (0.0,)], "ics_40 double")
    top2 = tables.item_prevalence(items, ["ics_40"], {"ics_40": "x"}, "ics_40", "recoded")
    strict = tables.item_prevalence(items, ["ics_40"], {"ics_40": "x"}, "ics_40", "recoded",
                                    strict=True)
    assert top2.first().pct_strain == 50.0 and strict.first().pct_strain == 25.0


def test_correlation_constant_column_is_null_not_error(spark):
    # Zero variance -> NULL (Spark's corr would raise under ANSI)
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, 2.0), (3.0, 5.0, 3.5)],
                               "t double, const double, x double")
    out = tables.correlate_with(df, "t", ["const", "x"], 30)
    assert [r.variable for r in out.collect()] == ["x"]
    pairs = {(r.v1, r.v2): r.r for r in tables.correlation_pairs(df, ["const", "t", "x"]).collect()}
    assert pairs[("const", "t")] is None and abs(pairs[("t", "x")] - 0.993399) < 1e-6


def test_missingness_bands_count_all_columns(spark):
    # Bands over all columns, not only the listed top rows
    df = spark.createDataFrame([(1, None, None), (2, 3, None), (3, None, None)],
                               "a int, b int, c int")
    r = profile.missingness_bands(df, ["a", "b", "c"]).first()
    assert (r.n_complete, r.n_1_to_50, r.n_over_50) == (1, 0, 2)


def test_codebook_cleaning_rules(spark):
    raw = spark.createDataFrame([
        ("v", "01", " Y  es ", 1), ("v", "00 - 84", "Range", 2), ("v", "2.0", "No", 3),
        ("v", "3", "Valid skip", 4), ("v", "2", "No (later)", 5)],
        "variable_name string, code string, label string, ord long")
    got = sorted(rows(clean_answer_codes(raw, "ord")))
    assert got == [("v", 1, "Yes"), ("v", 2, "No (later)")]


def test_variable_description_fallbacks(spark):
    raw = spark.createDataFrame([("a", "  ", "q" * 100), ("b", None, None), ("c", " C ", "x")],
                                "variable_name string, concept string, question_text string")
    d = dict(rows(variable_descriptions(raw, {})))
    assert d == {"a": "q" * 80, "b": "b", "c": "C"}


def test_display_label_marks_collisions(spark):
    df = spark.createDataFrame([("a", "x" * 50), ("b", "x" * 60), ("c", "short")],
                               "v string, desc string")
    out = dict((r.v, r.display) for r in decode.display_label(df, "desc", "v", 45).collect())
    assert out["a"] == "x" * 45 + "… [a]" and out["b"] == "x" * 45 + "… [b]"
    assert out["c"] == "short"


def test_histogram_has_exact_bins(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    h = tables.histogram(df, "x", 10)
    got = rows(h, ["bin"])
    assert len(got) == 10 and sum(r[3] for r in got) == 101 and got[-1][3] == 11


def test_classification_report_zero_division(spark):
    from strata.operators.evaluate import classification_report
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, p int")
    r = {x["class"]: x for x in classification_report(df, "y", "p").collect()}
    assert r["High"].precision == 0.0 and r["High"].recall == 0.0 and r["High"].f1 == 0.0
    assert math.isclose(r["accuracy"].f1, 2 / 3, rel_tol=1e-9)


def test_raw_and_recoded_labels_point_in_opposite_directions(spark):
    # Raw codes (1 = yes) average low for strained rows; the recoded score is high
    from strata.spec import coded_spec
    strain = coded_spec().strain_items
    row_strained = {c: 1 for c in strain}
    row_relaxed = {c: (4 if c == "ics_40" else 2) for c in strain}
    df = spark.createDataFrame([dict(row_strained, id=1), dict(row_relaxed, id=2)])
    rec = dict((r.id, r.s) for r in df.select("id", clean.strain_score(coded_spec())
                                               .alias("s")).collect())
    raw = dict((r.id, r.s) for r in df.select("id", clean.strain_score(
        coded_spec(raw_label=True)).alias("s")).collect())
    assert rec[1] == 1.0 and rec[2] == 0.0
    assert raw[1] < raw[2]


def test_prevalence_denominators(spark):
    # Recoded base drops codes outside the map; raw base keeps them
    recoded = spark.createDataFrame([(1.0,), (None,), (0.0,)], "fis_10a double")
    raw = spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "fis_10a double")
    a = tables.item_prevalence(recoded, ["fis_10a"], {"fis_10a": "x"}, "ics_40", "recoded").first()
    b = tables.item_prevalence(raw, ["fis_10a"], {"fis_10a": "x"}, "ics_40", "raw").first()
    assert (a.n_answered, a.pct_strain) == (2, 50.0)
    assert (b.n_answered, b.pct_strain) == (3, 33.3)


def test_target_is_not_ranked_against_itself(spark):
    # T11
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 3.5)], "t double, x double")
    out = [r.variable for r in tables.correlate_with(df, "t", ["t", "x"]).collect()]
    assert out == ["x"]


def test_filters_apply_before_every_table(spark):
    # A filtered view feeds the diagnostics, not the full frame
    df = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 1, 1)], "sex int, aro_10 int, y int")
    view = clean.filter_population(df, {"sex": 2})
    got = tables.activity_breadth(view, ["aro_10"], "y").collect()
    assert [(r.activity_count, r.respondents) for r in got] == [(1, 1)]


def test_weighted_rate(spark):
    # Optional weight; n stays the row count
    df = spark.createDataFrame([(1, 1, 3.0), (1, 0, 1.0)], "c int, y int, w double")
    r = tables.rate_by(df, "c", "y", weight="w").first()
    assert (r.n, r.high_pct) == (2, 75.0)


def test_golden_arithmetic_of_the_committed_report(spark):
    # 2,863 of 5,633 high = 50.8 %; confusion counts rebuilt from the per-class
    # support and recall (554 low at 0.762, 573 high at 0.773) give the reported
    # precision, F1 and accuracy.
    from strata.operators.evaluate import classification_report
    df = spark.createDataFrame([(2863, 5633)], "h long, n long")
    assert df.select(C.pct(F.col("h") / F.col("n")).alias("p")).first().p == 50.8
    tn, fp, tp, fn = 422, 554 - 422, 443, 573 - 443
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 1)] * tp + [(1, 0)] * fn
    rep = {r["class"]: r for r in classification_report(
        spark.createDataFrame(rows, "y int, p int"), "y", "p").collect()}
    assert round(rep["High"].precision, 3) == 0.770 and round(rep["Low"].precision, 3) == 0.764
    assert round(rep["High"].f1, 3) == 0.772 and round(rep["Low"].f1, 3) == 0.763
    assert round(rep["accuracy"].f1, 3) == 0.768 and rep["accuracy"].support == 1127


def test_zero_weight_group_and_empty_overview_do_not_raise(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 0, 1.0)], "c int, y int, w double")
    got = dict((r.category, r.high_pct) for r in tables.rate_by(df, "c", "y", weight="w").collect())
    assert got == {"1": None, "2": 0.0}
    empty = spark.createDataFrame([], "s double, y int, w double")
    r = profile.dataset_overview(empty, empty, "s", "y", "w", F.lit(0.5), 0).first()
    assert r.valid_rows == 0 and r.pct_high is None


def test_intake_parsing_and_validation(spark):
    from strata.streaming.intake import parse_intake
    rows = [(1, "20", "Employed full-time", "Strong support", "2 years", ""),
            (2, "n/a", "Employed part-time", "Some support", "6 months", None),
            (3, "200", "Retired", "Little or no support", "26 weeks", None),
            (4, "5", "Not currently employed", "Lots", "forever", None)]
    df = spark.createDataFrame(rows, "intake_id long, care_hours string, employment_status string, "
                                     "support_network string, care_duration string, notes string")
    got = {r.intake_id: r for r in parse_intake(df).collect()}
    assert got[1].valid and got[1].care_hours == 20.0 and got[1].duration_years == 2.0
    assert got[2].errors == ["care_hours"] and got[2].duration_years == 0.5
    assert sorted(got[3].errors) == ["care_hours", "employment_status"]
    assert got[3].duration_years == 0.5 and got[3].support_code == 3
    assert sorted(got[4].errors) == ["care_duration", "support_network"]


def test_labels_presence_and_leak_guards(spark, tmp_path):
    # S2, Q8, Q9, P2, P3, S6
    from strata.sources.survey import column_labels, with_labels, write_tables
    df = spark.createDataFrame([(1, 2, 3, 4.0)], "pumfid long, sex int, wtbs_001 int, w double")
    labelled = with_labels(df, {"sex": "Sex", "missing": "x"})
    assert column_labels(labelled) == {"sex": "Sex"}
    present, missing = clean.column_presence(df, ["sex", "vismin", "pumfid"])
    assert present == ["sex", "pumfid"] and missing == ["vismin"]
    assert clean.select_available(df, ["sex", "vismin", "pumfid"]).columns == ["sex", "pumfid"]
    assert "wtbs_001" not in clean.drop_prefix(df, ["WTBS_"]).columns
    assert clean.drop_columns(df, exact=["w"], prefixes=["wt"]).columns == ["pumfid", "sex"]
    spec = SurveySpec(id_col="pumfid", weight_col="w", features=("sex", "ics_40"),
                      strain_items=("ics_40",), strain_recode=None, fwa_pos=(), fwa_neg="",
                      ite_pos=(), ite_neg="")
    leaky = df.withColumn("ics_40", F.lit(1))
    try:
        clean.split_roles(leaky, spec)
    except ValueError:
        pass
    else:
        raise AssertionError("label item among features must raise")
    paths = write_tables({"t": df}, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(paths[0]).count() == 1


def test_rate_by_all_matches_rate_by_per_column(spark):
    df = spark.createDataFrame([(1, 2, 1, 2.0), (1, 3, 0, 1.0), (2, 2, 1, 1.0), (None, 3, 1, 5.0)],
                               "a int, b int, y int, w double")
    for weight in (None, "w"):
        allv = {(r.variable, r.category): (r.n, r.high_pct)
                for r in tables.rate_by_all(df, ["a", "b"], "y", weight=weight).collect()}
        for col in ("a", "b"):
            for r in tables.rate_by(df, col, "y", weight=weight).collect():
                assert allv[(col, r.category)] == (r.n, r.high_pct)
