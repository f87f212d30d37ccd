"""Registered queries over the survey-shaped ``coded`` table (P, Q, J, A ops)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import clean, decode, profile, tables
from strata.plans import sqltext as S
from strata.plans.registry import register
from strata.session import materialize
from strata.sources.coded import REPLICATE_WEIGHTS, coded_cte, coded_columns, load_coded
from strata.sources.codebook import inline_codes
from strata.sources.tables import read_table
from strata.spec import (EXPENSE_RANGES, INCOME_BRACKETS, STRAIN_LABELS, coded_spec)

SPEC = coded_spec()
SPEC_RAW = coded_spec(raw_label=True)
LABEL, SCORE, WEIGHT = SPEC.label_col, SPEC.score_col, SPEC.weight_col

# Fixed labels of the inline codebook rows (sex, market-segment marital codes).
INLINE_CODES = {
    "sex": {1: "Male", 2: "Female"},
    "marstat": {1: "AUTOMOBILE", 2: "BUILDING", 3: "FURNITURE", 4: "HOUSEHOLD"},
    "famincg1": INCOME_BRACKETS,
}
STRAIN_NAMES = {k.lower(): v for k, v in STRAIN_LABELS.items()}
FEATURES = list(SPEC.features)
DEMOS = ["sex", "prv", "famincg1", "marstat"]


def coded(spark: SparkSession, d: str) -> DataFrame:
    return load_coded(spark, d)


_CACHE: dict = {}


def adf(spark: SparkSession, d: str, policy: str = "median", raw: bool = False) -> DataFrame:
    """The analysis table.  The default (recoded, median split) table feeds most
    reports, so it is written once per session as a Parquet table into the
    shared ``spark.checkpoint.dir`` (as the source analysis keeps its cleaned
    frame for every section); later scans prune columns and take pushed
    filters.  Other policies are computed on demand."""
    if policy != "median" or raw:
        return clean.analysis_frame(coded(spark, d), SPEC_RAW if raw else SPEC, policy)
    key = (spark.sparkContext.applicationId, d.rstrip("/"))
    if key not in _CACHE:
        _CACHE[key] = materialize(clean.analysis_frame(coded(spark, d), SPEC, policy), "analysis")
    return _CACHE[key]


def demo_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codebook for the demographic columns: provinces from ``nation`` + inline rows."""
    nation = read_table(spark, d, "nation").select(
        F.lit("prv").alias("variable_name"), F.col("n_nationkey").cast("int").alias("code"),
        F.col("n_name").alias("label"))
    return nation.unionByName(inline_codes(spark, INLINE_CODES))


DEMO_CODES_SQL = (
    "codes AS (SELECT 'prv' AS variable_name, n_nationkey AS code, n_name AS label FROM nation "
    "UNION ALL SELECT * FROM (VALUES "
    + S.values_rows([(v, k, lab) for v, m in INLINE_CODES.items() for k, lab in m.items()])
    + ") t(variable_name, code, label))")

A = S.adf_cte()


# --------------------------------------------------------------- entry slice

@register("high_rate_by_region", A + """, g AS (
  SELECT prv AS value, count(*) AS n, sum(burnout_high) AS s FROM adf
  WHERE prv IS NOT NULL AND burnout_high IS NOT NULL GROUP BY prv),
d AS (SELECT COALESCE(nt.n_name, CAST(g.value AS VARCHAR)) AS category, g.n, g.s
      FROM g LEFT JOIN nation nt ON g.value = nt.n_nationkey)
SELECT category, CAST(sum(n) AS BIGINT) AS n,
       """ + S.pct(S.ratio("sum(s)", "sum(n)")) + """ AS high_pct
FROM d GROUP BY category ORDER BY high_pct DESC, category""")
def high_rate_by_region(spark, d):
    """Strain label (median split) -> high rate per decoded province (J1 + A1)."""
    codes = read_table(spark, d, "nation").select(
        F.lit("prv").alias("variable_name"), F.col("n_nationkey").alias("code"),
        F.col("n_name").alias("label"))
    return tables.rate_by(adf(spark, d), "prv", LABEL, codes=codes)


# --------------------------------------------------------------- P4, P5

_NULLED = [c for c in coded_columns() if c not in ("pumfid", "wght_per")
           and not c.startswith("wtbs_")]


@register("null_reserve_items", coded_cte() + "SELECT pumfid, wght_per, "
          + "".join(f"{w}, " for w in REPLICATE_WEIGHTS)
          + ", ".join(f"{S.nul(c)} AS {c}" for c in _NULLED) + " FROM coded")
def null_reserve_items(spark, d):
    """Reserve codes -> NULL in every coded column (P4, width-blind parity)."""
    return clean.null_reserve(coded(spark, d), _NULLED, spec=SPEC)


@register("recode_items", coded_cte() + "SELECT pumfid, "
          + ", ".join(f"{e} AS {c}" for c, e in zip(S.STRAIN, S.strain_items())) + " FROM coded")
def recode_items(spark, d):
    """Strain items: reserve -> NULL, recode to 0..1 strain (P4 + P5)."""
    return clean.strain_items_frame(coded(spark, d), SPEC)


# --------------------------------------------------------------- P6, P7, Q6

@register("flexibility_score_dist", coded_cte() + f"""SELECT flexibility_score, count(*) AS n
FROM (SELECT {S.FLEX} AS flexibility_score FROM coded) GROUP BY flexibility_score""")
def flexibility_score_dist(spark, d):
    """Distribution of the workplace flexibility composite, NULL included."""
    c = clean.with_composites(coded(spark, d), SPEC)
    return profile.value_counts(c, "flexibility_score")


@register("ite_score_dist", coded_cte() + f"""SELECT ite_score, count(*) AS n
FROM (SELECT {S.ITE} AS ite_score FROM coded) GROUP BY ite_score""")
def ite_score_dist(spark, d):
    """Distribution of the work-enabling composite, NULL included."""
    c = clean.with_composites(coded(spark, d), SPEC)
    return profile.value_counts(c, "ite_score")


# --------------------------------------------------------------- P8

@register("strain_score", coded_cte()
          + f"SELECT pumfid, {S.strain_score()} AS burnout_score FROM coded")
def strain_score(spark, d):
    """Row mean of the recoded strain items (NULL when none answered)."""
    return coded(spark, d).select("pumfid", clean.strain_score(SPEC).alias(SCORE))


@register("strain_score_raw", coded_cte()
          + f"SELECT pumfid, {S.strain_score(raw=True)} AS burnout_score FROM coded")
def strain_score_raw(spark, d):
    """Row mean of the raw strain codes (the raw-code label definition)."""
    return coded(spark, d).select("pumfid", clean.strain_score(SPEC_RAW).alias(SCORE))


# --------------------------------------------------------------- P9, A18

def _label_query(policy):
    def q(spark, d):
        return adf(spark, d, policy).select("pumfid", SCORE, LABEL)
    q.__doc__ = f"Threshold label with policy {policy!r} on the scored rows."
    return q


for _name, _policy in (("label_median", "median"), ("label_p75", "percentile_75"),
                       ("label_fixed", "fixed_0.5")):
    register(_name, S.adf_cte(_policy) + "SELECT pumfid, burnout_score, burnout_high FROM adf")(
        _label_query(_policy))


# --------------------------------------------------------------- P1-P3, P10-P12

@register("analysis_frame", A + "SELECT * FROM adf")
def analysis_frame(spark, d):
    """Features + label + score + weight of the scored rows (one DataFrame)."""
    return adf(spark, d)


@register("single_item_target", coded_cte() + "SELECT "
          + ", ".join(c for c in coded_columns() if c != "ics_40")
          + f", {S.nul('ics_40')} AS target FROM coded WHERE {S.nul('ics_40')} IS NOT NULL")
def single_item_target(spark, d):
    """One item as the target: reserve -> NULL, answered rows only."""
    return clean.single_item_target(coded(spark, d), "ics_40", SPEC)


# --------------------------------------------------------------- P15, P16, A15

@register("filtered_kpis", A + """SELECT count(*) AS n_view,
  CAST(COALESCE(sum(burnout_high), 0) AS BIGINT) AS n_high,
  COALESCE(round_even(CAST(COALESCE(sum(burnout_high), 0) AS DOUBLE) * CAST(100 AS DOUBLE)
           / CAST(count(*) AS DOUBLE), 1), CAST(0 AS DOUBLE)) AS pct_high,
  round_even(avg(burnout_score), 6) AS mean_score,
  round_even(avg(flexibility_score), 6) AS mean_flex
FROM adf WHERE sex = 1 AND marstat = 2""")
def filtered_kpis(spark, d):
    """KPIs of a filtered population (sex = 1 and marstat = 2).

    The filters reach the scan of the stored analysis table as pushed
    equality filters; the label keeps the whole-population threshold."""
    view = clean.filter_population(adf(spark, d), {"sex": 1, "marstat": 2})
    return tables.kpis(view, LABEL, SCORE, "flexibility_score")


_CUBE = ["sex", "marstat", "prv", "famincg1"]


@register("population_cube", A + "SELECT " + ", ".join(_CUBE) + """,
  """ + " || ".join(f"CAST(GROUPING({c}) AS VARCHAR)" for c in _CUBE) + """ AS all_flags,
  count(*) AS n_view, CAST(COALESCE(sum(burnout_high), 0) AS BIGINT) AS n_high,
  round_even(CAST(COALESCE(sum(burnout_high), 0) AS DOUBLE) * CAST(100 AS DOUBLE)
             / CAST(count(*) AS DOUBLE), 1) AS pct_high,
  round_even(avg(burnout_score), 6) AS mean_score, round_even(avg(flexibility_score), 6) AS mean_flex
FROM adf GROUP BY CUBE (""" + ", ".join(_CUBE) + ")")
def population_cube(spark, d):
    """KPIs of every filter combination of the dashboard, "All" being the cube's own level (P15 x A15 x A1)."""
    return tables.population_cube(adf(spark, d), _CUBE, LABEL, SCORE, "flexibility_score")


@register("filter_options", A + ", " + DEMO_CODES_SQL + ", u AS ("
          + S.unpivot("adf", DEMOS, "CAST({c} AS INTEGER)") + """),
dd AS (SELECT DISTINCT variable, value AS code FROM u WHERE value IS NOT NULL)
SELECT dd.variable, dd.code, COALESCE(codes.label, CAST(dd.code AS VARCHAR)) AS label
FROM dd LEFT JOIN codes ON dd.variable = codes.variable_name AND dd.code = codes.code
ORDER BY 1, 2""")
def filter_options(spark, d):
    """Distinct codes with labels for each demographic filter."""
    return decode.filter_options(adf(spark, d), DEMOS, demo_codes(spark, d))


# --------------------------------------------------------------- Q1, Q3

_ADF_COLS = ["pumfid", *FEATURES, LABEL, SCORE, WEIGHT]


@register("shape_nulls", A + "\nUNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
    f"count(*) AS n_rows FROM adf" for c in _ADF_COLS))
def shape_nulls(spark, d):
    """Row count and nulls per column of the analysis frame, one scan (Q1, Q3)."""
    return profile.null_counts(adf(spark, d))


# --------------------------------------------------------------- Q10 - Q13

_MISS_COLS = FEATURES


def _miss_sql():
    return S.unpivot("adf", _MISS_COLS, "avg(CAST({c} IS NULL AS DOUBLE))")


@register("missingness_top", A + ", m AS (" + _miss_sql() + """)
SELECT variable, value * CAST(100 AS DOUBLE) AS pct_missing FROM m WHERE value > 0
ORDER BY pct_missing DESC, variable LIMIT 20""")
def missingness_top(spark, d):
    """Top-20 features by percent missing (> 0 only)."""
    return profile.missingness(adf(spark, d), _MISS_COLS, 20)


@register("missingness_bands", A + ", m AS (" + _miss_sql() + f"""),
p AS (SELECT value * CAST(100 AS DOUBLE) AS pct_missing FROM m WHERE value > 0)
SELECT CAST({len(_MISS_COLS)} - count(*) AS BIGINT) AS n_complete,
  count(*) FILTER (WHERE pct_missing < 1) AS n_under_1,
  count(*) FILTER (WHERE pct_missing BETWEEN 1 AND 50) AS n_1_to_50,
  count(*) FILTER (WHERE pct_missing > 50) AS n_over_50 FROM p""")
def missingness_bands(spark, d):
    """Number of features fully answered, under 1 %, 1-50 % and > 50 % missing."""
    return profile.missingness_bands(adf(spark, d), _MISS_COLS)


@register("dataset_overview", A + f"""SELECT (SELECT count(*) FROM coded) AS total_rows,
  count(*) AS valid_rows, (SELECT count(*) FROM coded) - count(*) AS excluded_rows,
  {len(FEATURES)} AS n_features,
  round_even(avg(burnout_score), 6) AS score_mean,
  round_even(median(burnout_score), 6) AS score_median,
  round_even(stddev_samp(burnout_score), 6) AS score_std,
  round_even(min(burnout_score), 6) AS score_min,
  round_even(max(burnout_score), 6) AS score_max,
  round_even((SELECT t FROM thr), 6) AS threshold,
  CAST(sum(burnout_high) AS BIGINT) AS n_high,
  CAST(count(*) - sum(burnout_high) AS BIGINT) AS n_low,
  round_even(CAST(sum(burnout_high) AS DOUBLE) * CAST(100 AS DOUBLE) / count(*), 1) AS pct_high,
  round_even(CAST(count(*) - sum(burnout_high) AS DOUBLE) * CAST(100 AS DOUBLE) / count(*), 1)
    AS pct_low,
  min(wght_per) AS weight_min, max(wght_per) AS weight_max
FROM adf""")
def dataset_overview(spark, d):
    """Totals, score statistics, threshold, class split and weight range (Q12)."""
    raw = coded(spark, d)
    scored = clean.scored_frame(raw, SPEC)
    t = clean.threshold_value(scored, SCORE, "median")
    return profile.dataset_overview(raw, adf(spark, d), SCORE, LABEL, WEIGHT, t, len(FEATURES))


_EXPLORE = [c for c in FEATURES if c not in SPEC.composites]


@register("explorable_columns", A + ", u AS ("
          + S.unpivot("adf", _EXPLORE, "CAST({c} AS DOUBLE)") + """)
SELECT variable, count(DISTINCT value) AS n_distinct, count(value) AS n_answered
FROM u GROUP BY variable
HAVING count(DISTINCT value) <= 20 AND count(value) > 50 ORDER BY variable""")
def explorable_columns(spark, d):
    """Columns with <= 20 distinct answers and > 50 answered rows (Q13)."""
    return profile.explorable_columns(adf(spark, d), _EXPLORE)


# --------------------------------------------------------------- J1

@register("decode_prv", A + """SELECT a.pumfid, a.prv,
  CASE WHEN a.prv IS NOT NULL THEN COALESCE(nt.n_name, CAST(a.prv AS VARCHAR)) END AS prv_label
FROM adf a LEFT JOIN nation nt ON a.prv = nt.n_nationkey""")
def decode_prv(spark, d):
    """Decode the province code of every scored row through ``nation``."""
    codes = read_table(spark, d, "nation").select(
        F.lit("prv").alias("variable_name"), F.col("n_nationkey").alias("code"),
        F.col("n_name").alias("label"))
    return decode.decode(adf(spark, d).select("pumfid", "prv"), "prv", codes)


# --------------------------------------------------------------- A2, A17, A3, A4

@register("rate_by_demographics", A + ", " + DEMO_CODES_SQL + ", u AS ("
          + S.unpivot("adf", DEMOS, "CAST({c} AS INTEGER)", "burnout_high AS y") + """),
g AS (SELECT variable, value, count(*) AS n, sum(y) AS s FROM u
      WHERE value IS NOT NULL AND y IS NOT NULL GROUP BY variable, value),
dd AS (SELECT g.variable, COALESCE(codes.label, CAST(g.value AS VARCHAR)) AS category, g.n, g.s
       FROM g LEFT JOIN codes ON g.variable = codes.variable_name AND g.value = codes.code)
SELECT variable, category, CAST(sum(n) AS BIGINT) AS n,
  """ + S.pct(S.ratio("sum(s)", "sum(n)")) + """ AS high_pct
FROM dd GROUP BY variable, category""")
def rate_by_demographics(spark, d):
    """High rate per decoded category of every demographic column, one job (A2)."""
    return tables.rate_by_all(adf(spark, d), DEMOS, LABEL, demo_codes(spark, d))


_INCOME_SQL = "VALUES " + ", ".join(
    f"({k}, '{v}')" for k, v in INCOME_BRACKETS.items())


@register("answer_table", A + f""", lab AS (SELECT * FROM ({_INCOME_SQL}) t(code, label)),
g AS (SELECT famincg1 AS value, count(*) AS n, sum(burnout_high) AS s FROM adf
      WHERE famincg1 IS NOT NULL AND burnout_high IS NOT NULL GROUP BY famincg1),
dd AS (SELECT COALESCE(lab.label, CAST(g.value AS VARCHAR)) AS answer, g.n, g.s
       FROM g LEFT JOIN lab ON g.value = lab.code)
SELECT answer, CAST(sum(n) AS BIGINT) AS respondents,
  """ + S.pct(S.ratio("sum(s)", "sum(n)")) + """ AS high_pct FROM dd GROUP BY answer""")
def answer_table(spark, d):
    """Respondents and high rate per decoded income answer."""
    return tables.answer_table(adf(spark, d), "famincg1", LABEL, mapping=INCOME_BRACKETS)


@register("rate_by_flexibility", A + """SELECT flexibility_score, count(*) AS n,
  """ + S.pct("avg(burnout_high)") + """ AS high_pct FROM adf
WHERE flexibility_score IS NOT NULL AND burnout_high IS NOT NULL
GROUP BY flexibility_score""")
def rate_by_flexibility(spark, d):
    """High rate and n per flexibility score value (A3)."""
    return tables.rate_by_score(adf(spark, d), "flexibility_score", LABEL)


@register("score_stats", A + """SELECT count(flexibility_score) AS n,
  round_even(avg(flexibility_score), 6) AS mean, median(flexibility_score) AS median,
  round_even(stddev_samp(flexibility_score), 6) AS std FROM adf""")
def score_stats(spark, d):
    """n, mean, median and std of the flexibility score (A4)."""
    return tables.score_stats(adf(spark, d), "flexibility_score")


# --------------------------------------------------------------- A5 - A8

_ACT = list(SPEC.activity)
_KSQL = "(" + " + ".join(f"CAST(COALESCE({c} = 1, false) AS INTEGER)" for c in _ACT) + ")"


@register("activity_breadth", A + f"""SELECT {_KSQL} AS activity_count, count(*) AS respondents,
  {S.pct('avg(burnout_high)')} AS high_pct FROM adf GROUP BY 1""")
def activity_breadth(spark, d):
    """Respondents and high rate per number of activity types."""
    return tables.activity_breadth(adf(spark, d), _ACT, LABEL)


@register("activity_stats", A + f""", k AS (SELECT {_KSQL} AS k FROM adf)
SELECT count(*) FILTER (WHERE k > 0) AS n_active,
  round_even(avg(CASE WHEN k > 0 THEN k END), 6) AS mean_active,
  count(*) FILTER (WHERE k >= 3) AS n_3plus,
  {S.pct('avg(CAST(k >= 3 AS DOUBLE))')} AS pct_3plus FROM k""")
def activity_stats(spark, d):
    """Active caregivers, mean types among active, n and % with 3+."""
    return tables.activity_stats(adf(spark, d), _ACT)


@register("flag_breakdown", A + ", u AS ("
          + S.unpivot("adf", _ACT, "CAST({c} AS INTEGER)", "burnout_high AS y") + ")"
          + ", names AS (SELECT * FROM (VALUES "
          + ", ".join(f"('{k}', '{v}')" for k, v in SPEC.activity.items())
          + """) t(variable, activity))
SELECT u.variable, names.activity, count(*) AS n_yes,
  """ + S.pct(S.ratio("count(*)", "(SELECT count(*) FROM adf)")) + """ AS pct_rows,
  """ + S.pct("avg(y)") + """ AS high_pct
FROM u JOIN names ON u.variable = names.variable WHERE u.value = 1
GROUP BY u.variable, names.activity""")
def flag_breakdown(spark, d):
    """Per activity flag: n yes, % of all rows, high rate among yes."""
    return tables.flag_breakdown(adf(spark, d), SPEC.activity, LABEL)


_EXP = list(SPEC.expenses)
_ANY = "COALESCE(" + ", ".join(_EXP) + ") IS NOT NULL"


@register("answered_any", A + f"""SELECT count(*) FILTER (WHERE {_ANY}) AS n_answered,
  {S.pct(f'avg(CAST({_ANY} AS DOUBLE))')} AS pct_answered,
  count(*) FILTER (WHERE NOT ({_ANY})) AS n_remaining FROM adf""")
def answered_any(spark, d):
    """Respondents answering at least one expense item."""
    return tables.answered_any(adf(spark, d), _EXP)


_BRACKETS_SQL = "VALUES " + ", ".join(f"({k}, '{v}')" for k, v in EXPENSE_RANGES.items())


@register("bracket_distribution", A + ", u AS ("
          + S.unpivot("adf", _EXP, "CAST({c} AS INTEGER)", "burnout_high AS y")
          + f"), br AS (SELECT * FROM ({_BRACKETS_SQL}) t(code, bracket)),"
          + """
g AS (SELECT variable, value, count(*) AS n, sum(y) AS s, count(y) AS ny FROM u
      WHERE value IS NOT NULL GROUP BY variable, value),
t AS (SELECT variable, sum(n) AS tot FROM g GROUP BY variable)
SELECT g.variable, g.value AS code, br.bracket, g.n,
  """ + S.pct(S.ratio("g.n", "t.tot")) + """ AS pct_answers,
  """ + S.pct("CASE WHEN g.ny > 0 THEN CAST(g.s AS DOUBLE) / CAST(g.ny AS DOUBLE) "
              "ELSE CAST(0 AS DOUBLE) END") + """ AS high_pct
FROM g JOIN t ON g.variable = t.variable JOIN br ON g.value = br.code""")
def bracket_distribution(spark, d):
    """Per expense column and bracket: n, % of answers, high rate."""
    return tables.bracket_distribution(adf(spark, d), _EXP, LABEL, EXPENSE_RANGES)


@register("pooled_brackets", A + ", u AS ("
          + S.unpivot("adf", _EXP, "CAST({c} AS INTEGER)")
          + f"), br AS (SELECT * FROM ({_BRACKETS_SQL}) t(code, bracket))" + """
SELECT u.value AS code, COALESCE(br.bracket, CAST(u.value AS VARCHAR)) AS bracket,
  count(*) AS n FROM u LEFT JOIN br ON u.value = br.code WHERE u.value IS NOT NULL
GROUP BY u.value, br.bracket""")
def pooled_brackets(spark, d):
    """Counts per expense bracket over all expense columns stacked."""
    return tables.pooled_brackets(adf(spark, d), _EXP, EXPENSE_RANGES)


@register("share_at_least", A + ", u AS ("
          + S.unpivot("adf", _EXP, "CAST({c} AS INTEGER)")
          + "), names AS (SELECT * FROM (VALUES "
          + ", ".join(f"('{k}', '{v}')" for k, v in SPEC.expenses.items())
          + """) t(variable, category))
SELECT u.variable, names.category, count(*) AS n_answered,
  """ + S.pct("avg(CAST(u.value >= 4 AS DOUBLE))") + """ AS pct_at_least
FROM u JOIN names ON u.variable = names.variable WHERE u.value IS NOT NULL
GROUP BY u.variable, names.category""")
def share_at_least(spark, d):
    """Per expense column: answered n and % spending $1,000 or more."""
    return tables.share_at_least(adf(spark, d), _EXP, 4, SPEC.expenses)


# --------------------------------------------------------------- A14

def _prev_sql(raw: bool) -> str:
    items = ([f"CAST({S.nul(c)} AS DOUBLE)" for c in S.STRAIN] if raw else S.strain_items())
    sel = ", ".join(f"{e} AS {c}" for c, e in zip(S.STRAIN, items))
    hit = ("CASE WHEN u.variable = 'ics_40' THEN u.value <= 2 ELSE u.value = 1 END" if raw else
           "CASE WHEN u.variable = 'ics_40' THEN u.value >= CAST(2 AS DOUBLE) / CAST(3 AS DOUBLE) "
           "ELSE u.value = 1 END")
    names = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')"
                      for k, v in STRAIN_NAMES.items())
    return (coded_cte().rstrip() + f", items AS (SELECT {sel} FROM coded), u AS ("
            + S.unpivot("items", S.STRAIN) + f"), names AS (SELECT * FROM (VALUES {names}) "
            f"t(variable, indicator))\n"
            f"SELECT u.variable, names.indicator, {S.pct(f'avg(CAST({hit} AS DOUBLE))')} "
            "AS pct_strain, CASE WHEN u.variable = 'ics_40' THEN 'Very or Stressful (top 2 of 4)' "
            "ELSE 'Yes (strain present)' END AS scale, count(*) AS n_answered "
            "FROM u JOIN names ON u.variable = names.variable WHERE u.value IS NOT NULL "
            "GROUP BY u.variable, names.indicator")


@register("item_prevalence", _prev_sql(raw=False))
def item_prevalence(spark, d):
    """% at strain per item on recoded values; scale item = top two codes."""
    items = clean.strain_items_frame(coded(spark, d), SPEC)
    return tables.item_prevalence(items, SPEC.strain_items, STRAIN_NAMES, "ics_40", "recoded")


@register("item_prevalence_raw", _prev_sql(raw=True))
def item_prevalence_raw(spark, d):
    """% at strain per item on raw codes after reserve removal (dashboard base)."""
    items = clean.null_reserve(coded(spark, d).select(*SPEC.strain_items), SPEC.strain_items,
                               spec=SPEC)
    return tables.item_prevalence(items, SPEC.strain_items, STRAIN_NAMES, "ics_40", "raw")


# --------------------------------------------------------------- A10, A11

def _corr_sql(expr_x="x", expr_y="y"):
    return (f"covar_pop({expr_x}, {expr_y}) / NULLIF(stddev_pop({expr_x}) * "
            f"stddev_pop({expr_y}), 0)")


_CORR_COLS = FEATURES

_CORR_TOP_SQL = (", u AS (" + S.unpivot("adf", _CORR_COLS, "CAST({c} AS DOUBLE)",
                                        "burnout_score AS y") + """),
r AS (SELECT variable, """ + _corr_sql("value", "y") + """ AS r FROM u
      WHERE value IS NOT NULL AND y IS NOT NULL GROUP BY variable),
top AS (SELECT variable, r FROM r WHERE r IS NOT NULL AND NOT isnan(r)
        ORDER BY abs(r) DESC, variable LIMIT {n})""")


@register("correlate_with_score", A + _CORR_TOP_SQL.format(n=30) + """
SELECT CAST(row_number() OVER (ORDER BY abs(r) DESC, variable) AS INTEGER) AS rank, variable,
  round_even(r, 6) AS r,
  CASE WHEN r > 0 THEN 'More -> more burnout' ELSE 'More -> less burnout' END AS direction
FROM top""")
def correlate_with_score(spark, d):
    """Top-30 features by |Pearson r| with the strain score, pairwise complete (A10)."""
    return tables.correlate_with(adf(spark, d), SCORE, _CORR_COLS, 30)


@register("correlation_pairs", A + _CORR_TOP_SQL.format(n=15) + ", l AS ("
          + S.unpivot("adf", _CORR_COLS, "CAST({c} AS DOUBLE)", "pumfid") + """),
lt AS (SELECT l.* FROM l JOIN top ON l.variable = top.variable WHERE l.value IS NOT NULL)
SELECT a.variable AS v1, b.variable AS v2, count(*) AS n,
  round_even(""" + _corr_sql("a.value", "b.value") + """, 6) AS r
FROM lt a JOIN lt b ON a.pumfid = b.pumfid AND a.variable < b.variable
GROUP BY a.variable, b.variable""")
def correlation_pairs(spark, d):
    """Pairwise-complete r among the 15 features most correlated with the score.

    The 15 names (a bounded list) come from the A10 result; the pair moments
    are one partially aggregated pass over the analysis frame.
    """
    frame = adf(spark, d)
    top = tables.correlate_with(frame, SCORE, _CORR_COLS, 15)
    names = sorted(r["variable"] for r in top.select("variable").collect())
    return tables.correlation_pairs(frame, names)


# --------------------------------------------------------------- A19, A20

_CLUSTER_DEMOS = ["sex", "marstat", "prv", "famincg1"]


@register("cluster_profile", A + """, g AS (SELECT famincg1, count(*) AS n,
  avg(burnout_high) AS rate FROM adf WHERE famincg1 IS NOT NULL GROUP BY famincg1)
SELECT famincg1, n, """ + S.pct(S.ratio("n", "sum(n) OVER ()")) + """ AS pct_total,
  """ + S.pct("rate") + """ AS high_pct FROM g""")
def cluster_profile(spark, d):
    """Per cluster (the given income group code): size, % of total, high rate."""
    frame = adf(spark, d).filter(F.col("famincg1").isNotNull())
    return tables.cluster_profile(frame, "famincg1", LABEL)


@register("cluster_medians", A + ", u AS ("
          + S.unpivot("adf WHERE famincg1 IS NOT NULL", _CLUSTER_DEMOS, "CAST({c} AS DOUBLE)",
                      "famincg1 AS cluster") + """)
SELECT cluster AS famincg1, variable, round_even(median(value), 1) AS median
FROM u GROUP BY cluster, variable""")
def cluster_medians(spark, d):
    """Median of each demographic column per cluster."""
    frame = adf(spark, d).filter(F.col("famincg1").isNotNull())
    return tables.cluster_medians(frame, "famincg1", _CLUSTER_DEMOS)



# --------------------------------------------------------------- P1 - P3, Q1, Q8

_ALLOW = ["pumfid", "sex", "prv", "marstat", "famincg1", "vismin", "senflag",
          *SPEC.activity, *SPEC.expenses, "wght_per", "wtbs_001"]
_KEPT = [c for c in _ALLOW if c in coded_columns() and not c.startswith("wtbs_")]


@register("drop_replicate_weights", coded_cte() + "SELECT " + ", ".join(_KEPT) + " FROM coded")
def drop_replicate_weights(spark, d):
    """Drop replicate weights (prefix), the raw FWA/ITE module (prefix), then the
    ordered allow-list with absent names skipped (P1, P2, P3)."""
    c = clean.drop_prefix(coded(spark, d), ["wtbs_"])
    c = clean.drop_columns(c, exact=(), prefixes=("fwa_", "ite_"))
    return clean.select_available(c, _ALLOW)


# --------------------------------------------------------------- Q5, P21

@register("preview_scored", A + "SELECT * FROM adf ORDER BY pumfid LIMIT 10")
def preview_scored(spark, d):
    """First 10 rows of the analysis frame under an explicit order (Q5)."""
    return profile.preview(adf(spark, d), 10, "pumfid")


@register("report_rate_by_region", A + """, g AS (
  SELECT prv AS value, count(*) AS n, sum(burnout_high) AS s FROM adf
  WHERE prv IS NOT NULL AND burnout_high IS NOT NULL GROUP BY prv),
d AS (SELECT COALESCE(nt.n_name, CAST(g.value AS VARCHAR)) AS category, g.n, g.s
      FROM g LEFT JOIN nation nt ON g.value = nt.n_nationkey),
r AS (SELECT category, CAST(sum(n) AS BIGINT) AS n,
       """ + S.pct(S.ratio("sum(s)", "sum(n)")) + """ AS high_pct FROM d GROUP BY category)
SELECT category, format('{:,}', n) AS n, printf('%.1f', high_pct) || '%' AS high_pct FROM r""")
def report_rate_by_region(spark, d):
    """The province table formatted for the report: 1,234 and 52.3%."""
    from strata.functions.columns import format_cells
    return format_cells(high_rate_by_region(spark, d), {"n": "thousands", "high_pct": "pct"})


# --------------------------------------------------------------- T19 (optional weight)

@register("weighted_rate_by_region", A + """, g AS (
  SELECT prv AS value, count(*) AS n, sum(burnout_high * wght_per) AS s, sum(wght_per) AS sw
  FROM adf WHERE prv IS NOT NULL AND burnout_high IS NOT NULL AND wght_per IS NOT NULL
  GROUP BY prv),
d AS (SELECT COALESCE(nt.n_name, CAST(g.value AS VARCHAR)) AS category, g.n, g.s, g.sw
      FROM g LEFT JOIN nation nt ON g.value = nt.n_nationkey)
SELECT category, CAST(sum(n) AS BIGINT) AS n,
  round_even(sum(s) / sum(sw) * CAST(100 AS DOUBLE), 1) AS high_pct
FROM d GROUP BY category""")
def weighted_rate_by_region(spark, d):
    """Person-weighted high rate per decoded province (A1 with the survey weight)."""
    codes = read_table(spark, d, "nation").select(
        F.lit("prv").alias("variable_name"), F.col("n_nationkey").alias("code"),
        F.col("n_name").alias("label"))
    return tables.rate_by(adf(spark, d), "prv", LABEL, codes=codes, weight=WEIGHT)


@register("histogram_score", A + """, s AS (SELECT min(burnout_score) AS lo,
  max(burnout_score) AS hi FROM adf WHERE burnout_score IS NOT NULL),
w AS (SELECT lo, (hi - lo) / 30 AS width FROM s),
b AS (SELECT CAST(CASE WHEN w.width > 0 THEN least(floor((a.burnout_score - w.lo) / w.width), 29)
             ELSE 0 END AS INTEGER) AS bin FROM adf a, w WHERE a.burnout_score IS NOT NULL)
SELECT b.bin, round_even(w.lo + b.bin * w.width, 6) AS lo,
  round_even(w.lo + (b.bin + 1) * w.width, 6) AS hi, count(*) AS n
FROM b, w GROUP BY b.bin, w.lo, w.width""")
def histogram_score(spark, d):
    """30 fixed-width bins of the strain score (A16, the score distribution chart)."""
    return tables.histogram(adf(spark, d), SCORE, 30)
