"""Registered queries over lineitem, labels, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import evaluate, profile, tables
from strata.operators.episodes import attach_episodes
from strata.operators.prefix import exact_quantiles
from strata.plans.registry import register
from strata.plans.survey_queries import coded
from strata.sources.coded import coded_cte
from strata.sources.tables import read_table

# ------------------------------------------------------------------ Q4, A16

_DESC = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@register("describe_lineitem", "\nUNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS count, round_even(avg({c}), 6) AS mean, "
    f"round_even(stddev_samp({c}), 6) AS std, round_even(min({c}), 6) AS min, "
    f"round_even(quantile_cont({c}, 0.25), 6) AS q25, "
    f"round_even(quantile_cont({c}, 0.5), 6) AS q50, "
    f"round_even(quantile_cont({c}, 0.75), 6) AS q75, round_even(max({c}), 6) AS max "
    f"FROM lineitem" for c in _DESC))
def describe_lineitem(spark, d):
    """count, mean, std, min, exact quartiles, max of lineitem columns, the price among them (Q4)."""
    return profile.describe(read_table(spark, d, "lineitem"), _DESC, digits=6)


@register("histogram_price", """WITH s AS (SELECT min(l_extendedprice) AS lo,
  max(l_extendedprice) AS hi FROM lineitem),
w AS (SELECT lo, (hi - lo) / 30 AS width FROM s),
b AS (SELECT CAST(CASE WHEN w.width > 0 THEN least(floor((l.l_extendedprice - w.lo) / w.width), 29)
             ELSE 0 END AS INTEGER) AS bin FROM lineitem l, w
      WHERE l.l_extendedprice IS NOT NULL)
SELECT b.bin, round_even(w.lo + b.bin * w.width, 6) AS lo,
  round_even(w.lo + (b.bin + 1) * w.width, 6) AS hi, count(*) AS n
FROM b, w GROUP BY b.bin, w.lo, w.width""")
def histogram_price(spark, d):
    """30 fixed-width bins of l_extendedprice between its min and max."""
    return tables.histogram(read_table(spark, d, "lineitem"), "l_extendedprice", 30)


# ------------------------------------------------------------------ Q6, Q7

@register("class_balance", """SELECT quality,
  CASE quality WHEN 0 THEN 'Low quality' WHEN 1 THEN 'High quality'
       ELSE CAST(quality AS VARCHAR) END AS name, count(*) AS n
FROM labels GROUP BY quality""")
def class_balance(spark, d):
    """Label frequency with names, most frequent first (Q7)."""
    return profile.class_balance(read_table(spark, d, "labels"), "quality",
                                 {0: "Low quality", 1: "High quality"})


@register("role_counts", "SELECT role, count(*) AS n FROM conversations GROUP BY role")
def role_counts(spark, d):
    """Value counts of the conversation role, NULL kept (Q6)."""
    return profile.value_counts(read_table(spark, d, "conversations"), "role")


# ------------------------------------------------------------------ M1, M8

@register("stratified_split", """WITH k AS (SELECT doc_id, quality, toxic,
  md5('42:' || CAST(doc_id AS VARCHAR)) AS h,
  count(*) OVER (PARTITION BY quality) AS n_class FROM labels)
SELECT doc_id, quality, toxic,
  row_number() OVER (PARTITION BY quality ORDER BY h, doc_id)
    <= round_even(0.2 * n_class, 0) AS is_test
FROM k""")
def stratified_split(spark, d):
    """80/20 split of labels with exact class shares, md5-seeded (M1)."""
    return evaluate.stratified_split(read_table(spark, d, "labels"), "doc_id", "quality", 0.2, 42)


@register("sample_rows", """SELECT doc_id, quality, toxic FROM labels
ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")
def sample_rows(spark, d):
    """Exactly 100 labelled rows by seeded hash order (M8)."""
    return evaluate.sample_rows(read_table(spark, d, "labels"), "doc_id", 100, 42)


# ------------------------------------------------------------------ M4 - M6

def _docs(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "n_chars")
    labels = read_table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id")


_G = """WITH g AS (SELECT CAST(dc.n_chars AS DOUBLE) AS score,
  CAST(sum(lb.quality) AS BIGINT) AS pos, CAST(sum(1 - lb.quality) AS BIGINT) AS neg
  FROM documents dc JOIN labels lb ON dc.doc_id = lb.doc_id
  WHERE dc.n_chars IS NOT NULL AND lb.quality IS NOT NULL GROUP BY 1),
c AS (SELECT score, pos, neg,
  sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
  sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
  FROM g)
"""


@register("roc_auc", _G + """SELECT sum(pos * (CAST(cum_neg - neg AS DOUBLE)
    + CAST(neg AS DOUBLE) * CAST(0.5 AS DOUBLE)))
  / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c""")
def roc_auc(spark, d):
    """Exact tie-aware ROC-AUC of n_chars for the quality label (M4)."""
    return evaluate.roc_auc(_docs(spark, d), "n_chars", "quality")


@register("roc_curve", _G + """, t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM g)
SELECT score AS threshold, CAST(t.p - (cum_pos - pos) AS BIGINT) AS tp,
  CAST(t.n - (cum_neg - neg) AS BIGINT) AS fp,
  CAST(t.p - (cum_pos - pos) AS DOUBLE) / CAST(t.p AS DOUBLE) AS tpr,
  CAST(t.n - (cum_neg - neg) AS DOUBLE) / CAST(t.n AS DOUBLE) AS fpr FROM c, t""")
def roc_curve(spark, d):
    """tp, fp, tpr, fpr at every distinct n_chars threshold (M5)."""
    return evaluate.roc_curve(_docs(spark, d), "n_chars", "quality")


def _cr_sql():
    r = lambda e: f"round_even({e}, 9)"

    def div(a, b):
        return f"COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), CAST(0 AS DOUBLE))"

    def f1(p, q):
        return f"COALESCE((2 * {p} * {q}) / NULLIF({p} + {q}, 0), CAST(0 AS DOUBLE))"

    return f"""WITH j AS (SELECT lb.quality AS y,
  CAST(dc.n_chars >= (SELECT median(d2.n_chars) FROM documents d2
                      JOIN labels l2 ON d2.doc_id = l2.doc_id) AS INTEGER) AS p
  FROM documents dc JOIN labels lb ON dc.doc_id = lb.doc_id),
c AS (SELECT count(*) FILTER (WHERE y = 0 AND p = 0) AS n00,
  count(*) FILTER (WHERE y = 0 AND p = 1) AS n01,
  count(*) FILTER (WHERE y = 1 AND p = 0) AS n10,
  count(*) FILTER (WHERE y = 1 AND p = 1) AS n11 FROM j),
m AS (SELECT {div('n00', 'n00 + n10')} AS p0, {div('n00', 'n00 + n01')} AS r0,
  {div('n11', 'n11 + n01')} AS p1, {div('n11', 'n11 + n10')} AS r1,
  n00 + n01 AS s0, n10 + n11 AS s1, {div('n00 + n11', 'n00 + n01 + n10 + n11')} AS acc FROM c),
m2 AS (SELECT *, {f1('p0', 'r0')} AS f0, {f1('p1', 'r1')} AS f1, s0 + s1 AS s FROM m)
SELECT 'Low' AS class, {r('p0')} AS precision, {r('r0')} AS recall, {r('f0')} AS f1,
  CAST(s0 AS BIGINT) AS support FROM m2
UNION ALL SELECT 'High', {r('p1')}, {r('r1')}, {r('f1')}, CAST(s1 AS BIGINT) FROM m2
UNION ALL SELECT 'accuracy', NULL, NULL, {r('acc')}, CAST(s AS BIGINT) FROM m2
UNION ALL SELECT 'macro avg', {r('(p0 + p1) / 2')}, {r('(r0 + r1) / 2')}, {r('(f0 + f1) / 2')},
  CAST(s AS BIGINT) FROM m2
UNION ALL SELECT 'weighted avg', {r('(p0 * s0 + p1 * s1) / s')}, {r('(r0 * s0 + r1 * s1) / s')},
  {r('(f0 * s0 + f1 * s1) / s')}, CAST(s AS BIGINT) FROM m2"""


@register("classification_report", _cr_sql())
def classification_report(spark, d):
    """Per-class precision/recall/F1/support of 'n_chars >= median' for quality (M6)."""
    j = _docs(spark, d)
    med = exact_quantiles(j, "n_chars", [0.5]).select(F.col("q")[0]).scalar()
    pred = j.withColumn("pred", (F.col("n_chars") >= med).cast("int"))
    return evaluate.classification_report(pred, "quality", "pred")


# ------------------------------------------------------------------ A20

_SUPPLIER_COLS = ["l_quantity", "l_discount", "l_extendedprice"]


@register("supplier_medians", "\nUNION ALL ".join(
    f"SELECT l_suppkey, '{c}' AS variable, round_even(quantile_cont({c}, 0.5), 6) AS median "
    f"FROM lineitem GROUP BY l_suppkey" for c in _SUPPLIER_COLS))
def supplier_medians(spark, d):
    """Exact medians of continuous columns per supplier, all in one rank selection."""
    return tables.cluster_medians(read_table(spark, d, "lineitem"), "l_suppkey", _SUPPLIER_COLS, digits=6)


# ------------------------------------------------------------------ J4

@register("episodes_per_person", coded_cte().rstrip() + """,
e AS (SELECT l_orderkey, count(*) AS n_episodes, sum(l_quantity) AS total_quantity,
  sum(l_extendedprice) AS total_price, max(l_shipdate) AS last_episode
  FROM lineitem GROUP BY l_orderkey)
SELECT c.pumfid, c.wght_per, COALESCE(e.n_episodes, 0) AS n_episodes,
  round_even(COALESCE(e.total_quantity, 0), 6) AS total_quantity,
  round_even(COALESCE(e.total_price, 0), 6) AS total_price, e.last_episode
FROM coded c LEFT JOIN e ON c.pumfid = e.l_orderkey""")
def episodes_per_person(spark, d):
    """Episode rows (lineitem) aggregated per person and attached by id."""
    person = coded(spark, d).select("pumfid", "wght_per")
    lines = read_table(spark, d, "lineitem")
    j = attach_episodes(person, lines, "pumfid", "l_orderkey", {
        "n_episodes": F.count(F.lit(1)),
        "total_quantity": F.sum("l_quantity"),
        "total_price": F.sum("l_extendedprice"),
        "last_episode": F.max("l_shipdate"),
    }, fill_zero=("n_episodes", "total_quantity", "total_price"))
    return j.select("pumfid", "wght_per", "n_episodes",
                    F.bround("total_quantity", 6).alias("total_quantity"),
                    F.bround("total_price", 6).alias("total_price"), "last_episode")

