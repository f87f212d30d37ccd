"""Rate, prevalence, bracket and correlation tables.

Pattern used throughout: reduce first, decode later.  Rows are unpivoted
(when several columns are analysed together) and aggregated by
``(variable, code)`` with partial (map-side) aggregation, so a hot code
never concentrates raw rows in one task; only the small aggregated result is
joined to the codebook (broadcast behind a size check) and re-grouped by
label, which merges distinct codes that share a label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import count_flags, any_answered, direction, pct
from strata.operators.prefix import quantile_table
from strata.session import ship_package


def _labels(codes: DataFrame) -> DataFrame:
    """Codebook rows as (_v, _c, _l)."""
    return codes.select(F.col("variable_name").alias("_v"),
                        F.col("code").cast("int").alias("_c"),
                        F.col("label").alias("_l"))


def _decode_grouped(g: DataFrame, codes: DataFrame | None, mapping: dict | None,
                    var_col: str | None) -> DataFrame:
    """Attach ``category`` = label, else the code as text, to grouped rows."""
    if codes is not None:
        dim = _labels(codes)
        cond = g["value"] == dim["_c"]
        if var_col is not None:
            cond = cond & (g[var_col] == dim["_v"])
        j = g.join(dim, cond, "left")
        return j.select(*[F.col(c) for c in g.columns],
                        F.coalesce(F.col("_l"), F.col("value").cast("string")).alias("category"))
    if mapping:
        m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
        return g.select("*", F.coalesce(m[F.col("value")], F.col("value").cast("string"))
                        .alias("category"))
    return g.select("*", F.col("value").cast("string").alias("category"))


# ------------------------------------------------------------------ A1, A2, A17

def rate_by(df: DataFrame, col: str, label: str, codes: DataFrame | None = None,
            mapping: dict | None = None, names=("category", "n", "high_pct"),
            weight: str | None = None) -> DataFrame:
    """High-label rate and count per decoded category of ``col``, rate desc.

    Unweighted by default (as the source reports); with ``weight`` the rate
    is Σ w·y / Σ w over rows with a weight, ``n`` stays the row count.
    """
    if codes is not None:
        codes = codes.filter(F.col("variable_name") == col)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    src = df.select(F.col(col).cast("int").alias("value"), F.col(label).alias("_y"),
                    w.alias("_w"))
    g = (src.filter(F.col("value").isNotNull() & F.col("_y").isNotNull()
                    & F.col("_w").isNotNull())
         .groupBy("value").agg(F.count(F.lit(1)).alias("_n"),
                               F.sum(F.col("_y") * F.col("_w")).alias("_s"),
                               F.sum("_w").alias("_sw")))
    d = _decode_grouped(g, codes, mapping, None)
    out = (d.groupBy("category").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"),
                                     F.sum("_sw").alias("_sw"))
           .select(F.col("category").alias(names[0]), F.col("_n").alias(names[1]),
                   pct(F.try_divide(F.col("_s"), F.col("_sw"))).alias(names[2])))
    return out.orderBy(F.desc(names[2]), F.col(names[0]))


def rate_by_all(df: DataFrame, cols, label: str, codes: DataFrame | None = None,
                weight: str | None = None) -> DataFrame:
    """A1 over several columns in one job: (variable, category, n, high_pct).

    One ``unpivot`` feeds a single partially aggregated group-by over
    (variable, code); optional ``weight`` as in :func:`rate_by`.
    """
    cols = [c for c in cols if c in df.columns]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = (df.select(*[F.col(c).cast("int").alias(c) for c in cols], F.col(label).alias("_y"),
                      w.alias("_w"))
            .unpivot(["_y", "_w"], cols, "variable", "value")
            .filter(F.col("value").isNotNull() & F.col("_y").isNotNull()
                    & F.col("_w").isNotNull()))
    g = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("_n"),
                                              F.sum(F.col("_y") * F.col("_w")).alias("_s"),
                                              F.sum("_w").alias("_sw"))
    d = _decode_grouped(g, codes, None, "variable")
    out = (d.groupBy("variable", "category")
           .agg(F.sum("_n").alias("n"), F.sum("_s").alias("_s"), F.sum("_sw").alias("_sw"))
           .select("variable", "category", "n",
                   pct(F.try_divide(F.col("_s"), F.col("_sw"))).alias("high_pct")))
    return out.orderBy("variable", F.desc("high_pct"), "category")


def answer_table(df: DataFrame, col: str, label: str, codes: DataFrame | None = None,
                 mapping: dict | None = None) -> DataFrame:
    """Respondents and high rate per decoded answer of one column."""
    return rate_by(df, col, label, codes, mapping, names=("answer", "respondents", "high_pct"))


# ------------------------------------------------------------------ A3, A4

def rate_by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """High rate and n per score value, ordered by score."""
    return (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(score).agg(F.count(F.lit(1)).alias("n"),
                                pct(F.avg(label)).alias("high_pct"))
            .orderBy(score))


def score_stats(df: DataFrame, score: str, digits: int = 6) -> DataFrame:
    """n, mean, median, sample std of the non-null scores."""
    x = F.col(score)
    return df.agg(F.count(x).alias("n"), F.bround(F.avg(x), digits).alias("mean"),
                  F.median(x).alias("median"),
                  F.bround(F.stddev_samp(x), digits).alias("std"))


# ------------------------------------------------------------------ A5 - A8

def activity_breadth(df: DataFrame, cols, label: str) -> DataFrame:
    """Respondents and high rate per number of flags equal to 1."""
    cols = [c for c in cols if c in df.columns]
    return (df.select(count_flags(cols).alias("activity_count"), F.col(label))
            .groupBy("activity_count")
            .agg(F.count(F.lit(1)).alias("respondents"), pct(F.avg(label)).alias("high_pct"))
            .orderBy("activity_count"))


def activity_stats(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    """Active n, mean flags among active, n and % with at least 3 flags."""
    cols = [c for c in cols if c in df.columns]
    k = count_flags(cols)
    return (df.select(k.alias("k"))
            .agg(F.count_if(F.col("k") > 0).alias("n_active"),
                 F.bround(F.avg(F.when(F.col("k") > 0, F.col("k"))), digits).alias("mean_active"),
                 F.count_if(F.col("k") >= 3).alias("n_3plus"),
                 pct(F.avg((F.col("k") >= 3).cast("double"))).alias("pct_3plus")))


def flag_breakdown(df: DataFrame, flags: dict, label: str) -> DataFrame:
    """Per flag: n yes, % of all rows, high rate among yes; n desc."""
    cols = [c for c in flags if c in df.columns]
    total = df.select(F.count(F.lit(1))).scalar()
    names = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(flags[c]))])
    long = (df.select(*[F.col(c).cast("int").alias(c) for c in cols], F.col(label).alias("_y"))
            .unpivot(["_y"], cols, "variable", "value")
            .filter(F.col("value") == 1))
    g = long.groupBy("variable").agg(F.count(F.lit(1)).alias("n_yes"),
                                     F.avg("_y").alias("_rate"))
    return (g.select("variable", names[F.col("variable")].alias("activity"), "n_yes",
                     pct(F.col("n_yes") / total).alias("pct_rows"),
                     pct(F.col("_rate")).alias("high_pct"))
            .orderBy(F.desc("n_yes"), "variable"))


def answered_any(df: DataFrame, cols) -> DataFrame:
    """n and % with at least one answer among ``cols``, and the remainder."""
    cols = [c for c in cols if c in df.columns]
    a = any_answered(cols)
    return df.agg(F.count_if(a).alias("n_answered"),
                  pct(F.avg(a.cast("double"))).alias("pct_answered"),
                  F.count_if(~a).alias("n_remaining"))


# ------------------------------------------------------------------ A9, A12, A13

def bracket_distribution(df: DataFrame, cols, label: str, brackets: dict) -> DataFrame:
    """Per column and bracket: n, % of the column's answers, high rate.

    Empty brackets are skipped; codes outside the bracket table count in the
    denominator only.  The per-variable total is a window over the grouped
    (variables x codes) rows, never over raw rows.
    """
    cols = [c for c in cols if c in df.columns]
    long = (df.select(*[F.col(c).cast("int").alias(c) for c in cols], F.col(label).alias("_y"))
            .unpivot(["_y"], cols, "variable", "value")
            .filter(F.col("value").isNotNull()))
    g = long.groupBy("variable", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("_s"), F.count("_y").alias("_ny"))
    w = Window.partitionBy("variable")
    names = F.create_map(*[x for k, v in brackets.items() for x in (F.lit(k), F.lit(v))])
    rate = F.when(F.col("_ny") > 0, F.col("_s") / F.col("_ny")).otherwise(F.lit(0.0))
    return (g.withColumn("_tot", F.sum("n").over(w))
            .filter(F.col("value").isin(list(brackets)))
            .select("variable", F.col("value").alias("code"),
                    names[F.col("value")].alias("bracket"), "n",
                    pct(F.col("n") / F.col("_tot")).alias("pct_answers"),
                    pct(rate).alias("high_pct"))
            .orderBy("variable", "code"))


def pooled_brackets(df: DataFrame, cols, brackets: dict | None = None) -> DataFrame:
    """Counts per code over several columns stacked (UNION ALL)."""
    cols = [c for c in cols if c in df.columns]
    long = (df.select(*[F.col(c).cast("int").alias(c) for c in cols])
            .unpivot([], cols, "variable", "value").filter(F.col("value").isNotNull()))
    g = long.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    d = _decode_grouped(g, None, brackets, None)
    return d.select(F.col("value").alias("code"), F.col("category").alias("bracket"),
                    "n").orderBy("code")


def share_at_least(df: DataFrame, cols, code: int = 4, names: dict | None = None) -> DataFrame:
    """Per column: answered n and % with value >= ``code``; empty skipped; % asc."""
    cols = [c for c in cols if c in df.columns]
    long = (df.select(*[F.col(c).cast("int").alias(c) for c in cols])
            .unpivot([], cols, "variable", "value").filter(F.col("value").isNotNull()))
    g = long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_answered"),
        pct(F.avg((F.col("value") >= code).cast("double"))).alias("pct_at_least"))
    if names:
        m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
        g = g.select("variable", m[F.col("variable")].alias("category"), "n_answered",
                     "pct_at_least")
    return g.orderBy("pct_at_least", "variable")


# ------------------------------------------------------------------ A14

def item_prevalence(items: DataFrame, item_cols, labels: dict, scale_item: str,
                    mode: str = "recoded", strict: bool = False) -> DataFrame:
    """Per strain item: % at strain among answered rows, n answered, note.

    ``mode='recoded'``: ``items`` holds recoded values (1 = strain; the
    4-point item at 1, 2/3, 1/3, 0); codes outside the recode map are NULL
    and leave the denominator.  The scale item counts its top two codes
    (value >= 2/3), or only the top code when ``strict``.
    ``mode='raw'``: ``items`` holds raw codes after reserve nulling; other
    codes stay in the denominator; the scale item counts codes <= 2.
    """
    cols = [c for c in item_cols if c in items.columns]
    long = (items.select(*[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([], cols, "variable", "value").filter(F.col("value").isNotNull()))
    v = F.col("value")
    if mode == "recoded":
        scale_hit = (v >= 0.667) if strict else (v >= 2.0 / 3.0)
    elif mode == "raw":
        scale_hit = v <= 2
    else:
        raise ValueError(f"unknown mode {mode!r}")
    hit = F.when(F.col("variable") == scale_item, scale_hit).otherwise(v == 1)
    note = F.when(F.col("variable") == scale_item, F.lit("Very or Stressful (top 2 of 4)")) \
        .otherwise(F.lit("Yes (strain present)"))
    m = F.create_map(*[x for k, val in labels.items() for x in (F.lit(k), F.lit(val))])
    g = long.groupBy("variable").agg(F.count(F.lit(1)).alias("n_answered"),
                                     F.avg(hit.cast("double")).alias("_share"))
    return (g.select("variable", m[F.col("variable")].alias("indicator"),
                     pct(F.col("_share")).alias("pct_strain"), note.alias("scale"),
                     "n_answered")
            .orderBy(F.desc("pct_strain"), "variable"))


# ------------------------------------------------------------------ A10, A11

def _r(x, y):
    """Pairwise-complete Pearson r from stable moments; zero variance -> NULL."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlate_with(df: DataFrame, target: str, cols, n: int = 30, digits: int = 6,
                   pos: str = "More -> more burnout",
                   neg: str = "More -> less burnout") -> DataFrame:
    """Top-``n`` columns by |r| with ``target``: rank, variable, r, direction."""
    cols = [c for c in cols if c in df.columns and c != target]
    long = (df.select(*[F.col(c).cast("double").alias(c) for c in cols],
                      F.col(target).cast("double").alias("_t"))
            .unpivot(["_t"], cols, "variable", "x")
            .filter(F.col("x").isNotNull() & F.col("_t").isNotNull()))
    g = (long.groupBy("variable").agg(_r(F.col("x"), F.col("_t")).alias("_r"))
         .filter(F.col("_r").isNotNull() & ~F.isnan("_r")))
    top = g.orderBy(F.desc(F.abs("_r")), "variable").limit(n)
    w = Window.orderBy(F.desc(F.abs("_r")), "variable")  # over <= n rows only
    return top.select(F.row_number().over(w).alias("rank"), "variable",
                      F.bround("_r", digits).alias("r"), direction("_r", pos, neg).alias("direction"))


def correlation_pairs(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    """Pairwise-complete r for every pair of ``cols`` (i < j) from Gram matrices.

    Each task multiplies its rows, centred by the column means, with the mask
    of the values that are there: ``M'M`` counts, ``X'M`` sums, ``(X*X)'M``
    squares and ``X'X`` products of the rows that have both columns.  Spark
    adds the tasks' matrices cell by cell, so a task sends columns^2 numbers
    whatever its rows.  NULL and NaN are missing; a column that is constant on
    the common rows gives NULL.
    """
    cols = list(cols)
    ship_package(df.sparkSession)
    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    names = values.columns
    means = values.agg(*[F.coalesce(F.avg(F.when(~F.isnan(c), F.col(c))), F.lit(0.0)) for c in names]).first()
    centre, n = np.array(means, dtype=np.float64), len(cols)

    def gram(batches):
        total = np.zeros((4, n, n))
        for b in batches:
            x = b.to_numpy(dtype=np.float64, na_value=np.nan) - centre
            there = ~np.isnan(x)
            x[~there] = 0.0
            m = there.astype(np.float64)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        i, j = np.triu_indices(n, 1)
        have = total[0, i, j] > 0
        i, j = i[have], j[have]
        # sums of the first and of the second column over the rows that have both
        yield pd.DataFrame({"i": i, "j": j, "n": total[0, i, j].astype(np.int64), "sx": total[1, i, j], "sy": total[1, j, i],
                            "xx": total[2, i, j], "yy": total[2, j, i], "xy": total[3, i, j]})

    sums = ["sx", "sy", "xx", "yy", "xy"]
    cells = values.mapInPandas(gram, "i int, j int, n long, " + ", ".join(f"{s} double" for s in sums))
    g = cells.groupBy("i", "j").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])

    def spread(xx, sx):
        v = F.col(xx) - F.col(sx) * F.col(sx) / F.col("n")
        return F.when(v > F.col(xx) * 1e-13, v)         # below is the rounding of a constant
    r = (F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(spread("xx", "sx") * spread("yy", "sy"))
    name = F.array(*[F.lit(c) for c in cols])
    return g.select(name[F.col("i")].alias("v1"), name[F.col("j")].alias("v2"), "n",
                    F.bround(r, digits).alias("r")).orderBy("v1", "v2")


# ------------------------------------------------------------------ A15, A16

def kpis(df: DataFrame, label: str, score: str, flex: str | None = None,
         digits: int = 6) -> DataFrame:
    """n in view, n high, % high (0 when empty), mean score, mean flexibility."""
    n = F.count(F.lit(1))
    n_high = F.coalesce(F.sum(label), F.lit(0)).cast("long")
    aggs = [n.alias("n_view"), n_high.alias("n_high"),
            F.coalesce(F.bround(F.try_divide(n_high * 100.0, n), 1), F.lit(0.0)).alias("pct_high"),
            F.bround(F.avg(score), digits).alias("mean_score")]
    if flex:
        aggs.append(F.bround(F.avg(flex), digits).alias("mean_flex"))
    return df.agg(*aggs)


def population_cube(df: DataFrame, cols, label: str, score: str, flex: str, digits: int = 6) -> DataFrame:
    """KPIs of every combination of the filters, "All" included, in one pass.

    One row per combination of codes that occurs: ``cols`` (NULL where the
    filter is "All" or the code is missing), ``all_flags`` with one digit per
    column (1: it is "All"), and the columns of :func:`kpis`.  Rows are reduced to the finest cells first; only cells are
    expanded to the 2^columns levels.
    """
    cols = list(cols)
    cells = df.groupBy(*cols).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(label).cast("long").alias("_h"),
        F.sum(score).alias("_s"), F.count(score).alias("_sn"), F.sum(flex).alias("_f"), F.count(flex).alias("_fn"))
    every = F.concat(*[F.grouping(c).cast("string") for c in cols])
    g = cells.cube(*cols).agg(every.alias("all_flags"), *[F.sum(c).alias(c) for c in ("_n", "_h", "_s", "_sn", "_f", "_fn")])
    n_high = F.coalesce("_h", F.lit(0))
    return g.filter(F.col("_n").isNotNull()).select(
        *cols, "all_flags", F.col("_n").alias("n_view"), n_high.alias("n_high"),
        F.bround(n_high * 100.0 / F.col("_n"), 1).alias("pct_high"),
        F.bround(F.try_divide("_s", "_sn"), digits).alias("mean_score"),
        F.bround(F.try_divide("_f", "_fn"), digits).alias("mean_flex"))


def histogram(df: DataFrame, col: str, bins: int, digits: int = 6) -> DataFrame:
    """Exactly ``bins`` fixed-width bins between min and max (empty ones omitted)."""
    x = F.col(col).cast("double")
    src = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    rng = src.select(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    lo, hi = rng["lo"], rng["hi"]  # one scalar subquery, one scan
    width = (hi - lo) / bins
    b = F.when(width > 0, F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1))) \
        .otherwise(F.lit(0)).cast("int")
    g = src.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("bin", F.bround(lo + F.col("bin") * width, digits).alias("lo"),
                    F.bround(lo + (F.col("bin") + 1) * width, digits).alias("hi"),
                    "n").orderBy("bin")


# ------------------------------------------------------------------ A19, A20

def cluster_profile(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Per cluster: size, % of total, high rate (total over the k grouped rows)."""
    g = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("_rate"))
    w = Window.partitionBy()  # k rows: the global window is over the grouped result only
    return (g.select(cluster, "n", pct(F.col("n") / F.sum("n").over(w)).alias("pct_total"),
                     pct(F.col("_rate")).alias("high_pct"))
            .orderBy(cluster))


def cluster_medians(df: DataFrame, cluster: str, cols, digits: int = 1) -> DataFrame:
    """Exact median of each column per cluster, by one rank selection for all of them."""
    cols = [c for c in cols if c in df.columns]
    rows = df.select(F.col(cluster).alias("_k"), *cols)
    medians = quantile_table(rows, cols, [0.5], by=["_k"]).alias("m")
    # a column without values in a cluster has a NULL median
    keys = rows.select("_k").distinct().select("_k", F.explode(F.array(*[F.lit(c) for c in cols])).alias("variable")).alias("k")
    same = F.col("k._k").eqNullSafe(F.col("m._k")) & (F.col("k.variable") == F.col("m.variable"))
    return (keys.join(medians, same, "left")
            .select(F.col("k._k").alias(cluster), F.col("k.variable").alias("variable"),
                    F.bround(F.col("m.q")[0], digits).alias("median"))
            .orderBy(cluster, "variable"))
