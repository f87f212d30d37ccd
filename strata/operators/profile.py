"""Profiling operators (Q1-Q13).

Wide tables are profiled with one-pass aggregates (one row out) that are
reshaped with ``stack`` afterwards; per-value work goes through ``unpivot``
followed by partially aggregated group-bys, so no variable's rows ever
gather in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.prefix import quantile_table


# -------------------------------------------------------------------- Q1-Q3

def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns)."""
    return df.count(), len(df.columns)


def dtypes(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def null_counts(df: DataFrame, cols=None) -> DataFrame:
    """Nulls per column in one scan: (variable, null_count, n_rows)."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"n_{c}") for c in cols],
                  F.count(F.lit(1)).alias("_rows"))
    parts = ", ".join(f"'{c}', `n_{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {parts}) AS (variable, null_count)",
                           "_rows AS n_rows")


# -------------------------------------------------------------------- Q4-Q7

def describe(df: DataFrame, cols, digits: int | None = None) -> DataFrame:
    """count, mean, std (sample), min, exact quartiles (linear), max per column.

    One scan for the moments and one rank selection for the quartiles of all
    columns; columns with as many values as rows are fine.
    """
    cols = list(cols)
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[f(F.col(c).cast("double")).alias(f"{s}{i}") for i, c in enumerate(cols) for s, f in stats.items()])
    parts = ", ".join(f"'{c}', " + ", ".join(f"{s}{i}" for s in stats) for i, c in enumerate(cols))
    moments = wide.selectExpr(f"stack({len(cols)}, {parts}) AS (variable, {', '.join(stats)})")
    q = quantile_table(df, cols, (0.25, 0.5, 0.75))
    out = moments.join(F.broadcast(q), "variable", "left").select(     # one row per column
        "variable", "count", "mean", "std", "min",
        *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max")
    if digits is not None:
        out = out.select("variable", "count", *[F.bround(c, digits).alias(c) for c in
                                                ("mean", "std", "min", "q25", "q50", "q75", "max")])
    return out


def preview(df: DataFrame, n: int, order_by) -> DataFrame:
    """First ``n`` rows under an explicit order (top-k, no full sort)."""
    return df.orderBy(*([order_by] if isinstance(order_by, str) else order_by)).limit(n)


def value_counts(df: DataFrame, col: str, dropna: bool = False) -> DataFrame:
    """Frequency per value including NULL (last)."""
    src = df if not dropna else df.filter(F.col(col).isNotNull())
    return (src.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col(col).asc_nulls_last()))


def class_balance(df: DataFrame, label: str, names: dict) -> DataFrame:
    """Label frequency with names, most frequent first."""
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col(label), F.coalesce(m[F.col(label)], F.col(label).cast("string"))
                    .alias("name"), "n")
            .orderBy(F.desc("n"), F.col(label)))


# -------------------------------------------------------------------- Q10-Q13

def missingness(df: DataFrame, cols, n: int | None = 20) -> DataFrame:
    """Percent NULL per column, > 0 only, descending, top ``n`` (one scan)."""
    cols = list(cols)
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}") for c in cols])
    parts = ", ".join(f"'{c}', `m_{c}`" for c in cols)
    long = wide.selectExpr(f"stack({len(cols)}, {parts}) AS (variable, share)")
    out = (long.filter(F.col("share") > 0)
           .select("variable", (F.col("share") * 100.0).alias("pct_missing"))
           .orderBy(F.desc("pct_missing"), F.col("variable")))
    return out.limit(n) if n else out


def missingness_bands(df: DataFrame, cols) -> DataFrame:
    """Columns at 0 %, below 1 %, at 1-50 % and > 50 % missing; they add up to all columns."""
    m = missingness(df, cols, n=None)
    total = len(list(cols))
    return m.agg(
        (F.lit(total) - F.count(F.lit(1))).cast("long").alias("n_complete"),
        F.count_if(F.col("pct_missing") < 1).alias("n_under_1"),
        F.count_if(F.col("pct_missing").between(1, 50)).alias("n_1_to_50"),
        F.count_if(F.col("pct_missing") > 50).alias("n_over_50"))


def dataset_overview(raw: DataFrame, adf: DataFrame, score: str, label: str,
                     weight: str, threshold, n_features: int, digits: int = 6) -> DataFrame:
    """Totals, score statistics, threshold, class split and weight range (one row)."""
    total = raw.select(F.count(F.lit(1))).scalar()
    r = lambda c: F.bround(c, digits)
    n = F.count(F.lit(1))
    n_high = F.sum(F.col(label)).cast("long")
    return adf.agg(
        total.alias("total_rows"),
        n.alias("valid_rows"),
        (total - n).alias("excluded_rows"),
        F.lit(n_features).alias("n_features"),
        r(F.avg(score)).alias("score_mean"),
        r(F.median(score)).alias("score_median"),
        r(F.stddev_samp(score)).alias("score_std"),
        r(F.min(score)).alias("score_min"),
        r(F.max(score)).alias("score_max"),
        r(threshold).alias("threshold"),
        n_high.alias("n_high"),
        (n - n_high).alias("n_low"),
        F.bround(F.try_divide(n_high * 100.0, n), 1).alias("pct_high"),
        F.bround(F.try_divide((n - n_high) * 100.0, n), 1).alias("pct_low"),
        F.min(weight).alias("weight_min"),
        F.max(weight).alias("weight_max"))


def explorable_columns(df: DataFrame, cols, max_distinct: int = 20,
                       min_rows: int = 50) -> DataFrame:
    """Columns with <= ``max_distinct`` distinct non-null values and > ``min_rows`` answers."""
    cols = list(cols)
    long = (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([], cols, "variable", "value")
            .filter(F.col("value").isNotNull()))
    per_value = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    per_var = per_value.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_answered"))
    return (per_var.filter((F.col("n_distinct") <= max_distinct)
                           & (F.col("n_answered") > min_rows))
            .orderBy("variable"))
