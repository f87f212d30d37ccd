"""Exact running sums and quantiles in a global order without a single-partition window.

A global ``OVER (ORDER BY x)`` window moves every row into one task.  Here the
rows are written range-partitioned by the order, each with the number of its
range; a window inside each range gives running sums, and offsets come from
the totals of the ranges.  Spark's range partitioner finds a row's range by
binary search, and its ranges follow the rows, so the cost of a row does not
depend on the number of ranges.  Sums can run within groups (``by``): a group
of any size spreads over as many ranges as it fills.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.session import materialize


def in_ranges(df: DataFrame, order, ranges: int | None = None, part: str = "_part") -> DataFrame:
    """``df`` written in ranges of ``order``, with the number of each row's range.

    The number is stored with the row, so that later stages (and reruns of
    lost tasks) agree on it.  Without ``ranges`` there are as many as shuffle
    partitions, and AQE joins small ones up to its advisory size.
    """
    args = [*([ranges] if ranges else []), *order]
    return materialize(df.repartitionByRange(*args).withColumn(part, F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, order_col: str, value_cols, buckets: int | None = None,
                 tie_col: str | None = None, by=(), total: bool = False) -> DataFrame:
    """Add ``cum_<v>`` = Σ v over rows with order <= current (ascending), within ``by``.

    ``order_col`` should be unique per row and group (e.g. a grouped-by score);
    with duplicates, ``tie_col`` fixes the order among equal values.  ``total``
    adds ``total_<v>``, the sum of the whole group; ``buckets`` sets the number
    of ranges.
    """
    by, order = list(by), [order_col] + ([tie_col] if tie_col else [])
    rows = in_ranges(df, [*by, *order], buckets)
    key = [*by, "_part"]
    parts = rows.groupBy(*key).agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    # one row per group and range: without groups as many as ranges
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*key, *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in value_cols],
                         *[F.sum(f"_t_{v}").over(group).alias(f"_s_{v}") for v in value_cols if total])
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select("*", *[F.sum(v).over(inside).alias(f"_c_{v}") for v in value_cols]).alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in by], F.col("r._part") == F.col("p._part"))
    return summed.join(parts.alias("p"), same).select(
        *[F.col(f"r.{c}") for c in df.columns],
        *[(F.col(f"p._o_{v}") + F.col(f"r._c_{v}")).alias(f"cum_{v}") for v in value_cols],
        *[F.col(f"p._s_{v}").alias(f"total_{v}") for v in value_cols if total])


def exact_quantiles(df: DataFrame, col: str, probs, out: str = "q") -> DataFrame:
    """One row with the exact quantiles of ``col`` as an array; NULL without values."""
    return quantile_table(df, [col], probs, out=out).agg(F.first(out, ignorenulls=True).alias(out))


def quantile_table(df: DataFrame, cols, probs, by=(), out: str = "q") -> DataFrame:
    """``*by, variable, q``: exact quantiles of all ``cols`` per group, interpolated linearly.

    All columns and groups go through one rank selection: values are counted
    per (group, variable, value), the counts summed in order by
    :func:`running_sums`, and only the rows at a wanted rank are kept, at most
    two per quantile.  No task holds all distinct values of a group.  Columns
    without values have no row.
    """
    by, cols = list(by), list(cols)
    probs = [float(p) for p in probs]
    long = (df.select(*by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
            .unpivot(by, [f"_v{i}" for i in range(len(cols))], "_variable", "_x").filter(F.col("_x").isNotNull()))
    counts = long.groupBy(*by, "_variable", "_x").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(counts, "_x", ["_n"], by=[*by, "_variable"], total=True)
    first, after = F.col("cum__n") - F.col("_n"), F.col("cum__n")
    at = [F.lit(p) * (F.col("total__n") - 1) for p in probs]
    holds = [(first <= f(a)) & (f(a) < after) for a in at for f in (F.floor, F.ceil)]
    kept = ranked.filter(reduce(lambda a, b: a | b, holds))
    parts = []
    for a, lo, hi in zip(at, holds[::2], holds[1::2]):
        low, high = (F.max(F.when(h, F.col("_x"))) for h in (lo, hi))
        parts.append(low + (high - low) * F.max(a - F.floor(a)))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.substring("_variable", 3, 9).cast("int") + 1)
    return kept.groupBy(*by, "_variable").agg(F.array(*parts).alias(out)).select(*by, name.alias("variable"), out)
