"""Column builders: row-wise expressions that stay inside whole-stage codegen.

All of them return :class:`pyspark.sql.Column`; none needs a UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL (pandas treats NaN as missing, Spark as the largest value)."""
    c = _c(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def nonnull_count(cols) -> Column:
    """Number of non-null values among ``cols`` (integer)."""
    return reduce(lambda a, b: a + b, [_c(c).isNotNull().cast("int") for c in cols])


def coalesced_sum(cols) -> Column:
    """Σ coalesce(c, 0) in the given column order (fixed order -> stable floats)."""
    return reduce(lambda a, b: a + b, [F.coalesce(_c(c), F.lit(0)) for c in cols])


def row_sum(cols, min_count: int = 1) -> Column:
    """Null-aware row sum: NULL unless at least ``min_count`` values are present."""
    return F.when(nonnull_count(cols) >= min_count, coalesced_sum(cols))


def row_mean(cols) -> Column:
    """Mean over the non-null values only; NULL when none is present."""
    n = nonnull_count(cols)
    return F.when(n > 0, coalesced_sum(cols).cast("double") / n)


def count_flags(cols, value=1) -> Column:
    """How many of ``cols`` equal ``value`` (NULL counts as no)."""
    return reduce(lambda a, b: a + b,
                  [(_c(c).eqNullSafe(F.lit(value))).cast("int") for c in cols])


def any_answered(cols) -> Column:
    """True when at least one of ``cols`` is non-null."""
    return F.coalesce(*[_c(c) for c in cols]).isNotNull()


def pct(c, digits: int = 1) -> Column:
    """Share as a percentage, half-even rounded (numpy-style rounding)."""
    return F.bround(_c(c) * 100.0, digits)


def direction(c, pos: str = "Raises risk", neg: str = "Lowers risk") -> Column:
    """Sign tag; zero counts as negative."""
    return F.when(_c(c) > 0, F.lit(pos)).otherwise(F.lit(neg))


def thousands(c) -> Column:
    """Integer with thousands separators, e.g. 12,345."""
    return F.format_number(_c(c).cast("double"), 0)


def fixed(c, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", _c(c).cast("double"))


def signed(c, decimals: int) -> Column:
    return F.format_string(f"%+.{decimals}f", _c(c).cast("double"))


def percent_text(c, decimals: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{decimals}f", _c(c).cast("double")), F.lit("%"))


def format_cells(df, formats: dict):
    """Apply display formats ``{col: 'thousands'|'pct'|'signed4'|'fixedN'}``."""
    out = []
    for name in df.columns:
        fmt = formats.get(name)
        c = F.col(name)
        if fmt is None:
            out.append(c)
        elif fmt == "thousands":
            out.append(thousands(c).alias(name))
        elif fmt == "pct":
            out.append(percent_text(c).alias(name))
        elif fmt.startswith("signed"):
            out.append(signed(c, int(fmt[6:])).alias(name))
        elif fmt.startswith("fixed"):
            out.append(fixed(c, int(fmt[5:])).alias(name))
        else:
            raise ValueError(f"unknown format {fmt!r}")
    return df.select(*out)


def recode(c, mapping: dict) -> Column:
    """Map codes; values outside the map become NULL (no ELSE branch)."""
    c = _c(c)
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v)))
    return expr


def null_codes(c, codes) -> Column:
    """NULL when the value is one of ``codes``; other values unchanged."""
    c = _c(c)
    if not codes:
        return c
    return F.when(~c.isin(list(codes)), c)
