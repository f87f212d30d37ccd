"""Decode codes to labels and variables to descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def codes_for(codes: DataFrame, variable: str) -> DataFrame:
    """(code, label) of one variable of a codebook (variable_name, code, label)."""
    return (codes.filter(F.col("variable_name") == variable)
            .select(F.col("code").cast("int").alias("_code"), F.col("label").alias("_label")))


def decode(df: DataFrame, col: str, codes: DataFrame, out: str | None = None) -> DataFrame:
    """Left lookup (variable, code) -> label; falls back to the code as text.

    Spark broadcasts the codebook below its own byte threshold.
    """
    out = out or f"{col}_label"
    dim = codes_for(codes, col)
    j = df.join(dim, df[col] == dim["_code"], "left")
    lab = F.when(F.col(col).isNotNull(),
                 F.coalesce(F.col("_label"), F.col(col).cast("string")))
    return j.select(*[F.col(c) for c in df.columns], lab.alias(out))


def decode_map(col: str, mapping: dict) -> F.Column:
    """Inline decode for one column with a small fixed map (missing -> code)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.when(F.col(col).isNotNull(),
                  F.coalesce(m[F.col(col)], F.col(col).cast("string")))


def describe_variables(df: DataFrame, variable_col: str, variables: DataFrame,
                       width: int = 65, out: str = "description") -> DataFrame:
    """Left lookup variable -> description, fallback to the name, cut at ``width``."""
    dim = variables.select(F.col("variable_name").alias("_v"), F.col("description").alias("_d"))
    j = df.join(dim, df[variable_col] == dim["_v"], "left")
    d = F.substring(F.coalesce(F.col("_d"), F.col(variable_col)), 1, width)
    return j.select(*[F.col(c) for c in df.columns], d.alias(out))


def filter_options(df: DataFrame, cols, codes: DataFrame) -> DataFrame:
    """Sorted distinct non-null codes per filter column, with labels."""
    present = [c for c in cols if c in df.columns]
    long = (df.select(*[F.col(c).cast("int").alias(c) for c in present])
            .unpivot([], present, "variable", "code")
            .filter(F.col("code").isNotNull())
            .distinct())
    dim = codes.select(F.col("variable_name").alias("_v"), F.col("code").cast("int").alias("_c"),
                       F.col("label").alias("_l"))
    j = long.join(dim, (long["variable"] == dim["_v"]) & (long["code"] == dim["_c"]), "left")
    return (j.select("variable", "code",
                     F.coalesce("_l", F.col("code").cast("string")).alias("label"))
            .orderBy("variable", "code"))


def display_label(df: DataFrame, desc_col: str, code_col: str, n: int,
                  out: str = "display") -> DataFrame:
    """Truncate to ``n`` chars with an ellipsis; append ``[code]`` on collisions.

    Collisions are counted with a partially aggregated group-by on the
    truncated text and joined back, so a label shared by very many rows does
    not gather in one task (AQE splits a skewed join partition).
    """
    trunc = F.when(F.length(desc_col) > n,
                   F.concat(F.substring(desc_col, 1, n), F.lit("…"))).otherwise(F.col(desc_col))
    t = df.withColumn("_t", trunc)
    dups = t.groupBy("_t").agg(F.count(F.lit(1)).alias("_dup"))
    j = t.join(dups, "_t", "left")
    lab = F.when(F.col("_dup") > 1, F.concat(F.col("_t"), F.lit(" ["),
                                             F.col(code_col).cast("string"), F.lit("]")))
    return j.select(*[F.col(c) for c in df.columns],
                    F.coalesce(lab, F.col("_t")).alias(out))
