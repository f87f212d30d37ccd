"""Codebook readers (S3-S5): answer categories and variable descriptions.

The codebook is a dimension whose size is fixed by the questionnaire (a few
thousand rows), independent of the number of respondents; decode joins
are left to Spark, which broadcasts a side below its byte threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.spec import COMPUTED_DESCRIPTIONS, RESERVE_LABELS

VARIABLE_COLUMNS = ("variable_name", "concept", "question_text")


def parse_code(c) -> F.Column:
    """'01' -> 1, '1.0' -> 1, '00 - 84' -> NULL (int(float(x)) with skip)."""
    return F.expr(f"try_cast(try_cast({c} AS DOUBLE) AS INT)") if isinstance(c, str) else \
        c.try_cast("double").try_cast("int")


def clean_answer_codes(raw: DataFrame, order_col: str) -> DataFrame:
    """Trim labels, fix ``Y es``, drop reserve labels, parse codes, last wins.

    ``order_col`` gives the file order; among duplicate (variable, code)
    pairs the label of the largest order value is kept.
    """
    lab = F.regexp_replace(F.trim(F.col("label")), r"^Y\s+es$", "Yes")
    rows = (raw.select(F.col("variable_name"), parse_code(F.col("code")).alias("code"),
                       lab.alias("label"), F.col(order_col).alias("_ord"))
            .filter(~F.col("label").isin(list(RESERVE_LABELS)) | F.col("label").isNull())
            .filter(F.col("code").isNotNull()))
    return (rows.groupBy("variable_name", "code")
            .agg(F.max_by("label", "_ord").alias("label")))


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text, found by name whatever their order;
    doubled quotes and line breaks inside quotes belong to the field."""
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)


def read_answer_codes(spark: SparkSession, path: str) -> DataFrame:
    """S3: answer-category CSV -> (variable_name, code int, label)."""
    raw = (_read_csv(spark, path).select("variable_name", "code", "label")
           .withColumn("_ord", F.monotonically_increasing_id()))
    return clean_answer_codes(raw, "_ord")


def variable_descriptions(raw: DataFrame, computed: dict | None = None) -> DataFrame:
    """description = concept, else first 80 chars of the question, else the name."""
    spark = raw.sparkSession
    concept = F.nullif(F.trim(F.col("concept")), F.lit(""))
    desc = F.trim(F.coalesce(concept, F.substring("question_text", 1, 80),
                             F.col("variable_name")))
    out = raw.select("variable_name", desc.alias("description"))
    extra = computed if computed is not None else COMPUTED_DESCRIPTIONS
    if extra:
        out = out.unionByName(spark.createDataFrame(
            list(extra.items()), "variable_name string, description string"))
    return out


def read_variables(spark: SparkSession, path: str) -> DataFrame:
    """S4 reader: only the three used columns of the variables CSV are read."""
    raw = _read_csv(spark, path).select(*VARIABLE_COLUMNS)
    return variable_descriptions(raw)


def read_codebook_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nested JSONL codebook -> (answer codes, variable descriptions)."""
    cat = T.StructType([T.StructField(n, T.StringType()) for n in
                        ("label", "code", "frequency", "weighted_frequency", "percent")])
    schema = T.StructType([
        *[T.StructField(n, T.StringType()) for n in
          ("variable_name", "length", "position", "question_name", "concept",
           "question_text", "universe", "note", "source")],
        T.StructField("answer_categories", T.ArrayType(cat)),
    ])
    raw = spark.read.schema(schema).json(path).withColumn("_row", F.monotonically_increasing_id())
    cats = raw.select("variable_name", "_row",
                      F.posexplode("answer_categories").alias("_pos", "a"))
    flat = cats.select("variable_name", F.col("a.code").alias("code"),
                       F.col("a.label").alias("label"),
                       F.struct("_row", "_pos").alias("_ord"))
    return clean_answer_codes(flat, "_ord"), variable_descriptions(raw.select(*VARIABLE_COLUMNS))


def inline_codes(spark: SparkSession, mapping: dict) -> DataFrame:
    """Codebook rows for a few variables from ``{variable: {code: label}}``."""
    rows = [(v, int(k), lab) for v, m in mapping.items() for k, lab in m.items()]
    return spark.createDataFrame(rows, "variable_name string, code int, label string")
