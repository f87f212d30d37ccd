"""Small helpers that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import ensure_checkpoint_dir, ship_package
from strata.sources.tables import read_table

# The white space that separates words (space, \t \n \v \f \r).
WORD_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def prepare(spark: SparkSession) -> None:
    """Shared folder set and package importable in Python workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this run under ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor re-reads files that all share.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def text_or_empty(text: str | Column) -> Column:
    """The text; a null text counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def byte_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8.

    ``bytes.split`` and ``bytes.lower`` know ASCII only, which is exactly
    this rule; no other white space separates and no other letter folds.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()
