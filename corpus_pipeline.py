"""The corpus pipeline: documents through the stages in order.

Each stage is ``(name, function)``; the function takes ``(spark, docs,
sf_dir)`` and returns the documents that stay, with the columns of
``documents`` (the last adds its own).  ``run`` writes each stage's result to
the shared folder and reads it back as the next one's input.

Nulls, empty and very long texts, repeated rows, empty tables and extra
columns are met as each operator's docstring says; extra columns pass through
every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import decontaminate, jaccard, mixing, pii, quality
from strata.llm.common import documents, written
from strata.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the line rules go, and so do documents that are rejected."""
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles agree to 80 of 100, directly or by links, the first stays."""
    return jaccard.keep_first(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; every document stays."""
    return pii.redacted(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked source, language and topic shares, with its weights."""
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("mixing sources", mixing_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: The PII stage's trained classifier and the raked weights can't be said in SQL.
ORACLE_SQL = None
