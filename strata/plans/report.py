"""The analysis report as Spark jobs: every section is a table, written by S6.

``python -m strata.plans.report <sf_dir> <out_dir> [parquet|csv|json]``
computes the sections of the source report (overview, demographics,
correlations, model quality, drivers, prevalence, workload, finances,
composites, completeness) and writes one folder per table.
"""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from strata.plans.registry import QUERIES, register

SECTIONS = (
    "dataset_overview", "rate_by_demographics", "correlate_with_score", "boosted_auc",
    "boosted_report", "driver_importance", "driver_direction", "item_prevalence",
    "activity_stats", "activity_breadth", "flag_breakdown", "answered_any",
    "bracket_distribution", "rate_by_flexibility", "score_stats", "missingness_top",
    "missingness_bands",
)


def run_report(spark, sf_dir: str, out_dir: str, fmt: str = "parquet") -> dict[str, str]:
    from strata.sources.survey import write_tables
    # building the sections fills the shared results (analysis table, model,
    # attributions) one after another; the writes then run concurrently
    tables = {"report_header": header(spark, sf_dir)} | {name: QUERIES[name](spark, sf_dir) for name in SECTIONS}
    paths = write_tables(tables, out_dir, fmt, parallel=4)
    return dict(zip(tables, paths))


def header(spark, sf_dir: str):
    """When the report was made, from which folder, and its split with the threshold."""
    about = QUERIES["dataset_overview"](spark, sf_dir).select("valid_rows", "threshold")
    return about.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm").alias("generated"),
                        F.lit(sf_dir).alias("data"), F.lit("median").alias("split"), "threshold", "valid_rows")


def full_report(spark, d):
    """All report sections written as tables (S6); returns (section, rows) read back."""
    import uuid
    from strata.session import scratch_path
    out = scratch_path(spark, f"report-{uuid.uuid4().hex}")
    paths = run_report(spark, d, out)
    parts = [spark.read.parquet(p).select(F.lit(name).alias("section"),
                                         F.count(F.lit(1)).alias("rows"))
             for name, p in paths.items()]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


if __name__ != "__main__":          # registered once, by the catalog's import
    register("full_report")(full_report)

if __name__ == "__main__":
    from strata.plans import catalog  # noqa: F401
    from strata.session import get_spark
    fmt = sys.argv[3] if len(sys.argv) > 3 else "parquet"
    for k, v in run_report(get_spark(), sys.argv[1], sys.argv[2], fmt).items():
        print(k, v)
