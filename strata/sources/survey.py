"""Survey microdata sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import nan_to_null

_FLOATS = (T.FloatType, T.DoubleType)


def read_microdata(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   fmt: str = "parquet", labels: dict | None = None) -> DataFrame:
    """Wide person table; NaN -> NULL at the boundary (no NaN past the source).

    With an explicit ``schema`` no inference pass runs.  Column pruning and
    filter pushdown reach the scan because the NaN guard is a plain
    projection of ``nanvl``.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.format(fmt).load(path)
    cols = [nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, _FLOATS)
            else F.col(f.name) for f in df.schema.fields]
    out = df.select(*cols)
    return with_labels(out, labels) if labels else out


def with_labels(df: DataFrame, labels: dict) -> DataFrame:
    """Attach a human label to columns as field metadata."""
    for c, lab in labels.items():
        if c in df.columns:
            df = df.withMetadata(c, {"label": lab})
    return df


def column_labels(df: DataFrame) -> dict:
    return {f.name: f.metadata.get("label") for f in df.schema.fields if f.metadata.get("label")}


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet",
                 parallel: int = 1) -> list[str]:
    """Persist report tables, one folder per table, overwriting.

    With ``parallel`` > 1 the independent writes run as concurrent Spark
    jobs (small report tables leave most cores idle one at a time).
    """
    def write(item):
        name, df = item
        target = f"{path.rstrip('/')}/{name}"
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w = w.option("header", True)
        w.format(fmt).save(target)
        return target

    if parallel <= 1:
        return [write(it) for it in tables.items()]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=parallel) as ex:
        return list(ex.map(write, tables.items()))


def cached(df: DataFrame) -> DataFrame:
    """Keep a shared sub-result (memory, spilling to disk) across queries."""
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def save_model(model, path: str) -> str:
    """Spark ML persistence (overwrite)."""
    model.write().overwrite().save(path)
    return path
