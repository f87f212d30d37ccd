"""Survey-shaped input derived from the driver's ``orders`` and ``customer``.

The library operates on coded survey tables; the test data are TPC-H-like.
This module only *shapes* rows into the survey schema (integer codes, reserve
codes 6/9, routing skips, a person weight).  It performs none of the
analysis: every operator that consumes ``coded`` works on any table with this
schema.  The same SQL text runs in Spark (``spark.sql`` with DataFrame
arguments) and in DuckDB (as a CTE), which keeps the oracle honest.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.store import input_stamp
from strata.sources.tables import read_table

# Item columns in generation order; the position k (1-based) seeds the codes.
ITEM_COLUMNS = (
    ("ics_40", "sc", 4),
    *((f"fis_10{x}", "yn", None) for x in "abcdefgh"),
    ("crh_10", "yn", None), ("crh_20", "yn", None), ("crh_30", "yn", None),
    *((f"fwa_{x}", "yn", None) for x in (132, 133, 134, 136, 137, 150)),
    *((f"ite_30{x}", "yn", None) for x in "abcde"),
    ("ite_10", "yn", None),
    *((f"{x}_10", "yn", None) for x in ("aro", "arp", "arm", "ars", "arb", "arv", "arx")),
    *((f"{x}_exp", "sc", 6) for x in ("home", "hlth", "help", "trns", "aid", "med")),
)


# Replicate weights (dropped by the analysis, as in the survey file).
REPLICATE_WEIGHTS = ("wtbs_001", "wtbs_002", "wtbs_003")


def _u(k: int) -> str:
    return f"((o.o_orderkey * 7919 + {k} * 104729) % 1000)"


def _item_sql(k: int, kind: str, m: int | None) -> str:
    u = _u(k)
    if kind == "yn":
        return (f"CASE WHEN o.o_orderstatus = 'P' THEN 6 WHEN {u} < 60 THEN 9 "
                f"WHEN {u} < 60 + CAST(floor(o.o_totalprice / 700) AS BIGINT) THEN 1 "
                f"ELSE 2 END")
    return (f"CASE WHEN o.o_orderstatus = 'P' THEN 6 WHEN {u} < 60 THEN 9 "
            f"ELSE 1 + {u} % {m} END")


def coded_select(orders: str = "orders", customer: str = "customer") -> str:
    """SELECT text producing the coded table from ``orders`` and ``customer``."""
    items = ",\n       ".join(
        f"CAST({_item_sql(k, kind, m)} AS INTEGER) AS {name}"
        for k, (name, kind, m) in enumerate(ITEM_COLUMNS, start=1))
    wtbs = ",\n       ".join(
        f"o.o_totalprice * CAST(7 + ((o.o_orderkey + {k}) % 7) AS DOUBLE) / 10 AS {n}"
        for k, n in enumerate(REPLICATE_WEIGHTS, start=1))
    return f"""SELECT o.o_orderkey AS pumfid, o.o_totalprice AS wght_per,
       {wtbs},
       CAST(1 + o.o_custkey % 2 AS INTEGER) AS sex,
       CAST(c.c_nationkey AS INTEGER) AS prv,
       CAST(CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2
            WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 6 END AS INTEGER) AS marstat,
       CAST(1 + CAST(floor((c.c_acctbal + 1000) / 1500) AS BIGINT) AS INTEGER) AS famincg1,
       {items}
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey"""


def coded_cte() -> str:
    """``WITH coded AS (...)`` prefix for oracle SQL over DuckDB views."""
    return f"WITH coded AS (\n{coded_select()}\n)\n"


def coded_columns() -> list[str]:
    return ["pumfid", "wght_per", *REPLICATE_WEIGHTS, "sex", "prv", "marstat", "famincg1",
            *[n for n, _, _ in ITEM_COLUMNS]]


# Bump when the SELECT above changes so stale written copies are not reused.
CODED_VERSION = 3
_WRITTEN: dict[tuple[str, str], str] = {}


def coded_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coded rows as a lazy plan over ``orders`` and ``customer``."""
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    return spark.sql(coded_select("{orders}", "{customer}"), orders=orders,
                     customer=customer)


def load_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coded survey table for ``sf_dir``, stored like real microdata.

    A survey file is a stored wide table; the stand-in is written once as
    Parquet into the shared checkpoint folder and read back through
    :func:`strata.sources.survey.read_microdata`, so scans, pruning and
    pushed filters act on stored columns as they would on the real file.
    The store is named by the input's files, so changed input is read again.
    Each writer uses its own ``data-<uuid>`` folder and then appends its name
    to a small pointer table; nothing is overwritten or deleted, so concurrent
    sessions never read a half-written table.
    """
    import uuid

    from pyspark.errors import AnalysisException

    from strata.session import scratch_path
    from strata.sources.survey import read_microdata

    root = sf_dir.rstrip("/")
    known = (root, spark.sparkContext.applicationId)
    if known not in _WRITTEN:
        stamp = input_stamp(spark, f"{root}/orders.parquet", f"{root}/customer.parquet")
        slug = hashlib.md5(f"{CODED_VERSION}:{root}:{stamp}".encode()).hexdigest()[:16]
        base = scratch_path(spark, f"coded-{slug}")
        try:
            pointer = spark.read.parquet(f"{base}/pointer")
        except AnalysisException:       # no pointer yet: write the table
            data = f"{base}/data-{uuid.uuid4().hex}"
            coded_frame(spark, sf_dir).write.parquet(data)
            spark.createDataFrame([(data,)], "path string").coalesce(1).write \
                .mode("append").parquet(f"{base}/pointer")
        else:
            data = pointer.agg(F.min("path")).first()[0]
        _WRITTEN[known] = data
    return read_microdata(spark, _WRITTEN[known])
