"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "strata") -> SparkSession:
    """Local session for tests and benches; on a cluster use the provided one.

    AQE stays on so shuffle partition counts are coalesced at run time and
    skewed join partitions are split.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # survey plans carry many wide CASE expressions; inferring constraints
        # from them costs optimiser time exponential in plan depth and adds
        # no filter the scans could use
        .config("spark.sql.constraintPropagation.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the cluster (a shared file
    system); it is only created here when the session has none, as in local
    tests.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="strata-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables/models."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df, name: str):
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` (a lost executor re-reads the
    written files), but the result is a columnar table: later scans prune
    columns and take pushed filters, which a checkpointed RDD cannot.
    """
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"tables/{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def even_rows(df, rows: int, least: int, most: int, *by: str):
    """``df`` in partitions of equal size: one a core, of ``least`` to ``most`` rows each.

    A stored table is read in partitions that follow its files, and a stage
    is as slow as its largest one.  ``rows`` is the number of rows; with few
    there are fewer partitions than cores, with many a multiple of the cores.
    ``by`` (columns that hardly repeat) places a row by their hash, whatever
    its other values.
    """
    cores = max(1, df.sparkSession.sparkContext.defaultParallelism)
    waves = -(-rows // (most * cores))
    return df.repartition(max(1, min(-(-rows // least), max(1, waves) * cores)), *by)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``strata`` importable in executor Python workers (once per context).

    Python workers do not see ``sys.path`` changes of the driver (not even in
    local mode, where they only find the package when the driver happens to
    run from the repository root), so the package is zipped and added with
    ``addPyFile``, the public equivalent of ``--py-files``, before the first
    Python-backed stage (mapInPandas).
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="strata-pkg-"), "strata")
    archive = shutil.make_archive(base, "zip", os.path.dirname(pkg), "strata")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


# Settings for a large cluster (100 TB class inputs).  Partition sizes are
# set in bytes, not counts, so they hold at any scale; AQE then coalesces
# small shuffle partitions and splits skewed ones at run time.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",   # target shuffle partition
    "spark.sql.shuffle.partitions": "8000",     # upper bound; AQE coalesces by size
    "spark.sql.files.maxPartitionBytes": "256m",                 # scan split size
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",   # size-estimated broadcast ceiling
    "spark.sql.constraintPropagation.enabled": "false",  # wide CASE plans (see get_spark)
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",  # mapInPandas batch size
}


def with_cluster_conf(builder):
    """Apply :data:`CLUSTER_CONF` to a ``SparkSession.builder`` (cluster jobs)."""
    for k, v in CLUSTER_CONF.items():
        builder = builder.config(k, v)
    return builder
