"""Results that outlive a session (S7): tables and models named by what they were made from.

A result is named by its input files (names, sizes, times), the spec, the
configuration and the code version that its maker passes as key parts.  It
lies under ``spark.checkpoint.dir``: every writer uses a folder of its own and
then appends that folder's name to a small pointer table, so nothing is
overwritten, a half-written result is never read, and sessions that write the
same result at the same time agree on the first name.  Changed input or
configuration gives another name, which is a miss.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import scratch_path

# Bump when the code behind stored results changes their content.
STORE_VERSION = 3
_SALT = {"value": ""}


def input_stamp(spark: SparkSession, *paths: str) -> str:
    """Names, sizes and times of the input files as one number (no content is read)."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length", "modificationTime")
    r = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{r[0]}-{r[1]}"


def forget() -> None:
    """Let this session neither read what is stored nor be read by others, as a cold run does."""
    _SALT["value"] = uuid.uuid4().hex


def remember() -> None:
    """Undo :func:`forget`."""
    _SALT["value"] = ""


def stored(spark: SparkSession, name: str, key: tuple, make: Callable[[str], None]) -> str:
    """Folder of the result; ``make`` writes it into the folder it is given if there is none."""
    slug = hashlib.md5(repr((STORE_VERSION, _SALT["value"], name, *key)).encode()).hexdigest()
    base = scratch_path(spark, f"stored/{name}-{slug}")
    try:
        pointer = spark.read.parquet(f"{base}/pointer")
    except AnalysisException:       # no pointer yet
        data = f"{base}/data-{uuid.uuid4().hex}"
        make(data)
        spark.createDataFrame([(data,)], "path string").coalesce(1).write.mode("append").parquet(f"{base}/pointer")
        pointer = spark.read.parquet(f"{base}/pointer")
    return pointer.agg(F.min("path")).first()[0]


def stored_table(spark: SparkSession, name: str, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table of this key, or ``build()`` written and read back."""
    return spark.read.parquet(stored(spark, name, key, lambda path: build().write.parquet(path)))


def stored_model(spark: SparkSession, name: str, key: tuple, fit: Callable[[], tuple], load) -> tuple:
    """(model, curve): a fitted model and a list of numbers that came with it, stored or fitted now.

    ``load`` is the model class's ``load``.
    """
    def make(path: str) -> None:
        model, curve = fit()
        model.save(f"{path}/model")
        rows = [(i, float(v)) for i, v in enumerate(curve)]
        spark.createDataFrame(rows, "i int, v double").coalesce(1).write.parquet(f"{path}/curve")

    path = stored(spark, name, key, make)
    return load(f"{path}/model"), [r.v for r in spark.read.parquet(f"{path}/curve").orderBy("i").collect()]
