"""Intake records: schema, validation, profile scoring in batch and streaming.

The scoring step is a stateless column transform, so the same function runs
on a batch DataFrame and on a ``readStream`` source (no watermark, no state
store).  The fitted artefact is small and explicit: per-field mean/std and
the k centroids (k x fields numbers) with the profile of each, stored alongside the model.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.cluster import apply_scaler, assign_clusters, scaler_model
from strata.session import materialize
from strata.spec import PROFILE_SIGNATURES, PROFILES

INTAKE_SCHEMA = T.StructType([
    T.StructField("intake_id", T.LongType()),
    T.StructField("care_hours", T.StringType()),
    T.StructField("employment_status", T.StringType()),
    T.StructField("support_network", T.StringType()),
    T.StructField("care_duration", T.StringType()),
    T.StructField("notes", T.StringType()),
])

# Form options (fixed values of the intake form) and their codes.
EMPLOYMENT = {"Employed full-time": 1, "Employed part-time": 2, "Not currently employed": 3}
SUPPORT = {"Strong support": 1, "Some support": 2, "Little or no support": 3}
FIELDS = ("care_hours", "employment_code", "support_code", "duration_years")
FIELD_NAMES = {"care_hours": "Weekly caregiving hours", "employment_code": "Employment status",
               "support_code": "Support network", "duration_years": "Caregiving duration"}


def _code(col: str, mapping: dict) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return m[F.trim(F.col(col))]


def duration_years(col: str) -> Column:
    """Years of "2 years 6 months", "18 months", "3": all parts added, a bare number is years."""
    text = F.lower(F.col(col))
    parts = [F.aggregate(F.transform(F.regexp_extract_all(text, F.lit(rf"([0-9]+(?:\.[0-9]+)?)\s*{unit}"), F.lit(1)),
                                     lambda x: x.try_cast("double") / per), F.lit(0.0), lambda a, x: a + x)
             for unit, per in (("year", 1.0), ("month", 12.0), ("week", 52.0), ("day", 365.0))]
    named = text.rlike(r"[0-9]\s*(?:year|month|week|day)")
    return F.when(named, parts[0] + parts[1] + parts[2] + parts[3]).otherwise(
        F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"))


def parse_intake(df: DataFrame) -> DataFrame:
    """Validate and transform the form strings into numeric fields plus an error list."""
    hours = F.col("care_hours").try_cast("double")
    hours = F.when((hours >= 0) & (hours <= 168), hours)
    years = duration_years("care_duration")
    parsed = df.select("*", hours.alias("care_hours_n"),
                       _code("employment_status", EMPLOYMENT).alias("employment_code"),
                       _code("support_network", SUPPORT).alias("support_code"),
                       years.alias("duration_years"))
    errors = F.array_compact(F.array(
        F.when(F.col("care_hours_n").isNull(), F.lit("care_hours")),
        F.when(F.col("employment_code").isNull(), F.lit("employment_status")),
        F.when(F.col("support_code").isNull(), F.lit("support_network")),
        F.when(F.col("duration_years").isNull(), F.lit("care_duration"))))
    return (parsed.withColumn("errors", errors)
            .withColumn("valid", F.size("errors") == 0)
            .withColumn("care_hours", F.col("care_hours_n")).drop("care_hours_n"))


def _vector(df: DataFrame) -> DataFrame:
    """Field vector with missing fields at -1 (below every field's domain)."""
    return df.withColumn("_x", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0))
                                         for c in FIELDS]))


@dataclass
class IntakeModel:
    """Scaler, centroids, and the profile (by place in ``PROFILES``) of each centroid."""

    scaler: dict
    centroids: list
    profiles: list


def match_profiles(centroids: list, signatures=PROFILE_SIGNATURES) -> list:
    """Profile of each centroid, by the smallest total distance to the signatures.

    Centroids and signatures are in standard units, so k-means numbers, which
    have no order, decide nothing.  Up to as many centroids as profiles match
    one to one; any further centroid takes its nearest profile.
    """
    cost = [[sum((a - b) ** 2 for a, b in zip(c, s)) for s in signatures] for c in centroids]
    n = min(len(centroids), len(signatures))
    best = min(permutations(range(len(signatures)), n), key=lambda p: sum(cost[i][j] for i, j in enumerate(p)))
    return [*best, *(min(range(len(signatures)), key=row.__getitem__) for row in cost[n:])]


def fit_intake_model(history: DataFrame, k: int = len(PROFILES), restarts: int = 1,
                     seed: int = 42) -> IntakeModel:
    """Scaler statistics, centroids and their profiles from the valid forms of a history.

    The forms are parsed once: the fit reads their few numbers several times.
    """
    v = materialize(_vector(parse_intake(history).filter("valid")).select("intake_id", "_x"), "intake-vectors")
    scaler = scaler_model(v, "_x")
    z = apply_scaler(v, "_x", scaler, "_z")
    _, model = assign_clusters(z.select("intake_id", "_z"), "intake_id", "_z", k, restarts, seed)
    centroids = [list(map(float, c)) for c in model.clusterCenters()]
    return IntakeModel(scaler, centroids, match_profiles(centroids))


def score_intake(model: IntakeModel, df: DataFrame) -> DataFrame:
    """Stateless scoring: nearest centroid, its profile, top-3 factors by |z|.

    A form that isn't valid has no cluster, profile or factors (NULL).  Works unchanged on batch and streaming DataFrames.
    """
    v = apply_scaler(_vector(parse_intake(df)), "_x", model.scaler, "_z")
    dists = F.array(*[
        F.aggregate(F.zip_with("_z", F.array(*[F.lit(c) for c in cen]),
                               lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        for cen in model.centroids])
    best = F.array_min(F.transform(dists, lambda d, i: F.struct(d.alias("d"), i.alias("i"))))["i"]
    names = F.create_map(*[x for i, (n, _) in enumerate(PROFILES) for x in (F.lit(i), F.lit(n))])
    descs = F.create_map(*[x for i, (_, t) in enumerate(PROFILES) for x in (F.lit(i), F.lit(t))])
    labels = F.array(*[F.lit(FIELD_NAMES[c]) for c in FIELDS])
    ranked = F.array_sort(F.transform("_z", lambda z, i: F.struct(
        (-F.abs(z)).alias("k"), i.alias("i"))))
    top = F.transform(F.slice(ranked, 1, 3), lambda s: F.element_at(labels, s["i"] + 1))
    of_cluster = F.array(*[F.lit(int(p)) for p in model.profiles])
    profile = F.element_at(of_cluster, best + 1)
    return (v.withColumn("cluster", F.when(F.col("valid"), best))
            .select("intake_id", "valid", "errors", "cluster",
                    F.when(F.col("valid"), names[profile]).alias("profile_name"),
                    F.when(F.col("valid"), descs[profile]).alias("profile_description"),
                    F.when(F.col("valid"), top).alias("top_factors")))


GUIDANCE_SCHEMA = "kind string, subject string, place int, entry string"


def with_guidance(scored: DataFrame, guidance: DataFrame) -> DataFrame:
    """Scored forms with ``next_steps`` and ``resources``, from a table of entries.

    ``guidance`` has ``kind`` (next_step or resource), ``subject`` (a profile's
    name or a factor of ``FIELD_NAMES``), ``place`` and ``entry``.  A form gets
    the entries of its profile by place, then those of its top factors in the
    factors' order, each entry once; forms without a profile get empty lists.
    The table is folded to one row, so scoring stays a map, in a stream too.
    """
    entry = F.struct("place", "entry")
    folded = (guidance.groupBy("kind", "subject").agg(F.array_sort(F.collect_list(entry)).getField("entry").alias("entries"))
              .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "subject"), "entries"))).alias("m")))
    row = folded.first()        # as large as the table of entries, a fixed text
    entries = row.m if row and row.m else {}
    table = F.create_map(*[x for k, v in sorted(entries.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))]) if entries else None
    subjects = F.concat(F.array("profile_name"), F.coalesce("top_factors", F.array().cast("array<string>")))

    def listed(kind: str) -> Column:
        none = F.array().cast("array<string>")
        if table is None:
            return none
        got = F.flatten(F.transform(subjects, lambda s: F.coalesce(table[F.concat(F.lit(f"{kind}|"), s)], none)))
        return F.when(F.col("profile_name").isNotNull(), F.array_distinct(got)).otherwise(none)
    return scored.select("*", listed("next_step").alias("next_steps"), listed("resource").alias("resources"))


def read_intake(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON intake records with the fixed schema (batch or streaming)."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(INTAKE_SCHEMA).json(path)


BROKEN = "_broken_record"


def read_records(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Intake records, and the text of each line that is no record of the schema in ``BROKEN``."""
    reader = spark.readStream if stream else spark.read
    schema = T.StructType([*INTAKE_SCHEMA.fields, T.StructField(BROKEN, T.StringType())])
    return (reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
            .json(path).select("*", F.col("_metadata.file_name").alias("file_name")))


def whole_records(records: DataFrame) -> DataFrame:
    return records.filter(F.col(BROKEN).isNull()).drop(BROKEN, "file_name")


def broken_records(records: DataFrame) -> DataFrame:
    """``raw`` (the line) and ``file_name`` of each broken record."""
    return records.filter(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("raw"), "file_name")


def run_stream(spark: SparkSession, model: IntakeModel, source: str, sink: str,
               checkpoint: str) -> DataFrame:
    """Score every file in ``source`` with an available-now trigger into a Parquet sink."""
    q = (score_intake(model, read_intake(spark, source, stream=True))
         .writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()
    return spark.read.parquet(sink)


def run_stream_with_rejects(spark: SparkSession, model: IntakeModel, source: str, sink: str, rejects: str,
                            checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """(scores, broken records): one stream over new files into two Parquet sinks.

    Each micro-batch goes to a folder of its own number in both sinks, and a
    batch that is run again after a failure overwrites its own folders, so
    both sinks hold every record once.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()         # two sinks read it, the source is read once
        try:
            for df, target in ((score_intake(model, whole_records(batch)), sink), (broken_records(batch), rejects)):
                df.write.mode("overwrite").parquet(f"{target}/batch={number}")
        finally:
            batch.unpersist()

    q = (read_records(spark, source, stream=True).writeStream.foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return tuple(spark.read.option("basePath", t).parquet(t).drop("batch") for t in (sink, rejects))


def save_intake_model(spark: SparkSession, model: IntakeModel, path: str) -> str:
    """Store scaler statistics and centroids (a few numbers) as one JSON text row."""
    import json
    body = json.dumps({"scaler": model.scaler, "centroids": model.centroids, "profiles": model.profiles})
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def load_intake_model(spark: SparkSession, path: str) -> IntakeModel:
    import json
    body = json.loads(spark.read.text(path).first()["value"])
    return IntakeModel(body["scaler"], body["centroids"], body["profiles"])
