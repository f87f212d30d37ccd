"""Registered intake scoring queries (S8, M18): batch and Structured Streaming.

Intake records are shaped from ``events`` (one form per event) in the form's
schema: hours as text (some unparsable), the form's option strings,
durations such as "3 months", free-text notes.  Parsing, validation, the
profile model and scoring are the library's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strata.plans.registry import register
from strata.session import scratch_path
from strata.sources.tables import read_table
from strata.spec import PROFILES
from strata.streaming import intake

_CACHE: dict = {}


def intake_rows(spark, d):
    e = read_table(spark, d, "events")
    hours = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(
        F.floor("value").cast("int").cast("string"))
    # index 4 is past the three options: an unanswered field
    emp = F.try_element_at(F.array(*[F.lit(x) for x in intake.EMPLOYMENT]),
                           (F.col("user_id") % 4 + 1).cast("int"))
    sup = F.element_at(F.array(*[F.lit(x) for x in intake.SUPPORT]),
                       (F.col("event_id") % 3 + 1).cast("int"))
    unit = (F.when(F.col("event_type") == "click", F.lit(" months"))
            .when(F.col("event_type") == "view", F.lit(" weeks")).otherwise(F.lit(" years")))
    dur = F.concat((F.col("user_id") % 10 + 1).cast("string"), unit)
    return e.select(F.col("event_id").alias("intake_id"), hours.alias("care_hours"),
                    emp.alias("employment_status"),
                    sup.alias("support_network"), dur.alias("care_duration"),
                    F.col("props").alias("notes"))


def intake_model(spark, d):
    k = (spark.sparkContext.applicationId, d.rstrip("/"))
    if k not in _CACHE:
        _CACHE[k] = intake.fit_intake_model(intake_rows(spark, d))
    return _CACHE[k]


@register("score_intake")
def score_intake(spark, d):
    """Validate intake forms, assign the nearest profile cluster, top factors (batch)."""
    return intake.score_intake(intake_model(spark, d), intake_rows(spark, d))


@register("score_intake_stream")
def score_intake_stream(spark, d):
    """The same scoring as a Structured Streaming job over JSON intake files."""
    base = scratch_path(spark, f"intake-{uuid.uuid4().hex}")
    intake_rows(spark, d).write.mode("overwrite").json(f"{base}/source")
    # the stream scores with the stored model, as a separate scoring job would
    intake.save_intake_model(spark, intake_model(spark, d), f"{base}/model")
    model = intake.load_intake_model(spark, f"{base}/model")
    return intake.run_stream(spark, model, f"{base}/source", f"{base}/sink",
                             f"{base}/checkpoint")


# A stored model: scaler, centroids in standard units, and the profile of each.
GIVEN = intake.IntakeModel(
    {"mean": [40.0, 2.0, 2.0, 3.0], "std": [24.0, 0.8, 0.8, 2.5]},
    [[-1.0, 0.0, -1.2, 1.3], [1.2, 0.8, 1.1, 0.0], [0.1, -1.0, 0.5, -0.3]], [4, 0, 1])

_FORMS_SQL = """WITH forms AS (
  SELECT event_id AS intake_id,
    CASE WHEN event_type <> 'error' AND floor(value) BETWEEN 0 AND 168 THEN CAST(floor(value) AS INTEGER) END AS h,
    CASE WHEN user_id % 4 < 3 THEN user_id % 4 + 1 END AS e, event_id % 3 + 1 AS s,
    (user_id % 10 + 1) / CASE event_type WHEN 'click' THEN CAST(12 AS DOUBLE) WHEN 'view' THEN 52 ELSE 1 END AS y
  FROM events),
z AS (SELECT intake_id, h IS NOT NULL AND e IS NOT NULL AS valid,
        (h - CAST(40 AS DOUBLE)) / CAST(24 AS DOUBLE) AS a, (e - CAST(2 AS DOUBLE)) / CAST('0.8' AS DOUBLE) AS b,
        (s - CAST(2 AS DOUBLE)) / CAST('0.8' AS DOUBLE) AS c, (y - CAST(3 AS DOUBLE)) / CAST('2.5' AS DOUBLE) AS d FROM forms),
m(k, ma, mb, mc, md) AS (VALUES """ + ", ".join(
    "(" + ", ".join([str(k), *(f"CAST('{x}' AS DOUBLE)" for x in c)]) + ")" for k, c in enumerate(GIVEN.centroids)) + """),
near AS (SELECT intake_id, valid, arg_min(k, (a-ma)*(a-ma) + (b-mb)*(b-mb) + (c-mc)*(c-mc) + (d-md)*(d-md)) AS k
         FROM z CROSS JOIN m GROUP BY intake_id, valid)
SELECT intake_id, valid, CASE WHEN valid THEN k END AS cluster,
  CASE WHEN valid THEN CASE k """ + " ".join(f"WHEN {k} THEN '{PROFILES[p][0]}'" for k, p in enumerate(GIVEN.profiles)) + """ END END AS profile_name
FROM near"""


@register("score_intake_given", _FORMS_SQL)
def score_intake_given(spark, d):
    """Every form scored with a given stored model; forms that aren't valid get no profile."""
    return intake.score_intake(GIVEN, intake_rows(spark, d)).select("intake_id", "valid", "cluster", "profile_name")


# The source leaves the texts open, so these entries only show the table's use.
GUIDANCE = (
    [("next_step", name, 1, f"Review the care plan for: {name}") for name, _ in PROFILES]
    + [("resource", name, 1, "Local caregiver support line") for name, _ in PROFILES[:3]]
    + [("next_step", factor, 1, f"Talk about: {factor}") for factor in intake.FIELD_NAMES.values()])


@register("intake_guidance", _FORMS_SQL.replace("SELECT intake_id, valid, CASE WHEN valid THEN k END AS cluster,", "SELECT intake_id,").replace(
    " AS profile_name\nFROM near", " AS profile_name,\n  CASE WHEN valid THEN 'Review the care plan for: ' || CASE k "
    + " ".join(f"WHEN {k} THEN '{PROFILES[p][0]}'" for k, p in enumerate(GIVEN.profiles)) + " END ELSE '' END AS first_step,\n"
    "  CASE WHEN valid THEN 4 ELSE 0 END AS n_steps,\n  CASE WHEN valid AND k IN ("
    + ", ".join(str(k) for k, p in enumerate(GIVEN.profiles) if p < 3) + ") THEN 1 ELSE 0 END AS n_resources\nFROM near"))
def intake_guidance(spark, d):
    """Next steps and resources of every form by its profile and top factors."""
    guidance = spark.createDataFrame(GUIDANCE, intake.GUIDANCE_SCHEMA)
    out = intake.with_guidance(intake.score_intake(GIVEN, intake_rows(spark, d)), guidance)
    return out.select("intake_id", "profile_name", F.coalesce(F.get("next_steps", F.lit(0)), F.lit("")).alias("first_step"),
                      F.size("next_steps").alias("n_steps"), F.size("resources").alias("n_resources"))


# one form in JSON by event; the line of an "error" event ends inside its first value
_LINE = """concat('{"intake_id":', CAST(event_id AS VARCHAR(20)), ',"care_hours":"',
  CASE WHEN event_type = 'error' THEN '' ELSE concat(CAST(event_id % 90 AS VARCHAR(20)),
  '","employment_status":"Employed part-time","support_network":"Some support","care_duration":"2 years"}') END)"""


@register("intake_rejects", f"SELECT raw, count(*) AS n FROM (SELECT {_LINE} AS raw, event_type FROM events) x "
          "WHERE event_type = 'error' GROUP BY raw")
def intake_rejects(spark, d):
    """Broken JSON lines of an intake stream, from its second sink."""
    base = scratch_path(spark, f"rejects-{uuid.uuid4().hex}")
    read_table(spark, d, "events").selectExpr(f"{_LINE} AS value").write.text(f"{base}/source")
    _, broken = intake.run_stream_with_rejects(spark, intake_model(spark, d), f"{base}/source", f"{base}/scores",
                                               f"{base}/rejects", f"{base}/checkpoint")
    return broken.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
