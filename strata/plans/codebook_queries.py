"""Registered codebook queries.

The codebook files of the survey are not part of the test data; the raw
answer-category and variable rows are shaped from ``part`` (one raw row per
part) in the CSV schema the readers expect, with the messy cases the
readers must handle: zero-padded, decimal and range codes, spaced labels,
a split "Y es", reserve labels, blank concepts and missing question texts.
The cleaning itself is the library's (``clean_answer_codes``,
``variable_descriptions``), and it works on any rows of that schema.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import decode
from strata.plans.registry import register
from strata.sources.codebook import clean_answer_codes, variable_descriptions
from strata.sources.tables import read_table
from strata.spec import COMPUTED_DESCRIPTIONS, RESERVE_LABELS

_RAW_ANSWERS = """SELECT lower(p_type) AS variable_name,
  CASE WHEN p_size <= 40 THEN lpad(CAST(p_size AS {s}), 2, '0')
       WHEN p_size <= 45 THEN lpad(CAST(p_size - 40 AS {s}), 2, '0') || ' - 84'
       ELSE CAST(p_size AS {s}) || '.0' END AS code,
  CASE WHEN p_partkey % 17 = 0 THEN 'Y  es' WHEN p_partkey % 19 = 0 THEN 'Valid skip'
       WHEN p_partkey % 23 = 0 THEN '  Not stated ' ELSE ' ' || p_name || ' ' END AS label,
  p_partkey AS ord
FROM {part}"""

_RAW_VARIABLES = """SELECT 'v' || CAST(p_partkey AS {s}) AS variable_name,
  CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '   '
       ELSE p_brand || ' ' || p_type END AS concept,
  CASE WHEN p_size % 5 = 0 THEN NULL
       ELSE 'How often is the ' || p_name || ' used'
            || repeat(' at home', CAST(floor(p_size / 5) AS INTEGER)) END AS question_text
FROM {part}"""


def raw_answers(spark, d):
    return spark.sql(_RAW_ANSWERS.format(s="STRING", part="{part}"),
                     part=read_table(spark, d, "part"))


def raw_variables(spark, d):
    return spark.sql(_RAW_VARIABLES.format(s="STRING", part="{part}"),
                     part=read_table(spark, d, "part"))


def variables(spark, d):
    return variable_descriptions(raw_variables(spark, d))


_RES = ", ".join("'" + r.replace("'", "''") + "'" for r in RESERVE_LABELS)
_ANS_SQL = "raw AS (" + _RAW_ANSWERS.format(s="VARCHAR", part="part") + ")"
_VAR_SQL = ("rv AS (" + _RAW_VARIABLES.format(s="VARCHAR", part="part") + "),\n"
            "vars AS (SELECT variable_name, trim(COALESCE(NULLIF(trim(concept), ''), "
            "substring(question_text, 1, 80), variable_name)) AS description FROM rv "
            "UNION ALL SELECT * FROM (VALUES "
            + ", ".join(f"('{k}', '{v}')" for k, v in COMPUTED_DESCRIPTIONS.items())
            + ") t(variable_name, description))")


@register("clean_codebook", "WITH " + _ANS_SQL + f""",
c AS (SELECT variable_name,
        TRY_CAST(TRY_CAST(code AS DOUBLE) AS INTEGER) AS code,
        regexp_replace(trim(label), '^Y\\s+es$', 'Yes') AS label, ord FROM raw)
SELECT variable_name, code, arg_max(label, ord) AS label FROM c
WHERE (label NOT IN ({_RES}) OR label IS NULL) AND code IS NOT NULL
GROUP BY variable_name, code""")
def clean_codebook(spark, d):
    """Answer categories: trim, fix 'Y es', drop reserve labels, parse codes, last wins (S3)."""
    return clean_answer_codes(raw_answers(spark, d), "ord")


@register("describe_variables", "WITH " + _VAR_SQL + """,
li AS (SELECT l_orderkey, l_linenumber, 'v' || CAST(l_partkey AS VARCHAR) AS variable
       FROM lineitem)
SELECT li.l_orderkey, li.l_linenumber, li.variable,
  substring(COALESCE(vars.description, li.variable), 1, 65) AS description
FROM li LEFT JOIN vars ON li.variable = vars.variable_name""")
def describe_variables(spark, d):
    """Description of the variable named by every lineitem row, cut at 65 (S4 + J2)."""
    li = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("variable"))
    return decode.describe_variables(li, "variable", variables(spark, d), 65)


@register("display_labels", "WITH " + _VAR_SQL + """,
t AS (SELECT variable_name, description,
        CASE WHEN length(description) > 45 THEN substring(description, 1, 45) || '…'
             ELSE description END AS t FROM vars),
c AS (SELECT t, count(*) AS n FROM t GROUP BY t)
SELECT t.variable_name, t.description,
  CASE WHEN c.n > 1 THEN t.t || ' [' || t.variable_name || ']' ELSE t.t END AS display
FROM t JOIN c ON t.t = c.t""")
def display_labels(spark, d):
    """Display label: truncate at 45 with an ellipsis, [name] on collisions."""
    return decode.display_label(variables(spark, d), "description", "variable_name", 45)


# ------------------------------------------------------------------ S5

def _json_codebook_rows(spark, d):
    """One nested codebook record per part: answer_categories built from the row."""
    p = read_table(spark, d, "part")
    size2 = F.lpad(F.col("p_size").cast("string"), 2, "0")
    cat = lambda label, code: F.struct(label.alias("label"), code.alias("code"),
                                       F.lit(None).cast("string").alias("frequency"),
                                       F.lit(None).cast("string").alias("weighted_frequency"),
                                       F.lit(None).cast("string").alias("percent"))
    cats = F.array(cat(F.concat(F.lit(" "), F.col("p_name")), size2),
                   cat(F.lit("Y  es"), F.concat((F.col("p_size") % 10).cast("string"),
                                                F.lit(".0"))),
                   cat(F.lit("Valid skip"), F.lit("96")),
                   cat(F.col("p_brand"), F.lit("00 - 84")),
                   cat(F.col("p_type"), size2))
    return p.select(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("variable_name"),
                    F.lit(None).cast("string").alias("concept"),
                    F.col("p_name").alias("question_text"), cats.alias("answer_categories"))


@register("codebook_json", """WITH c AS (
  SELECT 'v' || CAST(p_partkey AS VARCHAR) AS v, 1 AS pos, ' ' || p_name AS label,
         lpad(CAST(p_size AS VARCHAR), 2, '0') AS code FROM part
  UNION ALL SELECT 'v' || CAST(p_partkey AS VARCHAR), 2, 'Y  es',
         CAST(p_size % 10 AS VARCHAR) || '.0' FROM part
  UNION ALL SELECT 'v' || CAST(p_partkey AS VARCHAR), 3, 'Valid skip', '96' FROM part
  UNION ALL SELECT 'v' || CAST(p_partkey AS VARCHAR), 4, p_brand, '00 - 84' FROM part
  UNION ALL SELECT 'v' || CAST(p_partkey AS VARCHAR), 5, p_type,
         lpad(CAST(p_size AS VARCHAR), 2, '0') FROM part),
k AS (SELECT v, pos, TRY_CAST(TRY_CAST(code AS DOUBLE) AS INTEGER) AS code,
        regexp_replace(trim(label), '^Y\\s+es$', 'Yes') AS label FROM c)
SELECT v AS variable_name, code, arg_max(label, pos) AS label FROM k
WHERE label NOT IN ('Valid skip', 'Don''t know', 'Refusal', 'Not stated') AND code IS NOT NULL
GROUP BY v, code""")
def codebook_json(spark, d):
    """Nested JSONL codebook written to the shared folder and read back."""
    import uuid
    from strata.session import scratch_path
    from strata.sources.codebook import read_codebook_json
    path = scratch_path(spark, f"codebook-{uuid.uuid4().hex}")
    _json_codebook_rows(spark, d).write.mode("overwrite").json(path)
    codes, _ = read_codebook_json(spark, path)
    return codes


# ------------------------------------------------------------------ S3, S4 from files

_CSV_ANSWERS = """SELECT CASE WHEN p_partkey % 7 = 0 THEN ' ' || p_name || ', "' || p_brand || '"' || chr(10) || p_type
       WHEN p_partkey % 17 = 0 THEN 'Y  es' WHEN p_partkey % 19 = 0 THEN 'Valid skip' ELSE ' ' || p_name || ' ' END AS label,
  'v' || CAST(p_partkey AS {s}) AS variable_name,
  CASE WHEN p_size <= 40 THEN lpad(CAST(p_size AS {s}), 2, '0') WHEN p_size <= 45 THEN '00 - 84'
       ELSE CAST(p_size AS {s}) || '.0' END AS code
FROM {part}"""

_CSV_VARIABLES = """SELECT CASE WHEN p_size % 5 = 0 THEN NULL
       ELSE 'Is the "' || p_name || '",' || chr(10) || 'by ' || p_brand || ', used?' END AS question_text,
  p_brand AS note,
  CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '   ' ELSE p_type || ', "' || p_brand || '"' END AS concept,
  'v' || CAST(p_partkey AS {s}) AS variable_name
FROM {part}"""


def _csv_file(spark, d, sql, name):
    """The rows as CSV files in the shared folder, quoted where needed."""
    import uuid
    from strata.session import scratch_path
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    rows = spark.sql(sql.format(s="STRING", part="{part}"), part=read_table(spark, d, "part"))
    rows.write.csv(path, header=True, quote='"', escape='"')
    return path


@register("read_codebook_csv", "WITH raw AS (" + _CSV_ANSWERS.format(s="VARCHAR", part="part") + f"""),
c AS (SELECT variable_name, TRY_CAST(TRY_CAST(code AS DOUBLE) AS INTEGER) AS code,
        regexp_replace(trim(label), '^Y\\s+es$', 'Yes') AS label FROM raw)
SELECT variable_name, code, label FROM c WHERE label NOT IN ({_RES}) AND code IS NOT NULL""")
def read_codebook_csv(spark, d):
    """Answer categories from CSV files whose columns stand in another order (S3)."""
    from strata.sources.codebook import read_answer_codes
    return read_answer_codes(spark, _csv_file(spark, d, _CSV_ANSWERS, "answers"))


@register("read_variables_csv", "WITH raw AS (" + _CSV_VARIABLES.format(s="VARCHAR", part="part") + """)
SELECT variable_name, trim(COALESCE(NULLIF(trim(concept), ''), substring(question_text, 1, 80), variable_name)) AS description FROM raw
UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in COMPUTED_DESCRIPTIONS.items())
          + ") t(variable_name, description)")
def read_variables_csv(spark, d):
    """Variable descriptions from CSV files with quotes and line breaks inside fields."""
    from strata.sources.codebook import read_variables
    return read_variables(spark, _csv_file(spark, d, _CSV_VARIABLES, "variables"))
