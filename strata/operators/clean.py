"""Cleaning and derivation of the analysis frame.

Everything is one lazy ``select`` chain over the source scan: Catalyst prunes
the Parquet read to the columns the spec names and pushes population filters
into the scan.  The only extra job is the threshold (a scalar subquery).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import (null_codes, recode, row_mean, row_sum)
from strata.spec import SurveySpec, YES_NO


# ---------------------------------------------------------------- P1 - P3

def drop_prefix(df: DataFrame, prefixes) -> DataFrame:
    """Drop columns whose (case-insensitive) name starts with a prefix."""
    prefixes = tuple(p.lower() for p in prefixes)
    out = df.drop(*[c for c in df.columns if c.lower().startswith(prefixes)])
    leaked = [c for c in out.columns if c.lower().startswith(prefixes)]
    if leaked:
        raise ValueError(f"columns with dropped prefix remain: {leaked}")
    return out


def drop_columns(df: DataFrame, exact=(), prefixes=()) -> DataFrame:
    """Drop by exact name or by prefix."""
    exact = {e.lower() for e in exact}
    prefixes = tuple(p.lower() for p in prefixes)
    return df.drop(*[c for c in df.columns
                     if c.lower() in exact or (prefixes and c.lower().startswith(prefixes))])


def column_presence(df: DataFrame, wanted) -> tuple[list[str], list[str]]:
    """(present, missing) names of an allow-list, in allow-list order."""
    have = set(df.columns)
    return [c for c in wanted if c in have], [c for c in wanted if c not in have]


def select_available(df: DataFrame, names) -> DataFrame:
    """Ordered allow-list projection; names absent from ``df`` are skipped."""
    present, _ = column_presence(df, names)
    return df.select(*present)


# ---------------------------------------------------------------- P4, P5

def null_reserve(df: DataFrame, cols, spec: SurveySpec | None = None, codes=None,
                 exempt=()) -> DataFrame:
    """Reserve codes -> NULL in ``cols`` (one projection over all columns)."""
    cols = set(cols) - set(exempt)
    out = []
    for c in df.columns:
        if c in cols:
            cc = codes if codes is not None else spec.reserve_for(c)
            out.append(null_codes(c, cc).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def recode_columns(df: DataFrame, maps: dict) -> DataFrame:
    """Recode ``{col: {from: to}}``; codes outside a map become NULL."""
    return df.select(*[recode(c, maps[c]).alias(c) if c in maps else F.col(c)
                       for c in df.columns])


# ---------------------------------------------------------------- P6 - P8

def clean_flag(col: str, spec: SurveySpec) -> Column:
    """Yes/no flag: reserve -> NULL, 1 -> 1, 2 -> 0."""
    return recode(null_codes(col, spec.reserve_for(col)), {k: int(v) for k, v in YES_NO.items()})


def composite_score(pos, neg, spec: SurveySpec) -> Column:
    """Σ positive flags (NULL when none answered) minus the negative flag (0 if NULL)."""
    pos_c = [clean_flag(c, spec) for c in pos]
    neg_c = F.coalesce(clean_flag(neg, spec), F.lit(0))
    return (row_sum(pos_c, min_count=1) - neg_c).cast("double")


def with_composites(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """Add ``flexibility_score`` and ``ite_score`` to ``df`` (cleaned flags first)."""
    flex, ite = spec.composites
    flags = [*spec.fwa_pos, spec.fwa_neg, *spec.ite_pos, spec.ite_neg]
    step1 = df.select("*", *[clean_flag(c, spec).alias(f"_f_{c}") for c in flags])

    def comp(pos, neg):
        return (row_sum([F.col(f"_f_{c}") for c in pos], min_count=1)
                - F.coalesce(F.col(f"_f_{neg}"), F.lit(0))).cast("double")

    return step1.select(*df.columns, comp(spec.fwa_pos, spec.fwa_neg).alias(flex),
                        comp(spec.ite_pos, spec.ite_neg).alias(ite))


def strain_item_columns(spec: SurveySpec) -> list[Column]:
    """Cleaned strain items: reserve -> NULL, then recode (or raw codes)."""
    out = []
    for c in spec.strain_items:
        x = null_codes(c, spec.reserve_for(c))
        if spec.strain_recode is not None:
            x = recode(x, spec.strain_recode[c])
        else:
            x = x.cast("double")
        out.append(x.alias(c))
    return out


def strain_items_frame(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """Id + cleaned strain items (the per-item frame behind prevalence tables)."""
    return df.select(spec.id_col, *strain_item_columns(spec))


def strain_score(spec: SurveySpec) -> Column:
    """Row mean of the cleaned strain items (fixed item order)."""
    return row_mean(strain_item_columns(spec))


# ---------------------------------------------------------------- P9, A18

def threshold_value(df: DataFrame, score: str, policy: str = "median") -> Column:
    """Threshold as a lazy scalar subquery (exact, linear interpolation).

    ``percentile`` keeps a value -> count map per group; scores are means of
    a fixed number of coded items, so their domain is small at any scale.
    """
    if policy == "median":
        p = 0.5
    elif policy == "percentile_75":
        p = 0.75
    elif policy.startswith("fixed_"):
        return F.lit(float(policy.split("_", 1)[1]))
    else:
        raise ValueError(f"Unknown threshold policy: {policy!r}")
    return df.select(F.percentile(score, F.lit(p))).scalar()


def threshold_label(df: DataFrame, score: str, label: str,
                    policy: str = "median") -> DataFrame:
    """label = (score >= threshold); NULL score keeps a NULL label."""
    t = threshold_value(df, score, policy)
    return df.withColumn(label, F.when(F.col(score).isNotNull(),
                                       (F.col(score) >= t).cast("int")))


# ---------------------------------------------------------------- P10 - P12

def keep_scored(df: DataFrame, score: str) -> DataFrame:
    """Drop rows without any answered strain item."""
    return df.filter(F.col(score).isNotNull())


def split_roles(df: DataFrame, spec: SurveySpec) -> dict:
    """Feature / label / score / weight roles; strain items never in features."""
    features = [c for c in spec.features if c in df.columns]
    leak = set(features) & (set(spec.strain_items) | {spec.weight_col})
    if leak:
        raise ValueError(f"label items or weight among features: {sorted(leak)}")
    return {"id": spec.id_col, "features": features, "label": spec.label_col,
            "score": spec.score_col, "weight": spec.weight_col}


def scored_frame(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """All rows with cleaned features, composites and the strain score.

    Two projections: the first materialises every cleaned item once, the
    second derives composites and the score from those attributes.  Each
    cleaned item is used twice (non-null count and sum); keeping it an
    attribute stops Catalyst from inlining the CASE tree twice, which keeps
    the generated code of the stage small enough for whole-stage codegen.
    Rows without a score stay (NULL score); use :func:`keep_scored` after
    the label is attached.
    """
    base = drop_prefix(df, spec.drop_prefixes)
    exempt = set(spec.composites) | {spec.weight_col}
    feats = [c for c in spec.features if c in base.columns]
    flags = [*spec.fwa_pos, spec.fwa_neg, *spec.ite_pos, spec.ite_neg]
    weight = (F.col(spec.weight_col).cast("double") if spec.weight_col in base.columns
              else F.lit(1.0)).alias(spec.weight_col or "weight")
    step1 = base.select(
        spec.id_col,
        *[F.col(c) if c in exempt else null_codes(c, spec.reserve_for(c)).alias(c)
          for c in feats],
        *[clean_flag(c, spec).alias(f"_f_{c}") for c in flags],
        *[x.alias(f"_s_{c}") for c, x in zip(spec.strain_items, strain_item_columns(spec))],
        weight)
    flex, ite = spec.composites

    def comp(pos, neg):
        return (row_sum([F.col(f"_f_{c}") for c in pos], min_count=1)
                - F.coalesce(F.col(f"_f_{neg}"), F.lit(0))).cast("double")

    derived = {flex: comp(spec.fwa_pos, spec.fwa_neg), ite: comp(spec.ite_pos, spec.ite_neg)}
    score = row_mean([F.col(f"_s_{c}") for c in spec.strain_items]).alias(spec.score_col)
    return step1.select(
        spec.id_col,
        *[derived[c].alias(c) if c in derived else F.col(c) for c in spec.features
          if c in derived or c in feats],
        score, spec.weight_col or "weight")


def analysis_frame(df: DataFrame, spec: SurveySpec, policy: str = "median",
                   population: dict | None = None) -> DataFrame:
    """Features + label + score + weight of the scored rows, one DataFrame.

    The threshold always comes from the whole table; ``population``
    (equality filters on codes) selects the rows that are returned and is
    applied to the raw codes so that it reaches the Parquet scan as pushed
    filters (see :func:`filter_raw_codes`).
    """
    scored = scored_frame(df, spec)
    t = threshold_value(scored, spec.score_col, policy)
    rows = scored if not population else scored_frame(filter_raw_codes(df, population, spec),
                                                      spec)
    labelled = rows.withColumn(spec.label_col, F.when(
        F.col(spec.score_col).isNotNull(), (F.col(spec.score_col) >= t).cast("int")))
    roles = split_roles(labelled, spec)
    return keep_scored(labelled, spec.score_col).select(
        roles["id"], *roles["features"], roles["label"], roles["score"],
        spec.weight_col or "weight")


# ---------------------------------------------------------------- P15, P17

def filter_population(df: DataFrame, filters: dict | None) -> DataFrame:
    """Conjunction of equality filters; an absent key means "All"."""
    for col, code in (filters or {}).items():
        if code is None or code == "All":
            continue
        df = df.filter(F.col(col) == F.lit(code))
    return df


def filter_raw_codes(df: DataFrame, filters: dict | None, spec: SurveySpec) -> DataFrame:
    """Population filter on raw codes, equal to filtering the cleaned columns.

    Equality to a code that is not a reserve code commutes with reserve
    nulling; a reserve code can never match a cleaned column, so it selects
    nothing.  Plain ``col = code`` predicates are pushed into the scan.
    """
    for col, code in (filters or {}).items():
        if code is None or code == "All":
            continue
        cond = F.lit(False) if code in spec.reserve_for(col) else (F.col(col) == F.lit(code))
        df = df.filter(cond)
    return df


def single_item_target(df: DataFrame, item: str, spec: SurveySpec) -> DataFrame:
    """One item as target: reserve -> NULL, answered rows only, item split off."""
    t = null_codes(item, spec.reserve_for(item)).alias("target")
    rest = [c for c in df.columns if c != item]
    return df.select(*rest, t).filter(F.col("target").isNotNull())
