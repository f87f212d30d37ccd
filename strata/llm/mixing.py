"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic) of token weight.  The
cells are raked: in turn, each dimension's sums are scaled to its target
marginal, until all marginals hold.  A cell's ratio of raked to present weight
calibrates the probability that one of its documents is sampled, and the
weight that a sampled document carries: probability times weight is the ratio,
so the weighted sample has the target marginals in expectation.

Targets: for each dimension either a table of shares or an exponent, which
flattens the present shares (1 keeps them, 0 makes all values equal).  Shares
of values that no cell has can't be met; the rest are scaled to 1.

Marginals may contradict the cells there are (a source with one language only
asks for more of it than the languages' shares leave).  Raking then settles
between them.  It ends when all marginals hold to the tolerance, when a job's
rounds no longer bring them nearer, or after ``max_rounds``.  Tables of shares
that aren't met by then raise ``TargetsNotMet`` with the error reached;
exponents are wishes, and the result says in ``mix_error`` how far off the
marginals are.

Cases: null dimension values and empty strings are one value, the empty
string.  Null and empty texts weigh 0 tokens and are sampled like their cell;
a cell without tokens keeps its documents with the sampling rate.  Documents
with equal ids share their draw; repeated rows are drawn alike.  An empty
table gives no rows.  The result has all columns of the documents and three
more, named so that they don't clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import WORD_SPACE, documents, prepare, written

ROUNDS_PER_TABLE = 4
STALLED = 0.999     # a job that leaves more of the error than this ends the raking

_WORD = "[^" + "".join(f"\\x{ord(c):02x}" for c in WORD_SPACE) + "]+"


@dataclass(frozen=True)
class Mix:
    """What the sample should look like."""

    exponents: dict = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 0.7})
    rate: float = 0.5           # share of all tokens that the sample should have
    tolerance: float = 1e-4     # largest relative error of a marginal
    max_rounds: int = 400       # an end for marginals that come nearer ever more slowly
    seed: int = 11


def word_count(text: str = "text") -> Column:
    """The token weight of a document: its words."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)).cast("long"), F.lit(0).cast("long"))


def form_topic(text: str = "text") -> Column:
    """The topic that the query uses, as the tables carry none: the text's form."""
    n = word_count(text)
    return (F.when(F.col(text).rlike(r"[0-9]{4}"), F.lit("figures")).when(n >= 1000, F.lit("treatise"))
            .when(n >= 250, F.lit("article")).otherwise(F.lit("note")))


def _value(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


class TargetsNotMet(ValueError):
    """The cells can't have the shares asked for; ``error`` is the largest relative error reached."""

    def __init__(self, error: float):
        super().__init__(f"raking ended with a marginal off by {error:.4g} of its target")
        self.error = error


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float, max_rounds: int) -> tuple[DataFrame, float]:
    """Scale column ``w`` of the cells until each dimension has its target shares.

    Returns the cells and the largest relative error of a marginal.

    ``targets`` maps a column of the cells to a table of its value and
    ``share``; shares sum to 1.  A round scales every dimension once; every
    ``ROUNDS_PER_TABLE`` rounds are one job that writes the cells and looks at
    the factors of its last round.
    """
    total = cells.agg(F.sum("w").alias("t")).first().t or 0.0
    columns = cells.columns
    for dim, target in targets.items():
        cells = cells.join(target.select(dim, F.col("share").alias(f"__share_{dim}")), dim)
    error = math.inf
    for _ in range(0, max_rounds, ROUNDS_PER_TABLE):
        cells = cells.withColumn("__off", F.lit(0.0))
        for i in range(ROUNDS_PER_TABLE):
            for dim in targets:
                now = F.sum("w").over(Window.partitionBy(dim))
                cells = cells.withColumn("__f", F.when(now > 0, F.col(f"__share_{dim}") * total / now).otherwise(F.lit(1.0)))
                cells = cells.withColumn("w", F.col("w") * F.col("__f"))
                if i == ROUNDS_PER_TABLE - 1:
                    lost = F.when(F.col(f"__share_{dim}") > 0, F.lit(1.0)).otherwise(F.lit(0.0))     # nothing left to scale
                    cells = cells.withColumn("__off", F.greatest("__off", F.when(now > 0, F.abs(F.col("__f") - 1)).otherwise(lost)))
        cells = written(cells.drop("__f"), "raked")
        before, error = error, cells.agg(F.max("__off").alias("m")).first().m or 0.0
        cells = cells.drop("__off")
        if error <= tolerance or error > STALLED * before:
            break
    return cells.select(columns), error


def flattened(cells: DataFrame, dim: str, exponent: float) -> DataFrame:
    """Target shares: present shares to the power of ``exponent``, scaled to 1."""
    now = cells.groupBy(dim).agg(F.sum("w").alias("t")).filter("t > 0").withColumn("s", F.pow("t", F.lit(exponent)))
    return now.select(dim, (F.col("s") / now.agg(F.sum("s")).scalar()).alias("share"))


def given(cells: DataFrame, dim: str, shares: DataFrame) -> DataFrame:
    """Target shares from a table (value, share), for the values there are."""
    there = cells.filter("w > 0").select(dim).distinct()
    use = shares.join(there, dim, "right").select(dim, F.coalesce("share", F.lit(0.0)).alias("s"))
    return use.select(dim, (F.col("s") / use.agg(F.sum("s")).scalar()).alias("share"))


def probabilities(cells: DataFrame, rate: float) -> DataFrame:
    """``probability`` and ``weight`` of each cell, for ``rate`` of all tokens.

    Probabilities are the ratio ``w / tokens`` times a common factor, at most
    1; the factor grows until the expected tokens reach the rate.  It settles
    when no further cell reaches 1.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(F.lit(0.0))
    cells = cells.withColumn("ratio", ratio)
    factor, full = rate, -1
    while True:
        capped = F.col("ratio") * factor >= 1
        r = cells.agg(F.sum("tokens").alias("all"), F.sum(F.when(capped, F.col("tokens"))).alias("sure"),
                      F.sum(F.when(~capped, F.col("w"))).alias("open"), F.count(F.when(capped, 1)).alias("n")).first()
        if r.n == full or not r.open:
            break
        factor, full = max(factor, (rate * r.all - (r.sure or 0)) / r.open), r.n
    p = F.least(F.lit(1.0), F.col("ratio") * factor)
    p = F.when(F.col("tokens") > 0, p).otherwise(F.lit(rate))
    return cells.withColumn("probability", p).withColumn(
        "weight", F.when(F.col("tokens") == 0, F.lit(1.0)).when(F.col("probability") > 0, F.col("ratio") / F.col("probability")))


def mixed(docs: DataFrame, mix: Mix = Mix(), targets: dict[str, DataFrame] | None = None, source: Column | None = None,
          lang: Column | None = None, topic: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """The sampled documents with ``mix_probability``, ``mix_weight`` and ``mix_error``.

    The cells' table is met by its measured size: Spark broadcasts it below
    its own threshold and shuffles beyond.
    """
    prepare(docs.sparkSession)
    dims = {"source": _value(source if source is not None else F.col("source")),
            "lang": _value(lang if lang is not None else F.col("lang")),
            "topic": _value(topic if topic is not None else form_topic(text_col))}
    summed = docs.select(*[c.alias(d) for d, c in dims.items()], word_count(text_col).alias("n"))
    cells = written(summed.groupBy(*dims).agg(F.sum("n").cast("double").alias("tokens")).withColumn("w", F.col("tokens")), "cells")
    shares = {d: written(given(cells, d, targets[d]) if targets and d in targets else flattened(cells, d, mix.exponents[d]), "target")
              for d in dims}
    raked, error = rake(cells.filter("w > 0"), shares, mix.tolerance, mix.max_rounds)
    if targets and error > mix.tolerance:
        raise TargetsNotMet(error)
    cells = raked.union(cells.filter("w = 0").select(raked.columns))
    drawn = written(probabilities(cells, mix.rate).select(
        *[F.col(d).alias(f"__{d}") for d in dims], F.col("probability").alias("mix_probability"), F.col("weight").alias("mix_weight")), "drawn")
    keyed = docs.select("*", *[c.alias(f"__{d}") for d, c in dims.items()])
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(mix.seed)), F.lit(1 << 53)) / float(1 << 53)
    return keyed.join(drawn, [f"__{d}" for d in dims]).filter(chance < F.col("mix_probability")).select(
        *docs.columns, "mix_probability", "mix_weight", F.lit(error).alias("mix_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled documents, their probability and weight, and the error that raking left."""
    return mixed(documents(spark, sf_dir)).select("doc_id", "source", "lang", "mix_probability", "mix_weight", "mix_error")
