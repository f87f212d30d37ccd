"""Splits, samples and classifier evaluation (M1, M4, M5, M6, M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.prefix import running_sums
from strata.session import materialize


def hash_key(id_col: str, seed: int = 42):
    """Deterministic pseudo-random key: md5('<seed>:<id>'), same text in DuckDB."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


# ------------------------------------------------------------------ M1

def stratified_split(df: DataFrame, id_col: str, label: str, test: float = 0.2,
                     seed: int = 42, prefix_len: int = 5, out: str = "is_test") -> DataFrame:
    """Exact per-class test share: the round(test * n_class) smallest hash keys.

    Equivalent to ``row_number() OVER (PARTITION BY label ORDER BY key, id) <=
    round(test * n)``, but no row is ranked that a comparison can place.  The
    last test row of a class is looked for in two steps: rows are counted per
    (label, key prefix), which names the prefix it lies in, and the rows of
    these prefixes, about n / 16**prefix_len of a class, per (label, key, id).
    Every other row is before or after that key.  The count tables have at most
    ``classes x 16**prefix_len`` rows and the distinct ids of one prefix of each
    class, whatever the data size.

    Ids may repeat.  Copies of an id are in the test set together, unless the
    class's last test row is one of them: these copies are ordered by a hash of
    the whole row, equal rows by their place in a written table, and numbered
    in ranges of that order, so that an id which holds half of all rows spreads
    over many tasks.  Rows without a label are a class of their own; rows
    without an id come first.
    """
    x = df.withColumn("_h", F.coalesce(hash_key(id_col, seed), F.lit(""))).withColumn("_p", F.substring("_h", 1, prefix_len))
    x = x.withColumn("_id", F.col(id_col)).withColumn("_l", F.col(label))
    until = lambda *order: Window.partitionBy("_l").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    holds = (F.col("_k") > F.col("_cum") - F.col("_n")) & (F.col("_k") <= F.col("_cum"))      # the class's last test row
    prefixes = x.groupBy("_l", "_p").agg(F.count(F.lit(1)).alias("_n")).select(
        "_l", "_p", "_n", F.bround(F.lit(test) * F.sum("_n").over(Window.partitionBy("_l")), 0).alias("_k"),
        F.sum("_n").over(until("_p")).alias("_cum"))
    last = prefixes.filter(holds).select(F.col("_l").alias("_c"), F.col("_p").alias("_at"), (F.col("_k") - (F.col("_cum") - F.col("_n"))).alias("_k"))
    near = x.join(last, F.col("_l").eqNullSafe(F.col("_c")) & (F.col("_p") == F.col("_at")))
    keys = near.groupBy("_l", "_h", "_id", "_k").agg(F.count(F.lit(1)).alias("_n")).select(
        "*", F.sum("_n").over(until("_h", "_id")).alias("_cum"))
    # one row per class: its last key, and how many of that key's rows are test rows
    ends = materialize(keys.filter(holds).select(
        F.col("_l").alias("_c"), F.col("_h").alias("_eh"), F.col("_id").alias("_eid"),
        (F.col("_k") - (F.col("_cum") - F.col("_n"))).alias("_take"), F.col("_n").alias("_of")), "split-ends")
    j = x.join(ends, F.col("_l").eqNullSafe(F.col("_c")), "left")       # a class without test rows has no end
    same = (F.col("_h") == F.col("_eh")) & F.col("_id").eqNullSafe(F.col("_eid"))
    before = (F.col("_h") < F.col("_eh")) | ((F.col("_h") == F.col("_eh")) & (F.col("_id") <= F.col("_eid"))) | same
    cut = F.coalesce(same & (F.col("_take") < F.col("_of")), F.lit(False))
    placed = j.select(*df.columns, F.coalesce(before, F.lit(False)).alias(out), cut.alias("_cut"), "_l", "_take")
    if not ends.filter("_take < _of").head(1):
        return placed.select(*df.columns, out)
    row = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    tied = materialize(placed.filter("_cut").withColumn("_t", row).withColumn("_u", F.monotonically_increasing_id()), "split-ties")
    numbered = running_sums(tied.withColumn("_one", F.lit(1)), "_t", ["_one"], tie_col="_u", by=["_l"])
    return placed.filter(~F.col("_cut")).select(*df.columns, out).unionByName(
        numbered.select(*df.columns, (F.col("cum__one") <= F.col("_take")).alias(out)))


# ------------------------------------------------------------------ M8

def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all when fewer) by smallest hash key: a top-k, no full sort."""
    return (df.withColumn("_h", hash_key(id_col, seed))
            .orderBy("_h", id_col).limit(n).drop("_h"))


# ------------------------------------------------------------------ M4, M5

def _score_groups(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score (partial aggregation)."""
    return (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(score).cast("double").alias("score"))
            .agg(F.sum(F.col(label).cast("long")).alias("pos"),
                 F.sum((1 - F.col(label)).cast("long")).alias("neg")))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve, ties counted half: (auc, n_pos, n_neg)."""
    g = running_sums(_score_groups(df, score, label), "score", ["neg"])
    below = F.col("cum_neg") - F.col("neg")
    return g.agg(
        F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") * 0.5)),
                     F.sum("pos").cast("double") * F.sum("neg").cast("double"))
        .alias("auc"),  # NULL when only one class is present
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """tp, fp, tpr, fpr at every distinct score threshold (score >= threshold)."""
    g = _score_groups(df, score, label)
    tot = g.select(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    p, n = tot["p"], tot["n"]  # one scalar subquery for both totals
    r = running_sums(g, "score", ["pos", "neg"])
    tp = p - (F.col("cum_pos") - F.col("pos"))
    fp = n - (F.col("cum_neg") - F.col("neg"))
    return (r.select(F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"))
            .select("threshold", "tp", "fp",
                    F.try_divide(F.col("tp").cast("double"), p).alias("tpr"),
                    F.try_divide(F.col("fp").cast("double"), n).alias("fpr"))
            .orderBy(F.desc("threshold")))


# ------------------------------------------------------------------ M6

def classification_report(df: DataFrame, label: str, pred: str, names=("Low", "High"),
                          digits: int = 9) -> DataFrame:
    """Precision, recall, F1, support per class, accuracy, macro and weighted avg.

    One aggregate over all rows gives the 2 x 2 confusion counts; the rest is
    arithmetic on that single row.  Division by zero gives 0.
    """
    y, p = F.col(label), F.col(pred)
    c = df.agg(F.count_if((y == 0) & (p == 0)).alias("n00"),
               F.count_if((y == 0) & (p == 1)).alias("n01"),
               F.count_if((y == 1) & (p == 0)).alias("n10"),
               F.count_if((y == 1) & (p == 1)).alias("n11"))

    def div(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    def f1(pr, rc):
        return F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0))

    n00, n01, n10, n11 = (F.col(k) for k in ("n00", "n01", "n10", "n11"))
    m = c.select(
        div(n00, n00 + n10).alias("p0"), div(n00, n00 + n01).alias("r0"),
        div(n11, n11 + n01).alias("p1"), div(n11, n11 + n10).alias("r1"),
        (n00 + n01).alias("s0"), (n10 + n11).alias("s1"),
        div(n00 + n11, n00 + n01 + n10 + n11).alias("acc"))
    m = m.select("*", f1(F.col("p0"), F.col("r0")).alias("f0"),
                 f1(F.col("p1"), F.col("r1")).alias("f1"), (F.col("s0") + F.col("s1")).alias("s"))

    def wavg(a, b):
        return (F.col(a) * F.col("s0") + F.col(b) * F.col("s1")) / F.col("s")

    r = lambda e: F.bround(e, digits)
    rows = [
        (F.lit(names[0]), r(F.col("p0")), r(F.col("r0")), r(F.col("f0")), F.col("s0")),
        (F.lit(names[1]), r(F.col("p1")), r(F.col("r1")), r(F.col("f1")), F.col("s1")),
        (F.lit("accuracy"), F.lit(None).cast("double"), F.lit(None).cast("double"),
         r(F.col("acc")), F.col("s")),
        (F.lit("macro avg"), r((F.col("p0") + F.col("p1")) / 2),
         r((F.col("r0") + F.col("r1")) / 2), r((F.col("f0") + F.col("f1")) / 2), F.col("s")),
        (F.lit("weighted avg"), r(wavg("p0", "p1")), r(wavg("r0", "r1")), r(wavg("f0", "f1")),
         F.col("s")),
    ]
    arr = F.array(*[F.struct(a.alias("class"), b.alias("precision"), cc.alias("recall"),
                             d.alias("f1"), e.cast("long").alias("support"))
                    for a, b, cc, d, e in rows])
    return m.select(F.inline(arr))


def train_validation_test(df: DataFrame, id_col: str, label: str, test: float = 0.2,
                          validation: float = 0.2, seed: int = 42,
                          early_stop_on: str = "validation") -> DataFrame:
    """Add ``is_test`` and ``is_val`` flags for model fitting.

    ``early_stop_on='validation'`` (default): exact stratified test share,
    then an exact stratified validation share of the remaining rows; early
    stopping watches validation, evaluation uses test.
    ``early_stop_on='test'``: the source's parity, where the held-out test
    rows also drive early stopping (``is_val = is_test``), which makes the
    reported test metrics optimistic.
    """
    frame = stratified_split(df, id_col, label, test, seed, out="is_test")
    if early_stop_on == "test":
        return frame.withColumn("is_val", F.col("is_test"))
    if early_stop_on != "validation":
        raise ValueError(f"unknown early_stop_on {early_stop_on!r}")
    train = frame.filter(~F.col("is_test"))
    val = stratified_split(train, id_col, label, validation, seed + 1, out="is_val")
    return val.unionByName(frame.filter(F.col("is_test")).withColumn("is_val", F.lit(False)))
