"""Toxicity by FTRL-proximal logistic regression.

A document's features are the distinct hashes of its words, word pairs and
pairs with one or two words between (skip-grams) in ``2 ** BITS`` places.
FTRL-proximal learns one weight per place with its own learning rate, and its
L1 term keeps most of them exactly zero, so the model that goes out to all
tasks is a short list, at most ``2 ** BITS`` long whatever the data.

The fit uses a bounded sample of labelled rows (``train_rows``, chosen by a
hash of the id alone); scoring covers every whole text.  Neither labels nor
ids, languages or sources enter a score.

Cases: a null text counts as empty and gets the score of the bias alone.  Rows
with null labels are not learnt from; a document labelled twice is learnt from
twice.  Without any labelled row every score is 0.  A null id belongs to no
label and counts as not held out.  Repeated rows are all returned, an empty
table gives no rows, extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import documents, prepare, written
from strata.sources.tables import read_table

BITS = 20

_WORDS = re.compile(r"\w+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


@dataclass(frozen=True)
class Settings:
    """Learning rate, its offset, L1 and L2 strength, passes over the sample.

    Chosen by the log loss on an inner fold (remainder 1) of the rows that may
    be learnt from, never by rows that are held out.
    """

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    passes: int = 3
    train_rows: int = 16_000


def features(text: str | None) -> np.ndarray:
    """Places of words, neighbours and skip-grams, with repeats."""
    import xxhash
    words = _WORDS.findall((text or "").lower())
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    parts = [w * _ODD[0]]
    for gap in (1, 2, 3):
        if len(w) > gap:
            a = (w[:-gap] ^ (w[:-gap] >> np.uint64(29))) * _ODD[gap]
            parts.append((a ^ w[gap:]) * _ODD[0])
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """State of the learner: z and n per place, and the same for the bias."""

    def __init__(self, s: Settings):
        self.s = s
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, s = self.z[at], self.s
        l1 = np.where(at == 1 << BITS, 0.0, s.l1)       # the bias is not shrunk to zero
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2))

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, 1 << BITS)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> dict[int, float] | None:
    """Weights that aren't zero by place; ``2 ** BITS`` is the bias.

    The sample has about ``train_rows`` rows, however many are labelled, so
    the one task that learns in sequence gets a bounded table of features.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = known.count()
    if not rows:
        return None
    scale = 1 << 40
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(scale)) < int(scale * min(1.0, settings.train_rows / rows))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"],
                                "places": [np.unique(features(t)).astype(np.int32) for t in b["text"]]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame({"doc_id": [], "toxic": [], "places": []})])
        if rows.empty:
            return
        # the same order wherever the rows came from
        rows = rows.sort_values("doc_id", kind="stable").sample(frac=1, random_state=7)
        model = Ftrl(settings)
        for _ in range(settings.passes):
            for label, at in zip(rows["toxic"], rows["places"]):
                model.learn(np.asarray(at, dtype=np.int64), int(label))
        at = np.arange((1 << BITS) + 1)
        w = model.weights(at)
        at = at[(w != 0) | (at == 1 << BITS)]
        yield pd.DataFrame({"place": at, "weight": w[at]})

    # written first, so that the one task which learns in sequence neither joins nor hashes
    sample = written(docs.filter(drawn).join(known.filter(drawn), "doc_id").mapInPandas(
        places, "doc_id long, toxic int, places array<int>"), "toxicity-features")
    weights = sample.coalesce(1).mapInPandas(learn, "place long, weight double").collect()
    return {r.place: r.weight for r in weights} or None


def toxicity_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    weights = fit(docs, labels, settings)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << BITS, dtype=np.float32)
        bias = None
        if sent.value:
            w = dict(sent.value)
            bias = w.pop(1 << BITS, 0.0)
            table[list(w)] = list(w.values())
        for b in batches:
            out = []
            for text in b["text"]:
                if bias is None:
                    out.append(0.0)
                    continue
                at = features(text)
                at = np.unique(at[table[at] != 0])
                out.append(1 / (1 + np.exp(-np.clip(bias + float(table[at].sum()), -35, 35))))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": np.array(out, dtype=float)})

    return docs.mapInPandas(score, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that aren't held out."""
    return toxicity_scores(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
