"""Benchmark decontamination with spaced seeds.

A seed mask reads some of the words of a window and ignores the others, so a
window still hits when words at ignored places were substituted.  The hashes
of all masks over the benchmark are joined with those over the documents; each
hit names a diagonal (document position minus item position), along which the
words around the hit are compared one by one.  An overlap counts when a stretch
has a share of equal words of at least ``min_share`` and at least ``min_words``
equal words, or ``min_share`` of the item's words if those are fewer.

No such overlap is without a hit.  With 12 words and 0.8, every one that can't
be cut to a smaller one has at most 5 unequal words: 12 equal and up to 3
unequal words, or 16 and 4 or 20 and 5 with 5 equal words at either end.
``MASKS`` hit each of these orders.  Looser settings read the longest run of
equal words that they leave.  An item from which fewer than ``min_words`` are
asked is cut in blocks, two more than the words that may differ; each pair of
blocks is a mask, and one pair is free of them.

Only document windows that pass a fixed-size filter of the benchmark's hashes
leave the scan, with the words around them; the join behind it is exact.
Words are runs of letters, digits and ``_``, lower-cased.

Cases: null and empty texts have no words and match nothing.  Texts and
items of any length are read whole: as many words as the longest item has are
kept on either side of a hit, so that its whole diagonal is compared.  Repeated items and rows
give their own hits, which are merged per document and item.  Rows with a null
id give no overlap and stay in ``clean_documents``.  Empty tables give no rows.  Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import documents, prepare, written
from strata.sources.tables import read_table

# The seed masks, 1 = word is read, 0 = word is ignored (weight 7, span up to 13).
MASKS = ("11011111", "11110010101", "11010100111", "1110010010011", "1100011111", "1001110111")
MASK_WORDS, MASK_SHARE = 12, 0.8      # what the masks are whole for
FILTER_BITS = 24       # the filter has 2 ** FILTER_BITS bits (2 MB), three per hash
SLICES = (0, 64 - FILTER_BITS, 20)      # first bit of each slice of a hash that the filter knows

_WORDS = re.compile(r"\w+")
_ODD = np.random.default_rng(20240611).integers(1, 1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    import xxhash
    words = _WORDS.findall((text or "").lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def seeds(w: np.ndarray, shape: str) -> np.ndarray:
    """One hash per window of the mask's length, over the words it reads."""
    size = len(w) - len(shape) + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(size, _ODD[int(shape, 2) % 61], dtype=np.uint64)
    for i, c in enumerate(shape):
        if c == "1":
            h = (h ^ w[i:i + size]) * _ODD[i]
            h ^= h >> np.uint64(31)
    return h


def needed(item_words: int, min_words: int, min_share: float) -> int:
    """Equal words that an overlap with an item of so many words has at least."""
    return min(min_words, math.ceil(min_share * item_words - 1e-9))


def _sure_run(min_words: int, min_share: float) -> int:
    """Equal words in a row that every stretch of the rule has."""
    if min_share <= 0:
        return 1
    return min(-(-n // (int(n * (1 - min_share) / min_share + 1e-9) + 1)) for n in range(min_words, min_words + 1000))


def shapes_of(item_words: int, min_words: int, min_share: float) -> list[tuple[str, int | None]]:
    """Masks for items of so many words, with the item's word each begins at (None: at any)."""
    n = needed(item_words, min_words, min_share)
    if n >= min_words:
        if min_words >= MASK_WORDS and min_share >= MASK_SHARE:
            return [(m, None) for m in MASKS]
        return [("1" * _sure_run(min_words, min_share), None)]
    n = max(n, 1)
    differ = item_words - n
    blocks = np.array_split(np.arange(item_words), min(differ + 2, item_words))
    out = []
    for read in combinations(blocks, len(blocks) - differ):
        at = np.concatenate(read)
        out.append(("".join("1" if k in at else "0" for k in range(at[0], at[-1] + 1)), int(at[0])))
    return out


def _item_seeds(items: DataFrame, min_words: int, min_share: float) -> DataFrame:
    """``hash, item_id, pos`` of every window of every item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, words in zip(b["item_id"], b["words"]):
                w = np.asarray(words, dtype=np.int64).view(np.uint64)
                if not len(w):
                    continue
                for shape, at in shapes_of(len(w), min_words, min_share):
                    h = seeds(w, shape)
                    pos = np.arange(len(h), dtype=np.int32)
                    if at is not None:
                        h, pos = h[at:at + 1], pos[at:at + 1]
                    yield pd.DataFrame({"hash": h.view(np.int64), "item_id": item, "pos": pos})

    return items.mapInPandas(run, "hash long, item_id long, pos int")


def _filter(item_seeds: DataFrame) -> bytes:
    """Bits of all benchmark hashes; comes to the driver as at most 2 ** (FILTER_BITS - 6) words."""
    slices = [F.shiftrightunsigned("hash", k).bitwiseAND((1 << FILTER_BITS) - 1) for k in SLICES]
    words = item_seeds.select(F.explode(F.array(*slices)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).collect()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for r in words:
        out[r.w] = r.mask
    return out.tobytes()


def _regions(docs: DataFrame, bits: bytes, shapes: list[str], context: int) -> DataFrame:
    """Stretches of documents with windows that pass the filter, and ``context`` words around them.

    Stretches don't overlap: no word of a document is sent twice.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    reach = max(map(len, shapes), default=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.unpackbits(np.frombuffer(sent.value, dtype=np.uint8), bitorder="little")
        low = np.uint64((1 << FILTER_BITS) - 1)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                w = word_hashes(text)
                found = []
                for shape in shapes:
                    h = seeds(w, shape)
                    at = np.flatnonzero(table[(h & low).astype(np.int64)])
                    for k in SLICES[1:]:
                        at = at[table[((h[at] >> np.uint64(k)) & low).astype(np.int64)] == 1]
                    if len(at):
                        found.append((at, h[at]))
                if not found:
                    continue
                pos, hashes = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(pos, kind="stable")
                pos, hashes = pos[order], hashes[order]
                for part in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(pos) > reach + 2 * context) + 1):
                    start = max(0, pos[part[0]] - context)
                    rows.append((doc, start, w[start:pos[part[-1]] + reach + context].view(np.int64),
                                 hashes[part].view(np.int64), pos[part].astype(np.int32)))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "words", "hashes", "pos"])

    return docs.mapInPandas(run, "doc_id long, start int, words array<long>, hashes array<long>, pos array<int>")


def best_stretch(equal: np.ndarray, min_share: float) -> tuple[int, int, int]:
    """Begin, end and equal words of the stretch that gains most.

    An equal word gains 1 and another one loses so much that no stretch pays
    whose share of equal words is below ``min_share``.
    """
    gain = np.where(equal, 1.0, -min_share / max(1e-9, 1 - min_share))
    total = np.r_[0.0, np.cumsum(gain)]
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    begin = int(np.argmin(total[:end + 1]))
    return begin, end, int(equal[begin:end].sum())


def longest_stretch(equal: np.ndarray, min_share: float) -> tuple[int, int, int]:
    """Begin, end and equal words of the stretch with most equal words whose share is at least ``min_share``."""
    total = np.r_[0.0, np.cumsum(np.where(equal, 1 - min_share, -min_share))]
    count = np.r_[0, np.cumsum(equal)]
    low = np.minimum.accumulate(total)
    first = np.searchsorted(-low, -(total + 1e-9))       # of each end, the first begin that holds the share
    end = int(np.argmax(count - count[first]))
    at = np.flatnonzero(equal[first[end]:end])
    if not len(at):
        return 0, 0, 0
    return int(first[end] + at[0]), int(first[end] + at[-1] + 1), len(at)


def overlaps(docs: DataFrame, items: DataFrame, min_words: int = 12, min_share: float = 0.8, id_col: str = "doc_id",
             text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_equal, n_words, item_words, doc_start`` of each overlap.

    One row per document and item: its longest stretch along one diagonal.
    """
    prepare(docs.sparkSession)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "words": [word_hashes(t).view(np.int64) for t in b["text"]]})

    items = written(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
                    .filter("item_id is not null").mapInPandas(words, "item_id long, words array<long>"), "items")
    item_seeds = written(_item_seeds(items, min_words, min_share), "item-seeds")
    asked = F.least(F.lit(min_words), F.ceil(F.lit(min_share) * F.size("words") - 1e-9))
    lengths = items.select(F.size("words").alias("n"), (asked >= min_words).alias("long")).filter("n > 0").select(
        F.when(F.col("long"), F.lit(-1)).otherwise(F.col("n")).alias("n")).distinct().collect()     # the lengths of short items
    longest = math.ceil(min_words / max(min_share, 1e-9)) + 1
    shapes = sorted({m for r in lengths for m, _ in shapes_of(r.n if r.n > 0 else longest, min_words, min_share)})
    context = items.agg(F.max(F.size("words")).alias("n")).first().n or 0
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    regions = written(_regions(docs, _filter(item_seeds), shapes, context), "regions")

    hits = regions.select("doc_id", "start", F.explode(F.arrays_zip("hashes", "pos")).alias("h")).select(
        "doc_id", "start", F.col("h.hashes").alias("hash"), F.col("h.pos").alias("at"))
    diagonals = hits.join(item_seeds, "hash").select(
        "doc_id", "start", "item_id", (F.col("at") - F.col("pos")).alias("diagonal")).distinct()
    # item word j stands beside region word j + shift; of a region, only the words beside the item go on
    shift = (F.col("diagonal") - F.col("start")).cast("int")
    aligned = diagonals.join(regions.select("doc_id", "start", "words"), ["doc_id", "start"]).join(
        items.withColumnRenamed("words", "item"), "item_id").select(
        "doc_id", "item_id", "diagonal", "item", F.greatest(F.lit(0), -shift).alias("lo"),
        F.slice("words", F.greatest(F.lit(0), shift) + 1, F.size("item")).alias("words"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, item, diagonal, lo, d, i in zip(b["doc_id"], b["item_id"], b["diagonal"], b["lo"], b["words"], b["item"]):
                size = min(len(i) - lo, len(d))
                equal, least = np.asarray(d[:size]) == np.asarray(i[lo:lo + size]), needed(len(i), min_words, min_share)
                begin, end, n = best_stretch(equal, min_share)
                if n < least:       # what gains most may be a part of a stretch that counts
                    begin, end, n = longest_stretch(equal, min_share)
                if n >= max(least, 1) and n >= min_share * (end - begin) - 1e-9:
                    rows.append((doc, item, n, end - begin, len(i), diagonal + lo + begin))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_equal", "n_words", "item_words", "doc_start"])

    found = aligned.mapInPandas(verify, "doc_id long, item_id long, n_equal long, n_words long, item_words long, doc_start long")
    best = F.struct("n_equal", -F.col("n_words"), -F.col("doc_start"), "n_words", "item_words", "doc_start")
    return found.groupBy("doc_id", "item_id").agg(F.max(best).alias("m")).select(
        "doc_id", "item_id", "m.n_equal", "m.n_words", "m.item_words", "m.doc_start")


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without an overlap; same columns."""
    bad = overlaps(docs, items, id_col=id_col, **options).select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col)).distinct()
    return docs.join(written(bad, "contaminated"), id_col, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of every document with every benchmark item."""
    return overlaps(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
