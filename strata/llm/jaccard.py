"""N-gram Jaccard join with set-relation skipping.

A document's set holds its distinct n-word shingles (64-bit hashes).  Two
documents link when ``100 * |s ∩ t| >= percent * |s ∪ t|``; a group is what
links connect.

* Equal sets are one class; only its representative (smallest id) goes on.
* Index lists.  Shingles are ordered from rare to frequent by a counting
  sketch over all documents (the order only steers cost, any order is right).
  A set enters the lists of its prefix, the ``n - ceil(percent n / 100) + 1``
  first shingles, with its size and position: linked sets share a list.
* Skipping by position.  Lists are cut in blocks by size class and by near or
  far position; a set enters the block of its own class, and as a guest those
  of larger sets that it may link to.  The first shared shingle of linked sets lies at positions
  i and j with ``i + j <= D``, where D bounds the sets' difference; so two far
  entries are never compared, nor blocks whose sizes can't link.
* Answers of a similar set.  The first set of each list is its leader.  All
  others are compared with leaders first; a set that links to one takes over
  the leader's answer (its group), and two sets of one group are not compared
  again, however large the group is.  Of sets that met the same leader, the
  difference of their distances to it bounds their own distance from below.
  A parity sketch of each set (256 bits, one flip per shingle) bounds the
  distance of all others.  Only pairs that pass go to the exact check.
* Numbers of links.  Links join sets of one group only.  A set's answers come
  from those of the group's first set, to which each set's difference is kept:
  two sets whose differences together are no larger than D link, and two whose
  differences' sizes lie further apart than D don't.  Only the pairs in between
  need the difference of the two differences, which gives their exact verdict
  from short lists.  Sets are classed by the size of their difference, in steps
  of the group's largest D, so that only neighbouring classes meet (a chain's
  far ends never do); large classes are dealt in buckets, pair by pair of
  buckets, and only sums per set leave a task.

Cases: a null text counts as empty; an empty text has an empty set, links with
nothing and is its own group.  Fewer words than n give one shingle.  Repeated
rows are copies; rows that repeat one id are one document.  Rows with a null
id come out with null group unless they equal another document.  Texts are
read whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import byte_words, documents, prepare, written
from strata.llm.components import connected_components

SKETCH_BITS = (16, 25)    # the order's sketch has 2 ** 16 to 2 ** 25 counters, sent out as one byte each
BYTES_PER_COUNTER = 96    # bytes of text for one counter
CHUNK = 1 << 16           # counters in one row while they are added up
FAN_IN = 256          # rows added in one group on each of the two levels
SIZE_RATIO = 1.4      # largest to smallest size of a block
PARITY = 4            # 64-bit words of the parity sketch
BUCKET = 2048         # sets in a bucket of a large group
BUCKET_TOKENS = 1 << 20   # shingles of the differences in a bucket
DEALS = 32            # keys over which the pairs of one leader are dealt
SALTED = 256          # sets of a group that meet its first set under one key
BLOOM_WORDS = 1 << 16     # 64-bit words of the filter for texts to read again

# Odd multipliers that mix the words of a shingle, by position.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles."""
    import xxhash
    words = byte_words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(n, len(words))
    size = len(words) - k + 1
    h = np.full(size, k, dtype=np.uint64)
    for i in range(k):
        h = (h ^ w[i:i + size]) * _MIX[i % len(_MIX)]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _difference(n: Column, m: Column, percent: int) -> Column:
    """Largest symmetric difference of linked sets of these sizes."""
    return F.floor((100 - percent) * (n + m) / F.lit(100 + percent))


def frequency_levels(docs: DataFrame, n: int) -> tuple[int, bytes]:
    """Bits of the sketch and the level of each of its ``2 ** bits`` counters.

    The sketch grows with the text, so that rare shingles tell apart at any
    size below its bound.  Every task counts its shingles by their leading
    bits (up to 255 each); the partial counts are added in two levels of
    bounded groups.  Only the counters, at most 32 MB, come to the driver.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((total // BYTES_PER_COUNTER).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    size = 1 << bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        total = np.zeros(size, dtype=np.uint16)
        for b in batches:
            for text in b["text"]:
                s = shingles(text, n)
                if len(s):      # they are sorted, so equal leading bits are neighbours
                    at = (s >> np.uint64(64 - bits)).astype(np.int64)
                    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    c = np.diff(np.r_[first, len(at)])
                    at = at[first]
                    total[at] = np.minimum(total[at].astype(np.int64) + c, 255)
        part = TaskContext.get().partitionId()
        for k in range(0, size, CHUNK):
            if total[k:k + CHUNK].any():
                yield pd.DataFrame({"chunk": [k // CHUNK], "part": [part], "counts": [zlib.compress(total[k:k + CHUNK].astype(np.uint8).tobytes(), 1)]})

    def add(kind: type) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(min(size, CHUNK), dtype=np.uint32)
            for c in rows["counts"]:
                total += np.frombuffer(zlib.decompress(c), dtype=kind)
            return pd.DataFrame({"chunk": rows["chunk"][:1], "part": rows["part"][:1] // FAN_IN, "counts": [zlib.compress(total.tobytes(), 1)]})
        return run

    schema = "chunk int, part int, counts binary"
    counts = docs.select("text").mapInPandas(count, schema)
    counts = counts.groupBy("chunk", F.floor(F.col("part") / FAN_IN).alias("g")).applyInPandas(add(np.uint8), schema)
    counts = counts.groupBy("chunk").applyInPandas(add(np.uint32), schema)
    levels = np.zeros(size, dtype=np.uint8)
    for r in counts.select("chunk", "counts").collect():     # size / CHUNK rows, compressed
        out = np.frombuffer(zlib.decompress(r.counts), dtype=np.uint32)
        high = np.minimum(128 + 8 * np.log2(np.maximum(out, 128) / 128), 255)
        levels[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.where(out < 128, out, high)
    return bits, zlib.compress(levels.tobytes(), 1)


def set_features(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc_id, n, set_key, prefix, parity`` of each document, a written table."""
    spark = docs.sparkSession
    bits, counters = frequency_levels(docs, n)
    levels = spark.sparkContext.broadcast(counters)
    del counters

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level = np.frombuffer(zlib.decompress(levels.value), dtype=np.uint8)
        for b in batches:
            rows = []
            for text in b["text"]:
                s = shingles(text, n)
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                # the hash's lowest bits place a shingle in the parity sketch
                flips = np.bincount((s & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
                order = np.lexsort((s, level[(s >> np.uint64(64 - bits)).astype(np.int64)]))
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                             s[order[:prefix_size(len(s), percent)]].view(np.int64),
                             np.packbits(flips.astype(np.uint8)).view(np.int64)))
            yield pd.concat([b[["doc_id"]].reset_index(drop=True),
                             pd.DataFrame(rows, columns=["n", "set_key", "prefix", "parity"])], axis=1)

    out = written(docs.mapInPandas(run, "doc_id long, n long, set_key binary, prefix array<long>, parity array<long>"), "features")
    levels.destroy()        # the table is written and read from files from here on
    return out


def _bloom(ids: DataFrame) -> Column:
    """The ids as a fixed-size Bloom filter, a scalar subquery of BLOOM_WORDS longs."""
    bits = ids.select(F.explode(_bloom_bits(F.col("doc_id"))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    dense = ids.sparkSession.range(BLOOM_WORDS).join(words, F.col("id") == F.col("w"), "left")
    return dense.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0)).alias("mask"))))
                     .getField("mask").alias("m")).scalar()


def _bloom_bits(doc_id: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(doc_id, F.lit(k)), F.lit(64 * BLOOM_WORDS)) for k in (1, 2)])


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``doc_id, set_key, tokens`` of the named documents, read from their texts again.

    Few documents are named, so the Bloom filter keeps most texts out of the
    shuffle; its size is fixed and the join behind it is exact.
    """
    bloom = _bloom(ids)
    near = docs
    for k in range(2):
        bit = _bloom_bits(F.col("doc_id"))[k]
        near = near.filter(F.get(bloom, F.shiftright(bit, 6).cast("int")).bitwiseAND(
            F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))) != 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, n) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                                "tokens": [s.view(np.int64) for s in sets]})

    return near.join(ids, "doc_id", "left_semi").mapInPandas(run, "doc_id long, set_key binary, tokens array<long>")


def _with_leader(pairs: DataFrame, leaders: DataFrame) -> DataFrame:
    """Pairs (a, b) joined to the rows of ``leaders`` on ``a``.

    A leader may have very many pairs: they are dealt by b's hash, and the
    leader's row is copied to the deals that occur, at most one for each pair.
    """
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("b"), F.lit(DEALS)))
    copies = dealt.select("a", "deal").distinct().join(leaders, "a")
    return dealt.join(copies, ["a", "deal"]).drop("deal")


def checked(pairs: DataFrame, docs: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """``a, b, apart, linked`` of the pairs: exact difference and verdict."""
    pairs = written(pairs, f"{name}-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = written(sets_of(docs, ids, n).drop("set_key"), f"{name}-sets")
    both = _with_leader(pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb")), "b"),
                        sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta")))
    both = (both.select("a", "b", (F.size("ta") + F.size("tb")).alias("sizes"),
                    F.size(F.array_intersect("ta", "tb")).alias("common")))
    return written(both.select("a", "b", (F.col("sizes") - 2 * F.col("common")).alias("apart"),
                               (100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).alias("linked")),
                   f"{name}-checked")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(SIZE_RATIO) + 1e-9).cast("int")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Size and position bounds of two entries of one list."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return ((100 * F.least(n, m) >= percent * F.greatest(n, m))
            & (F.col(f"{x}.pos") + F.col(f"{y}.pos") <= _difference(n, m, percent)))


def similarity_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id, n_copies`` per document.

    ``component_id`` is the smallest id that links reach, ``class_id`` the
    smallest id with an equal set, ``n_copies`` the documents of that class.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _groups(docs, n, percent).drop("set_key")


def _groups(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The columns of ``similarity_groups`` and ``set_key``."""
    features = set_features(docs, n, percent)
    classes = written(features.filter("n > 0").groupBy("set_key")
                      .agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies")), "classes")
    first = features.filter("n > 0").join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi")

    # blocks of index lists with at least two sets: one key per shingle and size class
    own = _size_class(F.col("n"))
    blocks = F.sequence(own, _size_class(F.floor(100 * F.col("n") / F.lit(percent))))
    entries = first.select("doc_id", "n", "prefix", F.explode(blocks).alias("block")).select(
        "doc_id", "n", (F.col("block") == own).alias("own"), "block", F.posexplode("prefix").alias("pos", "token")).select(
        F.xxhash64("token", "block").alias("token"), "doc_id", "n", "pos", "own")
    shared = entries.groupBy("token").count().filter("count > 1").select("token")
    far = 2 * F.col("pos") > _difference(F.col("n"), F.col("n"), percent)
    lists = written(entries.join(shared, "token", "left_semi").withColumn("far", far), "lists")

    # leaders first
    leaders = lists.groupBy("token").agg(F.min(F.struct("doc_id", "n", "pos", "own")).alias("l")).select("token", "l.*")
    led = lists.alias("x").join(leaders.alias("l"), "token").filter(
        (F.col("x.doc_id") > F.col("l.doc_id")) & (F.col("x.own") | F.col("l.own")) & _may_link("x", "l", percent))
    pairs = led.select(F.col("l.doc_id").alias("a"), F.col("x.doc_id").alias("b")).distinct()
    parity = first.select("doc_id", "n", "parity").distinct()
    pairs = _parity_join(pairs, parity, percent)
    by_leader = checked(pairs, docs, n, percent, "leaders")
    links = by_leader.filter("linked").select("a", "b")
    groups = written(connected_components(links), "leader-groups")
    # the nearest leader that a set was measured against
    met = by_leader.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("m")).select(
        F.col("b").alias("doc_id"), F.col("m.a").alias("leader"), F.col("m.apart").alias("apart"))

    # what remains: pairs of different groups within a block
    known = (parity.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(met, "doc_id", "left")
             .select("doc_id", "parity", F.coalesce("component", "doc_id").alias("group"), "leader", "apart"))
    rest = lists.join(known, "doc_id")
    open_lists = rest.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("token")
    rest = written(rest.join(open_lists, "token", "left_semi"), "open-lists")
    c = F.col
    bound = (F.coalesce(c("x.leader") != c("y.leader"), F.lit(True))
             | (F.abs(c("x.apart") - c("y.apart")) <= _difference(c("x.n"), c("y.n"), percent)))
    met_in_list = rest.filter("not far").alias("x").join(rest.alias("y"), (c("x.token") == c("y.token"))
                                        & (c("x.group") != c("y.group")) & (c("x.own") | c("y.own"))
                                        & (c("y.far") | (c("x.doc_id") < c("y.doc_id")))
                                        & _may_link("x", "y", percent) & bound
                                        & _parity_near("x", "y", percent))
    more = met_in_list.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    more = more.join(by_leader.select("a", "b"), ["a", "b"], "left_anti")
    between = checked(more, docs, n, percent, "rest").filter("linked").select("a", "b")
    groups = _merged(groups, between)
    labels = classes.join(groups.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "set_key", "class_id", "n_copies", F.coalesce("component", "class_id").alias("component_id"))
    return features.select("doc_id", "n", "set_key").join(labels, "set_key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"), "set_key")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` when links between groups are added: components of the groups, not of their nodes."""
    a, b = (groups.select(F.col("node").alias(k), F.col("component").alias(f"g{k}")) for k in "ab")
    ends = written(links.join(a, "a", "left").join(b, "b", "left").select(
        "a", "b", F.coalesce("ga", "a").alias("ga"), F.coalesce("gb", "b").alias("gb")), "group-links")
    if not ends.head(1):
        return groups
    higher = connected_components(ends.select(F.col("ga").alias("a"), F.col("gb").alias("b"))).select(
        F.col("node").alias("component"), F.col("component").alias("merged"))
    # ends that were in no group come with their own id
    alone = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ga").alias("component")),
                                          F.struct(F.col("b").alias("node"), F.col("gb").alias("component")))).alias("e")).select("e.*")
    nodes = groups.union(alone.filter("node = component").distinct().join(groups, "node", "left_anti"))
    return nodes.join(higher, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))


def similarity_links(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The columns of ``similarity_groups`` and ``n_links``: the other documents that link to each."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    groups = written(_groups(docs, n, percent), "groups")
    classes = groups.filter("n_shingles > 0").groupBy("set_key").agg(
        *[F.min(c).alias(c) for c in ("class_id", "n_copies", "component_id", "n_shingles")])
    members = _differences(classes, docs, n, percent)
    counts = link_counts(members, percent)
    own = F.when(F.col("n_shingles") > 0, F.col("n_copies") - 1).otherwise(F.lit(0))
    return groups.join(counts, "set_key", "left").select(
        "doc_id", "n_shingles", "component_id", "class_id", "n_copies",
        (own + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))


def _differences(classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``component_id, step, bucket, buckets, above, under, set_key, n, n_copies, apart`` of the sets in groups of several.

    ``apart`` lists the shingles in which a set differs from the group's first.
    ``step`` classes it by their number; ``buckets``, ``above`` and ``under``
    are the buckets of this class and of the next and the last one.
    """
    several = classes.groupBy("component_id").agg(F.count("*").alias("sets"), F.min(F.struct("class_id", "set_key")).alias("f")).filter("sets > 1").select(
        "component_id", "sets", F.col("f.set_key").alias("first_key"))
    several = written(several, "several")
    named = written(classes.join(several, "component_id"), "members")

    sets = sets_of(docs, named.select(F.col("class_id").alias("doc_id")).distinct(), n).withColumnRenamed("doc_id", "class_id")
    # a repeated row of one id gives its set once
    sets = written(sets.join(named, ["set_key", "class_id"]).dropDuplicates(["set_key"]), "member-sets")
    salts = F.ceil(F.col("sets") / F.lit(SALTED)).cast("int")
    firsts = sets.filter("set_key = first_key").select(
        "component_id", F.col("tokens").alias("first"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    met = sets.withColumn("salt", F.pmod(F.xxhash64("set_key"), salts).cast("int")).join(firsts, ["component_id", "salt"])
    apart = F.concat(F.array_except("tokens", "first"), F.array_except("first", "tokens"))
    met = written(met.select("component_id", "set_key", F.col("n_shingles").alias("n"), "n_copies", apart.alias("apart")), "differences")
    widest = met.groupBy("component_id").agg(F.greatest(_difference(F.max("n"), F.max("n"), percent), F.lit(1)).alias("width"))
    met = met.join(widest, "component_id").withColumn("step", F.floor(F.size("apart") / F.col("width")).cast("int")).drop("width")
    size = met.groupBy("component_id", "step").agg(F.greatest(
        F.ceil(F.count("*") / F.lit(BUCKET)), F.ceil(F.sum(F.size("apart")) / F.lit(BUCKET_TOKENS)), F.lit(1)).cast("int").alias("buckets"))
    size = written(size, "link-steps")
    for name, by in (("above", -1), ("under", 1)):
        other = size.groupBy("component_id", (F.col("step") + by).alias("step")).agg(F.first("buckets").alias(name))
        met = met.join(other, ["component_id", "step"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return met.join(size, ["component_id", "step"]).withColumn(
        "bucket", F.pmod(F.xxhash64("set_key", F.lit(7)), F.col("buckets")).cast("int"))


def _common(x: pd.Series, y: pd.Series) -> np.ndarray:
    """Number of shared entries of each two lists."""
    out = np.zeros((len(x), len(y)), dtype=np.int32)
    flat = [(np.concatenate([np.asarray(t, dtype=np.int64) for t in s]), np.repeat(np.arange(len(s)), [len(t) for t in s])) for s in (x, y)]
    both = np.intersect1d(flat[0][0], flat[1][0])
    sides = []
    for tokens, row in flat:
        keep = np.isin(tokens, both)
        order = np.argsort(tokens[keep], kind="stable")
        tokens, row = tokens[keep][order], row[keep][order]
        sides.append(np.split(row, np.flatnonzero(tokens[1:] != tokens[:-1]) + 1))
    for a, b in zip(*sides) if len(both) else ():
        out[np.ix_(a, b)] += 1
    return out


def verdicts(x: pd.DataFrame, y: pd.DataFrame, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Linked copies of each row of x and of y, and how many pairs had to be compared.

    Rows have ``n``, ``n_copies`` and ``apart``; ``same`` says that x is y.
    """
    n, m = (s["n"].to_numpy(dtype=np.int64) for s in (x, y))
    d, e = (s["apart"].map(len).to_numpy(dtype=np.int64) for s in (x, y))
    copies = [s["n_copies"].to_numpy(dtype=np.int64) for s in (x, y)]
    links = [np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)]
    compared = 0
    for k in range(0, len(x), 128):      # the verdicts of 128 rows at a time
        part = slice(k, k + 128)
        most = (100 - percent) * (n[part, None] + m[None, :]) // (100 + percent)
        linked = d[part, None] + e[None, :] <= most
        between = ~linked & (np.abs(d[part, None] - e[None, :]) <= most)
        rows, cols = np.flatnonzero(between.any(axis=1)), np.flatnonzero(between.any(axis=0))
        if len(rows):
            at = np.ix_(rows, cols)
            common = _common(x["apart"].iloc[k + rows], y["apart"].iloc[cols])
            far = (d[k + rows, None] + e[None, cols]) - 2 * common
            linked[at] |= between[at] & (far <= most[at])
            compared += int(between.sum())
        if same:
            linked[np.arange(len(linked)), k + np.arange(len(linked))] = False
        links[0][part] = linked @ copies[1]
        links[1] += linked.T @ copies[0][part]
    return links[0], links[1], compared


def link_counts(members: DataFrame, percent: int) -> DataFrame:
    """``set_key, links``: the documents of the other sets that link to each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = (tuple(rows[[f"{s}_step", f"{s}_bucket"]].iloc[0]) for s in ("lo", "hi"))
        x, y = (rows[(rows["step"] == s) & (rows["bucket"] == b)].reset_index(drop=True) for s, b in (lo, hi))
        if not len(x) or not len(y):
            return pd.DataFrame({"set_key": [], "links": []})
        of_x, of_y, _ = verdicts(x, y, percent, lo == hi)
        out = [pd.DataFrame({"set_key": s["set_key"], "links": v}) for s, v in ((x, of_x), (y, of_y))]
        return out[0] if lo == hi else pd.concat(out)

    def pair(lo_step, lo_bucket, hi_step, hi_bucket):
        return F.struct(*[c.cast("int").alias(a) for c, a in ((lo_step, "lo_step"), (lo_bucket, "lo_bucket"), (hi_step, "hi_step"), (hi_bucket, "hi_bucket"))])

    step, bucket = F.col("step"), F.col("bucket")
    none = F.array().cast("array<struct<lo_step:int,lo_bucket:int,hi_step:int,hi_bucket:int>>")

    def met(count, make):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)).otherwise(none)
    others = F.concat(met("buckets", lambda k: pair(step, F.least(k, bucket), step, F.greatest(k, bucket))),
                      met("above", lambda k: pair(step, bucket, step + 1, k)), met("under", lambda k: pair(step - 1, k, step, bucket)))
    dealt = members.withColumn("p", F.explode(others)).select("component_id", "p.*", "step", "bucket", "set_key", "n", "n_copies", "apart")
    sums = dealt.groupBy("component_id", "lo_step", "lo_bucket", "hi_step", "hi_bucket").applyInPandas(run, "set_key binary, links long")
    return sums.groupBy("set_key").agg(F.sum("links").alias("links"))


def _parity_near(x: str, y: str, percent: int) -> Column:
    """The parity sketches differ in no more bits than linked sets can."""
    flips = sum((F.bit_count(F.get(f"{x}.parity", F.lit(k)).bitwiseXOR(F.get(f"{y}.parity", F.lit(k)))) for k in range(PARITY)), F.lit(0))
    return flips <= _difference(F.col(f"{x}.n"), F.col(f"{y}.n"), percent)


def _parity_join(pairs: DataFrame, parity: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches allow a link."""
    a, b = (parity.select(F.col("doc_id").alias(k), F.struct("n", "parity").alias(to)) for k, to in (("a", "x"), ("b", "y")))
    return _with_leader(pairs.join(b, "b"), a).filter(_parity_near("x", "y", percent)).select("a", "b")


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that link to a group with a smaller id."""
    drop = similarity_groups(docs, n, percent, id_col, text_col).filter("component_id < doc_id").select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col)).distinct()
    return docs.join(drop, id_col, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose three-word shingles agree to 90 of 100, and each one's number of links."""
    return similarity_links(documents(spark, sf_dir), n=3, percent=90)


def links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same; kept under its earlier name."""
    return query(spark, sf_dir)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * common >= 90 * (na.n + nb.n - common)),
linked AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id),
texts AS (SELECT doc_id, string_agg(sh, chr(10) ORDER BY sh) AS t FROM s GROUP BY doc_id),
same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS class_id, count(*) OVER (PARTITION BY t) AS n_copies FROM texts)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.component_id,
       coalesce(same.class_id, d.doc_id) AS class_id, coalesce(same.n_copies, 1) AS n_copies,
       coalesce(linked.n_links, 0) AS n_links
FROM documents d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN same USING (doc_id) LEFT JOIN linked USING (doc_id)
"""
