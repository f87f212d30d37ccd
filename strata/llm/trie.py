"""Prefix trie of conversations by van Emde Boas recursion over their turns.

A conversation of ``n`` turns has ``n + 1`` places (depths 0 to n).  All
sequences are cut at half depth, at a power of two: the upper half keeps the
root it stands on, the lower half stands on the *cut prefix*, which is named
after the upper half's root and the digest of its turns.  Both halves of all
sequences are cut again in the same step, until every place is alone and
carries the name of its prefix, which is its node.

1. *Block digests*, from below: the digest of an aligned block of ``2**k``
   turns is made from those of its halves.
2. *Names*, from above: in each step a segment and the digest of its upper
   half give the two smaller segments.  A name is a SHA-256 digest, so that no
   step has to gather what shares a prefix, however many conversations do.
3. *Totals*, from below and then from above: a node's value stands at its
   smallest member's place.  Sums of aligned blocks are made from their
   halves, and the total of a lower half is grafted on to every place of the
   upper half; a node's subtree is the sum over its members' places.

There are log2(longest conversation) steps; each is a join or a grouping on
(conversation, block), keys that at most two rows share, so neither a very
long conversation nor a prefix that a third of all conversations share lands
in one task.  Order within a conversation comes from a range-partitioned table
and the counts of its ranges.

Cases: rows without conv_id are left out; null role or text counts as empty;
a null turn comes first; equal turns are ordered by the digest of role and
text, and rows that repeat are turns of their own; texts of any length are
read whole; an empty table has no node; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import WORD_SPACE, prepare, written
from strata.sources.tables import read_table

BASE_STEP = 20          # conversations c - c % 20 lend their first turns
HEAD_TURNS = 4          # ... crc32(c) % 4 of them
ID_CHUNK = 512          # ids that one row of joined ids holds
HEAVY_SHARE = 1000      # a node with more than 1/1000 of all nodes as children is heavy: 1000 at most


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _turn_digest(role: Column, text: Column) -> Column:
    """Role and text as one digest; the role's length keeps the two apart."""
    role = role.cast("binary")
    return _digest(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role, text.cast("binary"))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, part, before, at, digest, words``: turns and their place (from 0) is ``before + at``.

    ``turns`` has conv_id, turn, digest, words.  A conversation may hold most
    of the table: its rows lie in several ranges, ``at`` counts in one range
    and ``before`` is what the earlier ranges hold of the conversation.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    ranged = written(turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order)
                     .withColumn("part", F.spark_partition_id()), "turn-ranges")
    counts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "part").orderBy(*order[1:])
    placed = ranged.select("conv_id", "part", "digest", "words", (F.row_number().over(inside) - 1).cast("long").alias("at"))
    return placed.join(before, ["conv_id", "part"])


def with_lent_heads(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: ``(conv_id, place, digest, words)`` and ``(conv_id, n_turns)``.

    Conversation c takes the first h turns of c - c % 20 (all if it has
    fewer, none if there is none) in place of its own first h.
    """
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD_TURNS)).cast("long")
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.select(
        "conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % BASE_STEP).alias("base"))
    lent = sizes.filter(F.col("conv_id") % BASE_STEP == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = written(convs.join(lent, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lent"),
        F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("kept")), "rebuilt")
    at = F.col("before") + F.col("at")
    heads = placed.filter((F.col("conv_id") % BASE_STEP == 0) & (at < HEAD_TURNS - 1)).select(
        F.col("conv_id").alias("base"), at.alias("place"), "digest", "words")
    lent_turns = convs.join(heads, "base").filter(F.col("place") < F.col("h")).select("conv_id", "place", "digest", "words")
    # what the conversation has lent is joined through its ranges: no key holds more rows than a range
    ranges = placed.select("conv_id", "part", "before").distinct().join(convs.select("conv_id", "h", "lent"), "conv_id")
    own = placed.join(ranges.drop("before"), ["conv_id", "part"]).filter(at >= F.col("h")).select(
        "conv_id", (at - F.col("h") + F.col("lent")).alias("place"), "digest", "words")
    return own.unionByName(lent_turns), convs.select("conv_id", (F.col("lent") + F.col("kept")).alias("n_turns"))


def block_digests(turns: DataFrame, levels: int) -> list[DataFrame]:
    """``conv_id, block, digest`` of the full aligned blocks of 2**k turns, for k below ``levels``."""
    out = [turns.select("conv_id", F.col("place").alias("block"), "digest")]
    left, right = (F.max(F.when(F.col("block") % 2 == i, F.col("digest"))) for i in (0, 1))
    for k in range(1, levels):
        pairs = out[-1].groupBy("conv_id", F.shiftright("block", 1).alias("up")).agg(left.alias("l"), right.alias("r"))
        out.append(written(pairs.filter(F.col("l").isNotNull() & F.col("r").isNotNull())
                           .select("conv_id", F.col("up").alias("block"), _digest(F.col("l"), F.col("r")).alias("digest")),
                           f"blocks-{k}"))
    return out


def _halves(segments: DataFrame, k: int, upper: list[Column], lower: list[Column]) -> DataFrame:
    """Every segment of level ``k`` as its two halves; the lower one where the conversation reaches it."""
    second = 2 * F.col("block") + 1
    reached = second * (1 << (k - 1)) <= F.col("n_turns")
    both = F.array(F.struct((2 * F.col("block")).alias("block"), *upper),
                   F.when(reached, F.struct(second.alias("block"), *lower)))
    return segments.select("conv_id", "n_turns", F.explode(both).alias("s")).filter("s is not null").select(
        "conv_id", "n_turns", "s.*")


def prefix_names(convs: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """``conv_id, depth, name, n_turns``: the node at every place, by cutting at half depth."""
    name = F.col("name")
    segments = convs.select("conv_id", "n_turns", F.lit(0).cast("long").alias("block"), F.unhex(F.sha2(F.lit(""), 256)).alias("name"))
    for k in range(len(blocks), 0, -1):
        cut = blocks[k - 1].filter("block % 2 = 0").select("conv_id", F.shiftright("block", 1).alias("block"), "digest")
        segments = _halves(segments.join(cut, ["conv_id", "block"], "left"), k, [name.alias("name")],
                           [_digest(name, F.col("digest")).alias("name")])
    return segments.select("conv_id", F.col("block").alias("depth"), "name", "n_turns")


def below(values: DataFrame, convs: DataFrame, levels: int) -> DataFrame:
    """``conv_id, depth, saved, leaves``: sums of the values at this place and after it.

    Totals of aligned blocks are made from below; then the total of each lower
    half is grafted on to the places of the upper half.
    """
    cols = ["saved", "leaves"]
    sums = [values.select("conv_id", F.col("depth").alias("block"), *cols)]
    for k in range(1, levels):
        sums.append(written(sums[-1].groupBy("conv_id", F.shiftright("block", 1).alias("up"))
                            .agg(*[F.sum(c).alias(c) for c in cols]).withColumnRenamed("up", "block"), f"totals-{k}"))
    zero = F.lit(0).cast("long")
    segments = convs.select("conv_id", "n_turns", zero.alias("block"), *[zero.alias(c) for c in cols])
    for k in range(levels, 0, -1):
        lower = sums[k - 1].filter("block % 2 = 1").select(
            "conv_id", F.shiftright("block", 1).alias("block"), *[F.col(c).alias(f"_{c}") for c in cols])
        segments = _halves(segments.join(lower, ["conv_id", "block"], "left"), k,
                           [(F.col(c) + F.coalesce(f"_{c}", zero)).alias(c) for c in cols], [F.col(c).alias(c) for c in cols])
    own = sums[0].select("conv_id", "block", *[F.col(c).alias(f"_{c}") for c in cols])
    return segments.join(own, ["conv_id", "block"], "left").select(
        "conv_id", F.col("block").alias("depth"), *[(F.col(c) + F.coalesce(f"_{c}", zero)).alias(c) for c in cols])


def _joined_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (depth, name, conv_id) rows as rows of up to ID_CHUNK comma-joined ids."""
    for b in batches:
        if not len(b):
            continue
        depth, name = b["depth"].to_numpy(), b["name"].to_numpy()
        ids = b["conv_id"].to_numpy()
        new = np.flatnonzero(np.r_[True, (depth[1:] != depth[:-1]) | (name[1:] != name[:-1])])
        starts = np.concatenate([np.arange(i, j, ID_CHUNK) for i, j in zip(new, np.r_[new[1:], len(b)])])
        ends = np.r_[starts[1:], len(b)]
        yield pd.DataFrame({"depth": depth[starts], "name": name[starts], "first": ids[starts],
                            "ids": [",".join(map(str, ids[i:j].tolist())) for i, j in zip(starts, ends)]})


def _hashed_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One SHA-256 per node over its rows of joined ids; only the running hash is kept."""
    key, state = None, None
    for b in batches:
        out = []
        for depth, name, ids in zip(b["depth"], b["name"], b["ids"]):
            if (depth, name) == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, name), hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(out, columns=["depth", "name", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["depth", "name", "ends_sha256"])


def ends_hashes(paths: DataFrame) -> DataFrame:
    """``depth, name, ends_sha256`` of nodes at which conversations end.

    The ids are sorted over all tasks and joined to long rows first, so that
    the running hash of a node at which very many end reads few rows.
    """
    ends = paths.filter("depth = n_turns").select("depth", "name", "conv_id")
    order = ["depth", "name", "conv_id"]
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        _joined_ids, "depth long, name binary, first long, ids string")
    return chunks.repartition("depth", "name").sortWithinPartitions("depth", "name", "first").mapInPandas(
        _hashed_ids, "depth long, name binary, ends_sha256 string")


def _parents(nodes: DataFrame, n_children: DataFrame) -> DataFrame:
    """``depth, name, parent_conv_id``; at most HEAVY_SHARE parents have so many children that they are sent to all tasks."""
    total = nodes.count()
    labels = nodes.select("depth", "name", "conv_id").join(n_children, ["depth", "name"]).select(
        F.col("depth").alias("parent_depth"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy = F.col("n_children") * HEAVY_SHARE > total
    child = nodes.filter("depth > 0").select("depth", "name", (F.col("depth") - 1).alias("parent_depth"), "parent")
    key = ["parent_depth", "parent"]
    few = F.broadcast(labels.filter(heavy).drop("n_children"))
    light = child.join(few.drop("parent_conv_id"), key, "left_anti").join(labels.filter(~heavy).drop("n_children"), key)
    return child.join(few, key).unionByName(light).select("depth", "name", "parent_conv_id")


def prefix_trie(conversations: DataFrame, lend_heads: bool = False, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct prefix of turns (role, text), the empty one included.

    ``conv_id`` is the smallest member and, with ``depth``, the node's key;
    ``name`` its digest.  ``lend_heads`` rebuilds the conversations first
    (:func:`with_lent_heads`).  Columns: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, name.
    """
    spark = conversations.sparkSession
    prepare(spark)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    n_words = F.regexp_count(text, F.lit(f"[^{WORD_SPACE}]+")).cast("long")
    turns = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        _turn_digest(role, text).alias("digest"), n_words.alias("words"))
    placed = written(ordered_turns(turns), "placed")
    if lend_heads:
        turns, convs = with_lent_heads(placed)
    else:
        turns = placed.select("conv_id", (F.col("before") + F.col("at")).alias("place"), "digest", "words")
        convs = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    turns, convs = written(turns, "turns"), written(convs, "convs")
    longest = convs.agg(F.max("n_turns")).first()[0] or 0
    levels = max(1, int(longest).bit_length())

    paths = written(prefix_names(convs, block_digests(turns, levels)), "paths")
    nodes = paths.groupBy("depth", "name").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    # the smallest member's place above gives the parent's name, its last turn the words
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent")).join(
        turns.select("conv_id", (F.col("place") + 1).alias("depth"), "words"), ["conv_id", "depth"])
    nodes = written(nodes.join(above, ["conv_id", "depth"], "left"), "nodes")
    n_children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(n_children, ["depth", "name"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))), "nodes-children")

    values = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).alias("saved"),
                          (F.col("n_children") == 0).cast("long").alias("leaves"))
    first = convs.join(nodes.select("conv_id").distinct(), "conv_id")
    totals = paths.join(below(values, first, levels), ["conv_id", "depth"]).groupBy("depth", "name").agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    key = ["depth", "name"]
    nothing = hashlib.sha256(b"").hexdigest()
    return (nodes.join(totals, key).join(_parents(nodes.drop("n_children"), n_children), key, "left")
            .join(ends_hashes(paths), key, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "name"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations with lent heads."""
    return prefix_trie(read_table(spark, sf_dir, "conversations"), lend_heads=True).drop("name")


ORACLE_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
crc(conv_id, s, i, c) AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL
  SELECT conv_id, s, i + 1, xor(d >> 1, CASE WHEN d & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)
  FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(s, CAST(i // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE c END AS d
        FROM crc WHERE i < 8 * length(s)) x),
heads AS (
  SELECT ids.conv_id, n, ids.conv_id - ids.conv_id % 20 AS base, xor(c, CAST(4294967295 AS BIGINT)) % 4 AS h
  FROM ids JOIN crc ON crc.conv_id = ids.conv_id AND i = 8 * length(s)),
lent AS (SELECT a.*, least(h, coalesce(b.n, 0)) AS k FROM heads a LEFT JOIN ids b ON b.conv_id = a.base),
turns AS (
  SELECT l.conv_id, t.p AS p, role, text FROM lent l JOIN t ON t.conv_id = l.base AND t.p < l.h
  UNION ALL
  SELECT l.conv_id, t.p - h + k, role, text FROM lent l JOIN t ON t.conv_id = l.conv_id AND t.p >= l.h),
seqs AS (
  SELECT l.conv_id, coalesce(list({'r': role, 't': text} ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS seq
  FROM lent l LEFT JOIN turns t ON t.conv_id = l.conv_id GROUP BY l.conv_id),
paths AS (
  SELECT conv_id, d, len(seq) AS n, seq[1:d] AS prefix, CASE WHEN d > 0 THEN seq[d].t ELSE '' END AS last
  FROM seqs, LATERAL (SELECT unnest(range(0, len(seq) + 1)) AS d) x),
nodes AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    len(regexp_extract_all(any_value(last), '[^\\x20\\x09-\\x0D]+')) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM paths GROUP BY d, prefix),
kids AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.prefix = nodes.prefix),
sums AS (
  SELECT u.d, u.prefix, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
    sum(CASE WHEN v.d = 0 THEN 0 ELSE (v.n_convs - 1) * v.words END) AS saved
  FROM full_nodes v, LATERAL (SELECT unnest(range(0, v.d + 1)) AS e) x JOIN full_nodes u ON u.d = e AND u.prefix = v.prefix[1:e]
  GROUP BY u.d, u.prefix)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(a.n_convs AS BIGINT) AS n_convs,
  CAST(a.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  a.ends_sha256
FROM full_nodes a JOIN sums s ON s.d = a.d AND s.prefix = a.prefix
LEFT JOIN full_nodes p ON p.d = a.d - 1 AND p.prefix = a.prefix[1:a.d - 1]
"""
