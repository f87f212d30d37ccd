"""Aggregate episode rows per person and attach them to the person table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_episodes(person: DataFrame, episodes: DataFrame, person_id: str,
                    episode_id: str, aggs: dict, fill_zero=()) -> DataFrame:
    """``groupBy(episode_id).agg(...)`` then a left join on the person id.

    The aggregation runs first (partial + final), so the join sees one row
    per person on each side; both sides are hash-partitioned on the id and
    AQE splits a skewed id if one person holds a large share of episodes.
    ``aggs`` maps output name -> aggregate Column.
    """
    per = episodes.groupBy(F.col(episode_id).alias("_pid")).agg(
        *[c.alias(n) for n, c in aggs.items()])
    j = person.join(per, person[person_id] == per["_pid"], "left").drop("_pid")
    if fill_zero:
        j = j.fillna(0, subset=list(fill_zero))
    return j
