"""Registered queries over ``embeddings``."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from strata.operators import cluster
from strata.plans.registry import register
from strata.sources.tables import read_table



def _emb(spark, d):
    return read_table(spark, d, "embeddings")


@register("standardize_embeddings", """WITH x AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim,
         CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
s AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS std FROM x GROUP BY dim)
SELECT x.vec_id, CAST(x.dim AS INTEGER) AS dim,
  round_even((x.x - s.mean) / CASE WHEN s.std > 0 THEN s.std ELSE 1 END, 6) AS z
FROM x JOIN s ON x.dim = s.dim""")
def standardize_embeddings(spark, d):
    """Zero mean, unit population std per embedding dimension (M12), long form."""
    z = cluster.standardize(_emb(spark, d), "embedding")
    return z.select("vec_id", F.posexplode("z").alias("dim", "z")).select(
        "vec_id", "dim", F.bround("z", 6).alias("z"))


@register("silhouette_labels", """WITH s AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
x AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM s),
c AS (SELECT label, dim, sum(x) AS sx FROM x GROUP BY label, dim),
q AS (SELECT vec_id, any_value(label) AS label, sum(x * x) AS sq FROM x GROUP BY vec_id),
n AS (SELECT label, count(*) AS n, sum(sq) AS sq FROM q GROUP BY label),
dots AS (SELECT x.vec_id, c.label AS other, sum(x.x * c.sx) AS dot FROM x JOIN c ON c.dim = x.dim GROUP BY 1, 2),
m AS (SELECT q.vec_id, q.label, dots.other, n.n,
        n.n * q.sq + n.sq - 2 * dots.dot AS total
      FROM q JOIN dots ON dots.vec_id = q.vec_id JOIN n ON n.label = dots.other),
per AS (SELECT vec_id, max(CASE WHEN label = other AND n > 1 THEN total / (n - 1) END) AS a,
        min(CASE WHEN label <> other THEN total / n END) AS b FROM m GROUP BY vec_id)
SELECT round_even(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM per""")
def silhouette_labels(spark, d):
    """Silhouette of the given label over all vectors, squared Euclidean."""
    sil = cluster.silhouette(_emb(spark, d), "embedding", "label")
    return sil.select(F.bround("silhouette", 6).alias("silhouette"))


@register("silhouette_euclidean", """WITH s AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE label IS NOT NULL
  ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 2000),
n AS (SELECT label, count(*) AS n FROM s GROUP BY label),
t AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS total
      FROM s a CROSS JOIN s b GROUP BY ALL),
per AS (SELECT vec_id, max(CASE WHEN t.label = other AND n > 1 THEN total / (n - 1) END) AS a,
          min(CASE WHEN t.label <> other THEN total / n END) AS b FROM t JOIN n ON n.label = other GROUP BY vec_id)
SELECT round_even(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette,
  count(*) AS n_rows FROM per""")
def silhouette_euclidean(spark, d):
    """Silhouette of the given label in plain distances on the source's sample of 2,000."""
    out = cluster.plain_silhouette(_emb(spark, d), "vec_id", "embedding", "label")
    return out.select(F.bround("silhouette", 6).alias("silhouette"), "n_rows")


def _z(spark, d):
    return cluster.standardize(_emb(spark, d), "embedding").select("vec_id", "z", "label")


_CACHE: dict = {}


def _search(spark, d):
    key = (spark.sparkContext.applicationId, d.rstrip("/"))
    if key not in _CACHE:
        _CACHE[key] = cluster.kmeans_search(_z(spark, d), "vec_id", "z", range(2, 9))
    return _CACHE[key]


@register("kmeans_sweep")
def kmeans_sweep(spark, d):
    """k = 2..8, the best of ten k-means|| fits each: inertia and silhouettes over all rows."""
    return _search(spark, d)[0]


@register("choose_k")
def choose_k(spark, d):
    """The k of the sweep with the largest silhouette."""
    return cluster.choose_k(_search(spark, d)[0])


@register("choose_k_euclidean")
def choose_k_euclidean(spark, d):
    """The k that the plain-distance silhouette of all rows picks."""
    return cluster.choose_k(_search(spark, d)[0], "silhouette_euclidean")


@register("assign_clusters")
def assign_clusters(spark, d):
    """Final k-means fit at the chosen k; cluster id per vector
    and cluster sizes (M16)."""
    _, _, model = _search(spark, d)
    rows = model.transform(_z(spark, d).withColumn("_v", array_to_vector("z")))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    return rows.select("vec_id", "label", "cluster").join(sizes, "cluster")
