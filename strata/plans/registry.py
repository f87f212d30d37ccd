"""Registry of named queries: a DataFrame builder and (optionally) oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: ``fn(spark, sf_dir) -> DataFrame``; ``sql`` runs in DuckDB."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def reset_caches(keep_stored: bool = False) -> None:
    """Forget per-session results (analysis table, model, sweeps, intake model).

    Results stored across sessions are not read again either, unless
    ``keep_stored``, which leaves what a new session on the same folder finds.
    """
    from strata.plans import cluster_queries, intake_queries, model_queries, survey_queries
    from strata.sources import store
    for mod in (survey_queries, model_queries, cluster_queries, intake_queries):
        mod._CACHE.clear()
    if not keep_stored:
        store.forget()
