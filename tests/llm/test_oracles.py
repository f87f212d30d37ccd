"""The queries with DuckDB text against DuckDB, and the registration of all."""

from tests.conftest import SF_SMALL


def test_queries_equal_their_sql(spark):
    from strata.llm.catalog import ORACLE
    from tests.oracle_check import check
    got = check(spark, SF_SMALL, list(ORACLE), verbose=False)
    assert {k: v[0] for k, v in got.items()} == dict.fromkeys(ORACLE, "OK")


def test_all_are_registered():
    import __spark_entry__ as E
    names = set(E.queries())
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
