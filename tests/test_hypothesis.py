"""Property tests of the row-wise Column builders against plain Python."""

from hypothesis import given, settings
from hypothesis import strategies as st

from strata.functions import columns as C

cell = st.one_of(st.none(), st.integers(min_value=0, max_value=9))
rows = st.lists(st.tuples(cell, cell, cell), min_size=1, max_size=30)


@settings(max_examples=15, deadline=None)
@given(rows)
def test_row_builders_match_python(spark, data):
    df = spark.createDataFrame(data, "a int, b int, c int")
    cols = ["a", "b", "c"]
    got = df.select(C.row_sum(cols, 2).alias("s"), C.row_mean(cols).alias("m"),
                    C.count_flags(cols, 1).alias("k"), C.any_answered(cols).alias("any"),
                    C.recode("a", {1: 1.0, 2: 0.0}).alias("r")).collect()
    for (a, b, c), r in zip(data, got):
        present = [x for x in (a, b, c) if x is not None]
        assert r.s == (sum(present) if len(present) >= 2 else None)
        assert (r.m is None) if not present else abs(r.m - sum(present) / len(present)) < 1e-12
        assert r.k == sum(1 for x in (a, b, c) if x == 1)
        assert r.any == bool(present)
        assert r.r == {1: 1.0, 2: 0.0}.get(a)
