import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_queries_run_and_match_sql(spark):
    import duckdb

    from tessera.plans.catalog import QUERIES, SQL

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    for name in ("hybrid_rrf", "dense_threshold_cliff", "heading_paths", "interval_match", "vocab_merge", "tree_walk"):
        got = QUERIES[name](spark, SF).toPandas()
        want = con.execute(SQL[name]).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        key = lambda d: sorted(tuple(round(float(v), 8) if isinstance(v, float) else str(v) for v in r) for r in d[cols].itertuples(index=False))
        assert key(got) == key(want), name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.queries().keys() >= e.oracle_sql().keys()
    assert e.entry(spark).limit(1).count() == 1
