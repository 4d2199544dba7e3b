import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["select_filter", "frequency_nested", "stats_orders", "validate_inn_stats", "split_by_size", "query_pipe", "streaming_frequency"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events conversations pages").split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    text = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert text(got.select(cols).collect()) == text(con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({entry.oracle_sql()[name]})").fetchall())


def test_flagship(spark):
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() == 6
