"""Every query that SQL can express equals its DuckDB statement, over whole tables."""

import duckdb
import pytest

from tickscope.llm import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "pages"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = [c for c in ("doc_id", "vec_id", "item_id", "page_id", "word") if c in columns]
    got, want = (x[columns].sort_values(key).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
