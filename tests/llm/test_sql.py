"""Queries of the subpackage whose result SQL can express, against DuckDB on the smallest driver tables."""

from collections import Counter

import duckdb
import pytest

from tracewise.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_mix_sources", "op7_near_dedup"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    res = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in res.description]
    norm = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    got = Counter(norm(tuple(r)) for r in queries.QUERIES[name](spark, SF).select(*cols).collect())
    assert got == Counter(norm(r) for r in res.fetchall())
