"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from tracewise.plans.oracle import ORACLE  # noqa: E402
from compare import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
NO_ORACLE = {"train_predict"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_or_is_listed():
    from tracewise.plans.queries import REGISTRY

    assert set(REGISTRY) - set(entry.oracle_sql()) == NO_ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = Counter(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    res = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == Counter(rows_of(cols, res.fetchall()))


def test_entry_smoke(spark):
    r = entry.entry(spark).collect()
    assert len(r) == 1 and r[0].score > 0
