"""The adapter views in Spark (DataFrame code) equal their SQL text in DuckDB."""

import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from compare import rows_of  # noqa: E402
from tracewise.plans.views_sql import VIEWS, with_views  # noqa: E402
from tracewise.sources.testdata import DriverTables  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ["nation", "customer", "supplier", "part", "orders", "lineitem", "events"]:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("view", sorted(VIEWS))
def test_view_matches_sql(spark, duck, view):
    df = getattr(DriverTables(spark, SF), view)()
    res = duck.execute(with_views(f"select * from {view}"))
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    got = Counter(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    assert got == Counter(rows_of(cols, res.fetchall()))
