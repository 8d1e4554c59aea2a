"""Large steps are dealt into tasks by the number of line items, with the same results."""

import pytest

import __spark_entry__ as entry
from conftest import rows
from tracewise.sources import testdata

SF = "/root/testdata/sf0.001"
QUERIES = ["audit_report", "hazard_usage", "recycle_events_global", "subcomponent_count", "component_summary", "trace_rollup", "sourcing_ids"]


def test_slices_follow_the_line_items(spark, monkeypatch):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert testdata.DriverTables(spark, SF).slices() is None
    monkeypatch.setattr(testdata, "ROWS_PER_TASK", n // 20)
    d = testdata.DriverTables(spark, SF)
    assert 20 <= d.slices() <= 21
    for table in (d.bill_of_material(), d.component_composition(), d.sourcing()):
        assert table.rdd.getNumPartitions() == d.slices()


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_in_slices(spark, monkeypatch, name):
    query = entry.queries()[name]
    before = sorted(map(repr, query(spark, SF).collect()))
    monkeypatch.setattr(testdata, "ROWS_PER_TASK", 500)
    assert sorted(map(repr, query(spark, SF).collect())) == before


def test_rule_that_every_row_breaks_is_dealt(spark, seed):
    """The items of a broken rule do not share one key, and are all counted."""
    from tracewise.operators.audits import Rule, audit_report
    from tracewise.sources.tables import LifecycleTables

    wrong = spark.range(1000, numPartitions=5).selectExpr("cast(null as bigint) as SourcingID", "'S1' as SupplierID",
                                                          "'X' as ComponentID", "cast(null as string) as MaterialID")
    t = LifecycleTables(sourcing=wrong)
    rules = [Rule("sourcing", "not_null", ("SourcingID",)), Rule("sourcing", "not_null", ("SupplierID",))]
    for slices in (None, 7):
        assert rows(audit_report(t, rules, slices), "check_name", "violations") == [("not_null:SourcingID", 1000), ("not_null:SupplierID", 0)]
