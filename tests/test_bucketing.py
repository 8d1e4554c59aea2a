"""Bucketed storage co-locates the operators' repeated joins (fewer shuffles,
same results)."""

import io
import re
from contextlib import redirect_stdout

from conftest import rows
from tracewise.operators import bom, events
from tracewise.sources.tables import load_tables, save_tables
from tracewise.sources.testdata import driver_tables


def exchanges(df) -> int:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return len(re.findall(r"^\(\d+\) Exchange$", buf.getvalue(), re.M))


def test_bucketed_tables_save_shuffles(spark, tmp_path):
    src = driver_tables(spark, "/root/testdata/sf0.001")
    spark.sql(f"create database if not exists bk location '{tmp_path / 'bk'}'")
    spark.sql(f"create database if not exists pl location '{tmp_path / 'pl'}'")
    save_tables(src, "bk", 4)
    for name in ("components", "bill_of_material", "component_composition", "raw_materials",
                 "lifecycle_events", "product_instances"):
        getattr(src, name).write.mode("overwrite").saveAsTable(f"pl.{name}")
    bk, pl = load_tables(spark, "bk"), load_tables(spark, "pl")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cases = [
            lambda t: bom.trace_rollup(t.components, t.bill_of_material,
                                       t.component_composition, t.raw_materials),
            lambda t: bom.component_weight(t.components, t.component_composition),
            lambda t: events.latest_state(t.product_instances, t.lifecycle_events),
        ]
        for make in cases:
            a, b = make(pl), make(bk)
            assert exchanges(b) < exchanges(a)
            assert rows(a) == rows(b)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
