"""Properties of the physical plans that the scale design depends on."""

import io
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry
from tracewise.plans.queries import REGISTRY  # noqa: E402

SF = "/root/testdata/sf0.001"
SKIP = {"stream_disposal_gate", "stream_disposal_gate_batched", "stream_outcomes",
        "train_predict", "register_instances", "append_events", "audit_report"}


def plan_text(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - SKIP))
def test_batch_plans_stay_in_the_jvm(spark, name):
    text = plan_text(entry.queries()[name](spark, SF))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|"
                         r"MapInPandas|PythonUDF", text), name
    assert "CartesianProduct" not in text, name


def test_scans_read_only_needed_columns(spark):
    text = plan_text(entry.queries()["recyclability_score"](spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
    assert "struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in schemas
    assert all("l_comment" not in s and "l_extendedprice" not in s for s in schemas)


def test_timeline_window_is_sliced(spark):
    text = plan_text(entry.queries()["timeline"](spark, SF))
    specs = re.findall(r"Arguments: \[row_number\(\).*?\], \[([^\]]*)\]", text)
    assert specs and all("_ks" in s for s in specs)


def test_one_row_attachments_are_broadcast(spark):
    text = plan_text(entry.queries()["features_global"](spark, SF))
    assert "BroadcastNestedLoopJoin" in text
    assert "CartesianProduct" not in text
