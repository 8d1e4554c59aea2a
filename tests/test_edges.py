"""Edge rows (FIXTURES §4) and properties of the gates and helpers."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from tracewise import schemas
from tracewise.operators import bom, dashboard, events, features, gates, model, sourcing
from tracewise.operators.ranking import sequence_within


def test_grade_score_case_and_null(spark):
    cc = spark.createDataFrame([("C1", "M1", Decimal("10")), ("C1", "M2", Decimal("30")),
                                ("C1", "M3", Decimal("60"))], schemas.COMPONENT_COMPOSITION)
    rm = spark.createDataFrame([("M1", "x", False, "A"), ("M2", "y", None, "a"),
                                ("M3", "z", True, None)], schemas.RAW_MATERIALS)
    cs = dashboard.recyclability_score(cc, rm, case_sensitive=True).first()
    ci = dashboard.recyclability_score(cc, rm, case_sensitive=False).first()
    assert cs.total_weight == 100.0 and cs.score == 0.4     # 'a' and NULL score 0
    assert ci.score == 1.6                                  # 'a' scores like 'A'
    empty = dashboard.recyclability_score(cc.limit(0), rm).first()
    assert empty.score == 0.0


def test_hazard_weight_gate_boundaries(spark):
    rm = spark.createDataFrame([("MH", "Lead", True, "D"), ("MS", "Steel", False, "A"),
                                ("MN", "Unknown flag", None, "B")], schemas.RAW_MATERIALS)
    batch = spark.createDataFrame(
        [(1, "C1", "MH", "0.004"), (2, "C1", "MH", "0.005"), (3, "C1", "MH", "500.00"),
         (4, "C1", "MH", "500.004"), (5, "C1", "MH", "500.01"), (6, "C1", "MH", "-1"),
         (7, "C1", "MH", None), (8, "C1", "MS", "600"), (9, "C1", "MX", "900"),
         (10, "C1", "MN", "900"), (11, "C1", "MS", "abc")],
        "id int, ComponentID string, MaterialID string, WeightInGrams string")
    got = {r.id: (r.WeightInGrams, r.reason) for r in
           gates.hazard_weight_gate(batch, rm).collect()}
    assert got[1] == (Decimal("0.00"), schemas.MSG_INVALID_WEIGHT)
    assert got[2] == (Decimal("0.01"), None)
    assert got[3] == (Decimal("500.00"), None)
    assert got[4] == (Decimal("500.00"), None)
    assert got[5][1] == schemas.MSG_HAZARD_LIMIT
    assert got[6][1] == schemas.MSG_INVALID_WEIGHT
    assert got[7][1] == schemas.MSG_NULL_WEIGHT
    assert got[8][1] is None and got[9][1] is None and got[10][1] is None
    assert got[11][1] == schemas.MSG_INVALID_WEIGHT
    acc, rej = gates.split(gates.hazard_weight_gate(batch, rm))
    assert acc.count() + rej.count() == batch.count()


def _ev(spark, data):
    return spark.createDataFrame(
        [(i, t, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), n) for i, t, d, n in data],
        schemas.LIFECYCLE_EVENTS)


def test_disposal_gate_orders_by_insertion(spark):
    stored = _ev(spark, [(1, "Sold", 0, 30)])
    batch = _ev(spark, [
        (10, "Disposed", 5, 1), (11, "Sold", 1, 1),        # disposed before sold (by id)
        (12, "Sold", 9, 2), (13, "Disposed", 0, 2),        # sold earlier by id, later by date
        (14, "Disposed", 3, 30),                           # sold already stored
        (15, "disposed", 3, 40),                           # case-insensitive type
        (16, "Sold", 3, 50), (17, "Disposed", 3, 50),      # same instant
        (18, "Disposed", 1, None)])
    got = dict(rows(gates.disposal_gate(stored, batch), "EventID", "reason"))
    assert got == {10: schemas.MSG_UNSOLD_DISPOSAL, 11: None, 12: None, 13: None, 14: None,
                   15: schemas.MSG_UNSOLD_DISPOSAL, 16: None, 17: None,
                   18: schemas.MSG_UNSOLD_DISPOSAL}


def test_sourcing_gate(spark):
    b = spark.createDataFrame([(1, "S1", "component", "C1"), (2, "S1", "material", "M1"),
                               (3, "S1", "Component", "C1"), (4, "S1", "material", None)],
                              "id int, SupplierID string, supply_type string, item_id string")
    got = {r.id: (r.ComponentID, r.MaterialID, r.reason) for r in gates.sourcing_gate(b).collect()}
    assert got[1] == ("C1", None, None) and got[2] == (None, "M1", None)
    assert got[3][2] == schemas.MSG_INVALID_SUPPLY_TYPE
    assert got[4][2] == schemas.MSG_SOURCING_CHECK


def test_register_instances(spark, seed):
    batch = spark.createDataFrame([
        (1, "  NEW-1 ", "P100"),     # trimmed, accepted
        (2, "alpha-0001", "P200"),   # duplicate of a stored serial in other case
        (3, "NEW-2", "P999"),        # unknown product
        (4, "new-2", "p200"),        # same serial as 3, but 3 was refused: accepted
        (5, "NEW-1", "P100"),        # duplicate of request 1
        (6, None, "P100")], "RequestID long, SerialNumber string, ProductID string")
    decided, new_events = gates.register_instances(
        seed.product_instances, seed.products, batch, seed.lifecycle_events,
        "2025-12-01 10:00:00")
    got = {r.RequestID: (r.SerialNumber, r.InstanceID, r.EventID, r.reason)
           for r in decided.collect()}
    assert got[1] == ("NEW-1", 5, 14, None)
    assert got[2][3] == schemas.MSG_DUPLICATE_SERIAL
    assert got[3][3] == schemas.MSG_UNKNOWN_PRODUCT
    assert got[4] == ("new-2", 6, 15, None)
    assert got[5][3] == schemas.MSG_DUPLICATE_SERIAL
    assert got[6][3] == schemas.MSG_MISSING_SERIAL
    ev = rows(new_events, "EventID", "EventType", "InstanceID")
    assert ev == [(14, "Manufactured", 5), (15, "Manufactured", 6)]


def test_append_events(spark, seed):
    batch = spark.createDataFrame([
        (1, "5", "Disposed"),        # unknown instance, trigger first
        (2, "2", "Repair"), (3, " 3 ", None), (4, "x", "Sold"), (5, "99", "Sold")],
        "RequestID long, InstanceRef string, EventType string")
    out = gates.append_events(seed.product_instances, seed.lifecycle_events, batch,
                              "2025-12-01 10:00:00")
    got = {r.RequestID: (r.InstanceID, r.EventID, r.reason) for r in out.collect()}
    assert got[1] == (5, None, schemas.MSG_UNSOLD_DISPOSAL)
    assert got[2] == (2, 14, None)
    assert got[3] == (3, None, schemas.MSG_MISSING_EVENT_TYPE)
    assert got[4] == (None, None, schemas.MSG_UNKNOWN_INSTANCE)
    assert got[5] == (99, None, schemas.MSG_UNKNOWN_INSTANCE)


def test_add_suppliers(spark, seed):
    batch = spark.createDataFrame([(1, " S4 ", "New Co"), (2, "s1", "Dup"), (3, "s4", "Again"),
                                   (4, None, "No id"), (5, "S5", None)],
                                  "RequestID long, SupplierID string, SupplierName string")
    got = dict(rows(gates.add_suppliers(seed.suppliers, batch), "RequestID", "reason"))
    assert got == {1: None, 2: schemas.MSG_DUPLICATE_SUPPLIER, 3: schemas.MSG_DUPLICATE_SUPPLIER,
                   4: schemas.MSG_MISSING_SUPPLIER_ID, 5: schemas.MSG_MISSING_SUPPLIER_NAME}


def test_archive_delete_keeps_null_predicate(seed):
    le = seed.lifecycle_events.withColumn(
        "EventType", F.when(F.col("EventID") == 1, None).otherwise(F.col("EventType")))
    kept, backup = gates.archive_delete(le, F.col("EventType") == "Sold")
    assert backup.count() == 4 and kept.count() == 9
    assert gates.like(le).count() == 0 and gates.like(le).schema == le.schema


def test_supplier_type_all_kinds(spark):
    sup = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c"), ("D", "d")],
                                schemas.SUPPLIERS)
    so = spark.createDataFrame([(1, "A", "C1", None), (2, "A", None, "M1"), (3, "B", "C1", None),
                                (4, "C", None, "M1")], schemas.SOURCING)
    got = dict(rows(sourcing.supplier_type(sup, so), "SupplierID", "SupplierType"))
    assert got == {"A": "Both", "B": "Component Supplier", "C": "Material Supplier",
                   "D": "Unknown"}


def test_sequence_within_matches_window_with_hot_key(spark):
    random.seed(7)
    data = [(0 if i % 3 else random.randint(1, 50), random.randint(0, 200), i)
            for i in range(3000)]
    df = spark.createDataFrame(data, "k long, t long, id long")
    ours = sequence_within(df, "k", ["t", "id"], slice_by=(F.col("t") / 20).cast("long"))
    ref = df.withColumn("seq", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
    assert rows(ours, "id", "seq") == rows(ref, "id", "seq")
    # NULL keys and NULL slice values are numbered too, as one group each
    nulls = df.withColumn("k", F.when(F.col("k") == 0, None).otherwise(F.col("k"))) \
        .withColumn("t", F.when(F.col("id") % 97 == 0, None).otherwise(F.col("t")))
    ours = sequence_within(nulls, "k", ["t", "id"], slice_by=(F.col("t") / 20).cast("long"))
    ref = nulls.withColumn("seq", F.row_number().over(
        Window.partitionBy("k").orderBy("t", "id")))
    assert ours.count() == nulls.count()
    assert rows(ours, "id", "seq") == rows(ref, "id", "seq")


def test_assign_ids_consecutive(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7 % 5000).alias("k"))
    out = gates.assign_ids(df, ["k"], "new_id", start=100)
    got = rows(out, "k", "new_id")
    assert got == [(k, 101 + k) for k in range(5000)]


def test_component_summary_counts_missing_children(spark):
    comps = spark.createDataFrame([("P", "Parent"), ("A", "Alpha")], schemas.COMPONENTS)
    b = spark.createDataFrame([("P", "A", 2), ("P", "ZZ", 1)], schemas.BILL_OF_MATERIAL)
    got = dict(rows(bom.component_summary(comps, b), "ComponentID", "Summary"))
    assert got["P"] == "2 subcomponents: Alpha (x2)"


def test_timeline_ties_break_on_event_id(spark):
    le = _ev(spark, [(5, "Sold", 1, 1), (3, "Repair", 1, 1), (4, "Manufactured", 0, 1)])
    assert rows(events.timeline(le), "seq", "EventID") == [(1, 4), (2, 3), (3, 5)]
    st = events.latest_state(spark.createDataFrame([(1, "s", "P")], schemas.PRODUCT_INSTANCES),
                             le).first()
    assert st.current_state == "Sold"


def test_classification_report_and_model(spark):
    data = [(i, float(i % 10) / 10.0, 1 if i % 10 >= 4 else 0) for i in range(200)]
    df = spark.createDataFrame(data, "InstanceID long, x double, target int")
    rep = {r.label: r for r in model.classification_report(
        df.withColumn("prediction", (F.col("x") >= 0.5).cast("int"))).collect()}
    # class 1: tp 100 (x>=.5), predicted 100, support 120
    assert rep["1"].precision == 1.0 and rep["1"].recall == round(100 / 120, 6)
    assert rep["0"].recall == 1.0 and rep["accuracy"].f1_score == 0.9
    train, test = model.split(df)
    assert train.count() + test.count() == 200
    fitted = model.fit_logistic(train, ["x"])
    pred = model.predict(fitted, test)
    assert pred.agg(F.avg((F.col("prediction") == F.col("target")).cast("double"))).first()[0] > 0.8
    with pytest.raises(ValueError):
        model.fit_logistic(train.filter("target = 1"), ["x"])


def test_standard_scale_population_std(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in (1, 2, 3, 4)], "a double, b double")
    z = [r.a_z for r in features.standard_scale(df, ["a", "b"]).orderBy("a").collect()]
    assert [round(v, 4) for v in z] == [-1.3416, -0.4472, 0.4472, 1.3416]
    assert {r.b_z for r in features.standard_scale(df, ["a", "b"]).collect()} == {0.0}
