"""Set-based gates against a row-by-row simulation of the database on random
batches with many collisions (the database admits rows one at a time, each
seeing the rows admitted before it)."""

import datetime as dt
import random

from conftest import rows
from tracewise import schemas
from tracewise.operators import bom, gates

TYPES = ["Sold", "Disposed", "sold", "DISPOSED", "Repair", None, "Recycled"]


def test_disposal_gate_vs_simulation(spark):
    rnd = random.Random(11)
    stored = [(i, rnd.choice(TYPES), dt.datetime(2024, 1, 1), rnd.randint(1, 40))
              for i in range(1, 60)]
    batch = [(i, rnd.choice(TYPES), dt.datetime(2024, 2, 1), rnd.choice([None] + list(range(1, 60))))
             for i in rnd.sample(range(100, 10_000), 800)]
    sold = {n for _, t, _, n in stored if t and t.lower() == "sold"}
    expect = {}
    for eid, t, _, n in sorted(batch):
        kind = t.lower() if t else None
        if kind == "disposed" and n not in sold:
            expect[eid] = schemas.MSG_UNSOLD_DISPOSAL
        else:
            expect[eid] = None
            if kind == "sold" and n is not None:
                sold.add(n)
    got = dict(rows(gates.disposal_gate(
        spark.createDataFrame(stored, schemas.LIFECYCLE_EVENTS),
        spark.createDataFrame(batch, schemas.LIFECYCLE_EVENTS)), "EventID", "reason"))
    assert got == expect


def test_register_instances_vs_simulation(spark, seed):
    rnd = random.Random(5)
    serials = ["ALPHA-0001", "eco-0002", " x-1", "X-1 ", "y", "Y", "z", None]
    products = ["P100", "p200", "P300", None]
    batch = [(i, rnd.choice(serials), rnd.choice(products)) for i in rnd.sample(range(1, 5000), 300)]
    stored = {r.SerialNumber.lower() for r in seed.product_instances.collect()}
    known = {r.ProductID.lower() for r in seed.products.collect()}
    next_id, next_ev = 4, 13
    expect = {}
    for rid, s, p in sorted(batch):
        s = s.strip() if s is not None else None
        if s is None:
            expect[rid] = (None, schemas.MSG_MISSING_SERIAL)
        elif s.lower() in stored:
            expect[rid] = (None, schemas.MSG_DUPLICATE_SERIAL)
        elif p is None or p.lower() not in known:
            expect[rid] = (None, schemas.MSG_UNKNOWN_PRODUCT)
        else:
            next_id += 1
            next_ev += 1
            stored.add(s.lower())
            expect[rid] = (next_id, None)
    df = spark.createDataFrame(batch, "RequestID long, SerialNumber string, ProductID string")
    decided, new_events = gates.register_instances(seed.product_instances, seed.products, df,
                                                   seed.lifecycle_events, "2025-12-01")
    got = {r.RequestID: (r.InstanceID, r.reason) for r in decided.collect()}
    assert got == expect
    assert new_events.count() == sum(1 for v in expect.values() if v[1] is None)


def test_add_suppliers_vs_simulation(spark, seed):
    rnd = random.Random(3)
    ids = ["S1", "s2", " S9", "s9 ", "S10", "s10", None, "A"]
    names = ["n", None, " m "]
    batch = [(i, rnd.choice(ids), rnd.choice(names)) for i in rnd.sample(range(1, 5000), 200)]
    stored = {r.SupplierID.lower() for r in seed.suppliers.collect()}
    expect = {}
    for rid, s, n in sorted(batch):
        s = s.strip() if s is not None else None
        if s is None:
            expect[rid] = schemas.MSG_MISSING_SUPPLIER_ID
        elif n is None:
            expect[rid] = schemas.MSG_MISSING_SUPPLIER_NAME
        elif s.lower() in stored:
            expect[rid] = schemas.MSG_DUPLICATE_SUPPLIER
        else:
            stored.add(s.lower())
            expect[rid] = None
    df = spark.createDataFrame(batch, "RequestID long, SupplierID string, SupplierName string")
    assert dict(rows(gates.add_suppliers(seed.suppliers, df), "RequestID", "reason")) == expect


def test_empty_inputs(spark, seed):
    empty = {n: getattr(seed, n).limit(0) for n in
             ("bill_of_material", "component_composition", "lifecycle_events", "sourcing")}
    s = bom.component_summary(seed.components, empty["bill_of_material"])
    assert {r.Summary for r in s.collect()} == {"0 subcomponents: No subcomponents"}
    assert bom.hazard_usage(empty["component_composition"], seed.bill_of_material,
                            seed.raw_materials).first().hazard_count == 0
    d = gates.disposal_gate(empty["lifecycle_events"], empty["lifecycle_events"])
    assert d.count() == 0
    from tracewise.operators import dashboard, events, sourcing

    assert dashboard.outcome_share(empty["lifecycle_events"]).first().recycled_pct is None
    st = events.latest_state(seed.product_instances, empty["lifecycle_events"])
    assert {r.current_state for r in st.collect()} == {"NoEvents"}
    ty = sourcing.supplier_type(seed.suppliers, empty["sourcing"])
    assert {r.SupplierType for r in ty.collect()} == {"Unknown"}


def test_shares_add_to_100(spark):
    from tracewise.sources.testdata import driver_tables

    t = driver_tables(spark, "/root/testdata/sf0.001")
    sh = bom.composition_share(t.component_composition, t.raw_materials)
    from pyspark.sql import functions as F

    sums = sh.groupBy("ComponentID").agg(F.sum("share_pct").alias("s"),
                                         F.count("*").alias("n")).collect()
    assert all(abs(r.s - 100) <= 0.05 * r.n + 1e-9 for r in sums)


def test_append_events_vs_simulation(spark, seed):
    rnd = random.Random(9)
    refs = ["1", " 2 ", "3", "4", "5", "x", None, "04"]
    batch = [(i, rnd.choice(refs), rnd.choice(TYPES)) for i in rnd.sample(range(1, 5000), 300)]
    sold = {r.InstanceID for r in seed.lifecycle_events.collect() if r.EventType == "Sold"}
    known = {r.InstanceID for r in seed.product_instances.collect()}
    next_ev = 13
    expect = {}
    for rid, ref, t in sorted(batch):
        try:
            inst = int(ref.strip()) if ref is not None else None
        except ValueError:
            inst = None
        kind = t.lower() if t else None
        if kind == "disposed" and inst not in sold:
            expect[rid] = (None, schemas.MSG_UNSOLD_DISPOSAL)
        elif t is None:
            expect[rid] = (None, schemas.MSG_MISSING_EVENT_TYPE)
        elif inst not in known:
            expect[rid] = (None, schemas.MSG_UNKNOWN_INSTANCE)
        else:
            next_ev += 1
            if kind == "sold":
                sold.add(inst)
            expect[rid] = (next_ev, None)
    df = spark.createDataFrame(batch, "RequestID long, InstanceRef string, EventType string")
    out = gates.append_events(seed.product_instances, seed.lifecycle_events, df, "2025-12-01")
    got = {r.RequestID: (r.EventID, r.reason) for r in out.collect()}
    assert got == expect


def test_composition_gate_vs_simulation(spark, seed):
    rnd = random.Random(21)
    comps = ["C101", "c101", "C201", "C999", None]
    mats = ["M1", "m3", "M4", "M9"]
    weights = ["10", "0.004", "600", "499.999", None, "-2"]
    batch = [(i, rnd.choice(comps), rnd.choice(mats), rnd.choice(weights))
             for i in rnd.sample(range(1, 5000), 300)]
    rm = {r.MaterialID.lower(): r.IsHazardous for r in seed.raw_materials.collect()}
    known_c = {r.ComponentID.lower() for r in seed.components.collect()}
    stored = {(r.ComponentID.lower(), r.MaterialID.lower())
              for r in seed.component_composition.collect()}
    from decimal import ROUND_HALF_UP, Decimal

    expect = {}
    for rid, c, m, w in sorted(batch):
        wd = None if w is None else Decimal(w).quantize(Decimal("0.01"), ROUND_HALF_UP)
        haz = rm.get(m.lower()) if m else None
        if wd is not None and wd <= 0:
            expect[rid] = schemas.MSG_INVALID_WEIGHT
        elif wd is None:
            expect[rid] = schemas.MSG_NULL_WEIGHT
        elif haz is True and wd > 500:
            expect[rid] = schemas.MSG_HAZARD_LIMIT
        elif c is None or c.lower() not in known_c:
            expect[rid] = schemas.MSG_UNKNOWN_COMPONENT
        elif m.lower() not in rm:
            expect[rid] = schemas.MSG_UNKNOWN_MATERIAL
        elif (c.lower(), m.lower()) in stored:
            expect[rid] = schemas.MSG_DUPLICATE_COMPOSITION
        else:
            stored.add((c.lower(), m.lower()))
            expect[rid] = None
    df = spark.createDataFrame(batch, "RequestID long, ComponentID string, MaterialID string, "
                                      "WeightInGrams string")
    got = dict(rows(gates.composition_gate(df, seed.raw_materials, seed.components,
                                           seed.component_composition), "RequestID", "reason"))
    assert got == expect


def test_sourcing_insert_gate(spark, seed):
    b = spark.createDataFrame([(1, "S1", "component", "C101"), (2, "S9", "component", "C101"),
                               (3, "s2", "material", "m1"), (4, "S1", "component", "C999"),
                               (5, "S1", "material", "M9"), (6, "S1", "part", "C101")],
                              "RequestID long, SupplierID string, supply_type string, "
                              "item_id string")
    got = dict(rows(gates.sourcing_insert_gate(b, seed.suppliers, seed.components,
                                               seed.raw_materials), "RequestID", "reason"))
    assert got == {1: None, 2: schemas.MSG_UNKNOWN_SUPPLIER, 3: None,
                   4: schemas.MSG_UNKNOWN_COMPONENT, 5: schemas.MSG_UNKNOWN_MATERIAL,
                   6: schemas.MSG_INVALID_SUPPLY_TYPE}
