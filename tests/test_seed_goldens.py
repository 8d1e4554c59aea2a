"""Every operator on the reference's seed rows, expected values worked out by hand."""

from decimal import Decimal

from pyspark.sql import functions as F

from conftest import rows
from tracewise.operators import audits, bom, dashboard, events, features, gates, sourcing

AS_OF = "2025-12-01"


def test_table_counts(seed):
    got = dict(rows(dashboard.table_counts(seed)))
    assert got == {"products": 2, "components": 8, "materials": 5, "suppliers": 3,
                   "instances": 4, "events": 13}


def test_event_distribution(seed):
    got = dict(rows(dashboard.event_distribution(seed.lifecycle_events)))
    assert got == {"Manufactured": 4, "Sold": 4, "Repair": 1, "Disposed": 2, "Recycled": 2}


def test_outcomes_and_share(seed):
    r = dashboard.outcome_share(seed.lifecycle_events).first()
    assert (r.recycled, r.disposed, r.repair) == (2, 2, 1)
    assert (r.recycled_pct, r.disposed_pct, r.repair_pct) == (40.0, 40.0, 20.0)


def test_recyclability_score(seed):
    r = dashboard.recyclability_score(seed.component_composition, seed.raw_materials).first()
    assert r.total_weight == 925.0 and r.weighted_score == 1775.0 and r.score == 1.92


def test_score_by_component(seed):
    got = dict(rows(dashboard.recyclability_score(seed.component_composition,
                                                  seed.raw_materials, by="ComponentID"),
                    "ComponentID", "score"))
    assert got["C101"] == 2.75 and got["C103"] == round((300 * 1 + 50 * 4) / 350, 2)


def test_supplier_type(seed):
    got = dict(rows(sourcing.supplier_type(seed.suppliers, seed.sourcing),
                    "SupplierID", "SupplierType"))
    assert got == {"S1": "Component Supplier", "S2": "Material Supplier",
                   "S3": "Material Supplier"}


def test_component_weight_and_count(seed):
    w = dict(rows(bom.component_weight(seed.components, seed.component_composition)))
    assert w == {"C100": Decimal("0.00"), "C101": Decimal("200.00"), "C102": Decimal("200.00"),
                 "C103": Decimal("350.00"), "C200": Decimal("0.00"), "C201": Decimal("50.00"),
                 "C202": Decimal("100.00"), "C300": Decimal("25.00")}
    n = dict(rows(bom.subcomponent_count(seed.components, seed.bill_of_material)))
    assert n == {"C100": 4, "C200": 3, "C101": 0, "C102": 0, "C103": 0, "C201": 0,
                 "C202": 0, "C300": 0}


def test_component_summary_and_details(seed):
    s = dict(rows(bom.component_summary(seed.components, seed.bill_of_material),
                  "ComponentID", "Summary"))
    assert s["C100"] == ("4 subcomponents: 15-inch Screen Unit (x1), Laptop Keyboard (x1), "
                         "50Wh Battery Pack (x1), Universal Logic Board (x1)")
    assert s["C200"] == ("3 subcomponents: 5.8-inch OLED Screen (x1), 25Wh Battery Pack (x1), "
                         "Universal Logic Board (x1)")
    assert s["C300"] == "0 subcomponents: No subcomponents"
    d = dict(rows(bom.component_details(seed.components, seed.bill_of_material),
                  "ComponentID", "Details"))
    assert d["C200"] == "5.8-inch OLED Screen, 25Wh Battery Pack, Universal Logic Board"
    assert d["C101"] == "No subcomponents"


def test_hierarchy_report_case_insensitive_ids(seed):
    got = bom.component_summary(seed.components, seed.bill_of_material,
                                ids=["c100", "c200", "c310"])
    assert [r[0] for r in rows(got, "ComponentID")] == ["C100", "C200"]
    plain = seed.components.filter(F.col("ComponentID").isin("c100", "c200", "c310"))
    assert plain.count() == 0


def test_hazard_usage(seed):
    assert bom.hazard_usage(seed.component_composition, seed.bill_of_material,
                            seed.raw_materials).first().hazard_count == 2
    got = dict(rows(bom.hazard_usage_by_product(seed.products, seed.product_root,
                                                seed.bill_of_material,
                                                seed.component_composition, seed.raw_materials)))
    assert got == {"P100": 1, "P200": 1}


def test_features_global(seed):
    f = features.features_global(seed.product_instances, seed.products, seed.bill_of_material,
                                 seed.component_composition, seed.raw_materials,
                                 seed.lifecycle_events)
    got = rows(f, "InstanceID", "total_weight", "avg_recyclability", "hazardous_count",
               "component_count", "target")
    assert got == [(1, 950.0, 2.4444, 2, 6, 0), (2, 950.0, 2.4444, 2, 6, 1),
                   (3, 950.0, 2.4444, 2, 6, 1), (4, 950.0, 2.4444, 2, 6, 0)]
    z = features.standard_scale(features.training_set(f))
    assert all(v == 0.0 for r in z.select([c + "_z" for c in features.FEATURES]).collect()
               for v in r)


def test_features_global_equals_naive_join(spark, seed):
    for name in ("product_instances", "products", "bill_of_material", "component_composition",
                 "raw_materials"):
        getattr(seed, name).createOrReplaceTempView(name)
    naive = spark.sql("""
        select pi.InstanceID, cast(sum(cc.WeightInGrams) as double) as total_weight,
               round(avg(case upper(rm.RecyclableGrade) when 'A' then 4 when 'B' then 3
                         when 'C' then 2 when 'D' then 1 else 0 end), 4) as avg_recyclability,
               sum(cast(rm.IsHazardous as int)) as hazardous_count,
               count(distinct cc.ComponentID) as component_count
        from product_instances pi join products p on pi.ProductID = p.ProductID
        join bill_of_material bom on bom.ParentComponentID like 'C%'
        join component_composition cc on bom.ChildComponentID = cc.ComponentID
        join raw_materials rm on rm.MaterialID = cc.MaterialID
        group by pi.InstanceID""")
    ours = features.features_global(seed.product_instances, seed.products, seed.bill_of_material,
                                    seed.component_composition, seed.raw_materials,
                                    seed.lifecycle_events)
    cols = ("InstanceID", "total_weight", "avg_recyclability", "hazardous_count",
            "component_count")
    assert rows(ours, *cols) == rows(naive, *cols)


def test_recycle_target_and_state(seed):
    assert rows(events.recycle_target(seed.product_instances, seed.lifecycle_events)) == \
        [(1, 0), (2, 1), (3, 1), (4, 0)]
    st = rows(events.latest_state(seed.product_instances, seed.lifecycle_events),
              "InstanceID", "current_state")
    assert st == [(1, "Disposed"), (2, "Recycled"), (3, "Recycled"), (4, "Disposed")]


def test_lifecycle_age(seed):
    got = rows(events.lifecycle_age(seed.product_instances, seed.lifecycle_events, AS_OF),
               "InstanceID", "age_days")
    assert got == [(1, 700), (2, 699), (3, 669), (4, 668)]


def test_timeline(seed):
    t = events.timeline(seed.lifecycle_events, instance_id=1)
    assert rows(t, "seq", "EventType", "EventTime") == [
        (1, "Manufactured", "2024-01-01 00:00"), (2, "Sold", "2024-01-15 00:00"),
        (3, "Repair", "2025-03-15 00:00"), (4, "Disposed", "2025-10-20 00:00")]


def test_recent_instances(seed):
    got = events.recent_instances(seed.product_instances, seed.lifecycle_events, n=2)
    assert [tuple(r) for r in got.collect()] == [
        (4, "ECO-0002", "Disposed", "P200"), (3, "ECO-0001", "Recycled", "P200")]


def test_composition_share(seed):
    got = {(r.ComponentID, r.MaterialID): r.share_pct for r in
           bom.composition_share(seed.component_composition, seed.raw_materials).collect()}
    assert got[("C101", "M4")] == 75.0 and got[("C101", "M2")] == 25.0
    assert got[("C103", "M3")] == 85.7 and got[("C103", "M1")] == 14.3
    for c in ("C102", "C201", "C202", "C300"):
        assert [v for (k, _), v in got.items() if k == c] == [100.0]


def test_trace_and_passport(seed):
    tr = bom.trace_all(seed.components, seed.bill_of_material, seed.component_composition,
                       seed.raw_materials)
    assert tr.count() == 9
    assert tr.filter((F.col("ComponentID") == "C300") & (F.col("MaterialID") == "M5")).count() == 2
    roll = rows(bom.trace_rollup(seed.components, seed.bill_of_material,
                                 seed.component_composition, seed.raw_materials),
                "ComponentID", "MaterialID", "n_rows", "total_weight")
    assert ("C300", "M5", 2, 50.0) in roll and len(roll) == 8
    p = bom.material_passport(seed.product_root, seed.bill_of_material, seed.components,
                              seed.component_composition, seed.raw_materials)
    by = p.groupBy("ProductID").agg(F.count("*").alias("n"), F.sum("WeightInGrams").alias("w"))
    assert rows(by) == [("P100", 6, Decimal("775.00")), ("P200", 3, Decimal("175.00"))]
    roll = rows(bom.passport_rollup(seed.product_root, seed.bill_of_material, seed.components,
                                    seed.component_composition, seed.raw_materials))
    assert roll == [("P100", 6, 775.0, 1), ("P200", 3, 175.0, 1)]
    rep = bom.trace_report(p, "P100").collect()
    assert [r.ComponentName for r in rep][0] == "15-inch Screen Unit"
    assert {r.IsHazardous for r in rep} == {"Yes", "No"}


def test_recycle_events_global(seed):
    ev = gates.recycle_events(seed.product_instances, seed.product_root, seed.bill_of_material,
                              seed.component_composition, seed.raw_materials, AS_OF)
    assert {r.EventType for r in ev.collect()} == {"Recycled_Hazardous"}
    assert ev.count() == 4


def test_sourcing_detail(seed):
    d = sourcing.sourcing_detail(seed.suppliers, seed.sourcing, seed.components,
                                 seed.raw_materials).collect()
    assert len(d) == 6
    assert d[0].SupplierName == "EcoMaterials Ltd."
    s1 = [r for r in d if r.SupplierID == "S1"]
    assert {r.ComponentName for r in s1} == {"15-inch Screen Unit", "Universal Logic Board"}
    assert {r.MaterialName for r in s1} == {"-"}
    summ = sourcing.supplier_summary(seed.sourcing, seed.suppliers, "s2")
    assert rows(summ, "SupplierName", "MaterialID") == [("EcoMaterials Ltd.", "M2"),
                                                       ("EcoMaterials Ltd.", "M4")]


def test_seed_audit_is_clean(seed):
    rep = audits.audit_report(seed)
    bad = [r for r in rep.collect() if r.violations]
    assert bad == []
    assert rep.count() == len(audits.RULES)
