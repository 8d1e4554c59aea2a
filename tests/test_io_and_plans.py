"""Sources, sinks, model persistence and the page plans."""

from conftest import rows
from tracewise.functions import scalar
from tracewise.operators import features, model, sinks
from tracewise.plans import reports
from tracewise.sources import lookups
from tracewise.sources.tables import TABLE_NAMES, load_all


def test_load_all_roundtrip(spark, seed, tmp_path):
    for fmt in ("parquet", "csv", "json"):
        base = tmp_path / fmt
        for name in TABLE_NAMES:
            w = getattr(seed, name).write.mode("overwrite")
            if fmt == "csv":
                w = w.option("header", "true")
            getattr(w, fmt)(str(base / name))
        back = load_all(spark, str(base), fmt)
        for name in TABLE_NAMES:
            assert rows(getattr(back, name)) == rows(getattr(seed, name)), (fmt, name)


def test_sinks(spark, seed, tmp_path):
    js = sinks.to_json_rows(seed.products).collect()
    assert js[0].json.startswith('{"ProductID":')
    sinks.write_json(seed.products, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    for _ in range(2):
        sinks.append(seed.suppliers, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 6
    assert sinks.preview(seed.lifecycle_events, 5).count() == 5
    ch = dict(rows(sinks.chart_series(seed.component_composition.join(
        seed.raw_materials, "MaterialID"), "ComponentID", "MaterialName", "WeightInGrams",
        order="MaterialID")))
    assert ch["C101"] == '{"labels":["Plastic (ABS)","Glass (Gorilla)"],"weights":[50.0,150.0]}'


def test_lookups(seed):
    m = dict(rows(lookups.material_options(seed), "MaterialID", "label"))
    assert m["M3"] == "Lithium-Ion (Hazard)" and m["M1"] == "Aluminum"
    p = dict(rows(lookups.product_options(seed), "ProductID", "label"))
    assert p["P100"] == "P100 — Alpha Laptop 15-inch"
    assert lookups.instance_options(seed).count() == 4
    assert lookups.component_options(seed).count() == 8
    assert lookups.supplier_list(seed).count() == 3


def test_model_save_load(spark, tmp_path):
    data = [(i, float(i % 10), 1 if i % 10 >= 5 else 0) for i in range(100)]
    df = spark.createDataFrame(data, "InstanceID long, x double, target int")
    fitted = model.fit_logistic(df, ["x"])
    path = model.save(fitted, str(tmp_path / "m"))
    again = model.load(path)
    a = rows(model.predict(fitted, df), "InstanceID", "prediction")
    b = rows(model.predict(again, df), "InstanceID", "prediction")
    assert a == b


def test_page_plans(seed):
    d = reports.dashboard_view(seed)
    assert d["score"].first().score == 1.92
    lr = reports.lifecycle_report(seed, 2, "2025-12-01")
    assert lr["instance"].first().age_days == 699
    assert [r.EventType for r in lr["timeline"].collect()] == ["Manufactured", "Sold", "Recycled"]
    tr = reports.trace_report(seed, "p200")   # key parameters compare case-insensitively
    assert tr["product"].first().ModelName == "Eco Smartphone Model 5"
    assert tr["trace"].count() == 3
    assert sorted(r.ComponentID for r in reports.hierarchy_report(seed).collect()) == \
        ["C100", "C200"]
    assert reports.suppliers_view(seed).count() == 6


def test_scalar_helpers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" 12 ", "", "2024-05-06 07:08:09")], "a string, b string, t string")
    r = df.select(scalar.to_key("a").alias("k"), scalar.display_or_dash("b").alias("d"),
                  scalar.event_time(F.col("t").cast("timestamp_ntz")).alias("e"),
                  scalar.to_weight(F.lit("1.005")).alias("w")).first()
    assert (r.k, r.d, r.e, str(r.w)) == (12, "-", "2024-05-06 07:08", "1.01")
    assert features.FEATURES[0] == "total_weight"
