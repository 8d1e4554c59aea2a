"""Joins with a third of all rows on one key, broadcasts off: adaptive execution splits the hot partition."""

import pytest
from pyspark.sql import functions as F

from tracewise.operators import bom, features, gates, sourcing

CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false"}
N, KEYS = 60_000, 3_000


@pytest.fixture(autouse=True)
def conf(spark):
    old = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keyed(spark, n, prefix):
    """n rows (id, k); the key of every third row is prefix0."""
    k = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % KEYS)
    return spark.range(n).withColumn("k", F.concat(F.lit(prefix), k.cast("string")))


@pytest.fixture
def t(spark):
    ids = spark.range(KEYS)
    name = lambda p: F.concat(F.lit(p), F.col("id").cast("string"))
    return {
        "components": ids.select(name("X").alias("ComponentID"), name("part ").alias("ComponentName")),
        "rm": spark.range(50).select(name("M").alias("MaterialID"), name("stuff ").alias("MaterialName"),
                                     F.lit("A").alias("RecyclableGrade"), (F.col("id") % 2 == 0).alias("IsHazardous")),
        "cc_hot": keyed(spark, N, "X").select(F.col("k").alias("ComponentID"), F.concat(F.lit("M"), (F.col("id") % 50).cast("string")).alias("MaterialID"),
                                              (F.rand(1) * 100).cast("decimal(10,2)").alias("WeightInGrams")),
        "cc": spark.range(KEYS * 2).select(F.concat(F.lit("X"), (F.col("id") % KEYS).cast("string")).alias("ComponentID"),
                                           F.concat(F.lit("M"), (F.col("id") % 50).cast("string")).alias("MaterialID"),
                                           F.lit(1).cast("decimal(10,2)").alias("WeightInGrams")),
        "bom": keyed(spark, N, "X").select(F.concat(F.lit("R"), (F.col("id") % KEYS).cast("string")).alias("ParentComponentID"),
                                           F.col("k").alias("ChildComponentID"), F.lit(1).alias("Quantity")),
        "root": ids.select(name("P").alias("ProductID"), name("R").alias("ComponentID")),
        "products": ids.select(name("P").alias("ProductID"), name("model ").alias("ModelName")),
        "pi": keyed(spark, N, "P").select(F.col("id").alias("InstanceID"), F.col("k").alias("ProductID")),
        "le": spark.range(1000).select(F.col("id").alias("EventID"), F.col("id").alias("InstanceID"), F.lit("Recycled").alias("EventType"),
                                       F.lit("2024-01-01").cast("timestamp_ntz").alias("EventDate")),
        "suppliers": ids.select(name("S").alias("SupplierID"), name("firm ").alias("SupplierName")),
        "so": keyed(spark, N, "S").select(F.col("k").alias("SupplierID"), F.concat(F.lit("X"), F.col("id").cast("string")).alias("ComponentID"),
                                          F.lit(None).cast("string").alias("MaterialID")),
    }


def _sales(t):
    """One stored sale per instance; a batch of disposals, a third of them of one instance."""
    hot = t["so"].select(F.col("SupplierID").alias("InstanceID"), F.monotonically_increasing_id().alias("EventID"), F.lit("Disposed").alias("EventType"))
    sold = t["suppliers"].select(F.col("SupplierID").alias("InstanceID"), F.lit(0).cast("long").alias("EventID"), F.lit("Sold").alias("EventType"))
    return sold, hot


CASES = {
    "composition_share": lambda t: bom.composition_share(t["cc_hot"], t["rm"]),
    "trace_all": lambda t: bom.trace_all(t["components"], t["bom"], t["cc"], t["rm"]),
    "material_passport": lambda t: bom.material_passport(t["root"], t["bom"], t["components"], t["cc"], t["rm"]),
    "passport_rollup": lambda t: bom.passport_rollup(t["root"], t["bom"], t["components"], t["cc"], t["rm"]),
    "hazard_usage_by_product": lambda t: bom.hazard_usage_by_product(t["products"], t["root"], t["bom"], t["cc"], t["rm"]),
    "features_by_product": lambda t: features.features_by_product(t["pi"], t["products"], t["root"], t["bom"], t["cc"], t["rm"], t["le"]),
    "trace_rollup": lambda t: bom.trace_rollup(t["components"], t["bom"], t["cc_hot"], t["rm"]),
    "disposal_gate": lambda t: gates.disposal_gate(*_sales(t)),
    "recycle_by_product": lambda t: gates.recycle_events(t["pi"], t["root"], t["bom"], t["cc"], t["rm"], "2024-01-01", scope="product"),
    "sourcing_ids": lambda t: sourcing.sourcing_ids(t["suppliers"], t["so"]),
    "sourcing_detail": lambda t: sourcing.sourcing_detail(t["suppliers"], t["so"], t["components"], t["rm"]),
    "key_flag": lambda t: gates._key_flag(t["so"], t["suppliers"], [F.col("SupplierID")], ["SupplierID"], "known"),
    "flag_join": lambda t: gates._flag_join(t["so"], t["suppliers"].select("SupplierID"), "SupplierID", "known"),
    "first_per_key": lambda t: gates._first_per_key(t["so"], "SupplierID", "ComponentID", F.lit(True)),
}


@pytest.mark.parametrize("name", CASES)
def test_hot_key_is_split(t, name):
    plan = CASES[name](t)._jdf.queryExecution()
    plan.toRdd().count()
    assert "skew=true" in plan.executedPlan().toString()


def test_suppliers_without_rows_are_kept(spark, t):
    few = t["suppliers"].limit(5)
    rows = t["so"].where("SupplierID = 'S1'")
    got = sourcing.sourcing_ids(few, rows)
    want = few.join(rows, "SupplierID", "left").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
