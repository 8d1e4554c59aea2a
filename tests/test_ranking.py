"""Positions and running totals by prefix sums over range partitions."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewise.operators import events
from tracewise.operators.ranking import running_within


def test_running_within_equals_window_with_hot_and_null_keys(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None).cast("string")) \
        .otherwise((F.col("id") % 50).cast("string"))
    df = spark.range(5000).select(key.alias("k"), F.pmod(F.xxhash64("id"), F.lit(40)).alias("t"), "id",
                                  (F.col("id") % 11).alias("v"))
    df = df.withColumn("t", F.when(F.col("t") > 3, F.col("t")))
    got = running_within(df, "k", ["t", "id"], "pos", {"total": "v"}, partitions=13)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("*", F.row_number().over(w).cast("long").alias("pos"),
                     F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert running_within(df.limit(0), "k", ["t", "id"]).count() == 0


def test_two_key_columns(spark):
    df = spark.range(600).select((F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"), "id")
    got = running_within(df, ["a", "b"], ["id"], partitions=7)
    w = Window.partitionBy("a", "b").orderBy("id")
    want = df.withColumn("seq", F.row_number().over(w).cast("long"))
    assert got.exceptAll(want).isEmpty()


def test_hot_instance_at_midnight_is_even_over_tasks(spark):
    """A third of all events on one instance, every event on one date without a time."""
    le = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("InstanceID"), F.col("id").alias("EventID"),
        F.lit("Sold").alias("EventType"), F.lit("2024-01-01").cast("timestamp_ntz").alias("EventDate"))
    scratch = []
    hot = running_within(le, "InstanceID", ["EventDate", "EventID"], partitions=16, scratch=scratch)
    assert hot.where("InstanceID = 0").agg(F.max("seq")).first()[0] == 10_000
    sizes = [r["count"] for r in spark.read.parquet(scratch[0]).groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * np.mean(sizes)
    seen = events.timeline(le).where("InstanceID = 0").select("seq", "EventID").orderBy("seq").collect()
    assert [r["seq"] for r in seen] == list(range(1, 10_001))
    assert [r["EventID"] for r in seen] == list(range(0, 30_000, 3))
