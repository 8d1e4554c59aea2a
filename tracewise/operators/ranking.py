"""Row numbers within a key that stay balanced when one key holds most rows.

``row_number().over(Window.partitionBy(key).orderBy(...))`` sends every row
of a key to one task. ``sequence_within`` cuts each key into slices by a
column that never decreases along the order (for events: the hour of the
event), numbers rows inside each (key, slice), then adds the sizes of the
key's earlier slices. The slice sizes come from a map-side-combined count,
and only that small table (one row per key and slice) is ordered per key.
Everything is derived from data, so a recomputed task gives the same numbers.

``running_within`` needs no such column: it range-partitions the rows on (key,
order), so a hot key fills as many partitions as its rows need, numbers and sums
inside each (partition, key), and carries the counts and sums of a key's earlier
partitions across the borders. Only the first and the last key of a partition can
cross a border, so the carried table has at most two rows per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def sequence_within(df: DataFrame, key: str, order: list[str | Column], slice_by: Column,
                    out: str = "seq") -> DataFrame:
    """Add ``out`` = 1-based position of each row within ``key`` by ``order``.

    ``order`` must be unique within a key (add a tie-break column) and
    ``slice_by`` must be non-decreasing along it (e.g. a truncation of the
    first order column), NULLs first like the ascending order.
    """
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    # One struct key (key, slice): plain equality on structs treats NULL
    # fields as equal, and the window and the join then share one hash
    # partitioning, so the big side is shuffled once.
    d = df.withColumn("_slice", slice_by).withColumn(
        "_ks", F.struct(F.col(key).alias("k"), F.col("_slice").alias("s")))
    local = d.withColumn("_pos", F.row_number().over(
        Window.partitionBy("_ks").orderBy(*order_cols)))
    sizes = d.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(key).orderBy(F.col("_slice").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.struct(F.col(key).alias("k"), F.col("_slice").alias("s")).alias("_ks"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    return (local.join(offsets, "_ks")
            .withColumn(out, (F.col("_pos") + F.col("_off")).cast("int"))
            .drop("_slice", "_pos", "_off", "_ks"))


def running_within(df: DataFrame, key: str | list[str], order: list[str], out: str = "seq",
                   sums: dict[str, str] | None = None, partitions: int | None = None,
                   scratch: list[str] | None = None) -> DataFrame:
    """Add ``out`` = 1-based position (long) of each row within ``key`` by ``order``,
    NULLs first, and for every (name, column) of ``sums`` the running total of that
    long column up to and including the row.

    ``order`` must be unique within a key. The range-partitioned rows are stored once
    below the checkpoint folder (the path goes to ``scratch``), so the partition
    borders are fixed for every later read and every retried task.
    """
    keys, sums = [key] if isinstance(key, str) else key, sums or {}
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(parts, *keys, *order)
                  .withColumn("_part", F.spark_partition_id()), "running", scratch)
    # one struct key: equality on structs treats NULL fields as equal
    piece = F.struct(F.col("_part").alias("p"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    rows = rows.withColumn("_ks", piece)
    ends = rows.groupBy("_part").agg(F.min("_ks").alias("lo"), F.max("_ks").alias("hi"))
    border = F.broadcast(ends.select(F.explode(F.array("lo", "hi")).alias("_ks")).distinct())  # two rows a partition
    carried = rows.join(border, "_ks", "left_semi").groupBy("_ks").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    before = Window.partitionBy(*[F.col(f"_ks.k{i}") for i in range(len(keys))]).orderBy("_ks.p") \
        .rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("_ks", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c + "_before")
                                      for c in ["_n"] + [f"_s{i}" for i in range(len(sums))]])
    inside = Window.partitionBy("_ks").orderBy(*[F.col(o).asc_nulls_first() for o in order])
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", F.row_number().over(inside).alias("_n"),
                        *[F.sum(c).over(so_far).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    add = lambda c: F.col(c) + F.coalesce(F.col(c + "_before"), F.lit(0))
    return local.join(F.broadcast(carried), "_ks", "left").select(
        *df.columns, add("_n").cast("long").alias(out),
        *[add(f"_s{i}").alias(name) for i, name in enumerate(sums)])


def concat_within(df: DataFrame, key: str, order: list[str], item: str, out: str, sep: str = ", ",
                  count: str | None = None, partitions: int | None = None) -> DataFrame:
    """(key, ``out``): the non-null ``item`` texts of each key joined in ``order``; with ``count`` also
    the number of its rows.

    Two levels: rows are range-partitioned on (key, order), every (partition, key) joins its own
    items, and the strings are joined in the order of the partitions. A hot key's rows
    are thus sorted and joined in as many tasks as they fill; only the strings meet in one.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id())
    by = ", ".join(f"`{o}`" for o in order)
    pieces = rows.groupBy(key, "_part").agg(
        F.expr(f"listagg(`{item}`, '{sep}') within group (order by {by})").alias("_piece"), F.count(F.lit(1)).alias("_rows"))
    whole = pieces.groupBy(key).agg(
        F.expr(f"listagg(_piece, '{sep}') within group (order by _part)").alias(out), F.sum("_rows").alias("_rows"))
    return whole.withColumnRenamed("_rows", count) if count else whole.drop("_rows")
