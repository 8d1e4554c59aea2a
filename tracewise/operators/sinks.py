"""Outputs: JSON rows, chart series, appends, previews.

Everything stays distributed: JSON is built per row on the executors and
written as files; nothing is collected to the driver except an explicitly
bounded preview.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object text per row, column ``json``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines files, one object per row."""
    df.write.mode(mode).json(path)


def chart_series(df: DataFrame, key: str, label: str, value: str,
                 order: str | Column | None = None) -> DataFrame:
    """Per ``key`` a chart payload ``{"labels": [...], "weights": [...]}`` as
    JSON text, points in ``order`` (default the label) (S5, F11).

    Points are gathered in two levels: range partitions on (key, order) sort their own, the
    sorted pieces are joined in order, so a key with very many points is sorted in several tasks.
    """
    o = F.col(order) if isinstance(order, str) else (order if order is not None else F.col(label))
    pts = df.select(key, o.alias("_o"), F.col(label).alias("_l"),
                    F.col(value).cast("double").alias("_v"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pts.repartitionByRange(parts, key, "_o", "_l", "_v").withColumn("_part", F.spark_partition_id()) \
        .groupBy(key, "_part").agg(F.sort_array(F.collect_list(F.struct("_o", "_l", "_v"))).alias("_piece"))
    agg = pieces.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_part", "_piece"))).alias("_pieces")) \
        .withColumn("_pts", F.flatten(F.transform("_pieces", lambda p: p["_piece"])))
    payload = F.struct(F.transform("_pts", lambda p: p["_l"]).alias("labels"),
                       F.transform("_pts", lambda p: p["_v"]).alias("weights"))
    return agg.select(key, F.to_json(payload).alias("chart"))


def append(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None
           ) -> None:
    """Append admitted rows to a table folder (S7). Re-running a failed job
    is safe only for writers that key on ids; gates assign ids first."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def append_table(df: DataFrame, table: str) -> None:
    """Append to a catalog table (S7), keeping its layout (bucketing,
    sorting); columns are matched to the table's by name."""
    cols = df.sparkSession.table(table).columns
    df.select(*cols).write.insertInto(table)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows (S8) — a bounded peek, the only driver-side read here."""
    return df.limit(n)
