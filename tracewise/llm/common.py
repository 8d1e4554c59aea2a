"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Fixed: a word is a run of characters that are none of space, \t \n \v \f \r.
WORD_SQL = r"[^\x20\x09-\x0D]+"


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, so that models and
    memo tables outlast one task (functions shipped by value get fresh
    globals each time, hence the module entry). A worker keeps those of one operator
    only: asking for another operator's dict releases the one before."""
    holder = sys.modules.setdefault("_tracewise_llm_worker", types.ModuleType("_tracewise_llm_worker")).__dict__
    if holder.get("name") != name:
        holder.update(name=name, cache={})
        pa.default_memory_pool().release_unused()
    return holder["cache"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet below ``spark.checkpoint.dir`` and read
    back: cuts the lineage on the shared folder. The path is added to ``scratch``
    if given, so that the caller can remove it with :func:`drop`."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch tables this operator has written and no longer needs."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    paths.clear()


#: join_small broadcasts a table only below this measured size.
BROADCAST_ROWS, BROADCAST_BYTES, SALTS = 100_000, 8 << 20, 32


def join_small(big: DataFrame, small: DataFrame, key: str, salt_by: str = "doc_id") -> DataFrame:
    """Left join of ``big`` to a table with unique ``key`` that is usually small.

    ``small`` must be cheap to read twice (a stored table). Its rows and key
    bytes are counted; below the bound it is broadcast, beyond it ``big`` is
    salted by a hash of ``salt_by`` and ``small`` repeated per salt, so that a
    hot key is dealt over SALTS tasks. Null keys match null keys.
    """
    size = small.agg(F.count("*").alias("n"), F.coalesce(F.sum(
        F.octet_length(F.col(key).cast("string")) + 64), F.lit(0)).alias("b")).first()
    if size.n <= BROADCAST_ROWS and size.b <= BROADCAST_BYTES:
        s = F.broadcast(small.withColumnRenamed(key, "_key"))
        return big.join(s, big[key].eqNullSafe(s["_key"]), "left").drop("_key")
    s = small.withColumnRenamed(key, "_key").withColumn(
        "_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    b = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    return b.join(s, (b["_salt"] == s["_salt2"]) & b[key].eqNullSafe(s["_key"]), "left") \
        .drop("_key", "_salt", "_salt2")


def fewest_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hash of ``key``. A hash threshold at twice the
    wanted share thins the rows out where they are read, so the one task that picks sees
    about 2 x ``most`` rows however large the table is."""
    share = min(1.0, 2.0 * most / max(1, rows.count()))
    h = F.xxhash64(key)
    return rows.where(h <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))).orderBy(h, key).limit(most)


def input_slices(spark: SparkSession, least: int = 8) -> int:
    """Number of partitions for work dealt out by the operator itself."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_slices(lengths: list[int], limit: int):
    """(start, end) ranges of consecutive rows with about ``limit`` bytes each
    (one row at least), so that batches are balanced by bytes, not by rows."""
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)
