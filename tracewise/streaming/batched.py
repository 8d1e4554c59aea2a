"""Streaming disposal gate, set-based per micro-batch (X1, second form).

The keyed-state form (``disposal.py``) calls Python once per instance and
micro-batch. This form keeps the work in the JVM. Its state is a table below the shared checkpoint
folder with two kinds of rows: per instance its first Sold event, and the Disposed events that have no earlier
sale yet (held back). The table is dealt by a hash of the instance into buckets; a
micro-batch reads and rewrites only the buckets its Sold and Disposed rows fall into,
each as one merged folder, so the cost of a batch follows its own buckets and not the number of
batches before it. A held row whose sale has come is admitted in that batch and leaves the state.

A manifest per epoch names for every bucket the epoch that wrote it last. An epoch reads the manifest
of the one before and writes folders and manifest of its own, so a retried epoch gives the same
result (exactly-once with an idempotent sink); folders that neither of the last two manifests names are removed.

Files need not come in EventID order. When the run has read the files present, the rows still held are
published as refused (a versioned table: a later run, which may admit some of them, replaces it by switching a
pointer). The decisions are thus those of the batch gate over all files, however they are cut into micro-batches or runs.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalar import ci
from ..operators.gates import REASON, with_status
from ..operators.skew import plain
from ..session import scratch_path
from ..sources import versions
from .runner import event_stream

COLUMNS = ["EventID", "InstanceID", "EventType"]
ROWS = "EventID bigint, InstanceID bigint, EventType string"
#: Buckets of the state; the list of touched ones and the manifest have at most this many entries.
BUCKETS = 32


def _is(kind: str):
    return F.coalesce(ci("EventType") == kind, F.lit(False))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("InstanceID"), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, state: str, before: int | None = None) -> dict[int, int]:
    """Bucket -> epoch that wrote it, of the newest manifest (of an epoch below ``before``)."""
    found = [n for n in versions.names(spark, f"{state}/_manifest") if n.isdigit() and (before is None or int(n) < before)]
    return {int(k): v for k, v in json.loads(versions.read_text(spark, f"{state}/_manifest/{found[-1]}")).items()} if found else {}


def _state(spark: SparkSession, state: str, manifest: dict[int, int], buckets: list[int]) -> DataFrame:
    """State rows of the given buckets."""
    paths = [f"{state}/epoch={manifest[b]}/bucket={b}" for b in buckets if b in manifest]
    return spark.read.schema(ROWS).parquet(*paths) if paths else spark.createDataFrame([], ROWS)


def _merge(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Disposed rows of batch and state with ``_first``, the first sale before them or null; first sales)."""
    both = state.select(*COLUMNS).unionByName(rows.select(*COLUMNS))
    sold = both.filter(_is(schemas.SOLD)).groupBy("InstanceID").agg(F.min("EventID").alias("_first"))
    # the aggregate joined plain: the Disposed rows of a hot instance are split
    disposed = both.filter(_is(schemas.DISPOSED)).join(plain(sold), "InstanceID", "left")
    return disposed.withColumn("_first", F.when(F.col("_first") < F.col("EventID"), F.col("_first"))), sold


def _accepted(df: DataFrame) -> DataFrame:
    return with_status(df.select(*COLUMNS).withColumn(REASON, F.lit(None).cast("string")))


def run_disposal_gate_batched(spark: SparkSession, folder: str, out: str | None = None,
                              checkpoint: str | None = None, max_files: int | None = None,
                              buckets: int = BUCKETS) -> str:
    """Run the set-based streaming gate over the files present; returns the output path (see :func:`gate_output`)."""
    out = out or scratch_path(spark, "stream-gate-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-gate-ckpt")
    state = f"{checkpoint.rstrip('/')}-state"

    def step(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        rows = batch.select(*COLUMNS).persist()      # read twice; recomputed from the files if lost
        deciding = rows.filter(_is(schemas.SOLD) | _is(schemas.DISPOSED))
        touched = sorted(r["b"] for r in deciding.select(_bucket(buckets).alias("b")).distinct().collect())
        before = _manifest(session, state, epoch)
        disposed, sold = _merge(deciding, _state(session, state, before, touched))
        # rows other than Disposed are always admitted, Disposed ones once their sale is known
        admitted = rows.filter(~_is(schemas.DISPOSED)).unionByName(disposed.filter("_first is not null").select(*COLUMNS))
        _accepted(admitted).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        left = disposed.filter("_first is null").select(*COLUMNS).unionByName(
            sold.select(F.col("_first").alias("EventID"), "InstanceID", F.lit(schemas.SOLD).alias("EventType")))
        # one folder per bucket; adaptive execution splits a bucket that is much larger than the others
        left.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket") \
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/epoch={epoch}")
        versions.write_text(session, f"{state}/_manifest/{epoch:012d}", json.dumps({**before, **{b: epoch for b in touched}}))
        _clean(session, state, epoch, before)
        rows.unpersist()

    q = (event_stream(spark, folder, max_files=max_files).writeStream
         .foreachBatch(step).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    manifest = _manifest(spark, state)
    held = _state(spark, state, manifest, sorted(manifest)).filter(_is(schemas.DISPOSED))
    versions.publish(with_status(held.withColumn(REASON, F.lit(schemas.MSG_UNSOLD_DISPOSAL))), f"{out}-refused")
    return out


def _clean(spark: SparkSession, state: str, epoch: int, before: dict[int, int]) -> None:
    """Remove bucket folders that only manifests older than the one before ``epoch`` name."""
    older = [n for n in versions.names(spark, f"{state}/_manifest") if n.isdigit() and int(n) < epoch][:-1]
    for name in older:
        past = json.loads(versions.read_text(spark, f"{state}/_manifest/{name}"))
        for b, wrote in past.items():
            if before.get(int(b)) != wrote:
                versions.remove(spark, f"{state}/epoch={wrote}/bucket={b}")
        versions.remove(spark, f"{state}/_manifest/{name}")


def gate_output(spark: SparkSession, out: str) -> DataFrame:
    """Every event with its decision and epoch: the admitted ones, and the newest version of the refused ones (epoch -1)."""
    schema = f"{ROWS}, reason string, status string"
    return spark.read.schema(f"{schema}, epoch int").parquet(out).unionByName(
        spark.read.schema(schema).parquet(versions.current(spark, f"{out}-refused")).withColumn("epoch", F.lit(-1)))
