"""Running the streaming operators over the driver's files.

Sources are file streams over the driver's folder; sinks are parquet below
the shared checkpoint folder, and every query keeps its progress in a
checkpoint there, so a restarted run resumes where the last one committed.
``availableNow`` processes what is present and stops. All files present are one
batch unless ``max_files`` cuts them. The set-based disposal gate gives one result for
any cut; the keyed one never admits wrongly, but refuses for good (see ``disposal.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.dashboard import event_distribution, merge_spellings
from ..session import scratch_path
from ..sources import versions
from ..sources.testdata import events_as_lifecycle
from .disposal import disposal_gate_stream

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, " \
                "value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet",
                 max_files: int | None = None) -> DataFrame:
    """The driver's events folder as a lifecycle-event stream."""
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return events_as_lifecycle(reader.parquet(folder))


def run_disposal_gate(spark: SparkSession, folder: str, out: str | None = None,
                      checkpoint: str | None = None,
                 max_files: int | None = None) -> str:
    """Run X1 to completion over the files present; returns the output path."""
    out = out or scratch_path(spark, "stream-disposal-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-disposal-ckpt")
    q = (disposal_gate_stream(event_stream(spark, folder, max_files=max_files))
         .writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return out


def run_outcomes(spark: SparkSession, folder: str, out: str | None = None,
                 checkpoint: str | None = None,
                 max_files: int | None = None) -> str:
    """Run X2 (running event distribution, complete mode): each micro-batch publishes the full,
    small result as a new version of the table ``out``, so a reader (``versions.read_current``)
    sees one whole result at any time; returns the path of the newest version."""
    out = out or scratch_path(spark, "stream-outcomes-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-outcomes-ckpt")

    def publish(df: DataFrame, epoch: int) -> None:
        versions.publish(merge_spellings(df), out)

    # the state counts exact spellings (hash aggregate); spellings are merged per epoch
    q = (event_distribution(event_stream(spark, folder, max_files=max_files), case_insensitive=False)
         .writeStream.outputMode("complete").foreachBatch(publish)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return versions.current(spark, out)
