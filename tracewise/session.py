"""Spark session helpers.

The library never creates a session behind the caller's back: every operator
takes DataFrames. These helpers exist for the bench, the tests and the
command-line runs, and for the one thing operators need from the session,
the shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Sessions built here get these settings; a cluster job passes its own.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime (post-shuffle) broadcast decision: only sides whose measured
    # size is below this are broadcast; everything else stays a shuffle join.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # transformWithState (streaming disposal gate) needs RocksDB state.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tracewise", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (cluster jobs bring their own)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared file system; it is read from the
    session and never replaced. Only where it is unset on a local master
    (tests) a fresh scratch folder is made and set; elsewhere that is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder "
                               "(a machine-local one would be lost with its executor)")
        configured = tempfile.mkdtemp(prefix="tracewise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path below the shared checkpoint folder (for sinks and streams)."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tracewise/{name}-{uuid.uuid4().hex[:12]}"


def checkpointed(df):
    """``df`` written to the shared checkpoint folder and read back (cuts the
    lineage, so later stages and retries read fixed data). Columns are stored as Parquet,
    so a later scan reads only those it needs; rows may come back in another order and other partitions."""
    return stored(df, "checkpoint")


def stored(df, name: str, scratch: list[str] | None = None):
    """``df`` written once as Parquet below the shared checkpoint folder and read
    back: the lineage is cut and later scans read only the columns they need.
    The path is added to ``scratch`` if given, for :func:`drop`."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch tables that are no longer needed."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    paths.clear()


def cluster_conf(total_cores: int, input_tb: float = 100.0) -> dict[str, str]:
    """Settings we would start a large job with (a starting point, not a rule).

    Many initial shuffle partitions (about 2-3 per core, at least one per
    ~1 GB of input) that AQE coalesces to ~256 MB each after measuring; file
    splits of 512 MB; skew splitting on; runtime broadcast only under the
    measured threshold. Checkpoints go to ``spark.checkpoint.dir``, which the
    cluster sets to a shared file system.
    """
    partitions = max(3 * total_cores, int(input_tb * 1024))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512MB",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
        "spark.sql.autoBroadcastJoinThreshold": "64MB",
        "spark.sql.files.maxPartitionBytes": "512MB",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }

