"""Tables whose readers always see one whole version.

A version is a folder of its own below ``<folder>/_versions``, written completely before
an empty file ``<folder>/_current/<number>.<version>`` is created, which is one atomic step on a
shared file system or object store. Readers take the highest number. Names that start with an underscore are
hidden from a plain read of the folder, so a plain table folder becomes version 0 by the first publish.
One writer per table at a time; a writer that dies before the last step leaves nothing a reader sees.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted (none if there is no such folder)."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def create(spark: SparkSession, path: str) -> bool:
    """Create an empty file in one step; false if it was there."""
    fs, p = _fs(spark, path)
    return fs.createNewFile(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, written under another name and renamed; replaces an older one."""
    fs, p = _fs(spark, path)
    other = p.suffix("." + uuid.uuid4().hex[:8])
    stream = fs.create(other, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(other, p)


def read_text(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def current(spark: SparkSession, folder: str) -> str | None:
    """Path of the newest version; None where nothing was published."""
    found = names(spark, f"{folder}/_current")
    return f"{folder}/_versions/{found[-1].split('.', 1)[1]}" if found else None


def read_current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of the table (a plain folder: its files)."""
    return spark.read.parquet(current(spark, folder) or folder)


def publish(df: DataFrame, folder: str, keep: int = 2) -> str:
    """Write ``df`` as the newest version and switch readers to it; returns its path. ``df`` may read
    the current version. The last ``keep`` versions stay for readers that have begun on them."""
    spark = df.sparkSession
    found = names(spark, f"{folder}/_current")
    number = int(found[-1].split(".", 1)[0]) + 1 if found else 1
    name = f"v{number}-{uuid.uuid4().hex[:12]}"
    path = f"{folder}/_versions/{name}"
    df.write.parquet(path)
    create(spark, f"{folder}/_current/{number:012d}.{name}")
    for old in found[:len(found) + 1 - keep]:
        remove(spark, f"{folder}/_current/{old}")
        remove(spark, f"{folder}/_versions/{old.split('.', 1)[1]}")
    return path
