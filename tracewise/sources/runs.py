"""Re-runnable appends to several tables.

A run has a key given by its caller (a batch's name, a date). Its rows are first staged, ids
included, below ``<root>/_runs/<key>``; the empty file ``_STAGED`` there is the manifest's
first line and closes the set. Then every table gets the staged rows that it does not hold yet (anti-join on its
key), and ``_DONE`` ends the run. A run that died anywhere is run again under the same key: staged rows
are taken as they are, so ids do not move, and only what is missing is added.

Ids follow the tables' highest ones, so two runs must not overlap: a new run is refused while another is staged and not
done. One writer at a time per set of tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.skew import plain
from . import versions


class UnfinishedRun(RuntimeError):
    """Another run is staged and not done: run it again under its own key first."""


@dataclass(frozen=True)
class Target:
    """A table that a run appends to: ``read`` its present rows, ``append`` more, its key columns."""

    name: str
    key: tuple[str, ...]
    read: Callable[[], DataFrame]
    append: Callable[[DataFrame], None]


def pending(spark: SparkSession, root: str) -> list[str]:
    """Keys of the runs that are staged and not done."""
    folder = f"{root}/_runs"
    return [k for k in versions.names(spark, folder)
            if "_STAGED" in (found := versions.names(spark, f"{folder}/{k}")) and "_DONE" not in found]


def missing(staged: DataFrame, present: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The staged rows whose key the table does not hold."""
    return staged.join(plain(present.select(*key)), list(key), "left_anti").select(*staged.columns)


def commit(spark: SparkSession, root: str, run: str, compute: Callable[[], dict[str, DataFrame]],
           targets: list[Target]) -> dict[str, DataFrame]:
    """Append what ``compute`` returns for each target (by name) under the run's key; returns all
    it staged, read back (entries without a target, such as refused rows, are staged only)."""
    folder = f"{root}/_runs/{run}"
    others = [k for k in pending(spark, root) if k != run]
    if others:
        raise UnfinishedRun(f"run {others[0]!r} on {root} is staged and not done; run it again first")
    found = versions.names(spark, folder)
    if "_STAGED" not in found:
        for name, df in compute().items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        versions.create(spark, f"{folder}/_STAGED")
    staged = {n: spark.read.parquet(f"{folder}/{n}") for n in versions.names(spark, folder) if not n.startswith("_")}
    if "_DONE" not in found:
        for t in targets:
            t.append(missing(staged[t.name], t.read(), t.key))
        versions.create(spark, f"{folder}/_DONE")
    return staged
