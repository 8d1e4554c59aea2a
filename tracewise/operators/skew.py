"""Joins in which one key may hold a third of the rows.

Adaptive execution splits a hot partition of a sort-merge join only if both
inputs come straight from a shuffle that the join asked for, and only on a side
whose rows the join type lets it deal out. An aggregate is already partitioned
by its key, so a join of raw rows to it stays unsplit. :func:`plain` hides
that partitioning: the join then shuffles the (reduced) aggregate once more, and
its other side can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: More partitions than any frame has: a coalesce to it merges none.
MOST_PARTITIONS = 1 << 20


def plain(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions, with no partitioning known to the planner."""
    return df.coalesce(MOST_PARTITIONS)


def dealt(df: DataFrame, slices: int | None, *keys: str) -> DataFrame:
    """``df`` partitioned by ``keys`` into ``slices`` tasks; unchanged if ``slices`` is None.

    The sorts and hash tables of a task grow with its share of the rows, so the number of tasks of a
    step over very many rows follows their number instead of the session's settings.
    """
    return df if slices is None else df.repartition(slices, *keys)
