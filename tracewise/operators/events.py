"""Lifecycle state, age, timeline, recent instances and recycle target
(W1, W2, W4, F4-F6, T-1, T-2, A14, J9)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalar import ci, ci_eq, event_time
from .ranking import running_within


def latest_events(le: DataFrame) -> DataFrame:
    """Newest event type per instance: latest EventDate, ties to the higher
    EventID (W1, T12). A map-side-combined aggregate, not a window, so a hot
    instance is reduced in every partition before the shuffle."""
    return le.groupBy("InstanceID").agg(
        F.max_by("EventType", F.struct("EventDate", "EventID")).alias("current_state"))


def latest_state(pi: DataFrame, le: DataFrame, default: str = schemas.NO_EVENTS) -> DataFrame:
    """Every instance with its newest event type, ``NoEvents`` without events."""
    return pi.select("InstanceID", "SerialNumber", "ProductID").join(
        latest_events(le), "InstanceID", "left").select(
        "InstanceID", "SerialNumber", "ProductID",
        F.coalesce(F.col("current_state"), F.lit(default)).alias("current_state"))


def recent_instances(pi: DataFrame, le: DataFrame, n: int = 10,
                     default: str = schemas.NO_EVENTS) -> DataFrame:
    """The ``n`` highest instance ids with their state (T-1, T-2).

    The top-n is taken first (a bounded TakeOrdered), so only those ``n``
    instances' events are aggregated; the n ids are broadcast (size n).
    """
    top = pi.select("InstanceID", "SerialNumber", "ProductID") \
        .orderBy(F.col("InstanceID").desc()).limit(n)
    ev = le.join(F.broadcast(top.select("InstanceID")), "InstanceID", "left_semi")
    return top.join(latest_events(ev), "InstanceID", "left").select(
        "InstanceID", "SerialNumber",
        F.coalesce(F.col("current_state"), F.lit(default)).alias("current_state"),
        "ProductID").orderBy(F.col("InstanceID").desc())


def first_manufactured(le: DataFrame) -> DataFrame:
    """Date of the earliest Manufactured event per instance."""
    return le.filter(ci_eq("EventType", schemas.MANUFACTURED)).groupBy("InstanceID").agg(
        F.min(F.to_date("EventDate")).alias("manufactured_on"))


def lifecycle_age(pi: DataFrame, le: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Days from first manufacture to ``as_of``; NULL without one.

    ``as_of`` is required: the stored function reads the current date, which
    would make results depend on the day they run.
    """
    day = F.lit(str(as_of)).cast("date")
    return pi.select("InstanceID", "SerialNumber").join(
        first_manufactured(le), "InstanceID", "left").select(
        "InstanceID", "SerialNumber",
        F.datediff(day, F.col("manufactured_on")).alias("age_days"))


def timeline(le: DataFrame, instance_id: int | None = None) -> DataFrame:
    """Events of each instance in time order, ties by EventID, with position
    ``seq`` and the report's time text (W4, F4).

    ``instance_id`` narrows to one instance (the report). Rows are range-partitioned on
    (instance, date, id) and numbered by prefix sums over the partitions, so an instance
    with very many events is split even where all of them carry one date.
    """
    ev = le if instance_id is None else le.filter(F.col("InstanceID") == instance_id)
    numbered = running_within(ev.select("InstanceID", "EventID", "EventType", "EventDate"),
                              "InstanceID", ["EventDate", "EventID"])
    return numbered.select("InstanceID", F.col("seq").cast("int").alias("seq"), "EventID", "EventType",
                           event_time("EventDate").alias("EventTime"))


def targets(le: DataFrame) -> DataFrame:
    """Per instance with events: 1 if ever recycled (either kind), else 0 if
    ever disposed, else NULL (A14, J9, P6). One map-side-combined aggregate."""
    et = ci("EventType")
    flags = le.groupBy("InstanceID").agg(
        F.max(et.isin(schemas.RECYCLED, schemas.RECYCLED_HAZARDOUS)).alias("_rec"),
        F.max(et == schemas.DISPOSED).alias("_dis"))
    target = F.when(F.col("_rec"), F.lit(1)).when(F.col("_dis"), F.lit(0)) \
        .otherwise(F.lit(None).cast("int"))
    return flags.select("InstanceID", target.alias("target"))


def recycle_target(pi: DataFrame, le: DataFrame) -> DataFrame:
    """Every instance with its target; NULL without a deciding event."""
    return pi.select("InstanceID").join(targets(le), "InstanceID", "left")
