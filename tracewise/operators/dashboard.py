"""Dashboard aggregates: table counts, event distribution, outcomes, score (A1-A5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalar import grade_score
from ..sources.tables import LifecycleTables


def table_counts(t: LifecycleTables) -> DataFrame:
    """Six KPI counts as (metric, row_count) rows, all in one job (A1)."""
    parts = [
        ("products", t.products), ("components", t.components),
        ("materials", t.raw_materials), ("suppliers", t.suppliers),
        ("instances", t.product_instances), ("events", t.lifecycle_events),
    ]
    frames = [df.select().agg(F.count(F.lit(1)).alias("row_count"))
              .select(F.lit(name).alias("metric"), "row_count") for name, df in parts]
    return reduce(DataFrame.unionByName, frames)


def event_distribution(le: DataFrame, case_insensitive: bool = True) -> DataFrame:
    """Count per event type (A2).

    The database groups text case-insensitively; the group is labelled with
    its smallest spelling so the result is deterministic.
    """
    # counted per exact spelling first (a hash aggregate over the events);
    # the smallest spelling is taken over those few rows
    exact = le.groupBy("EventType").agg(F.count(F.lit(1)).alias("cnt"))
    return merge_spellings(exact) if case_insensitive else exact


def merge_spellings(exact: DataFrame) -> DataFrame:
    """(EventType, cnt) per exact spelling to one row per type, labelled with its smallest spelling."""
    return (exact.groupBy(F.lower("EventType").alias("_k"))
            .agg(F.min("EventType").alias("EventType"), F.sum("cnt").alias("cnt")).drop("_k"))


def lifecycle_outcomes(le: DataFrame) -> DataFrame:
    """recycled (both recycled types), disposed, repair in one pass (A3)."""
    et = F.col("EventType")
    return le.agg(
        F.count_if(et.isin(schemas.RECYCLED, schemas.RECYCLED_HAZARDOUS)).alias("recycled"),
        F.count_if(et == schemas.DISPOSED).alias("disposed"),
        F.count_if(et == schemas.REPAIR).alias("repair"))


def outcome_share(le: DataFrame) -> DataFrame:
    """A3 plus each outcome's percent of the three, one decimal; NULL on a zero total (A4)."""
    o = lifecycle_outcomes(le)
    total = F.col("recycled") + F.col("disposed") + F.col("repair")

    def pct(c: str):
        # the page's order of operations: (value / total) * 100, then one decimal
        return F.round(F.try_divide(F.col(c).cast("double"), total.cast("double")) * 100, 1)

    return o.select("recycled", "disposed", "repair",
                    pct("recycled").alias("recycled_pct"),
                    pct("disposed").alias("disposed_pct"),
                    pct("repair").alias("repair_pct"))


def _score_cols(total_w, weighted):
    tw = total_w.cast("double")
    ws = weighted.cast("double")
    return [tw.alias("total_weight"), ws.alias("weighted_score"),
            F.when(tw > 0, F.round(ws / tw, 2)).otherwise(F.lit(0.0)).alias("score")]


def recyclability_score(cc: DataFrame, rm: DataFrame, by: str | None = None,
                        case_sensitive: bool = True) -> DataFrame:
    """Weight-weighted mean grade score Σ(w·score)/Σw, two decimals, 0 when Σw = 0 (A5).

    Unknown grades score 0 but their weight counts; rows whose material is
    missing drop out (inner join). ``by=None`` gives one row; ``by`` a column
    of the composition (``ComponentID``) gives one row per value.

    Global form: composition is first reduced per material on the map side
    (one row per material and partition), so only that small frame meets the
    material table; the big table is never shuffled row by row.
    """
    w = F.col("WeightInGrams")
    if by is None:
        per_mat = cc.groupBy("MaterialID").agg(F.sum(w).alias("w"))
        j = per_mat.join(rm.select("MaterialID", "RecyclableGrade"), "MaterialID")
        score = grade_score("RecyclableGrade", case_sensitive)
        return j.agg(*_score_cols(F.sum("w"), F.sum(F.col("w") * score)))
    j = cc.select(by, "MaterialID", "WeightInGrams").join(
        rm.select("MaterialID", "RecyclableGrade"), "MaterialID")
    score = grade_score("RecyclableGrade", case_sensitive)
    return j.groupBy(by).agg(*_score_cols(F.sum(w), F.sum(w * score)))


def score_by_product(product_root: DataFrame, bom: DataFrame, cc: DataFrame, rm: DataFrame,
                     case_sensitive: bool = False) -> DataFrame:
    """The weighted score of each product's parts: its root's direct children, a child once per BOM row (A5).

    Composition is reduced per component and edges per (product, component) first, so the (edge x material) rows are never built.
    """
    from .bom import _product_edges
    from .skew import plain

    w = F.col("WeightInGrams")
    per = (cc.select("ComponentID", "MaterialID", "WeightInGrams")
           .join(rm.select("MaterialID", grade_score("RecyclableGrade", case_sensitive).alias("_score")), "MaterialID")
           .groupBy("ComponentID").agg(F.sum(w).alias("_w"), F.sum(w * F.col("_score")).alias("_ws")))
    j = _product_edges(product_root, bom).join(plain(per), "ComponentID")
    return j.groupBy("ProductID").agg(*_score_cols(F.sum(F.col("_w") * F.col("_edges")), F.sum(F.col("_ws") * F.col("_edges"))))
