"""Feature building for the recycle-or-dispose model (A12, A13, A15, J7, J8,
P3, P9, M1, M2).

The reference's feature query joins every instance to every
(assembly edge x material) row with no link between the two (T4), so all
instances get the same features. ``features_global`` computes exactly that
without the Cartesian product: the edge x material side is reduced per child
component, then to one row, which is crossed with the instances (a one-row
broadcast). ``features_by_product`` scopes the same aggregates to each
product's root assembly (our labelled extension).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import grade_score, key_prefix
from .events import targets
from .skew import plain

FEATURES = ["total_weight", "avg_recyclability", "hazardous_count", "component_count"]


def _child_stats(cc: DataFrame, rm: DataFrame) -> DataFrame:
    """Per component over its (composition x material) rows: rows, Σ weight,
    Σ grade score (case-insensitive), hazardous rows, rows with a known hazard flag."""
    h = F.col("IsHazardous")
    return (cc.select("ComponentID", "MaterialID", "WeightInGrams")
            .join(rm.select("MaterialID", "RecyclableGrade", "IsHazardous"), "MaterialID")
            .groupBy("ComponentID").agg(
                F.count(F.lit(1)).alias("_rows"),
                F.sum("WeightInGrams").alias("_w"),
                F.sum(grade_score("RecyclableGrade")).alias("_score"),
                F.count_if(h).alias("_haz"),
                F.count(h).alias("_haz_known")))


def _rollup(j: DataFrame, by: list[str]) -> DataFrame:
    """Aggregate edge-weighted child stats to the feature columns."""
    k = F.col("_edges")
    rows = F.sum(k * F.col("_rows"))
    return j.groupBy(*by).agg(
        F.sum(k * F.col("_w")).cast("double").alias("total_weight"),
        F.round(F.sum(k * F.col("_score")).cast("double") / rows.cast("double"), 4)
        .alias("avg_recyclability"),
        F.when(F.sum(k * F.col("_haz_known")) > 0, F.sum(k * F.col("_haz")))
        .cast("bigint").alias("hazardous_count"),
        F.count(F.lit(1)).cast("bigint").alias("component_count"),
        rows.alias("_n"))


def features_global(pi: DataFrame, products: DataFrame, bom: DataFrame, cc: DataFrame,
                    rm: DataFrame, le: DataFrame, prefix: str = "C") -> DataFrame:
    """Per instance: Σ weight, mean grade score (4 decimals), hazardous rows,
    distinct components over all BOM edges whose parent starts with
    ``prefix`` (case-insensitive), plus the target (A12, J7, J8, P3, A14)."""
    edges = key_prefix(bom, "ParentComponentID", prefix) \
        .groupBy(F.col("ChildComponentID").alias("ComponentID")) \
        .agg(F.count(F.lit(1)).alias("_edges"))
    one = _rollup(edges.join(_child_stats(cc, rm), "ComponentID"), []) \
        .filter(F.col("_n") > 0).drop("_n")     # no joined rows -> no output rows
    inst = pi.select("InstanceID", "ProductID").join(
        products.select("ProductID", "ModelName"), "ProductID")
    # ``one`` is a global aggregate: exactly one row (or none), so this cross
    # join attaches constants; it never pairs rows of two tables. Scalar
    # subqueries would express the same but are planned apart from the main
    # query, which then recomputes the feature pipeline (measured 3x slower).
    return (inst.crossJoin(F.broadcast(one))
            .join(targets(le), "InstanceID", "left")
            .select("InstanceID", "ProductID", "ModelName", *FEATURES, "target"))


def features_by_product(pi: DataFrame, products: DataFrame, product_root: DataFrame,
                        bom: DataFrame, cc: DataFrame, rm: DataFrame,
                        le: DataFrame) -> DataFrame:
    """The same features scoped to the instance's product root assembly."""
    edges = (product_root.select("ProductID", F.col("ComponentID").alias("ParentComponentID"))
             .join(bom.select("ParentComponentID", "ChildComponentID"), "ParentComponentID")
             .groupBy("ProductID", F.col("ChildComponentID").alias("ComponentID"))
             .agg(F.count(F.lit(1)).alias("_edges")))
    per_product = _rollup(edges.join(plain(_child_stats(cc, rm)), "ComponentID"), ["ProductID"]) \
        .drop("_n")
    models = plain(products.select("ProductID", "ModelName").join(per_product, "ProductID"))
    return (pi.select("InstanceID", "ProductID").join(models, "ProductID")
            .join(targets(le), "InstanceID", "left")
            .select("InstanceID", "ProductID", "ModelName", *FEATURES, "target"))


def training_set(features: DataFrame) -> DataFrame:
    """Rows with a known target."""
    return features.na.drop(subset=["target"])


def standard_scale(df: DataFrame, cols: list[str] = FEATURES, fit_on: DataFrame | None = None,
                   suffix: str = "_z") -> DataFrame:
    """``(x - mean) / population std``, 0 where the std is 0 (M2).

    Statistics come from ``fit_on`` (default ``df`` itself, as the reference
    fits on all rows before splitting) in one aggregate row, broadcast to
    every partition.
    """
    src = df if fit_on is None else fit_on
    stats = src.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                    *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(stats))   # one aggregate row attached to each row
    for c in cols:
        m, s = F.col(f"_m_{c}"), F.col(f"_s_{c}")
        out = out.withColumn(c + suffix, F.when(s > 0, (F.col(c) - m) / s).otherwise(F.lit(0.0)))
    return out.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])
