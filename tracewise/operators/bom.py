"""Bill of materials, composition and traces.

Every per-key stored function of the reference is one grouped pass over all
keys here; a caller narrows to one key with a filter that Spark pushes to the
scan. Joins that would multiply rows (edge x material) are done on frames
that were aggregated per key first wherever the result is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalar import ci_eq, hazard_flag, hazard_label, key_in
from .ranking import concat_within, running_within
from .skew import dealt, plain


# -- J1 / W3 ---------------------------------------------------------------
def composition_detail(cc: DataFrame, rm: DataFrame) -> DataFrame:
    """Composition rows with material name and hazard."""
    return (cc.join(rm.select("MaterialID", "MaterialName", "IsHazardous"), "MaterialID")
            .select("ComponentID", "MaterialID", "MaterialName", "WeightInGrams",
                    "IsHazardous", hazard_label("IsHazardous").alias("HazardLabel")))


def composition_share(cc: DataFrame, rm: DataFrame) -> DataFrame:
    """Each material's percent of its component's weight, one decimal.

    The total is an aggregate joined back rather than a window, and joined
    plain, so a component with a huge share of all rows is split over tasks.
    """
    rows = cc.join(rm.select("MaterialID", "MaterialName"), "MaterialID") \
        .select("ComponentID", "MaterialID", "MaterialName", "WeightInGrams")
    totals = rows.groupBy("ComponentID").agg(F.sum("WeightInGrams").alias("_total"))
    w = F.col("WeightInGrams").cast("double")
    return rows.join(plain(totals), "ComponentID").select(
        "ComponentID", "MaterialID", "MaterialName", w.alias("WeightInGrams"),
        F.round(F.try_divide(w, F.col("_total").cast("double")) * 100, 1).alias("share_pct"))


# -- A7 / A8 -----------------------------------------------------------------
def component_weight(components: DataFrame, cc: DataFrame) -> DataFrame:
    """Σ composition weight per component, 0.00 when none; no BOM roll-up."""
    w = cc.groupBy("ComponentID").agg(F.sum("WeightInGrams").alias("_w"))
    return components.select("ComponentID").join(w, "ComponentID", "left").select(
        "ComponentID",
        F.coalesce(F.col("_w"), F.lit(0)).cast(schemas.WEIGHT).alias("weight"))


def subcomponent_count(components: DataFrame, bom: DataFrame, slices: int | None = None) -> DataFrame:
    """Number of direct BOM children per component, 0 for leaves (A8). ``slices``: tasks of the join."""
    n = bom.groupBy(F.col("ParentComponentID").alias("ComponentID")) \
        .agg(F.count(F.lit(1)).alias("_n"))
    return dealt(components.select("ComponentID"), slices, "ComponentID").join(n, "ComponentID", "left").select(
        "ComponentID", F.coalesce(F.col("_n"), F.lit(0)).alias("subcomponents"))


# -- A9 / A10 / J6 / J12 ----------------------------------------------------
def _children(bom: DataFrame, components: DataFrame) -> DataFrame:
    """BOM edges with the child's name; children missing from Components keep
    a NULL name (they count, but are not listed) (J6)."""
    names = components.select(F.col("ComponentID").alias("ChildComponentID"),
                              F.col("ComponentName").alias("ChildName"))
    return bom.join(names, "ChildComponentID", "left")


def component_details(components: DataFrame, bom: DataFrame) -> DataFrame:
    """Child names joined by ', ' in child-id order, else 'No subcomponents' (A9).

    A parent's children are joined in two levels (``ranking.concat_within``), so the sort of a
    parent with very many is spread over tasks; no cut at any length (T10).
    """
    kids = bom.join(components.select(F.col("ComponentID").alias("ChildComponentID"),
                                      F.col("ComponentName").alias("ChildName")),
                    "ChildComponentID")
    lists = concat_within(kids.select(F.col("ParentComponentID").alias("ComponentID"), "ChildComponentID", "ChildName"),
                          "ComponentID", ["ChildComponentID", "ChildName"], "ChildName", "_list")
    return components.join(lists, "ComponentID", "left").select(
        "ComponentID", "ComponentName",
        F.coalesce(F.col("_list"), F.lit(schemas.NO_SUBCOMPONENTS)).alias("Details"))


def component_summary(components: DataFrame, bom: DataFrame,
                      ids: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """``'<n> subcomponents: name (xq), ...'`` per component.

    n counts every BOM row of the parent; the list names children found in
    Components, in child-id order; a leaf reads ``0 subcomponents: No
    subcomponents`` (T9). ``ids`` narrows to a case-insensitive id list (P2); ``slices``: tasks
    that join the items.
    """
    comps = components if ids is None else key_in(components, "ComponentID", ids)
    edges = bom if ids is None else key_in(bom, "ParentComponentID", ids)
    item = F.concat(F.col("ChildName"), F.lit(" (x"), F.col("Quantity").cast("string"), F.lit(")"))
    kids = _children(edges, components).select(F.col("ParentComponentID").alias("ComponentID"), "ChildComponentID", item.alias("_item"))
    per_parent = concat_within(kids, "ComponentID", ["ChildComponentID", "_item"], "_item", "_list", count="_n", partitions=slices)
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("string")
    summary = F.concat(n, F.lit(schemas.SUBCOMPONENTS_INFIX),
                       F.coalesce(F.col("_list"), F.lit(schemas.NO_SUBCOMPONENTS)))
    return comps.join(per_parent, "ComponentID", "left").select(
        "ComponentID", "ComponentName", summary.alias("Summary"))


# -- J4 / J5 -----------------------------------------------------------------
def trace_all(components: DataFrame, bom: DataFrame, cc: DataFrame,
              rm: DataFrame) -> DataFrame:
    """The trace procedure as written (T2): every component that is some
    parent's child, once per parent, times its materials (J4)."""
    parts = plain(components.join(cc, "ComponentID"))   # the edges meet it in a join of their own
    return (bom.select("ChildComponentID").join(parts, F.col("ChildComponentID") == F.col("ComponentID"))
            .join(rm, "MaterialID")
            .select("ComponentID", "ComponentName", "MaterialID", "MaterialName",
                    "WeightInGrams", "RecyclableGrade"))


def _edge_counts(bom: DataFrame) -> DataFrame:
    """Number of BOM rows per child component (map-side combined)."""
    return bom.groupBy(F.col("ChildComponentID").alias("ComponentID")) \
        .agg(F.count(F.lit(1)).alias("_edges"))


def _multiplicity(components: DataFrame) -> DataFrame:
    """Rows per component id (1 unless the key is duplicated)."""
    return components.groupBy("ComponentID").agg(F.count(F.lit(1)).alias("_mult"))


def trace_rollup(components: DataFrame, bom: DataFrame, cc: DataFrame,
                 rm: DataFrame, slices: int | None = None) -> DataFrame:
    """``trace_all`` rolled up per (component, material): rows and Σ weight.

    Equal to grouping ``trace_all``, without building its edge x material
    rows: BOM is reduced to a count per child first. ``slices``: tasks of the grouping.
    """
    j = (plain(_edge_counts(bom).join(components.select("ComponentID", "ComponentName"), "ComponentID"))
         .join(cc.select("ComponentID", "MaterialID", "WeightInGrams"), "ComponentID")
         .join(rm.select("MaterialID", "MaterialName", "RecyclableGrade"), "MaterialID"))
    return dealt(j, slices, "ComponentID", "MaterialID").groupBy("ComponentID", "ComponentName", "MaterialID", "MaterialName",
                     "RecyclableGrade").agg(
        F.sum("_edges").alias("n_rows"),
        F.sum(F.col("WeightInGrams") * F.col("_edges")).cast("double").alias("total_weight"))


def material_passport(product_root: DataFrame, bom: DataFrame, components: DataFrame,
                      cc: DataFrame, rm: DataFrame, position: str | None = None) -> DataFrame:
    """The product material passport view (J5, T1): for each product, its root
    assembly's direct children and their materials, one row per (edge, material).

    ``position`` names a column for each row's 1-based place in its product's report, by
    (ComponentName, ComponentID, MaterialID). It is added up from two smaller tables, the edges with the
    numbers of materials before them and the materials numbered per component, so that the
    rows themselves are neither sorted nor stored. k equal edges take k places per material.
    """
    roots = product_root.select("ProductID", F.col("ComponentID").alias("ParentComponentID"))
    found = ["ProductID", F.col("ChildComponentID").alias("ComponentID"), "ComponentName", "MaterialID",
             "MaterialName", "WeightInGrams", "RecyclableGrade", "IsHazardous"]
    if position is None:
        parts = plain(components.select("ComponentID", "ComponentName").join(cc, "ComponentID")
                      .withColumnRenamed("ComponentID", "ChildComponentID"))
        return roots.join(bom, "ParentComponentID").join(parts, "ChildComponentID").join(rm, "MaterialID").select(*found)
    materials = running_within(cc.join(rm, "MaterialID").withColumnRenamed("ComponentID", "ChildComponentID"),
                               "ChildComponentID", ["MaterialID"], "_place")
    sizes = materials.groupBy("ChildComponentID").agg(F.count(F.lit(1)).alias("_size"))
    names = components.select(F.col("ComponentID").alias("ChildComponentID"), "ComponentName").join(sizes, "ChildComponentID")
    by = ["ProductID", "ComponentName", "ChildComponentID"]
    edges = (roots.join(bom.select("ParentComponentID", "ChildComponentID"), "ParentComponentID")
             .join(plain(names), "ChildComponentID")
             .groupBy(*by, "_size").agg(F.count(F.lit(1)).alias("_copies"))
             .withColumn("_rows", F.col("_copies") * F.col("_size")))
    edges = running_within(edges, "ProductID", by[1:], "_seq", sums={"_upto": "_rows"}) \
        .select(*by, "_copies", (F.col("_upto") - F.col("_rows")).alias("_before"))
    place = F.col("_before") + (F.col("_place") - 1) * F.col("_copies") + F.col("_copy")
    return (edges.join(plain(materials), "ChildComponentID")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")))
            .select(*found, place.alias(position)))


def trace_report(passport: DataFrame, product_id: str | None = None) -> DataFrame:
    """The report's trace table: hazard as Yes/No, sorted by component name
    with a unique tie-break (P1, T-2, F7). ``product_id`` narrows to one product."""
    p = passport if product_id is None else passport.filter(ci_eq("ProductID", product_id))
    return p.select("ProductID", "ComponentName", "MaterialName", "WeightInGrams",
                    "RecyclableGrade", hazard_label("IsHazardous").alias("IsHazardous"),
                    "ComponentID", "MaterialID") \
        .orderBy("ProductID", "ComponentName", "ComponentID", "MaterialID")


def _child_material_stats(cc: DataFrame, rm: DataFrame) -> DataFrame:
    """Per component: composition rows, Σ weight, hazardous rows (cc ⋈ rm)."""
    return (cc.select("ComponentID", "MaterialID", "WeightInGrams")
            .join(rm.select("MaterialID", "IsHazardous"), "MaterialID")
            .groupBy("ComponentID").agg(
                F.count(F.lit(1)).alias("_rows"),
                F.sum("WeightInGrams").alias("_w"),
                F.count_if(hazard_flag("IsHazardous")).alias("_haz")))


def _product_edges(product_root: DataFrame, bom: DataFrame) -> DataFrame:
    """(ProductID, child ComponentID) per BOM edge under the product's root,
    weight ``_edges`` = 1. Summing per-child stats over these raw edges equals
    the naive join's totals (duplicated keys included) without grouping the
    edges first, which would shuffle them once more for nothing when the
    keys are unique."""
    return (product_root.select("ProductID", F.col("ComponentID").alias("ParentComponentID"))
            .join(bom.select("ParentComponentID", "ChildComponentID"), "ParentComponentID")
            .select("ProductID", F.col("ChildComponentID").alias("ComponentID"),
                    F.lit(1).alias("_edges")))


def passport_rollup(product_root: DataFrame, bom: DataFrame, components: DataFrame,
                    cc: DataFrame, rm: DataFrame) -> DataFrame:
    """``material_passport`` rolled up per product: rows, Σ weight, hazardous rows.

    Equal to grouping the passport, computed from per-child aggregates so the
    (edge x material) rows are never materialised or shuffled.
    """
    edges = _product_edges(product_root, bom)
    j = edges.join(plain(_multiplicity(components)
                         .join(_child_material_stats(cc, rm), "ComponentID")), "ComponentID")
    k = F.col("_edges") * F.col("_mult")
    return j.groupBy("ProductID").agg(
        F.sum(k * F.col("_rows")).alias("n_rows"),
        F.sum(k * F.col("_w")).cast("double").alias("total_weight"),
        F.sum(k * F.col("_haz")).alias("hazardous_rows"))


# -- A11 ---------------------------------------------------------------------
def _hazard_rows(cc: DataFrame, rm: DataFrame) -> DataFrame:
    """Composition rows per component whose material is hazardous (IN-subquery, J11)."""
    hazardous = rm.filter(F.col("IsHazardous")).select("MaterialID")
    return (cc.select("ComponentID", "MaterialID").join(hazardous, "MaterialID", "left_semi")
            .groupBy("ComponentID").agg(F.count(F.lit(1)).alias("_haz")))


def hazard_usage(cc: DataFrame, bom: DataFrame, rm: DataFrame) -> DataFrame:
    """Count of (BOM child edge x hazardous composition row) pairs over all of
    the BOM, as the recycle procedure computes it (A11, scope 'global', T3)."""
    j = _edge_counts(bom).join(_hazard_rows(cc, rm), "ComponentID")
    return j.agg(F.coalesce(F.sum(F.col("_edges") * F.col("_haz")), F.lit(0))
                 .cast("bigint").alias("hazard_count"))


def hazard_usage_by_product(products: DataFrame, product_root: DataFrame, bom: DataFrame,
                            cc: DataFrame, rm: DataFrame) -> DataFrame:
    """Hazard count scoped to each product's root assembly; 0 when none
    (A11, scope 'product', our extension)."""
    edges = _product_edges(product_root, bom)
    per_product = (edges.join(plain(_hazard_rows(cc, rm)), "ComponentID")
                   .groupBy("ProductID")
                   .agg(F.sum(F.col("_edges") * F.col("_haz")).alias("_h")))
    return products.select("ProductID").join(per_product, "ProductID", "left").select(
        "ProductID", F.coalesce(F.col("_h"), F.lit(0)).cast("bigint").alias("hazard_count"))
