"""The pages' data as plans: each returns DataFrames, computed on executors;
key filters are applied before the work so Spark pushes them to the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bom, dashboard, events, sourcing
from ..functions.scalar import key_in
from ..sources.tables import LifecycleTables

HIERARCHY_IDS = ("c100", "c200", "c310")   # the report's fixed id list (case-insensitive)


def dashboard_view(t: LifecycleTables) -> dict[str, DataFrame]:
    """Counts, outcome shares and the weighted score (E1: A1, A3-A5)."""
    return {
        "counts": dashboard.table_counts(t),
        "outcomes": dashboard.outcome_share(t.lifecycle_events),
        "score": dashboard.recyclability_score(t.component_composition, t.raw_materials),
    }


def lifecycle_report(t: LifecycleTables, instance_id: int, as_of: str) -> dict[str, DataFrame]:
    """Serial, age and timeline of one instance (E2 lifecycle: P1, F5, W4)."""
    pi = t.product_instances.filter(F.col("InstanceID") == instance_id)
    le = t.lifecycle_events.filter(F.col("InstanceID") == instance_id)
    return {"instance": events.lifecycle_age(pi, le, as_of),
            "timeline": events.timeline(le).orderBy("seq")}


def trace_report(t: LifecycleTables, product_id: str) -> dict[str, DataFrame]:
    """Model name and material passport of one product (E2 trace: P1, J5, T-2)."""
    root = key_in(t.product_root, "ProductID", [product_id])
    passport = bom.material_passport(root, t.bill_of_material, t.components,
                                     t.component_composition, t.raw_materials)
    return {"product": key_in(t.products, "ProductID", [product_id]),
            "trace": bom.trace_report(passport, product_id)}


def hierarchy_report(t: LifecycleTables, ids=HIERARCHY_IDS) -> DataFrame:
    """Summaries of the listed assemblies (E2 hierarchy: P2, A10)."""
    return bom.component_summary(t.components, t.bill_of_material, ids=list(ids))


def suppliers_view(t: LifecycleTables) -> DataFrame:
    """Suppliers with their sourcing rows and types."""
    return sourcing.sourcing_detail(t.suppliers, t.sourcing, t.components, t.raw_materials)
