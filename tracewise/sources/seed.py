"""Inline seed rows (S2): the reference's sample data set, for exact goldens."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import SparkSession

from .. import schemas
from .tables import LifecycleTables

# ---------------------------------------------------------------------------
# The reference's seed rows, in its order.
# ---------------------------------------------------------------------------
PRODUCTS = [
    ("P100", "Alpha Laptop 15-inch"),
    ("P200", "Eco Smartphone Model 5"),
]
COMPONENTS = [
    ("C100", "Alpha Laptop Main Assembly"),
    ("C101", "15-inch Screen Unit"),
    ("C102", "Laptop Keyboard"),
    ("C103", "50Wh Battery Pack"),
    ("C200", "Eco Phone Main Assembly"),
    ("C201", "5.8-inch OLED Screen"),
    ("C202", "25Wh Battery Pack"),
    ("C300", "Universal Logic Board"),
]
RAW_MATERIALS = [
    ("M1", "Aluminum", False, "A"),
    ("M2", "Plastic (ABS)", False, "C"),
    ("M3", "Lithium-Ion", True, "D"),
    ("M4", "Glass (Gorilla)", False, "B"),
    ("M5", "Silicon", False, "B"),
]
SUPPLIERS = [
    ("S1", "Global Components Inc."),
    ("S2", "EcoMaterials Ltd."),
    ("S3", "Pure Metals Co."),
]
PRODUCT_INSTANCES = [
    (1, "ALPHA-0001", "P100"),
    (2, "ALPHA-0002", "P100"),
    (3, "ECO-0001", "P200"),
    (4, "ECO-0002", "P200"),
]
BILL_OF_MATERIAL = [
    ("C100", "C101", 1),
    ("C100", "C102", 1),
    ("C100", "C103", 1),
    ("C100", "C300", 1),
    ("C200", "C201", 1),
    ("C200", "C202", 1),
    ("C200", "C300", 1),
]
COMPONENT_COMPOSITION = [
    ("C101", "M4", "150.0"),
    ("C101", "M2", "50.0"),
    ("C102", "M2", "200.0"),
    ("C103", "M3", "300.0"),
    ("C103", "M1", "50.0"),
    ("C201", "M4", "50.0"),
    ("C202", "M3", "100.0"),
    ("C300", "M5", "25.0"),
]
SOURCING = [
    (1, "S1", "C101", None),
    (2, "S1", "C300", None),
    (3, "S2", None, "M2"),
    (4, "S2", None, "M4"),
    (5, "S3", None, "M1"),
    (6, "S3", None, "M3"),
]
LIFECYCLE_EVENTS = [
    (1, "Manufactured", "2024-01-01", 1),
    (2, "Sold", "2024-01-15", 1),
    (3, "Repair", "2025-03-15", 1),
    (4, "Disposed", "2025-10-20", 1),
    (5, "Manufactured", "2024-01-02", 2),
    (6, "Sold", "2024-01-18", 2),
    (7, "Recycled", "2025-10-22", 2),
    (8, "Manufactured", "2024-02-01", 3),
    (9, "Sold", "2024-02-10", 3),
    (10, "Recycled", "2025-10-25", 3),
    (11, "Manufactured", "2024-02-02", 4),
    (12, "Sold", "2024-02-11", 4),
    (13, "Disposed", "2025-09-01", 4),
]
# Our assumption: the seed's product ids map to their main assemblies.
PRODUCT_ROOT = [
    ("P100", "C100"),
    ("P200", "C200"),
]
# ---------------------------------------------------------------------------


def _ts(day: str) -> dt.datetime:
    return dt.datetime.fromisoformat(day)


def seed_tables(spark: SparkSession) -> LifecycleTables:
    """The seed as DataFrames with the model's Spark schemas."""
    mk = spark.createDataFrame
    return LifecycleTables(
        products=mk(PRODUCTS, schemas.PRODUCTS),
        components=mk(COMPONENTS, schemas.COMPONENTS),
        raw_materials=mk(RAW_MATERIALS, schemas.RAW_MATERIALS),
        suppliers=mk(SUPPLIERS, schemas.SUPPLIERS),
        product_instances=mk(PRODUCT_INSTANCES, schemas.PRODUCT_INSTANCES),
        lifecycle_events=mk([(i, t, _ts(d), n) for i, t, d, n in LIFECYCLE_EVENTS],
                            schemas.LIFECYCLE_EVENTS),
        bill_of_material=mk(BILL_OF_MATERIAL, schemas.BILL_OF_MATERIAL),
        component_composition=mk([(c, m, Decimal(w)) for c, m, w in COMPONENT_COMPOSITION],
                                 schemas.COMPONENT_COMPOSITION),
        sourcing=mk(SOURCING, schemas.SOURCING),
        product_root=mk(PRODUCT_ROOT, schemas.PRODUCT_ROOT),
    )
