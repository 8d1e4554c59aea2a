"""Projected lookup lists the pages show as drop-downs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import material_label, option_label
from .tables import LifecycleTables


def product_options(t: LifecycleTables) -> DataFrame:
    return t.products.select("ProductID", "ModelName",
                             option_label("ProductID", "ModelName").alias("label"))


def instance_options(t: LifecycleTables) -> DataFrame:
    return t.product_instances.select("InstanceID", "SerialNumber",
                                      option_label(F.col("InstanceID").cast("string"),
                                                   "SerialNumber").alias("label"))


def component_options(t: LifecycleTables) -> DataFrame:
    return t.components.select("ComponentID", "ComponentName",
                               option_label("ComponentID", "ComponentName").alias("label"))


def material_options(t: LifecycleTables) -> DataFrame:
    return t.raw_materials.select("MaterialID", "MaterialName", "IsHazardous",
                                  material_label("MaterialName", "IsHazardous").alias("label"))


def supplier_list(t: LifecycleTables) -> DataFrame:
    return t.suppliers.select("*")
