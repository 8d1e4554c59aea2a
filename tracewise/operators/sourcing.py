"""Suppliers and sourcing: type, detail list, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalar import display_or_dash, key_in
from .skew import plain


def _spread_nulls(key: str, *spread: str):
    """``key``, or for NULL a never-matching key spread by the row's other
    columns (control character prefix), so NULL-key rows hash apart."""
    filler = F.concat(F.lit("\u0001"), *[F.coalesce(F.col(c), F.lit("")) for c in spread])
    return F.coalesce(F.col(key), filler)


def _with_rows(suppliers: DataFrame, rows: DataFrame) -> DataFrame:
    """``suppliers`` LEFT JOIN ``rows`` on SupplierID, as an inner join, whose hot
    supplier can be split, and the suppliers that have no row."""
    rest = suppliers.join(rows.select("SupplierID").distinct(), "SupplierID", "left_anti")
    return rows.join(plain(suppliers), "SupplierID").unionByName(rest, allowMissingColumns=True)


def supplier_kinds(so: DataFrame) -> DataFrame:
    """Type per supplier that has sourcing rows (A6, P7): first rule that holds wins."""
    counts = so.groupBy("SupplierID").agg(
        F.count("ComponentID").alias("comp_count"),
        F.count("MaterialID").alias("mat_count"))
    c, m = F.col("comp_count") > 0, F.col("mat_count") > 0
    kind = (F.when(c & m, schemas.SUPPLIER_BOTH).when(c, schemas.SUPPLIER_COMPONENT)
            .when(m, schemas.SUPPLIER_MATERIAL).otherwise(schemas.SUPPLIER_UNKNOWN))
    return counts.select("SupplierID", kind.alias("SupplierType"))


def supplier_type(suppliers: DataFrame, so: DataFrame) -> DataFrame:
    """Every supplier with its type; without sourcing rows ``Unknown``."""
    return suppliers.select("SupplierID", "SupplierName").join(
        supplier_kinds(so), "SupplierID", "left").select(
        "SupplierID", "SupplierName",
        F.coalesce(F.col("SupplierType"), F.lit(schemas.SUPPLIER_UNKNOWN)).alias("SupplierType"))


def sourcing_detail(suppliers: DataFrame, so: DataFrame, components: DataFrame,
                    rm: DataFrame, with_type: bool = True) -> DataFrame:
    """Suppliers left-joined to their sourcing rows, component and material
    names; suppliers without rows kept; sorted by supplier name (J2, J13, F2).

    A sourcing row names a component or a material, never both, so half the
    rows carry a NULL in each lookup key, and a shuffle join sends all rows
    with a NULL key to one reducer. NULL keys are therefore replaced by
    spread-out keys that cannot match (see ``_spread_nulls``).
    """
    so = so.select("SupplierID", "ComponentID", "MaterialID")
    comp_names = components.select(F.col("ComponentID").alias("_ck"), "ComponentName")
    mat_names = rm.select(F.col("MaterialID").alias("_mk"), "MaterialName")
    rows = (so.withColumn("_ck", _spread_nulls("ComponentID", "MaterialID", "SupplierID"))
            .withColumn("_mk", _spread_nulls("MaterialID", "ComponentID", "SupplierID"))
            .join(comp_names, "_ck", "left")
            .join(mat_names, "_mk", "left")
            .drop("_ck", "_mk"))
    names = suppliers.select("SupplierID", "SupplierName")
    sel = [F.col("SupplierID"), F.col("SupplierName"),
           display_or_dash("ComponentName").alias("ComponentName"),
           display_or_dash("MaterialName").alias("MaterialName")]
    if with_type:
        names = names.join(supplier_kinds(so), "SupplierID", "left")
        sel.append(F.coalesce(F.col("SupplierType"), F.lit(schemas.SUPPLIER_UNKNOWN))
                   .alias("SupplierType"))
    return _with_rows(names, rows).select(*sel, "ComponentID", "MaterialID").orderBy(
        "SupplierName", "SupplierID", "ComponentID", "MaterialID")


def sourcing_ids(suppliers: DataFrame, so: DataFrame) -> DataFrame:
    """The older id-only listing: suppliers left-joined to sourcing ids."""
    return _with_rows(suppliers.select("SupplierID", "SupplierName"),
                      so.select("SupplierID", "ComponentID", "MaterialID")) \
        .select("SupplierID", "SupplierName", "ComponentID", "MaterialID")


def supplier_summary(so: DataFrame, suppliers: DataFrame,
                     supplier_id: str | None = None) -> DataFrame:
    """Supplier name with each sourced component or material id."""
    s = so if supplier_id is None else key_in(so, "SupplierID", [supplier_id])
    return s.select("SupplierID", "ComponentID", "MaterialID").join(
        suppliers.select("SupplierID", "SupplierName"), "SupplierID").select(
        "SupplierID", "SupplierName", "ComponentID", "MaterialID")
