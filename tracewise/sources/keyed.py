"""Model tables stored for key lookups.

The database compares text keys case-insensitively. A collated comparison cannot be pushed to a Parquet scan, so these tables
carry every text key once more in lower case (``<column>_key``), and are range-partitioned and sorted by
their first key: a lookup by id, id list or prefix (``functions.scalar.key_in``, ``key_prefix``) then is a plain pushed
filter, and files and row groups outside the range of the ids are skipped by their statistics.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .tables import LifecycleTables

#: Text keys of each table, the one it is sorted by first.
KEYS = {
    "products": ("ProductID",),
    "product_root": ("ProductID", "ComponentID"),
    "components": ("ComponentID",),
    "bill_of_material": ("ParentComponentID", "ChildComponentID"),
    "component_composition": ("ComponentID", "MaterialID"),
    "raw_materials": ("MaterialID",),
    "suppliers": ("SupplierID",),
    "sourcing": ("SupplierID", "ComponentID", "MaterialID"),
}


def save_keyed(t: LifecycleTables, location: str, files: int | None = None) -> None:
    """Write the tables below ``location`` with lower-case key columns, in ranges of the first key."""
    for name, keys in KEYS.items():
        if not t.has(name):
            continue
        df = getattr(t, name)
        n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keyed = df.withColumns({f"{k}_key": F.lower(k) for k in keys})
        order = [f"{k}_key" for k in keys]
        # by all keys: the rows of a key with a third of them fill several files
        keyed.repartitionByRange(n, *order).sortWithinPartitions(*order) \
            .write.mode("overwrite").parquet(f"{location.rstrip('/')}/{name}")
