"""The bundle of model tables every operator reads, and the table source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from . import versions

TABLE_NAMES = tuple(schemas.SCHEMAS)


class LifecycleTables:
    """Named DataFrames of the lifecycle model.

    Each entry is a DataFrame or a zero-argument callable that builds one; a
    callable is resolved on first use, so a query only plans the tables it
    touches.
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        unknown = set(tables) - set(TABLE_NAMES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._src = dict(tables)
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            src = self._src.get(name)
            if src is None:
                raise KeyError(f"table {name!r} was not provided")
            self._cache[name] = src() if callable(src) else src
        return self._cache[name]

    def has(self, name: str) -> bool:
        return name in self._src

    def replace(self, **tables: DataFrame | Callable[[], DataFrame]) -> "LifecycleTables":
        merged = dict(self._src)
        merged.update(tables)
        return LifecycleTables(**merged)


def load(spark: SparkSession, location: str, table: str, fmt: str = "parquet",
         options: dict | None = None) -> DataFrame:
    """Read one model table.

    ``fmt`` is ``parquet`` (default), ``csv``, ``json`` or ``jdbc``. Parquet carries its own
    schema, and of a versioned table (``sources.versions``) the newest version is read; csv and
    json are read with the model's schema (no inference); ``jdbc`` takes
    url, user and password from ``options`` (job configuration, never code)
    and reads ``location`` as the table name, partitioned when the options
    carry ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``.
    """
    schema = schemas.SCHEMAS[table]
    opts = dict(options or {})
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(dbtable=location, **opts).load()
    reader = spark.read.options(**opts)
    if fmt == "parquet":
        path = f"{location.rstrip('/')}/{table}"
        return reader.parquet(versions.current(spark, path) or path)
    if fmt == "csv":
        return reader.schema(schema).option("header", "true").csv(
            f"{location.rstrip('/')}/{table}")
    if fmt == "json":
        return reader.schema(schema).json(f"{location.rstrip('/')}/{table}")
    raise ValueError(f"unsupported format {fmt!r}")


def load_all(spark: SparkSession, location: str, fmt: str = "parquet",
             options: dict | None = None) -> LifecycleTables:
    """All model tables stored below ``location`` (one folder per table)."""
    return LifecycleTables(**{
        name: (lambda n=name: load(spark, location, n, fmt, options)) for name in TABLE_NAMES
    })


# Join keys the operators use again and again: BOM children, composition and
# components meet on the component id; events and instances on the instance id.
BUCKET_KEYS = {
    "bill_of_material": "ChildComponentID",
    "component_composition": "ComponentID",
    "components": "ComponentID",
    "lifecycle_events": "InstanceID",
    "product_instances": "InstanceID",
}


def save_tables(t: LifecycleTables, database: str, buckets: int,
                names: tuple[str, ...] = TABLE_NAMES) -> None:
    """Store the model tables in the catalog, the big join partners bucketed
    (and sorted) by their join key with one bucket count, so their joins and
    per-key aggregates read co-located data instead of shuffling it."""
    for name in names:
        if not t.has(name):
            continue
        w = getattr(t, name).write.mode("overwrite").format("parquet")
        key = BUCKET_KEYS.get(name)
        if key:
            w = w.bucketBy(buckets, key).sortBy(key)
        w.saveAsTable(f"{database}.{name}")


def load_tables(spark: SparkSession, database: str) -> LifecycleTables:
    """Model tables from the catalog (see ``save_tables``)."""
    return LifecycleTables(**{
        name: (lambda n=name: spark.table(f"{database}.{n}")) for name in TABLE_NAMES
        if spark.catalog.tableExists(f"{database}.{name}")
    })
