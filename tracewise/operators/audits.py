"""Constraint audits: the keys, NOT NULLs, CHECKs and lengths the schema
declares and Spark does not enforce (Q1-Q6).

The rules are data (``RULES``); ``audit_report`` evaluates them all and
returns one row per rule with its violation count. Each table is read once, its
keys, references and broken row-level rules (NOT NULL, CHECK, length) are tagged by
rule, and one grouped pass counts them all.
Text keys compare case-insensitively, as the database's default collation.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..sources.tables import LifecycleTables
from .skew import dealt


@dataclass(frozen=True)
class Rule:
    table: str
    kind: str            # primary_key, unique, foreign_key, not_null, check, length
    columns: tuple[str, ...]
    ref: tuple[str, str] | None = None   # (table, column) for foreign keys
    limit: int | None = None             # for length

    @property
    def name(self) -> str:
        cols = ",".join(self.columns)
        if self.kind == "foreign_key":
            return f"foreign_key:{cols}->{self.ref[0]}.{self.ref[1]}"
        if self.kind == "length":
            return f"length:{cols}<={self.limit}"
        return f"{self.kind}:{cols}"


TEXT = {(t, f.name) for t, s in schemas.SCHEMAS.items() for f in s.fields
        if f.dataType == schemas.S}

RULES: list[Rule] = [
    Rule("products", "primary_key", ("ProductID",)),
    Rule("components", "primary_key", ("ComponentID",)),
    Rule("raw_materials", "primary_key", ("MaterialID",)),
    Rule("suppliers", "primary_key", ("SupplierID",)),
    Rule("product_instances", "primary_key", ("InstanceID",)),
    Rule("product_instances", "unique", ("SerialNumber",)),
    Rule("lifecycle_events", "primary_key", ("EventID",)),
    Rule("bill_of_material", "primary_key", ("ParentComponentID", "ChildComponentID")),
    Rule("component_composition", "primary_key", ("ComponentID", "MaterialID")),
    Rule("sourcing", "primary_key", ("SourcingID",)),
    Rule("product_instances", "foreign_key", ("ProductID",), ("products", "ProductID")),
    Rule("lifecycle_events", "foreign_key", ("InstanceID",), ("product_instances", "InstanceID")),
    Rule("bill_of_material", "foreign_key", ("ParentComponentID",), ("components", "ComponentID")),
    Rule("bill_of_material", "foreign_key", ("ChildComponentID",), ("components", "ComponentID")),
    Rule("component_composition", "foreign_key", ("ComponentID",), ("components", "ComponentID")),
    Rule("component_composition", "foreign_key", ("MaterialID",), ("raw_materials", "MaterialID")),
    Rule("sourcing", "foreign_key", ("SupplierID",), ("suppliers", "SupplierID")),
    Rule("sourcing", "foreign_key", ("ComponentID",), ("components", "ComponentID")),
    Rule("sourcing", "foreign_key", ("MaterialID",), ("raw_materials", "MaterialID")),
    *[Rule(t, "not_null", (c,)) for t, cols in [
        ("products", ("ProductID", "ModelName")),
        ("components", ("ComponentID", "ComponentName")),
        ("raw_materials", ("MaterialID", "MaterialName")),
        ("suppliers", ("SupplierID", "SupplierName")),
        ("product_instances", ("InstanceID", "SerialNumber", "ProductID")),
        ("lifecycle_events", ("EventID", "EventType", "EventDate", "InstanceID")),
        ("bill_of_material", ("ParentComponentID", "ChildComponentID", "Quantity")),
        ("component_composition", ("ComponentID", "MaterialID", "WeightInGrams")),
        ("sourcing", ("SourcingID", "SupplierID")),
    ] for c in cols],
    Rule("bill_of_material", "check", ("Quantity",)),
    Rule("component_composition", "check", ("WeightInGrams",)),
    Rule("sourcing", "check", ("ComponentID", "MaterialID")),
    *[Rule(t, "length", (c,), limit=n) for (t, c), n in schemas.VARCHAR_LIMITS.items()],
]


def _key(table: str, c: str):
    """Key column as compared by the database: text case-insensitively."""
    return F.lower(F.col(c)) if (table, c) in TEXT else F.col(c)


def _violation(rule: Rule):
    """Row-level violation predicate (NULL counts as passing, as in SQL)."""
    if rule.kind == "not_null":
        return F.col(rule.columns[0]).isNull()
    if rule.kind == "length":
        return F.length(F.col(rule.columns[0])) > rule.limit
    if rule.kind == "check":
        if rule.columns == ("ComponentID", "MaterialID"):
            c, m = F.col("ComponentID"), F.col("MaterialID")
            ok = (c.isNotNull() & m.isNull()) | (c.isNull() & m.isNotNull())
        else:
            ok = F.col(rule.columns[0]) > 0
        return ~F.coalesce(ok, F.lit(True))
    raise ValueError(rule.kind)


def _key_text(table: str, columns: tuple[str, ...]):
    """One text per key as the database compares it, NULL if any part is; parts carry their length."""
    parts = [_key(table, c).cast("string") for c in columns]
    return F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def audit_report(t: LifecycleTables, rules: list[Rule] = RULES, slices: int | None = None) -> DataFrame:
    """One row per rule: table_name, check_name, violations (Q1-Q6).

    Every table is read once. Each of its rows is exploded into tagged items: its keys, its references and the
    row-level rules it breaks. A key and the references to it share a ``space``; a reference carries
    its rule as a ``slot``, a key the slot -1. One grouped pass over (space, key) then shows duplicate keys (two or more of slot
    -1) and orphans (references without one); a hot key or a rule that every row breaks is combined before the shuffle.

    ``slices`` deals the items to so many tasks instead, for more keys than the session's shuffle partitions can
    hold. Broken rules have no key: theirs is the partition of the row, so they are dealt evenly too.
    """
    items: dict[str, list] = {}
    spaces: dict[tuple, int] = {}
    slots: dict[tuple[int, int], Rule] = {}

    def add(table: str, space: int, slot: int, key) -> None:
        item = F.struct(F.lit(space).alias("space"), F.lit(slot).alias("slot"), key.alias("key"))
        items.setdefault(table, []).append(F.when(key.isNotNull(), item))

    def space_of(table: str, columns: tuple[str, ...]) -> int:
        if (table, columns) not in spaces:
            spaces[table, columns] = len(spaces)
            add(table, spaces[table, columns], -1, _key_text(table, columns))
        return spaces[table, columns]

    for r in rules:
        if r.kind in ("primary_key", "unique"):
            slots[space_of(r.table, r.columns), -1] = r
        elif r.kind == "foreign_key":
            space = space_of(r.ref[0], (r.ref[1],))
            slot = sum(s == space and k >= 0 for s, k in slots)
            slots[space, slot] = r
            add(r.table, space, slot, _key_text(r.table, r.columns))
        else:
            space = spaces[r] = len(spaces)
            slots[space, 0] = r
            add(r.table, space, 0, F.when(_violation(r), F.spark_partition_id().cast("string")))

    tagged = reduce(DataFrame.unionByName, [
        getattr(t, table).select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("x.*")
        for table, found in items.items()])
    most = max(k for _, k in slots) + 1
    keyed = dealt(tagged, slices, "space", "key").groupBy("space", "key").agg(
        F.count_if(F.col("slot") == -1).alias("_own"), *[F.count_if(F.col("slot") == i).alias(f"_{i}") for i in range(most)])
    counts = keyed.groupBy("space").agg(
        F.count_if(F.col("_own") > 1).alias("_dup"),
        *[F.sum(F.when(F.col("_own") == 0, F.col(f"_{i}"))).alias(f"_{i}") for i in range(most)])
    found = counts.select("space", F.explode(F.array(
        F.struct(F.lit(-1).alias("slot"), F.col("_dup").alias("n")),
        *[F.struct(F.lit(i).alias("slot"), F.col(f"_{i}").alias("n")) for i in range(most)])).alias("x")).select("space", "x.*")
    named = tagged.sparkSession.createDataFrame(
        [(r.table, r.name, space, slot) for (space, slot), r in slots.items()],
        "table_name string, check_name string, space int, slot int")
    return named.join(F.broadcast(found), ["space", "slot"], "left").select(     # a few rows per rule
        "table_name", "check_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("violations"))
