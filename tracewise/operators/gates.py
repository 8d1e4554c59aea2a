"""Validated ingest: the reference's procedures, triggers and CHECKs re-aimed
as batch gates (G1-G9, R2).

Each gate returns the batch with a ``reason`` column: NULL for rows that
are admitted, the refusal text otherwise (the reference's own message where
it has one). ``split`` turns that into (accepted, rejected). Row-by-row
semantics of the database (a row sees the rows inserted before it) are kept
by set logic over the batch's order column, never by a loop or a global
window.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalar import ci, to_key, to_weight
from ..session import checkpointed, stored
from .skew import plain

REASON = "reason"


def split(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows without ``reason``, rejected rows with it)."""
    return (decided.filter(F.col(REASON).isNull()).drop(REASON),
            decided.filter(F.col(REASON).isNotNull()))


def with_status(decided: DataFrame) -> DataFrame:
    """Add ``status`` = accepted / rejected next to ``reason``."""
    return decided.withColumn(
        "status", F.when(F.col(REASON).isNull(), "accepted").otherwise("rejected"))


def _first_reason(*rules: tuple[Column, str]) -> Column:
    """The message of the first rule whose condition is true (NULL counts as false)."""
    expr = F.lit(None).cast("string")
    for cond, msg in reversed(rules):
        expr = F.when(F.coalesce(cond, F.lit(False)), F.lit(msg)).otherwise(expr)
    return expr


def _flag_join(df: DataFrame, keys: DataFrame, left_key: Column | str, flag: str) -> DataFrame:
    """Left-join a de-duplicated key set as a boolean ``flag`` (existence, J9/J10).

    ``left_key`` may name a column of ``df``, which the join then keeps. Every
    step shuffles the batch for itself, so a key with a third of it is split.
    """
    if isinstance(left_key, str):
        k = keys.select(F.col(keys.columns[0]).alias(left_key)).groupBy(left_key) \
            .agg(F.lit(True).alias(flag))
        out = plain(df).join(plain(k), left_key, "left")
    else:
        k = keys.select(F.col(keys.columns[0]).alias("_fk")).groupBy("_fk") \
            .agg(F.lit(True).alias(flag))
        out = df.withColumn("_lk", left_key).join(plain(k), F.col("_lk") == F.col("_fk"), "left") \
            .drop("_lk", "_fk")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


# -- R2 ----------------------------------------------------------------------
def assign_ids(df: DataFrame, order: list[str | Column], out: str,
               start: int = 0) -> DataFrame:
    """Consecutive ids ``start + 1, start + 2, ...`` in ``order`` (R2, AUTO_INCREMENT).

    The batch is range-sorted and stored once below the shared checkpoint folder with each
    row's partition and index (fixed for every later read and retry); each row's id is its
    index inside its partition plus the sizes of all earlier partitions. The
    size table has one row per partition, so it is broadcast; no window over
    all rows in one task.
    """
    local = stored(df.orderBy(*order).withColumn("_part", F.spark_partition_id())
                   .withColumn("_idx", F.monotonically_increasing_id()
                               - F.shiftleft(F.spark_partition_id().cast("long"), 33)), "ids")
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_part")
            .withColumn(out, (F.lit(start) + F.col("_off") + F.col("_idx") + 1).cast("long"))
            .drop("_part", "_idx", "_off"))


def max_id(df: DataFrame, col: str, alias: str) -> DataFrame:
    """One-row frame with the highest ``col`` (0 when empty)."""
    return df.agg(F.coalesce(F.max(col), F.lit(0)).cast("long").alias(alias))


def ids_after(numbered: DataFrame, seq: str, existing: DataFrame, existing_col: str,
              out: str) -> DataFrame:
    """``out`` = highest stored ``existing_col`` + ``seq`` (one-row broadcast).

    Lazy like every frame: checkpoint the result before appending to
    ``existing``, or a later evaluation sees the appended rows."""
    start = max_id(existing, existing_col, "_start")
    return numbered.crossJoin(F.broadcast(start)) \
        .withColumn(out, F.col("_start") + F.col(seq)).drop("_start")


# -- G1 ----------------------------------------------------------------------
def disposal_gate(existing: DataFrame, batch: DataFrame, order: str = "EventID",
                  batch_sold: DataFrame | None = None) -> DataFrame:
    """A Disposed event needs a Sold event of the same instance stored before
    it: in ``existing`` or earlier in the batch by ``order`` (T8: insertion
    order, not event date). Only Disposed rows can be refused and only Sold
    rows matter, so the rule is: some Sold row exists in ``existing``, or the
    batch's first Sold row precedes the Disposed row. Both are per-instance
    aggregates (combined map-side), joined to the Disposed rows only (G1, J10).
    ``batch_sold`` limits which batch rows count as stored Sold rows (those
    that pass every other check); default all of the batch.
    """
    is_sold = ci("EventType") == schemas.SOLD
    is_disposed = ci("EventType") == schemas.DISPOSED
    known = existing.filter(is_sold).groupBy("InstanceID").agg(F.lit(True).alias("_stored"))
    sold_src = batch if batch_sold is None else batch_sold
    first = sold_src.filter(is_sold).groupBy("InstanceID").agg(F.min(order).alias("_first"))
    # one row per instance with a sale, joined plain: the Disposed rows of a hot instance are split
    sales = known.join(first, "InstanceID", "full")
    disposed = (batch.filter(F.coalesce(is_disposed, F.lit(False)))
                .join(plain(sales), "InstanceID", "left"))
    ok = F.coalesce(F.col("_stored"), F.lit(False)) | \
        F.coalesce(F.col("_first") < F.col(order), F.lit(False))
    disposed = disposed.withColumn(
        REASON, F.when(ok, F.lit(None).cast("string")).otherwise(F.lit(schemas.MSG_UNSOLD_DISPOSAL)))
    others = batch.filter(~F.coalesce(is_disposed, F.lit(False))) \
        .withColumn(REASON, F.lit(None).cast("string"))
    return others.unionByName(disposed.select(*batch.columns, REASON))


# -- G2 / G3 -----------------------------------------------------------------
def hazard_weight_gate(batch: DataFrame, rm: DataFrame,
                       limit: int = schemas.HAZARD_WEIGHT_LIMIT) -> DataFrame:
    """New composition rows: the weight is first made DECIMAL(10,2) (0.004 ->
    0.00, 500.004 -> 500.00); a weight <= 0 is refused (G3); a hazardous
    material over ``limit`` grams is refused (G2; exactly 500.00 passes; an
    unknown material passes here). A missing weight passes the procedure's
    test and fails NOT NULL (P5, F10)."""
    w = to_weight(F.col("WeightInGrams"))
    # the trigger's lookup compares ids case-insensitively; one row per id
    haz = rm.groupBy(F.lower("MaterialID").alias("_mid")).agg(F.max("IsHazardous").alias("_haz"))
    j = batch.withColumn("_w", w).join(plain(haz), F.lower(F.col("MaterialID")) == F.col("_mid"), "left")
    raw = F.col("WeightInGrams")
    reason = _first_reason(
        (raw.isNotNull() & F.col("_w").isNull(), schemas.MSG_INVALID_WEIGHT),
        (F.col("_w") <= 0, schemas.MSG_INVALID_WEIGHT),
        (F.col("_w").isNull(), schemas.MSG_NULL_WEIGHT),
        ((F.col("_haz") == F.lit(True)) & (F.col("_w") > limit), schemas.MSG_HAZARD_LIMIT))
    cols = [c for c in batch.columns if c != "WeightInGrams"]
    return j.select(*cols, F.col("_w").alias("WeightInGrams"), reason.alias(REASON))


def _key_flag(df: DataFrame, keys: DataFrame, left: list[Column], right: list[str],
              flag: str) -> DataFrame:
    """Existence of the (case-insensitive) composite key in ``keys`` as ``flag``."""
    k = keys.select(*[F.lower(F.col(c)).alias(f"_r{i}") for i, c in enumerate(right)]) \
        .groupBy(*[f"_r{i}" for i in range(len(right))]).agg(F.lit(True).alias(flag))
    out = df
    for i, c in enumerate(left):
        out = out.withColumn(f"_l{i}", F.lower(c))
    cond = [F.col(f"_l{i}") == F.col(f"_r{i}") for i in range(len(left))]
    out = out.join(plain(k), cond, "left").drop(*[f"_l{i}" for i in range(len(left))],
                                         *[f"_r{i}" for i in range(len(right))])
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def composition_gate(batch: DataFrame, rm: DataFrame, components: DataFrame,
                     stored: DataFrame, order: str = "RequestID") -> DataFrame:
    """A new composition row as the database takes it (G2, G3 and Q1/Q2 at
    insert): the procedure's weight test, the hazard trigger, NOT NULL, both
    foreign keys, then the (component, material) primary key against stored
    rows and rows admitted earlier in ``order``."""
    d = hazard_weight_gate(batch, rm)
    d = _key_flag(d, components, [F.col("ComponentID")], ["ComponentID"], "_ck")
    d = _key_flag(d, rm, [F.col("MaterialID")], ["MaterialID"], "_mk")
    d = d.withColumn("_kc", F.lower("ComponentID")).withColumn("_km", F.lower("MaterialID"))
    pk = stored.select(F.lower("ComponentID").alias("_kc"), F.lower("MaterialID").alias("_km")) \
        .groupBy("_kc", "_km").agg(F.lit(True).alias("_dup"))
    d = d.join(plain(pk), ["_kc", "_km"], "left").withColumn("_dup", F.coalesce("_dup", F.lit(False)))
    eligible = F.col(REASON).isNull() & F.col("_ck") & F.col("_mk") & ~F.col("_dup")
    d = _first_per_key(d, ["_kc", "_km"], order, eligible, keep_min=True)
    reason = F.coalesce(F.col(REASON), _first_reason(
        (~F.col("_ck"), schemas.MSG_UNKNOWN_COMPONENT),
        (~F.col("_mk"), schemas.MSG_UNKNOWN_MATERIAL),
        (F.col("_dup"), schemas.MSG_DUPLICATE_COMPOSITION),
        (F.col("_min") < F.col(order), schemas.MSG_DUPLICATE_COMPOSITION)))
    return d.withColumn(REASON, reason).drop("_ck", "_mk", "_dup", "_min", "_first", "_kc",
                                             "_km")


# -- G4 ----------------------------------------------------------------------
def sourcing_gate(batch: DataFrame) -> DataFrame:
    """Sourcing form posts (SupplierID, supply_type, item_id): 'component' or
    'material' puts the item in that column, anything else is refused; the
    row must then name exactly one of the two (G4, Q4's CHECK)."""
    st = F.col("supply_type")
    comp = F.when(st == schemas.SUPPLY_COMPONENT, F.col("item_id"))
    mat = F.when(st == schemas.SUPPLY_MATERIAL, F.col("item_id"))
    one = comp.isNotNull() != mat.isNotNull()
    reason = _first_reason(
        (~st.isin(schemas.SUPPLY_COMPONENT, schemas.SUPPLY_MATERIAL) | st.isNull(),
         schemas.MSG_INVALID_SUPPLY_TYPE),
        (~one, schemas.MSG_SOURCING_CHECK))
    keep = [c for c in batch.columns if c not in ("supply_type", "item_id")]
    return batch.select(*keep, comp.alias("ComponentID"), mat.alias("MaterialID"),
                        reason.alias(REASON))


def sourcing_insert_gate(batch: DataFrame, suppliers: DataFrame, components: DataFrame,
                         rm: DataFrame) -> DataFrame:
    """A sourcing post as the database takes it: ``sourcing_gate``, then the
    foreign keys of supplier, component and material (NULL keys pass)."""
    d = sourcing_gate(batch)
    d = _key_flag(d, suppliers, [F.col("SupplierID")], ["SupplierID"], "_sk")
    d = _key_flag(d, components, [F.col("ComponentID")], ["ComponentID"], "_ck")
    d = _key_flag(d, rm, [F.col("MaterialID")], ["MaterialID"], "_mk")
    reason = F.coalesce(F.col(REASON), _first_reason(
        (~F.col("_sk"), schemas.MSG_UNKNOWN_SUPPLIER),
        (F.col("ComponentID").isNotNull() & ~F.col("_ck"), schemas.MSG_UNKNOWN_COMPONENT),
        (F.col("MaterialID").isNotNull() & ~F.col("_mk"), schemas.MSG_UNKNOWN_MATERIAL)))
    return d.withColumn(REASON, reason).drop("_sk", "_ck", "_mk")


# -- G5 ----------------------------------------------------------------------
def _first_per_key(df: DataFrame, key: Column | str | list[str], order: str,
                   eligible: Column, keep_min: bool = False) -> DataFrame:
    """Flag ``_first``: the row is the earliest eligible one of its key
    (``_min``, that row's order value, kept on request). A map-side-combined
    ``min`` per key, joined back plain (see ``skew``)."""
    if isinstance(key, (str, list)):
        names = [key] if isinstance(key, str) else key
        firsts = df.filter(eligible).groupBy(*names).agg(F.min(order).alias("_min"))
        out = plain(df).join(plain(firsts), names, "left")
    else:
        firsts = df.filter(eligible).groupBy(key.alias("_key")).agg(F.min(order).alias("_min"))
        out = plain(df).withColumn("_key", key).join(plain(firsts), "_key", "left").drop("_key")
    out = out.withColumn("_first", F.coalesce(F.col(order) == F.col("_min"), F.lit(False)))
    return out if keep_min else out.drop("_min")


def register_instances(existing: DataFrame, products: DataFrame, batch: DataFrame,
                       existing_events: DataFrame, as_of: str | dt.datetime,
                       order: str = "RequestID") -> tuple[DataFrame, DataFrame]:
    """Register serial-numbered instances.

    The serial is trimmed; it must be new (case-insensitive UNIQUE, against
    stored rows and earlier admitted rows of the batch) and the product must
    exist. Admitted rows get consecutive InstanceIDs after the stored maximum
    in ``order``, and one Manufactured event each, stamped ``as_of``, with
    EventIDs after the stored maximum. Returns (decided requests, new events).
    """
    b = batch.withColumn("SerialNumber", F.trim("SerialNumber")) \
        .withColumn("_skey", F.lower("SerialNumber"))
    b = _flag_join(b, products.select(F.lower("ProductID")), F.lower("ProductID"), "_product")
    # the stored serials, then the earliest row of each serial
    b = _flag_join(b, existing.select(F.lower("SerialNumber")), "_skey", "_dup_stored")
    # the earliest row of each serial that passes every check is the one admitted;
    # any later row with that serial finds it taken
    eligible = F.col("SerialNumber").isNotNull() & ~F.col("_dup_stored") & F.col("_product")
    b = _first_per_key(b, "_skey", order, eligible, keep_min=True)
    reason = _first_reason(
        (F.col("SerialNumber").isNull(), schemas.MSG_MISSING_SERIAL),
        (F.col("_dup_stored"), schemas.MSG_DUPLICATE_SERIAL),
        (F.col("_min") < F.col(order), schemas.MSG_DUPLICATE_SERIAL),
        (~F.col("_product"), schemas.MSG_UNKNOWN_PRODUCT))
    # both outputs read the decisions: compute them once (shared checkpoint folder)
    decided = checkpointed(
        b.withColumn(REASON, reason).drop("_min", "_first", "_dup_stored", "_product", "_skey"))
    acc, rej = split(decided)
    acc = assign_ids(acc, [order], "_seq")
    acc = ids_after(acc, "_seq", existing, "InstanceID", "InstanceID")
    acc = ids_after(acc, "_seq", existing_events, "EventID", "EventID").drop("_seq")
    # fix the ids now: appending to the stored tables must not move them
    acc = checkpointed(acc)
    stamp = F.lit(str(as_of)).cast("timestamp_ntz")
    new_events = acc.select("EventID", F.lit(schemas.MANUFACTURED).alias("EventType"),
                            stamp.alias("EventDate"), "InstanceID")
    decided = acc.withColumn(REASON, F.lit(None).cast("string")).unionByName(
        rej.withColumn("InstanceID", F.lit(None).cast("long"))
        .withColumn("EventID", F.lit(None).cast("long")))
    return decided, new_events


# -- G6 ----------------------------------------------------------------------
def append_events(instances: DataFrame, existing: DataFrame, batch: DataFrame,
                  as_of: str | dt.datetime, order: str = "RequestID") -> DataFrame:
    """Add events posted by instance reference (text) and type.

    Each row is stamped ``as_of``. In the database's order: the disposal
    trigger (G1, counting only Sold rows that are themselves stored), then
    NOT NULL, then the instance foreign key. Admitted rows get consecutive
    EventIDs after the stored maximum, in ``order``.
    """
    b = batch.withColumn("InstanceID", to_key("InstanceRef")) \
        .withColumn("EventDate", F.lit(str(as_of)).cast("timestamp_ntz"))
    b = _flag_join(b, instances.select("InstanceID"), F.col("InstanceID"), "_known")
    storable = F.col("_known") & F.col("EventType").isNotNull()
    j = disposal_gate(existing, b, order=order, batch_sold=b.filter(storable))
    reason = F.coalesce(F.col(REASON), _first_reason(
        (F.col("EventType").isNull(), schemas.MSG_MISSING_EVENT_TYPE),
        (~F.col("_known"), schemas.MSG_UNKNOWN_INSTANCE)))
    decided = checkpointed(j.withColumn(REASON, reason).drop("_known"))
    acc, rej = split(decided)
    acc = checkpointed(ids_after(assign_ids(acc, [order], "_seq"), "_seq", existing,
                                 "EventID", "EventID").drop("_seq"))
    return acc.withColumn(REASON, F.lit(None).cast("string")).unionByName(
        rej.withColumn("EventID", F.lit(None).cast("long")))


# -- G7 ----------------------------------------------------------------------
def recycle_events(instances: DataFrame, product_root: DataFrame, bom: DataFrame,
                   cc: DataFrame, rm: DataFrame, as_of: str | dt.datetime,
                   scope: str = "global") -> DataFrame:
    """One recycle event per instance: ``Recycled_Hazardous`` when the hazard
    count (A11) is above 0, else ``Recycled`` (G7, J11, T3).

    ``scope='global'`` counts over the whole BOM as the procedure does, so all
    instances get the same type (one row, broadcast). ``scope='product'``
    counts under the instance's product root assembly.
    """
    from .bom import _hazard_rows, _product_edges, hazard_usage

    stamp = F.lit(str(as_of)).cast("timestamp_ntz")
    if scope == "global":
        h = hazard_usage(cc, bom, rm)
        j = instances.select("InstanceID").crossJoin(F.broadcast(h))
    elif scope == "product":
        edges = _product_edges(product_root, bom)
        per_product = (edges.join(_hazard_rows(cc, rm), "ComponentID").groupBy("ProductID")
                       .agg(F.sum(F.col("_edges") * F.col("_haz")).alias("hazard_count")))
        # a product with very many instances is split: the counts are joined plain
        j = instances.select("InstanceID", "ProductID").join(plain(per_product), "ProductID", "left")
    else:
        raise ValueError("scope must be 'global' or 'product'")
    etype = F.when(F.coalesce(F.col("hazard_count"), F.lit(0)) > 0,
                   F.lit(schemas.RECYCLED_HAZARDOUS)).otherwise(F.lit(schemas.RECYCLED))
    return j.select("InstanceID", etype.alias("EventType"), stamp.alias("EventDate"))


# -- G8 ----------------------------------------------------------------------
def add_suppliers(existing: DataFrame, batch: DataFrame, order: str = "RequestID") -> DataFrame:
    """New suppliers: id and name trimmed; both required; the id must be new
    (case-insensitive primary key, against stored rows and earlier admitted
    rows of the batch) (G8)."""
    b = batch.withColumn("SupplierID", F.trim("SupplierID")) \
        .withColumn("SupplierName", F.trim("SupplierName")) \
        .withColumn("_skey", F.lower("SupplierID"))
    key = "_skey"
    b = _flag_join(b, existing.select(F.lower("SupplierID")), key, "_dup")
    pre = _first_reason(
        (F.col("SupplierID").isNull(), schemas.MSG_MISSING_SUPPLIER_ID),
        (F.col("SupplierName").isNull(), schemas.MSG_MISSING_SUPPLIER_NAME),
        (F.col("_dup"), schemas.MSG_DUPLICATE_SUPPLIER))
    b = _first_per_key(b.withColumn("_pre", pre), key, order, F.col("_pre").isNull())
    reason = F.coalesce(F.col("_pre"), F.when(~F.col("_first"),
                                              F.lit(schemas.MSG_DUPLICATE_SUPPLIER)))
    return b.withColumn(REASON, reason).drop("_pre", "_first", "_dup", "_skey")


# -- G9 / S6 -----------------------------------------------------------------
def like(df: DataFrame) -> DataFrame:
    """An empty table with ``df``'s schema (S6, ``CREATE TABLE .. LIKE``)."""
    return df.sparkSession.createDataFrame([], df.schema)


def archive_delete(le: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Delete events matching ``predicate``, keeping full copies.

    Returns (kept, backup); a NULL predicate keeps the row, as SQL DELETE
    does. Write ``backup`` (append) before replacing the table with ``kept``,
    and write ``kept`` to a new path: a path being read cannot be overwritten.
    """
    hit = F.coalesce(predicate, F.lit(False))
    return le.filter(~hit), le.filter(hit)
