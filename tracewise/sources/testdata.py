"""Adapter views: the driver's TPC-H-like parquet tables seen as the lifecycle model.

The mapping is ours (the test tables are not lifecycle data). Every model table
is derived from whole input tables, so the work of every query grows with them.
The same mapping is written as SQL for the DuckDB oracle in
``tracewise.plans.oracle``; both must stay in step.

    products            one per order        'P'||o_orderkey
    product_root        order -> assembly    'K'/'C'||o_orderkey ('K' for status P)
    components          assemblies + parts   'C'/'K'||o_orderkey, 'X'||p_partkey
    raw_materials       one per nation       'M'||n_nationkey
    suppliers           one per supplier     'S'||s_suppkey, and 'N'||s_suppkey for every tenth
    product_instances   one per customer     c_custkey+1, serial c_name
    lifecycle_events    one per event        type from event_type
    bill_of_material    assembly -> part     lineitem grouped by (order, part)
    component_composition part -> material   lineitem grouped by (part, supplier nation)
    sourcing            supplier roles       every line item: component or material by its keys
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import dealt
from .tables import LifecycleTables

#: Rows of the largest table that a task of a large shuffle is to hold; below so many tasks Spark chooses their number.
ROWS_PER_TASK, LEAST_SLICES = 500_000, 4


def _id(prefix: str, c: str | Column) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))


def _assembly_id(status: str, key: str) -> Column:
    return F.concat(F.when(F.col(status) == "P", F.lit("K")).otherwise(F.lit("C")),
                    F.col(key).cast("string"))


def events_as_lifecycle(events: DataFrame) -> DataFrame:
    """The driver's events (batch or stream) as lifecycle events."""
    et = F.col("event_type")
    etype = (F.when(et == "signup", "Manufactured").when(et == "purchase", "Sold")
             .when(et == "click", "Repair").when(et == "error", "Disposed")
             .when((F.col("event_id") % 3) == 0, "Recycled_Hazardous")
             .otherwise("Recycled"))
    return events.select(
        F.col("event_id").alias("EventID"), etype.alias("EventType"),
        F.col("ts").alias("EventDate"),
        (F.col("user_id") * 10 + F.col("event_id") % 7 + 1).alias("InstanceID"))


class DriverTables:
    """Column-pruned readers of the driver's parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._slices: int | None = None

    def read(self, name: str, *cols: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*cols) if cols else df

    def slices(self) -> int | None:
        """Tasks for shuffles of line items, in proportion to their number (counted from the
        files' footers); None for few line items, where Spark's own choice will do."""
        if self._slices is None:
            self._slices = -(-self.read("lineitem").count() // ROWS_PER_TASK)
        return self._slices if self._slices > LEAST_SLICES else None

    # -- model tables -------------------------------------------------------
    def products(self) -> DataFrame:
        return self.read("orders", "o_orderkey", "o_orderpriority").select(
            _id("P", "o_orderkey").alias("ProductID"),
            F.concat(F.lit("Model "), F.col("o_orderpriority")).alias("ModelName"))

    def product_root(self) -> DataFrame:
        return self.read("orders", "o_orderkey", "o_orderstatus").select(
            _id("P", "o_orderkey").alias("ProductID"),
            _assembly_id("o_orderstatus", "o_orderkey").alias("ComponentID"))

    def components(self) -> DataFrame:
        assemblies = self.read("orders", "o_orderkey", "o_orderstatus").select(
            _assembly_id("o_orderstatus", "o_orderkey").alias("ComponentID"),
            F.concat(F.lit("Assembly "), F.col("o_orderkey").cast("string")).alias("ComponentName"))
        parts = self.read("part", "p_partkey", "p_name").select(
            _id("X", "p_partkey").alias("ComponentID"), F.col("p_name").alias("ComponentName"))
        return assemblies.unionByName(parts)

    def raw_materials(self) -> DataFrame:
        grade = (F.when(F.col("n_regionkey") == 0, "A").when(F.col("n_regionkey") == 1, "B")
                 .when(F.col("n_regionkey") == 2, "C").when(F.col("n_regionkey") == 3, "D"))
        return self.read("nation", "n_nationkey", "n_name", "n_regionkey").select(
            _id("M", "n_nationkey").alias("MaterialID"),
            F.col("n_name").alias("MaterialName"),
            ((F.col("n_nationkey") % 4) == 3).alias("IsHazardous"),
            grade.alias("RecyclableGrade"))

    def suppliers(self) -> DataFrame:
        # besides the suppliers of line items, a new one for every tenth: it has no sourcing rows
        su = self.read("supplier", "s_suppkey", "s_name")
        new = F.when(F.col("s_suppkey") % 10 == 0, F.array(F.lit("S"), F.lit("N"))).otherwise(F.array(F.lit("S")))
        return su.select(F.explode(new).alias("kind"), "s_suppkey", "s_name").select(
            F.concat("kind", F.col("s_suppkey").cast("string")).alias("SupplierID"),
            F.col("s_name").alias("SupplierName"))

    def product_instances(self) -> DataFrame:
        return self.read("customer", "c_custkey", "c_name").select(
            (F.col("c_custkey") + 1).alias("InstanceID"),
            F.col("c_name").alias("SerialNumber"),
            _id("P", "c_custkey").alias("ProductID"))

    def lifecycle_events(self) -> DataFrame:
        return events_as_lifecycle(
            self.read("events", "event_id", "ts", "user_id", "event_type"))

    def bill_of_material(self) -> DataFrame:
        # aggregate on the numeric keys, build the text ids afterwards
        li = self.read("lineitem", "l_orderkey", "l_partkey", "l_quantity")
        od = self.read("orders", "o_orderkey", "o_orderstatus")
        li, od = dealt(li, self.slices(), "l_orderkey"), dealt(od, self.slices(), "o_orderkey")
        return (li.join(od, li.l_orderkey == od.o_orderkey)
                .groupBy("o_orderkey", "o_orderstatus", "l_partkey")
                .agg(F.sum("l_quantity").cast("int").alias("Quantity"))
                .select(_assembly_id("o_orderstatus", "o_orderkey").alias("ParentComponentID"),
                        _id("X", "l_partkey").alias("ChildComponentID"), "Quantity"))

    def component_composition(self) -> DataFrame:
        li = self.read("lineitem", "l_partkey", "l_suppkey", "l_quantity")
        su = self.read("supplier", "s_suppkey", "s_nationkey")
        return (dealt(li.join(su, li.l_suppkey == su.s_suppkey), self.slices(), "l_partkey", "s_nationkey")
                .groupBy("l_partkey", "s_nationkey")
                .agg(F.sum(F.col("l_quantity").cast("decimal(10,2)"))
                     .cast("decimal(10,2)").alias("WeightInGrams"))
                .select(_id("X", "l_partkey").alias("ComponentID"),
                        _id("M", "s_nationkey").alias("MaterialID"), "WeightInGrams"))

    def sourcing(self) -> DataFrame:
        # Every line item is a row: suppliers give components (key % 3 = 0), materials (1)
        # or, by the part's key, both (2).
        role = F.col("l_suppkey") % 3
        material = (role == 1) | ((role == 2) & (F.col("l_partkey") % 2 == 1))
        roles = self.read("lineitem", "l_suppkey", "l_partkey").select(
            _id("S", "l_suppkey").alias("SupplierID"),
            F.when(~material, _id("X", "l_partkey")).alias("ComponentID"),
            F.when(material, _id("M", F.col("l_partkey") % 25)).alias("MaterialID"))
        return (dealt(roles, self.slices(), *roles.columns).distinct()
            .withColumn("SourcingID", F.lit(None).cast("bigint"))
            .select("SourcingID", "SupplierID", "ComponentID", "MaterialID"))

    # -- request batches for the gates -------------------------------------
    def composition_candidates(self) -> DataFrame:
        """One candidate composition row per line item (weights -18 .. 570 g); the material is
        shifted by the line number, so rows are new, stored already, or name an unknown
        material; quantity 7 names an unknown component."""
        li = self.read("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       "l_quantity")
        su = self.read("supplier", "s_suppkey", "s_nationkey")
        return li.join(su, li.l_suppkey == su.s_suppkey).select(
            "l_orderkey", "l_linenumber",
            F.when(F.col("l_quantity") == 7, _id("Y", "l_partkey")).otherwise(_id("X", "l_partkey"))
            .alias("ComponentID"),
            _id("M", ((F.col("s_nationkey") + F.col("l_linenumber") - 1) % 27).cast("bigint")).alias("MaterialID"),
            (F.col("l_quantity") * 12 - 30).cast("decimal(10,2)").alias("WeightInGrams"))

    def sourcing_requests(self) -> DataFrame:
        """One sourcing form post per line item; flag N gives an invalid type, line 6
        no item, line 7 an unknown supplier; materials 25 and 26 and the
        components of line 5 are unknown."""
        rf = F.col("l_returnflag")
        line = F.col("l_linenumber")
        part = F.when(line == 5, _id("Y", "l_partkey")).otherwise(_id("X", "l_partkey"))
        return self.read("lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
                         "l_returnflag").select(
            "l_orderkey", "l_linenumber",
            F.when(line == 7, _id("U", "l_suppkey")).otherwise(_id("S", "l_suppkey")).alias("SupplierID"),
            F.when(rf == "R", "component").when(rf == "A", "material").otherwise("part")
            .alias("supply_type"),
            F.when(line != 6, F.when(rf == "A", _id("M", F.col("l_partkey") % 27)).otherwise(part))
            .alias("item_id"))

    def registration_requests(self) -> DataFrame:
        """One registration per order: open orders re-register an existing serial
        (other case, blanks), others a per-customer serial; status P orders name
        an unknown product."""
        st = F.col("o_orderstatus")
        serial = F.when(
            st == "O",
            F.concat(F.lit(" customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"),
                     F.lit(" "))).otherwise(_id("SN-", "o_custkey"))
        product = F.when(st == "P", _id("Q", "o_orderkey")).otherwise(_id("P", "o_orderkey"))
        return self.read("orders", "o_orderkey", "o_custkey", "o_orderstatus").select(
            F.col("o_orderkey").alias("RequestID"), serial.alias("SerialNumber"),
            product.alias("ProductID"))

    def supplier_requests(self) -> DataFrame:
        """One new-supplier form post per customer; building-segment customers
        reuse a supplier id, and ids are lower case (case-insensitive keys); nation 2
        leaves out the id, nation 3 the name."""
        seg = F.col("c_mktsegment")
        sid = F.when(F.col("c_nationkey") != 2, F.when(seg == "BUILDING", _id("S", "c_nationkey"))
                     .otherwise(_id("s", "c_custkey")))
        return self.read("customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment").select(
            F.col("c_custkey").alias("RequestID"),
            F.concat(F.lit(" "), sid, F.lit(" ")).alias("SupplierID"),
            F.when(F.col("c_nationkey") != 3, F.col("c_name")).alias("SupplierName"))

    def event_days(self) -> DataFrame:
        """One row: the first day of the events and the middle day of their period
        (nulls if there are none)."""
        days = self.read("events", "ts").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("z"))
        middle = F.date_add("a", F.floor((F.datediff("z", "a") + 1) / 2).cast("int"))
        return days.select(F.col("a").cast("timestamp_ntz").alias("first"),
                           middle.cast("timestamp_ntz").alias("middle"))

    def event_requests(self) -> DataFrame:
        """Event form posts: the events from the middle day of their period on, with instance
        ids given as text, some unknown."""
        et = F.col("event_type")
        etype = (F.when(et == "signup", "Sold").when(et == "purchase", "Sold")
                 .when(et == "click", "Repair").when(et == "error", "Disposed")
                 .otherwise("Recycled"))
        return (self.read("events", "event_id", "ts", "user_id", "event_type")
                .filter(F.col("ts") >= F.lit(self.event_days().first().middle).cast("timestamp_ntz"))
                .select(F.col("event_id").alias("RequestID"),
                        (F.col("user_id") * 11 + F.col("event_id") % 7 + 1).cast("string")
                        .alias("InstanceRef"),
                        etype.alias("EventType")))

    def tables(self) -> LifecycleTables:
        return LifecycleTables(
            products=self.products, components=self.components,
            raw_materials=self.raw_materials, suppliers=self.suppliers,
            product_instances=self.product_instances, lifecycle_events=self.lifecycle_events,
            bill_of_material=self.bill_of_material,
            component_composition=self.component_composition,
            sourcing=self.sourcing, product_root=self.product_root)


def driver_tables(spark: SparkSession, sf_dir: str) -> LifecycleTables:
    return DriverTables(spark, sf_dir).tables()
