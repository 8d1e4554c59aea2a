"""Batch jobs over stored model tables: the application's flows as Spark jobs.

    python -m tracewise.jobs <command> --tables DIR [--format parquet] --out DIR ...

Reads the model tables below ``--tables`` (one folder per table, see
``sources.tables.load_all``) and writes each result frame as JSON lines below
``--out`` (``--out-format parquet`` for large results). Ingest commands append
admitted rows to the table folders and write refused rows with their reasons.

    dashboard                              counts, outcome shares, weighted score
    lifecycle --instance N --as-of DATE    serial, age, timeline of one instance
    trace --product P                      material passport of one product
    hierarchy [--ids c100,c200,c310]       component summaries
    suppliers                              suppliers, sourcing, types
    audit                                  key / NOT NULL / CHECK / length violations
    register --batch PATH --as-of TS       new instances (+ Manufactured events)
    add-events --batch PATH --as-of TS     new lifecycle events
    add-suppliers --batch PATH             new suppliers
    add-composition --batch PATH           new composition rows (weight and hazard gates)
    add-sourcing --batch PATH              new sourcing rows
    recycle --as-of TS [--scope global]    one recycle event per instance
    archive --before TS                    events before TS moved to lifecycle_events_backup
    train [--model PATH]                   features, scaling, fit, test report

Ingest commands take ``--run KEY``: the admitted rows are staged under that key first (``sources.runs``), and a
job that failed is run again with the same key, which adds only what is missing. Without a key a new one is made.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import features, gates, model, sinks
from .operators.audits import audit_report
from .plans import reports
from .session import build_session, checkpointed, ensure_checkpoint_dir
from .sources import runs, versions
from .sources.tables import LifecycleTables, load, load_all, load_tables


def _append(args, df: DataFrame, table: str) -> None:
    """Append admitted rows to a stored table: a catalog table (keeps its
    bucketing) with ``--database``, else the table's folder (its newest version)."""
    if args.database:
        sinks.append_table(df, f"{args.database}.{table}")
    else:
        path = f"{args.tables.rstrip('/')}/{table}"
        sinks.append(df, versions.current(df.sparkSession, path) or path, args.format)


#: Key columns by which a rerun knows the rows that a table already holds.
KEYS = {"product_instances": ("InstanceID",), "lifecycle_events": ("EventID",), "suppliers": ("SupplierID",),
        "component_composition": ("ComponentID", "MaterialID"), "sourcing": ("SourcingID",)}


def _commit(args, spark: SparkSession, columns: dict[str, list[str]], compute) -> dict[str, DataFrame]:
    """Stage ``compute``'s frames and append those named in ``columns`` to their tables, once per run key."""
    root = args.runs or (f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs/{args.database}" if args.database else args.tables.rstrip("/"))
    read = lambda n: (lambda: spark.table(f"{args.database}.{n}") if args.database else load(spark, args.tables, n, args.format))
    append = lambda n: (lambda df: _append(args, df.select(*columns[n]), n))
    return runs.commit(spark, root, args.run or uuid.uuid4().hex, compute,
                       [runs.Target(n, KEYS[n], read(n), append(n)) for n in columns])


def _write(frames: dict[str, DataFrame], out: str, fmt: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").format(fmt).save(f"{out.rstrip('/')}/{name}")


def _batch(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", "true").option("inferSchema", "false")
    return r.load(path)


def _ingest(args, spark: SparkSession, table: str, decide, cols: list[str]) -> dict[str, DataFrame]:
    """Append admitted rows to ``table``; return refused rows for the output."""
    def compute() -> dict[str, DataFrame]:
        acc, rej = gates.split(checkpointed(decide()))
        return {table: acc, "rejected": rej}

    staged = _commit(args, spark, {table: cols}, compute)
    return {"rejected": staged["rejected"], "accepted": staged[table]}


EVENT_COLUMNS = ["EventID", "EventType", "EventDate", "InstanceID"]


def _archive(args, spark: SparkSession, t: LifecycleTables) -> dict[str, DataFrame]:
    """Move events before ``--before`` to the table ``lifecycle_events_backup``.

    The backup is completed first (only rows it lacks are added), then the kept rows are published as a new
    version of ``lifecycle_events``: a reader sees all events or the kept ones, and a failed job can be run again."""
    if args.database or args.format != "parquet":
        raise SystemExit("archive works on Parquet folders (--tables)")
    kept, old = gates.archive_delete(t.lifecycle_events, F.col("EventDate") < F.lit(args.before).cast("timestamp_ntz"))
    folder = args.tables.rstrip("/")
    backup = f"{folder}/lifecycle_events_backup"
    if not versions.exists(spark, backup):
        gates.like(t.lifecycle_events).write.parquet(backup)
    sinks.append(runs.missing(old, spark.read.parquet(backup), KEYS["lifecycle_events"]), backup)
    versions.publish(kept, f"{folder}/lifecycle_events")
    return {"archived": old.groupBy("EventType").count()}


def run(args, spark: SparkSession) -> dict[str, DataFrame]:
    t = load_tables(spark, args.database) if args.database else \
        load_all(spark, args.tables, args.format)
    c = args.command
    if c == "dashboard":
        return reports.dashboard_view(t)
    if c == "lifecycle":
        return reports.lifecycle_report(t, int(args.instance), args.as_of)
    if c == "trace":
        return reports.trace_report(t, args.product)
    if c == "hierarchy":
        return {"hierarchy": reports.hierarchy_report(t, args.ids.split(","))}
    if c == "suppliers":
        return {"suppliers": reports.suppliers_view(t)}
    if c == "audit":
        return {"audit": audit_report(t)}
    batch = _batch(spark, args.batch, args.batch_format) if args.batch else None
    if c == "register":
        def register() -> dict[str, DataFrame]:
            decided, new_events = gates.register_instances(
                t.product_instances, t.products, batch, t.lifecycle_events, args.as_of, order=args.order)
            acc, rej = gates.split(decided)        # decisions are already materialised
            return {"product_instances": acc, "lifecycle_events": new_events, "rejected": rej}

        staged = _commit(args, spark, {"product_instances": ["InstanceID", "SerialNumber", "ProductID"],
                                       "lifecycle_events": EVENT_COLUMNS}, register)
        return {"rejected": staged["rejected"], "accepted": staged["product_instances"]}
    if c == "add-events":
        return _ingest(args, spark, "lifecycle_events", lambda: gates.append_events(
            t.product_instances, t.lifecycle_events, batch, args.as_of, order=args.order), EVENT_COLUMNS)
    if c == "add-suppliers":
        return _ingest(args, spark, "suppliers", lambda: gates.add_suppliers(t.suppliers, batch, order=args.order),
                       ["SupplierID", "SupplierName"])
    if c == "add-composition":
        return _ingest(args, spark, "component_composition", lambda: gates.composition_gate(
            batch, t.raw_materials, t.components, t.component_composition, order=args.order),
            ["ComponentID", "MaterialID", "WeightInGrams"])
    if c == "add-sourcing":
        def source() -> dict[str, DataFrame]:
            acc, rej = gates.split(checkpointed(gates.sourcing_insert_gate(batch, t.suppliers, t.components, t.raw_materials)))
            return {"sourcing": gates.ids_after(gates.assign_ids(acc, [args.order], "_seq"), "_seq", t.sourcing,
                                                "SourcingID", "SourcingID"), "rejected": rej}

        staged = _commit(args, spark, {"sourcing": ["SourcingID", "SupplierID", "ComponentID", "MaterialID"]}, source)
        return {"rejected": staged["rejected"], "accepted": staged["sourcing"]}
    if c == "recycle":
        def recycle() -> dict[str, DataFrame]:
            ev = gates.recycle_events(t.product_instances, t.product_root, t.bill_of_material,
                                      t.component_composition, t.raw_materials, args.as_of, scope=args.scope)
            numbered = gates.ids_after(gates.assign_ids(ev, ["InstanceID"], "_seq"), "_seq", t.lifecycle_events,
                                       "EventID", "EventID")
            return {"lifecycle_events": numbered.drop("_seq")}

        return {"recycle_events": _commit(args, spark, {"lifecycle_events": EVENT_COLUMNS}, recycle)["lifecycle_events"]}
    if c == "archive":
        return _archive(args, spark, t)
    if c == "train":
        f = features.features_by_product(t.product_instances, t.products, t.product_root,
                                         t.bill_of_material, t.component_composition,
                                         t.raw_materials, t.lifecycle_events) \
            if args.features == "by_product" else features.features_global(
                t.product_instances, t.products, t.bill_of_material, t.component_composition,
                t.raw_materials, t.lifecycle_events)
        ts = checkpointed(features.training_set(f))
        train, test = model.split(checkpointed(features.standard_scale(ts)))
        fitted = model.fit_logistic(train, [x + "_z" for x in features.FEATURES])
        pred = model.predict(fitted, test)
        if args.model:
            model.save(fitted, args.model)
        return {"predictions": pred, "report": model.classification_report(pred),
                "accuracy": model.accuracy(pred)}
    raise ValueError(f"unknown command {c!r}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewise.jobs", description=__doc__,
                                formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command")
    p.add_argument("--tables", help="folder with one sub-folder per model table")
    p.add_argument("--database", help="catalog database with the model tables "
                                      "(e.g. bucketed by sources.tables.save_tables)")
    p.add_argument("--format", default="parquet")
    p.add_argument("--out", required=True)
    p.add_argument("--out-format", default="json")
    p.add_argument("--batch")
    p.add_argument("--batch-format", default="parquet")
    p.add_argument("--order", default="RequestID",
                   help="batch column giving the insertion order")
    p.add_argument("--run", help="key of an ingest run; the same key again completes a failed run")
    p.add_argument("--runs", help="folder for the runs' staged rows (default: the tables' folder)")
    p.add_argument("--before", help="archive events before this time")
    p.add_argument("--instance")
    p.add_argument("--product")
    p.add_argument("--ids", default=",".join(reports.HIERARCHY_IDS))
    p.add_argument("--as-of", dest="as_of")
    p.add_argument("--scope", default="global")
    p.add_argument("--features", default="by_product")
    p.add_argument("--model")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if not (args.tables or args.database):
        raise SystemExit("give --tables or --database")
    own = spark is None
    spark = spark or build_session()
    try:
        _write(run(args, spark), args.out, args.out_format)
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
