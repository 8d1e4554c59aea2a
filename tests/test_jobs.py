"""The batch jobs end to end on the seed tables stored as parquet."""

import pytest
from pyspark.sql import functions as F

from tracewise import jobs
from tracewise.sources.tables import TABLE_NAMES


def _store(seed, base):
    for name in TABLE_NAMES:
        getattr(seed, name).write.mode("overwrite").parquet(f"{base}/{name}")


def test_jobs_flow(spark, seed, tmp_path):
    tables, out = str(tmp_path / "tables"), str(tmp_path / "out")
    _store(seed, tables)
    jobs.main(["dashboard", "--tables", tables, "--out", f"{out}/dash"], spark=spark)
    score = spark.read.json(f"{out}/dash/score").first()
    assert score.score == 1.92
    batch = spark.createDataFrame([(1, "NEW-9", "P100"), (2, "eco-0001", "P200")],
                                  "RequestID long, SerialNumber string, ProductID string")
    batch.write.parquet(str(tmp_path / "reg"))
    jobs.main(["register", "--tables", tables, "--out", f"{out}/reg", "--batch",
               str(tmp_path / "reg"), "--as-of", "2025-12-01 09:00:00"], spark=spark)
    assert spark.read.parquet(f"{tables}/product_instances").count() == 5
    assert spark.read.parquet(f"{tables}/lifecycle_events").count() == 14
    assert spark.read.json(f"{out}/reg/rejected").first().reason == "Duplicate serial number"
    new = spark.read.parquet(f"{tables}/product_instances").filter("SerialNumber = 'NEW-9'").first()
    made = spark.read.parquet(f"{tables}/lifecycle_events").filter("EventID = 14").first()
    assert new.InstanceID == 5 and made.InstanceID == 5 and made.EventType == "Manufactured"
    assert spark.read.json(f"{out}/reg/accepted").first().InstanceID == 5
    ev = spark.createDataFrame([(1, "5", "Sold"), (2, "5", "Disposed"), (3, "9", "Repair")],
                               "RequestID long, InstanceRef string, EventType string")
    ev.write.parquet(str(tmp_path / "ev"))
    jobs.main(["add-events", "--tables", tables, "--out", f"{out}/ev", "--batch",
               str(tmp_path / "ev"), "--as-of", "2025-12-02 09:00:00"], spark=spark)
    le = spark.read.parquet(f"{tables}/lifecycle_events")
    assert le.count() == 16 and le.agg({"EventID": "max"}).first()[0] == 16
    jobs.main(["lifecycle", "--tables", tables, "--out", f"{out}/lc", "--instance", "5",
               "--as-of", "2025-12-31"], spark=spark)
    tl = spark.read.json(f"{out}/lc/timeline").orderBy("seq").collect()
    assert [r.EventType for r in tl] == ["Manufactured", "Sold", "Disposed"]
    assert spark.read.json(f"{out}/lc/instance").first().age_days == 30
    jobs.main(["audit", "--tables", tables, "--out", f"{out}/audit"], spark=spark)
    bad = spark.read.json(f"{out}/audit/audit").filter("violations > 0").count()
    assert bad == 0
    jobs.main(["trace", "--tables", tables, "--out", f"{out}/tr", "--product", "P100"],
              spark=spark)
    assert spark.read.json(f"{out}/tr/trace").count() == 6
    jobs.main(["recycle", "--tables", tables, "--out", f"{out}/rc", "--as-of",
               "2025-12-03 00:00:00"], spark=spark)
    le = spark.read.parquet(f"{tables}/lifecycle_events")
    assert le.count() == 21 and le.select("EventID").distinct().count() == 21
    out_ids = sorted(r.EventID for r in spark.read.json(f"{out}/rc/recycle_events").collect())
    assert out_ids == [17, 18, 19, 20, 21]


def test_jobs_other_commands(spark, seed, tmp_path):
    tables, out = str(tmp_path / "tables"), str(tmp_path / "out")
    _store(seed, tables)
    comp = spark.createDataFrame([(1, "C102", "M3", "600"), (2, "C102", "M1", "10.005"),
                                  (3, "c102", "m1", "5"), (4, "C101", "M4", "3")],
                                 "RequestID long, ComponentID string, MaterialID string, "
                                 "WeightInGrams string")
    comp.write.parquet(str(tmp_path / "comp"))
    jobs.main(["add-composition", "--tables", tables, "--out", f"{out}/comp", "--batch",
               str(tmp_path / "comp")], spark=spark)
    cc = spark.read.parquet(f"{tables}/component_composition")
    assert cc.count() == 9
    assert {r.reason for r in spark.read.json(f"{out}/comp/rejected").collect()} == \
        {"Excessive hazardous material use detected!", "Duplicate composition row"}
    so = spark.createDataFrame([(1, "S3", "component", "C102"), (2, "S9", "material", "M1")],
                               "RequestID long, SupplierID string, supply_type string, "
                               "item_id string")
    so.write.parquet(str(tmp_path / "so"))
    jobs.main(["add-sourcing", "--tables", tables, "--out", f"{out}/so", "--batch",
               str(tmp_path / "so")], spark=spark)
    src = spark.read.parquet(f"{tables}/sourcing")
    assert src.count() == 7 and src.agg({"SourcingID": "max"}).first()[0] == 7
    sup = spark.createDataFrame([(1, "S4", "New"), (2, "s4", "Again")],
                                "RequestID long, SupplierID string, SupplierName string")
    sup.write.parquet(str(tmp_path / "sup"))
    jobs.main(["add-suppliers", "--tables", tables, "--out", f"{out}/sup", "--batch",
               str(tmp_path / "sup")], spark=spark)
    assert spark.read.parquet(f"{tables}/suppliers").count() == 4
    jobs.main(["suppliers", "--tables", tables, "--out", f"{out}/s"], spark=spark)
    types = {r.SupplierID: r.SupplierType for r in spark.read.json(f"{out}/s/suppliers").collect()}
    assert types["S3"] == "Both" and types["S4"] == "Unknown"
    jobs.main(["hierarchy", "--tables", tables, "--out", f"{out}/h"], spark=spark)
    assert spark.read.json(f"{out}/h/hierarchy").count() == 2


def test_jobs_on_bucketed_catalog(spark, seed, tmp_path):
    from tracewise.sources.tables import save_tables

    spark.sql(f"create database if not exists jobdb location '{tmp_path / 'db'}'")
    save_tables(seed, "jobdb", 4)
    out = str(tmp_path / "out")
    batch = spark.createDataFrame([(1, "NEW-7", "P200")],
                                  "RequestID long, SerialNumber string, ProductID string")
    batch.write.parquet(str(tmp_path / "reg"))
    jobs.main(["register", "--database", "jobdb", "--out", f"{out}/reg", "--batch",
               str(tmp_path / "reg"), "--as-of", "2025-12-01 09:00:00"], spark=spark)
    pi = spark.table("jobdb.product_instances")
    assert pi.count() == 5 and pi.filter("SerialNumber = 'NEW-7'").first().InstanceID == 5
    le = spark.table("jobdb.lifecycle_events")
    assert le.filter("EventID = 14").first().InstanceID == 5
    jobs.main(["dashboard", "--database", "jobdb", "--out", f"{out}/d"], spark=spark)
    counts = dict((r.metric, r.row_count) for r in spark.read.json(f"{out}/d/counts").collect())
    assert counts["instances"] == 5 and counts["events"] == 14


def test_train_job(spark, tmp_path):
    from tracewise.sources.testdata import driver_tables

    tables, out = str(tmp_path / "tables"), str(tmp_path / "out")
    _store(driver_tables(spark, "/root/testdata/sf0.001"), tables)
    jobs.main(["train", "--tables", tables, "--out", out, "--model", str(tmp_path / "m")],
              spark=spark)
    report = {r.label: r for r in spark.read.json(f"{out}/report").collect()}
    assert {"0", "1", "accuracy", "macro avg", "weighted avg"} <= set(report)
    preds = spark.read.json(f"{out}/predictions")
    assert preds.count() == report["accuracy"].support
    assert 0.0 <= spark.read.json(f"{out}/accuracy").first().accuracy <= 1.0
    from tracewise.operators import model

    assert model.load(str(tmp_path / "m")) is not None


def _register(spark, tables, out, batch, run):
    jobs.main(["register", "--tables", tables, "--out", out, "--batch", batch, "--run", run,
               "--as-of", "2025-12-01 09:00:00"], spark=spark)


def test_register_failing_between_appends_is_completed_by_a_rerun(spark, seed, tmp_path, monkeypatch):
    """A failure after the instances, before their events: the rerun adds the events only, and another run waits."""
    from tracewise.sources import runs

    tables, out, reg = str(tmp_path / "tables"), str(tmp_path / "out"), str(tmp_path / "reg")
    _store(seed, tables)
    spark.createDataFrame([(k, f"NEW-{k}", "P100") for k in range(1, 8)],
                          "RequestID long, SerialNumber string, ProductID string").write.parquet(reg)
    append, calls = jobs._append, []

    def failing(args, df, table):
        calls.append(table)
        if table == "lifecycle_events":
            raise OSError("lost")
        append(args, df, table)

    monkeypatch.setattr(jobs, "_append", failing)
    with pytest.raises(OSError):
        _register(spark, tables, out, reg, "monday")
    assert calls == ["product_instances", "lifecycle_events"]
    monkeypatch.setattr(jobs, "_append", append)
    with pytest.raises(runs.UnfinishedRun):
        _register(spark, tables, out, reg, "tuesday")
    before = spark.read.parquet(f"{tables}/lifecycle_events").count()
    for _ in range(2):                                     # the second one finds nothing to do
        _register(spark, tables, out, reg, "monday")
        pi, le = spark.read.parquet(f"{tables}/product_instances"), spark.read.parquet(f"{tables}/lifecycle_events")
        new = pi.filter("SerialNumber like 'NEW-%'")
        assert new.count() == 7 and le.count() == before + 7
        assert le.join(new, "InstanceID").groupBy("InstanceID").count().where("count <> 1").isEmpty()
        assert le.select("EventID").distinct().count() == le.count()
    assert spark.read.json(f"{out}/accepted").count() == 7
    _register(spark, tables, out, reg, "tuesday")           # now all serials are taken
    assert spark.read.parquet(f"{tables}/product_instances").count() == pi.count()
    assert spark.read.json(f"{out}/rejected").count() == 7


def test_rerun_adds_only_the_rows_that_are_missing(spark, tmp_path):
    from tracewise.sources import runs

    root = str(tmp_path / "t")
    spark.range(5).write.parquet(f"{root}/a")
    read = lambda: spark.read.parquet(f"{root}/a")
    target = runs.Target("a", ("id",), read, lambda df: df.write.mode("append").parquet(f"{root}/a"))
    staged = runs.commit(spark, root, "k", lambda: {"a": spark.range(3, 9), "other": spark.range(1)}, [target])
    assert sorted(r.id for r in read().collect()) == list(range(9))
    assert staged["other"].count() == 1 and runs.pending(spark, root) == []


def test_archive_job(spark, seed, tmp_path, monkeypatch):
    """Readers see a whole table at every step; a failed archive is run again; later jobs use the kept version."""
    from tracewise.sources import versions
    from tracewise.sources.tables import load

    tables, out = str(tmp_path / "tables"), str(tmp_path / "out")
    _store(seed, tables)
    every = seed.lifecycle_events.count()
    cut = "2024-02-01 12:00:00"
    old = seed.lifecycle_events.filter(F.col("EventDate") < F.lit(cut).cast("timestamp_ntz")).count()
    assert 0 < old < every
    args = ["archive", "--tables", tables, "--out", f"{out}/ar", "--before", cut]

    def failing(df, folder, keep=2):
        raise OSError("lost")

    publish = versions.publish
    monkeypatch.setattr(versions, "publish", failing)
    with pytest.raises(OSError):
        jobs.main(args, spark=spark)
    assert load(spark, tables, "lifecycle_events").count() == every         # backed up, nothing removed
    reader = load(spark, tables, "lifecycle_events")
    monkeypatch.setattr(versions, "publish", publish)
    for _ in range(2):
        jobs.main(args, spark=spark)
        assert load(spark, tables, "lifecycle_events").count() == every - old
        assert spark.read.parquet(f"{tables}/lifecycle_events_backup").count() == old
    assert reader.count() == every                                            # a reader that began before
    spark.createDataFrame([(1, "1", "Repair")], "RequestID long, InstanceRef string, EventType string").write.parquet(str(tmp_path / "ev"))
    jobs.main(["add-events", "--tables", tables, "--out", f"{out}/ev", "--batch", str(tmp_path / "ev"), "--as-of", "2025-12-02 09:00:00"], spark=spark)
    assert load(spark, tables, "lifecycle_events").count() == every - old + 1
