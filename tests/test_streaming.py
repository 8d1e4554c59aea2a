"""The streaming gate equals the batch gate, across micro-batches and a restart."""

import pyarrow.parquet as pq

from conftest import rows
from tracewise.operators import gates
from tracewise.sources.testdata import driver_tables
from tracewise.streaming.runner import run_disposal_gate, run_outcomes

SF = "/root/testdata/sf0.001"


def _write_parts(folder, parts):
    t = pq.read_table(f"{SF}/events.parquet").sort_by("event_id")
    n = t.num_rows
    bounds = [n * i // parts for i in range(parts + 1)]
    for i in range(parts):
        pq.write_table(t.slice(bounds[i], bounds[i + 1] - bounds[i]),
                       f"{folder}/events_{i:02d}.parquet")
    return t


def test_stream_gate_equals_batch_with_restart(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    t = pq.read_table(f"{SF}/events.parquet").sort_by("event_id")
    half = t.num_rows // 2
    # first run: two files, one per micro-batch
    pq.write_table(t.slice(0, half // 2), f"{src}/events_00.parquet")
    pq.write_table(t.slice(half // 2, half - half // 2), f"{src}/events_01.parquet")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    run_disposal_gate(spark, str(src), out=out, checkpoint=ckpt, max_files=1)
    first = spark.read.parquet(out).count()
    assert first == half
    # restart from the checkpoint with more files: only new rows are processed
    pq.write_table(t.slice(half, t.num_rows - half), f"{src}/events_02.parquet")
    run_disposal_gate(spark, str(src), out=out, checkpoint=ckpt, max_files=1)
    streamed = spark.read.parquet(out)
    le = driver_tables(spark, SF).lifecycle_events
    batch = gates.with_status(gates.disposal_gate(le.limit(0), le.select(
        "EventID", "InstanceID", "EventType")))
    cols = ("EventID", "InstanceID", "EventType", "status", "reason")
    assert rows(streamed, *cols) == rows(batch, *cols)
    got = dict(rows(streamed.groupBy("status").count()))
    assert got == {"accepted": 910, "rejected": 90}


def test_stream_outcomes(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    _write_parts(str(src), 3)
    out = run_outcomes(spark, str(src), out=str(tmp_path / "out"),
                       checkpoint=str(tmp_path / "ck"), max_files=1)
    le = driver_tables(spark, SF).lifecycle_events
    expect = le.groupBy("EventType").count()
    assert rows(spark.read.parquet(out)) == rows(expect)


def test_batched_stream_gate_equals_batch_with_restart(spark, tmp_path):
    from tracewise.streaming.batched import gate_output, run_disposal_gate_batched

    src = tmp_path / "src"
    src.mkdir()
    t = pq.read_table(f"{SF}/events.parquet").sort_by("event_id")
    third = t.num_rows // 3
    pq.write_table(t.slice(0, third), f"{src}/events_00.parquet")
    pq.write_table(t.slice(third, third), f"{src}/events_01.parquet")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    run_disposal_gate_batched(spark, str(src), out=out, checkpoint=ckpt, max_files=1)
    pq.write_table(t.slice(2 * third, t.num_rows - 2 * third), f"{src}/events_02.parquet")
    run_disposal_gate_batched(spark, str(src), out=out, checkpoint=ckpt, max_files=1)
    streamed = gate_output(spark, out)
    assert streamed.select("epoch").distinct().count() == 4      # three batches and the held rows
    le = driver_tables(spark, SF).lifecycle_events
    batch = gates.with_status(gates.disposal_gate(le.limit(0), le.select(
        "EventID", "InstanceID", "EventType")))
    cols = ("EventID", "InstanceID", "EventType", "status", "reason")
    assert rows(streamed, *cols) == rows(batch, *cols)


def test_files_out_of_event_order(spark, tmp_path):
    """Any cut of files in any order gives the batch gate's decisions (set-based form);
    the keyed form admits no row that the batch gate refuses."""
    from tracewise.streaming.batched import gate_output, run_disposal_gate_batched

    src = tmp_path / "src"
    src.mkdir()
    t = pq.read_table(f"{SF}/events.parquet").sort_by("event_id")
    n = t.num_rows
    for name, a, b in (("00", n // 2, n), ("01", 0, n // 4), ("02", n // 4, n // 2)):
        pq.write_table(t.slice(a, b - a), f"{src}/events_{name}.parquet")
    le = driver_tables(spark, SF).lifecycle_events
    cols = ("EventID", "InstanceID", "EventType", "status", "reason")
    expect = rows(gates.with_status(gates.disposal_gate(le.limit(0), le.select(*cols[:3]))), *cols)
    for k in (None, 1, 2):
        out = run_disposal_gate_batched(spark, str(src), out=str(tmp_path / f"out{k}"),
                                        checkpoint=str(tmp_path / f"ckpt{k}"), max_files=k)
        assert rows(gate_output(spark, out), *cols) == expect
    out = run_disposal_gate(spark, str(src), out=str(tmp_path / "keyed"),
                            checkpoint=str(tmp_path / "keyed-ckpt"), max_files=1)
    admitted = {r[0] for r in expect if r[3] == "accepted"}
    assert {r.EventID for r in spark.read.parquet(out).where("status = 'accepted'").collect()} <= admitted


def test_state_stays_small_over_many_epochs(spark, tmp_path):
    """Fifty epochs in reverse order of events: one folder per bucket and at most two manifests stay, a batch
    touches few buckets, held rows leave when their sale comes, and the decisions are the batch gate's."""
    import json
    import time

    from tracewise.sources import versions
    from tracewise.streaming import batched

    src = tmp_path / "src"
    src.mkdir()
    t = pq.read_table(f"{SF}/events.parquet").sort_by("event_id")
    n, files = t.num_rows, 50
    for k in range(files):
        a, b = n * (files - 1 - k) // files, n * (files - k) // files
        pq.write_table(t.slice(a, b - a), f"{src}/events_{k:02d}.parquet")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    seen, clean = [], batched._clean

    def watched(spark_, state, epoch, before):
        clean(spark_, state, epoch, before)
        kept = [f for f in versions.names(spark_, state) if f.startswith("epoch=")]
        folders = sum(sum(x.startswith("bucket=") for x in versions.names(spark_, f"{state}/{f}")) for f in kept)
        seen.append((time.time(), folders, len(versions.names(spark_, f"{state}/_manifest"))))

    batched._clean = watched
    try:
        batched.run_disposal_gate_batched(spark, str(src), out=out, checkpoint=ckpt, max_files=1, buckets=16)
    finally:
        batched._clean = clean
    assert len(seen) == files
    assert max(f for _, f, _ in seen) <= 2 * 16 and max(m for _, _, m in seen) <= 2
    early, late = seen[14][0] - seen[4][0], seen[48][0] - seen[38][0]
    assert late < 2.5 * early                      # seconds of ten epochs, late against early
    le = driver_tables(spark, SF).lifecycle_events
    cols = ("EventID", "InstanceID", "EventType", "status", "reason")
    expect = rows(gates.with_status(gates.disposal_gate(le.limit(0), le.select(*cols[:3]))), *cols)
    got = batched.gate_output(spark, out)
    assert rows(got, *cols) == expect
    manifest = versions.read_text(spark, f"{ckpt}-state/_manifest/{files - 1:012d}")
    left = batched._state(spark, f"{ckpt}-state", {int(k): v for k, v in json.loads(manifest).items()}, list(range(16)))
    held = left.where("lower(EventType) = 'disposed'")
    assert held.count() == sum(r[3] == "rejected" for r in expect)
    assert left.where("lower(EventType) = 'sold'").groupBy("InstanceID").count().where("count > 1").count() == 0


def test_outcomes_reader_sees_whole_versions(spark, tmp_path):
    """At every publish the reader's version holds the whole distribution of the epochs so far."""
    from tracewise.sources import versions
    from tracewise.streaming import runner

    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    t = _write_parts(str(src), 4)
    totals, publish = [], versions.publish

    def watched(df, folder, keep=2):
        if versions.current(spark, folder):
            totals.append(versions.read_current(spark, folder).groupBy().sum("cnt").first()[0])
        path = publish(df, folder, keep)
        totals.append(versions.read_current(spark, folder).groupBy().sum("cnt").first()[0])
        return path

    versions.publish = watched
    try:
        runner.run_outcomes(spark, str(src), out=out, checkpoint=str(tmp_path / "ck"), max_files=1)
    finally:
        versions.publish = publish
    quarter = t.num_rows // 4
    assert totals == [quarter, quarter, 2 * quarter, 2 * quarter, 3 * quarter, 3 * quarter, 4 * quarter]
    assert len(versions.names(spark, f"{out}/_versions")) == 2
