"""Streaming operators over file sources, against their batch twins, with late and shuffled rows."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.operators import tasks as K
from reelspark.operators.tasks import EXPIRED
from reelspark.plans import adapters as A
from reelspark.plans import catalog
from reelspark.streaming import tasks as ST
from reelspark.streaming.run import STATE_STORE, refresh_expired

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def write_batches(spark, rows, schema, folder, parts):
    """Rows dealt to ``parts`` files that arrive one per micro-batch, in order."""
    for i, chunk in enumerate(parts):
        spark.createDataFrame([rows[j] for j in chunk], schema).coalesce(1).write.mode("append").parquet(f"{folder}/part={i:03d}")


def stream(spark, schema, folder):
    return spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, df, name, checkpoint, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name)


def test_heartbeat_expiry(spark, tmp_path):
    schema = "task_id long, ts timestamp, status string"
    rows = [(1, at(0), "running"), (2, at(5), "running"), (1, at(60), "running"), (3, at(70), "running"), (2, at(80), "completed"), (3, at(150), "running"), (9, at(400), "running"), (9, at(402), "running")]
    write_batches(spark, rows, schema, tmp_path / "in", [[0, 1], [2, 3], [4], [5], [6], [7]])
    out = run(spark, ST.expire_heartbeats(stream(spark, schema, tmp_path / "in")), "beats", tmp_path / "cp")
    got = {r["task_id"]: (r["status"], r["heartbeat_ms"]) for r in out.collect()}
    epoch = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert got == {1: ("interrupted", epoch + 60000), 3: ("interrupted", epoch + 150000)}


def test_expired_tasks_stay_expired_however_rows_are_batched(spark, tmp_path):
    schema = "task_id long, ts timestamp, status string"
    rows = [(1, at(0), "running"), (1, at(200), "running"), (1, at(500), "running"), (2, at(0), "running"), (2, at(60), "completed"), (2, at(400), "running"), (3, at(500), "running"), (3, at(10), "running")]
    found = []
    for n, parts in enumerate(([[0, 1, 2, 3, 4, 5, 6]], [[0, 3], [4], [1], [5, 2], [6]])):
        write_batches(spark, rows, schema, tmp_path / f"in{n}", parts)
        out = run(spark, ST.expire_heartbeats(stream(spark, schema, tmp_path / f"in{n}")), f"again{n}", tmp_path / f"cp{n}")
        found.append(sorted(r["task_id"] for r in out.collect()))
    assert found == [[1], [1]]


def test_a_restarted_stream_goes_on(spark, tmp_path):
    schema = "task_id long, ts timestamp, status string"
    rows = [(1, at(0), "running"), (1, at(300), "running"), (1, at(900), "running"), (2, at(900), "running")]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i:03d}")
        out = ST.expire_heartbeats(stream(spark, schema, tmp_path / "in"))
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(240)
    assert [r["task_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [1]


def test_task_fold_matches_batch(spark, tmp_path, data_dir):
    log = A.command_log(spark, data_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    schema = "task_id long, ts timestamp, seq long, op string, stage string, percent double, status string"
    slices = 4
    cut = log.withColumn("n", F.ntile(slices).over(Window.orderBy("ts", "seq")))
    for i in range(1, slices + 1):
        cut.where(F.col("n") == i).select("task_id", "ts", "seq", "op", "stage", "percent", "status").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={i:03d}")
    out = run(spark, ST.fold_tasks(stream(spark, schema, tmp_path / "in")), "folded", tmp_path / "cp", "update")
    final = out.withColumn("row", F.monotonically_increasing_id()).groupBy("task_id").agg(F.max_by(F.struct("status", "stage", "percent", "cancel_requested"), F.struct("heartbeat_ms", "row")).alias("s")).select("task_id", "s.*")
    batch = K.fold_task_log(A.command_log(spark, data_dir)).select("task_id", "status", "stage", "percent", "cancel_requested")
    assert sorted(map(tuple, final.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_cancel_wins_and_terminal_is_final(spark, tmp_path):
    schema = "task_id long, ts timestamp, seq long, op string, stage string, percent double, status string"
    rows = [(1, at(0), 0, "progress", "probe", 10.0, None), (1, at(1), 1, "cancel", None, None, None), (1, at(2), 2, "progress", "late", 50.0, None), (1, at(3), 3, "finish", None, None, "completed"), (1, at(4), 4, "finish", None, None, "failed"),
            (2, at(0), 5, "progress", "queued", None, None), (2, at(1), 6, "progress", "probe", 1.0, None), (2, at(2), 7, "progress", "score", 2.0, None), (2, at(3), 8, "finish", None, None, "completed"), (2, at(9), 9, "cancel", None, None, None)]
    write_batches(spark, rows, schema, tmp_path / "in", [[2, 1, 0, 5, 6], [3, 8, 7], [4, 9]])
    out = run(spark, ST.fold_tasks(stream(spark, schema, tmp_path / "in")), "cancels", tmp_path / "cp", "update")
    last = {}
    for r in out.collect():
        last[r["task_id"]] = r
    assert (last[1]["status"], last[1]["stage"], last[1]["percent"], last[1]["cancel_requested"]) == ("cancelled", "probe", 10.0, True)
    assert (last[2]["status"], last[2]["percent"], last[2]["n_steps"]) == ("completed", 100.0, 2)


def test_progress_stream_matches_batch(spark, tmp_path):
    schema = "op_id long, seq long, line string, duration double, scale double"
    rng = random.Random(1)
    rows = [(i % 3, i, rng.choice([f"out_time_us={rng.randint(0, 12_000_000)}", f"progress = {rng.randint(0, 120)}%", "out_time_us=N/A", "noise"]), 10.0, 98.0) for i in range(200)]
    shuffled = [list(range(i, i + 50)) for i in range(0, 200, 50)]
    for part in shuffled:
        rng.shuffle(part)
    write_batches(spark, rows, schema, tmp_path / "in", shuffled)
    got = run(spark, ST.progress_stream(stream(spark, schema, tmp_path / "in")), "lines", tmp_path / "cp").collect()
    log = spark.createDataFrame(rows, schema).select("op_id", F.timestamp_seconds("seq").alias("ts"), "seq", K.line_percent(F.col("line"), F.col("duration"), F.col("scale")).alias("percent"))
    want = K.monotone_progress(log).select("op_id", "seq", "percent").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_snapshot_stream_drops_old_and_repeated(spark, tmp_path):
    schema = "task_id long, ts timestamp, seq long, updated_at timestamp, status string, percent double"
    rows = [(1, at(0), 0, at(0), "running", 1.0), (1, at(1), 1, at(0), "running", 1.0), (1, at(2), 2, at(5), "running", 2.0), (1, at(3), 3, at(4), "running", 3.0), (1, at(4), 4, at(6), "odd", 3.0), (1, at(5), 5, at(7), "completed", 100.0), (1, at(6), 6, at(9), "running", 5.0), (2, at(6), 7, at(6), "running", 101.0)]
    write_batches(spark, rows, schema, tmp_path / "in", [[1, 0], [3, 2], [4], [5], [6, 7]])
    out = run(spark, ST.snapshot_stream(stream(spark, schema, tmp_path / "in")), "snaps", tmp_path / "cp")
    assert sorted(r["seq"] for r in out.collect()) == [0, 2, 5]


def test_lease_fence_stream_matches_batch(spark, tmp_path):
    schema = "task_id long, seq long, lease_id string"
    rows = [(i % 5, i, f"lease-{i % 3}") for i in range(60)] + [(0, 99, "")]
    leases = spark.createDataFrame([(i, f"lease-{i % 3}" if i else "", "running" if i != 4 else "failed") for i in range(5)], "task_id long, lease_id string, status string")
    write_batches(spark, rows, schema, tmp_path / "in", [list(range(30)), list(range(30, 61))])
    got = run(spark, ST.fence_stream(stream(spark, schema, tmp_path / "in"), leases), "fenced", tmp_path / "cp")
    want = K.fence_leases(spark.createDataFrame(rows, schema), leases)
    assert sorted(map(tuple, got.select("task_id", "seq").collect())) == sorted(map(tuple, want.select("task_id", "seq").collect()))
    assert got.count() > 0


def progress_of(df, checkpoint, tmp):
    q = df.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_state_goes_with_event_time(spark, tmp_path):
    schema = "task_id long, ts timestamp, seq long, updated_at timestamp, status string, percent double"
    day = 86400
    rows = [(i, at(i), i, at(i), "running", 1.0) for i in range(20)] + [(99, at(40 * day), 50, at(0), "running", 1.0), (99, at(80 * day), 51, at(1), "running", 1.0), (99, at(81 * day), 52, at(2), "running", 2.0)]
    write_batches(spark, rows, schema, tmp_path / "in", [list(range(20)), [20], [21], [22]])
    totals = progress_of(ST.snapshot_stream(stream(spark, schema, tmp_path / "in"), retention="10 days"), tmp_path / "cp", tmp_path)
    assert max(totals) >= 40 and totals[-1] < 10, totals
    assert sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [*range(20), 50, 51, 52]


def test_progress_state_goes_after_idle_time(spark, tmp_path):
    schema = "op_id long, seq long, line string, duration double, scale double"
    rows = [(i, i, "progress = 10%", 10.0, 98.0) for i in range(30)] + [(77, 100, "progress = 20%", 10.0, 98.0)]
    write_batches(spark, rows, schema, tmp_path / "in", [list(range(30))])
    before = progress_of(ST.progress_stream(stream(spark, schema, tmp_path / "in"), idle="3 seconds"), tmp_path / "cp", tmp_path)
    time.sleep(4)
    spark.createDataFrame(rows[30:], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part=900")
    after = progress_of(ST.progress_stream(stream(spark, schema, tmp_path / "in"), idle="3 seconds"), tmp_path / "cp", tmp_path)
    assert max(before) >= 30 and after[-1] < max(before), (before, after)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 31


def test_a_changed_lease_refuses_the_old_holder(spark, tmp_path):
    up, le = "task_id long, seq long, ts timestamp, lease_id string", "task_id long, lease_id string, granted_at timestamp, status string"
    updates = [(1, 0, at(10), "a"), (1, 1, at(200), "a"), (1, 2, at(210), "b"), (2, 3, at(20), "c"), (2, 4, at(400), "c"), (3, 5, at(30), "x"), (1, 6, at(90), "b"), (9, 7, at(5000), "z"), (9, 8, at(9000), "z")]
    leases = [(1, "a", at(0), "running"), (2, "c", at(0), "running"), (1, "b", at(100), "running"), (2, "c", at(300), "failed"), (9, "z", at(5000), "running"), (9, "z", at(9000), "running")]
    found = []
    for n, (parts, versions) in enumerate((([[0, 1, 2, 3, 4, 5, 6], [7], [8]], [[0, 1, 2, 3], [4], [5]]), ([[1, 4], [0, 3, 2], [5, 6], [7], [8]], [[2], [0], [1, 3], [4], [5]]))):
        write_batches(spark, updates, up, tmp_path / f"u{n}", parts)
        write_batches(spark, leases, le, tmp_path / f"l{n}", versions)
        out = run(spark, ST.fence_versions(stream(spark, up, tmp_path / f"u{n}").drop("part"), stream(spark, le, tmp_path / f"l{n}").drop("part")), f"versions{n}", tmp_path / f"cp{n}")
        found.append(sorted(r["seq"] for r in out.collect()))
    assert found == [[0, 2, 3, 7], [0, 2, 3, 7]]


def test_an_expired_task_changes_its_workflow_and_project(spark, tmp_path):
    schema = "task_id long, ts timestamp, status string"
    rows = [(1, at(0), "running"), (2, at(0), "running"), (3, at(300), "running"), (3, at(390), "running"), (4, at(900), "running")]
    write_batches(spark, rows, schema, tmp_path / "in", [[0, 1], [2], [3], [4]])
    tasks = spark.createDataFrame(
        [(1, 7, 70, "analyze", "content", 1, "running", ""), (2, 7, 70, "analyze", "content", 0, "completed", ""), (3, 8, 80, "export", "content", 1, "running", ""), (5, 8, 80, "export", "content", 2, "completed", ""), (4, 9, 90, "analyze", "content", 1, "running", "")],
        "task_id long, project_id long, workflow_id long, kind string, goal string, seq long, status string, error string",
    )
    goals = spark.createDataFrame([(70, "content", "analyzing", "", 0), (80, "content", "analyzing", "", 1), (90, "content", "analyzing", "", 0)], "workflow_id long, goal string, status string, error string, n_drafts int")
    flows, projects = refresh_expired(ST.expire_heartbeats(stream(spark, schema, tmp_path / "in")), spark, tasks, goals)
    assert {r["workflow_id"]: (r["goal_status"], r["workflow_status"], r["project_status"]) for r in flows.collect()} == {
        70: ("interrupted", "interrupted", "interrupted"), 80: ("failed", "partial", "partial")}
    assert {r["project_id"]: (r["status"], r["error"]) for r in projects.collect()} == {7: ("interrupted", EXPIRED), 8: ("interrupted", EXPIRED)}


def test_catalog_has_the_batch_twins():
    assert {"heartbeat_expiry", "task_state_stream", "lease_fence", "accepted_snapshots", "monotone_progress"} <= set(catalog.QUERIES)


@pytest.fixture(autouse=True)
def _small_state(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
