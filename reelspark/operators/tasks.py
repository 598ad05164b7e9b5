"""Task logs: step history, progress, snapshots, claims, heartbeats and checkpoints.

Log operators order rows per task; a task (or a source that looks like one) may own a large share of the
log, so ordered columns come from sliced scans, not from one window per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import Scan, prefix_scan, slice_hot_keys
from ..functions.text import first_reason
from .rollup import TERMINAL

STATUSES = ("queued", "running", "completed", "failed", "interrupted", "cancelled")
HEARTBEAT_SECONDS = 90
# Fixed value: error text of an expired task.
EXPIRED = "Worker heartbeat expired; review before retrying paid requests"
ORDER = ["ts", "seq"]


def _sliced(log: DataFrame, key: str = "task_id") -> DataFrame:
    """Log with slice ``__b`` of its task; ordinary tasks are one slice."""
    return slice_hot_keys(log, [key], ORDER)


def task_steps(log: DataFrame) -> DataFrame:
    """Completed steps per task, one row each: ``task_id, step_no, stage``.

    ``log``: task_id, ts, seq, stage, done.  A step completes when the stage changes (empty and ``queued`` do
    not count) and the last stage completes with the task.  Rows with an empty stage change nothing.
    """
    named = _sliced(log.where((F.coalesce("stage", F.lit("")) != "") | F.col("done")))
    prior = prefix_scan(
        named, ["task_id"], "__b", ORDER,
        [Scan("before", "last", F.when(F.coalesce("stage", F.lit("")) != "", F.col("stage")))],
    )
    stage = F.when(F.coalesce("stage", F.lit("")) != "", F.col("stage")).otherwise(F.col("before"))
    left = F.when((F.col("before") != stage) & (F.col("before") != "queued"), F.col("before"))
    steps = prior.select(
        "task_id", "ts", "seq", "__b",
        F.posexplode(F.array(left, F.when(F.col("done"), F.coalesce(stage, F.lit(""))))).alias("part", "step"),
    ).where(F.col("step").isNotNull())
    return prefix_scan(steps, ["task_id"], "__b", ["ts", "seq", "part"], [Scan("step_no", "count")]).select(
        "task_id", "step_no", F.col("step").alias("stage")
    )


def ffmpeg_percent(line: Column, duration: Column, scale: Column) -> Column:
    """Percent of one ``out_time_us=`` line, clamped to [0, scale]; null for other lines and ``N/A``."""
    value = F.regexp_extract(line, "^out_time_us=(.*)\\z", 1).try_cast("double")
    usable = line.startswith("out_time_us=") & ~F.isnan(value) & (F.abs(value) < float("inf")) & (duration > 0)
    return F.when(usable, F.least(scale, F.greatest(F.lit(0.0), value / F.lit(1e6) / duration * scale)))


def asr_percent(line: Column) -> Column:
    """Percent of a ``progress = N%`` line, at most 99."""
    n = F.regexp_extract(line, "progress\\s*=\\s*(\\d{1,3})%", 1)
    return F.when(n != "", F.least(F.lit(99), n.try_cast("int")))


def line_percent(line: Column, duration: Column, scale: Column) -> Column:
    return F.coalesce(ffmpeg_percent(line, duration, scale), asr_percent(line).cast("double"))


def monotone_progress(log: DataFrame) -> DataFrame:
    """Rows of ``op_id, ts, seq, percent`` that strictly exceed every earlier percent of the operation."""
    known = _sliced(log.where(F.col("percent").isNotNull()), "op_id")
    scanned = prefix_scan(known, ["op_id"], "__b", ORDER, [Scan("__best", "max", F.col("percent"))])
    return scanned.where(F.col("__best").isNull() | (F.col("percent") > F.col("__best"))).drop("__best", "__b")


def snapshot_changes(log: DataFrame, content: tuple[str, ...], status_col: str = "status") -> DataFrame:
    """Snapshots that differ from the one before, up to and including the first terminal one."""
    text = F.to_json(F.struct(*content), {"ignoreNullFields": "false"})
    boxed = _sliced(log.withColumn("__key", F.sha2(text, 256)))
    ended = F.when(F.col(status_col).isin(*TERMINAL), F.lit(1)).otherwise(F.lit(0))
    scanned = prefix_scan(
        boxed, ["task_id"], "__b", ORDER, [Scan("__prev", "lag", F.col("__key")), Scan("__ended", "sum", ended)]
    )
    return scanned.where(
        (F.col("__ended") == 0) & (F.col("__prev").isNull() | (F.col("__prev") != F.col("__key")))
    ).drop("__b", "__key", "__prev", "__ended")


def accepted_snapshots(log: DataFrame) -> DataFrame:
    """Arrivals (``task_id, ts`` arrival order, ``seq``, ``updated_at``, status, percent) that a reader accepts.

    Invalid rows are refused; a row older than the newest accepted one is dropped, ties are accepted; nothing is
    accepted after a terminal snapshot.
    """
    pct = F.col("percent")
    valid = F.col("status").isin(*STATUSES) & (pct.isNull() | (~F.isnan(pct) & (pct >= 0) & (pct <= 100)))
    rows = _sliced(log.where(F.coalesce(valid, F.lit(False))))
    scanned = prefix_scan(rows, ["task_id"], "__b", ORDER, [Scan("__newest", "max", F.col("updated_at"))])
    fresh = scanned.where(F.col("__newest").isNull() | (F.col("updated_at") >= F.col("__newest"))).drop("__newest")
    ended = F.when(F.col("status").isin(*TERMINAL), F.lit(1)).otherwise(F.lit(0))
    return (
        prefix_scan(fresh, ["task_id"], "__b", ORDER, [Scan("__ended", "sum", ended)])
        .where(F.col("__ended") == 0)
        .drop("__b", "__ended")
    )


def latest_snapshot(log: DataFrame) -> DataFrame:
    """The snapshot a reader ends on, per task."""
    rest = [c for c in log.columns if c not in ("task_id",)]
    return (
        accepted_snapshots(log)
        .groupBy("task_id")
        .agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("s"))
        .select("task_id", "s.*")
    )


def claimable_tasks(tasks: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Oldest queued task per ``scope`` (whole table by default) where nothing is running."""
    queued = F.col("status") == "queued"
    picked = tasks.groupBy(*scope).agg(
        F.bool_or(F.col("status") == "running").alias("running"),
        F.min_by("task_id", F.when(queued, F.struct("seq", "task_id"))).alias("task_id"),
    )
    return picked.where(~F.col("running") & F.col("task_id").isNotNull()).drop("running")


def busy_projects(tasks: DataFrame) -> DataFrame:
    """``project_id, busy, import_ready`` per project with tasks."""
    return tasks.groupBy("project_id").agg(
        F.bool_or(F.col("status").isin("queued", "running")).alias("busy"),
        (~F.bool_or((F.col("kind") == "import") & (F.col("status") != "completed"))).alias("import_ready"),
    )


def expire_heartbeats(tasks: DataFrame, now: Column, seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Running tasks whose heartbeat is older than ``seconds`` become interrupted and retryable."""
    expired = (F.col("status") == "running") & (F.col("heartbeat") < now - F.make_dt_interval(secs=F.lit(seconds)))
    return tasks.withColumns(
        {
            "status": F.when(expired, F.lit("interrupted")).otherwise(F.col("status")),
            "retryable": F.when(expired, F.lit(True)).otherwise(F.col("retryable")),
            "error": F.when(expired, F.lit(EXPIRED)).otherwise(F.col("error")),
        }
    )


def fence_leases(updates: DataFrame, leases: DataFrame) -> DataFrame:
    """Updates whose lease is the current lease of a running task (batch or stream on the left)."""
    current = leases.where(F.col("status") == "running").select("task_id", F.col("lease_id").alias("__lease"))
    return (
        updates.join(current, "task_id")
        .where((F.col("lease_id") != "") & (F.col("lease_id") == F.col("__lease")))
        .drop("__lease")
    )


def fold_task_log(log: DataFrame) -> DataFrame:
    """Final state of each task from its command log (batch twin of the stream fold).

    ``log``: task_id, ts, seq, op (progress / heartbeat / cancel / finish), stage, percent, status.  A task
    starts running; after a cancel request progress is refused and any finish becomes ``cancelled``; the
    first finish is final and later commands are ignored.
    """
    op = F.col("op")
    flagged = _sliced(log)
    scanned = prefix_scan(
        flagged, ["task_id"], "__b", ORDER,
        [
            Scan("__ended", "sum", F.when(op == "finish", F.lit(1)).otherwise(F.lit(0))),
            Scan("__cancel", "sum", F.when(op == "cancel", F.lit(1)).otherwise(F.lit(0))),
        ],
    ).where(F.col("__ended") == 0)
    live = scanned.withColumn("__open", F.col("__cancel") == 0)
    moves = (op == "progress") & F.col("__open")
    beat = op.isin("progress", "heartbeat") & F.col("__open") | op.isin("cancel", "finish")
    at = F.struct("ts", "seq")
    facts = live.groupBy("task_id").agg(
        F.max_by("stage", F.when(moves & (F.coalesce("stage", F.lit("")) != ""), at)).alias("stage"),
        F.max_by(F.struct("percent"), F.when(moves, at)).alias("p"),
        F.max(F.when(beat, F.col("ts"))).alias("heartbeat"),
        F.bool_or(op == "cancel").alias("cancel_requested"),
        F.max_by(F.struct("status", (F.col("__cancel") > 0).alias("c")), F.when(op == "finish", at)).alias("f"),
    )
    status = (
        F.when(F.col("f").isNull(), F.lit("running"))
        .when(F.col("f.c"), F.lit("cancelled"))
        .otherwise(F.col("f.status"))
    )
    out = facts.withColumn("status", status)
    return out.select(
        "task_id", "status", "stage",
        F.when(F.col("status") == "completed", F.lit(100.0)).otherwise(F.col("p.percent")).alias("percent"),
        "heartbeat", "cancel_requested",
    )


VERSION = "reelspark-1"
#: Stages of a run that are chained.
MAX_STAGES = 256


def checkpoint_lineage(stages: DataFrame, saved: DataFrame, version: str = VERSION) -> DataFrame:
    """Digest chain of each run, and whether each saved checkpoint is still valid.

    ``stages``: run_id, n (0-based), stage, input, data; ``saved``: run_id, stage, version, input_hash, previous,
    data_hash.  A run has a short list of stages (one row each), folded per run in the JVM; a stage at place ``MAX_STAGES`` or
    later is never gathered and comes back as ``too_many_stages``.
    """
    hex_digest = lambda c: F.sha2(c, 256)
    listed = F.col("n") < MAX_STAGES
    runs = stages.where(listed).groupBy("run_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("n", "stage", hex_digest(F.col("input")).alias("input_hash"), hex_digest(F.col("data")).alias("data_hash"))
            )
        ).alias("xs")
    )
    link = "struct<stage:string,input_hash:string,previous:string,data_hash:string>"
    zero = F.struct(F.array().cast(f"array<{link}>").alias("links"), F.lit("").alias("previous"))

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(
            x["stage"].alias("stage"), x["input_hash"].alias("input_hash"), acc["previous"].alias("previous"),
            x["data_hash"].alias("data_hash"),
        )
        after = hex_digest(F.concat_ws(":", acc["previous"], x["stage"], x["data_hash"]))
        return F.struct(F.concat(acc["links"], F.array(here)).alias("links"), after.alias("previous"))

    chain = runs.select("run_id", F.inline(F.aggregate("xs", zero, step, lambda a: a["links"])))
    s = saved.select(
        "run_id", "stage", F.col("version").alias("s_version"), F.col("input_hash").alias("s_input"),
        F.col("previous").alias("s_previous"), F.col("data_hash").alias("s_data"),
    )
    joined = chain.join(s, ["run_id", "stage"], "left")
    reason = first_reason(
        (F.col("s_version").isNull(), "absent"),
        (F.col("s_version") != version, "version"),
        (F.col("s_input") != F.col("input_hash"), "input"),
        (F.col("s_previous") != F.col("previous"), "previous"),
        (F.col("s_data") != F.col("data_hash"), "data"),
    )
    checked = joined.select("run_id", "stage", "input_hash", "previous", "data_hash", reason.alias("stale_reason"))
    rest = stages.where(~listed).select(
        "run_id", "stage", hex_digest(F.col("input")).alias("input_hash"), F.lit(None).cast("string").alias("previous"),
        hex_digest(F.col("data")).alias("data_hash"), F.lit("too_many_stages").alias("stale_reason"),
    )
    return checked.unionByName(rest)
