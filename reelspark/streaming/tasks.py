"""Structured Streaming over task and progress feeds.

Every operator takes and returns a streaming DataFrame; the caller chooses source, sink and trigger.  State per
task is a few typed scalars in the RocksDB state store; it goes by event-time timers.  Rows of
one micro-batch and key are put in event order and applied as columns (running maxima, first ends), not row by row; the
micro-batch size bounds that work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.rollup import TERMINAL
from ..operators.tasks import EXPIRED, HEARTBEAT_SECONDS, STATUSES, fence_leases, line_percent


#: Event time for which a task without rows is remembered.
RETENTION = "30 days"


def _in_order(pdfs: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    return pd.concat(list(pdfs)).sort_values(columns, kind="stable")


def _millis(ts: pd.Timestamp) -> int:
    return pd.Timestamp(ts).as_unit("ns").value // 1_000_000


def expire_heartbeats(
    feed: DataFrame, seconds: int = HEARTBEAT_SECONDS, delay: str = "10 seconds", retention: str = RETENTION
) -> DataFrame:
    """``task_id, ts, status`` feed -> one row per task whose heartbeat stopped for ``seconds`` of event time.

    A gap within the rows of one batch counts like one that the watermark shows, so the result does not depend on how
    rows fall into batches.  An expired or finished task stays marked for ``retention`` of event time: later rows neither
    revive it nor interrupt it again; then its state goes.
    """
    wait, keep = seconds * 1000, pd.Timedelta(retention).value // 1_000_000

    def expired(key, last):
        return pd.DataFrame(
            {"task_id": [key[0]], "status": ["interrupted"], "heartbeat_ms": [last], "retryable": [True], "error": [EXPIRED]}
        )

    def settle(state: GroupState, last: int, done: bool) -> None:
        state.update((last, done))
        # what is already behind the watermark fires with the next one
        state.setTimeoutTimestamp(max(last + (keep if done else wait), state.getCurrentWatermarkMs() + 1))

    def fold(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            last, done = state.get
            if done:
                state.remove()
                return
            settle(state, last, True)
            yield expired(key, last)
            return
        last, done = state.get if state.exists else (None, False)
        if done:
            settle(state, last, True)
            return
        rows = _in_order(pdfs, ["ts"])
        at = rows["ts"].map(_millis).to_numpy()
        end = rows["status"].isin(TERMINAL).to_numpy()
        before = np.concatenate([[at[0] if last is None else last], np.maximum.accumulate(at)[:-1]])
        before = np.maximum(before, before[0])
        gap = np.flatnonzero(at - before > wait)
        finish = np.flatnonzero(end)
        if len(gap) and (not len(finish) or gap[0] <= finish[0]):
            settle(state, int(before[gap[0]]), True)
            yield expired(key, int(before[gap[0]]))
        else:
            settle(state, int(max(at.max(), before[0])), bool(len(finish)))

    return (
        feed.withWatermark("ts", delay)
        .groupBy("task_id")
        .applyInPandasWithState(
            fold,
            "task_id long, status string, heartbeat_ms long, retryable boolean, error string",
            "last long, done boolean",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


class _Remembered(StatefulProcessor):
    """A value per key that goes after ``keep`` milliseconds of event time without rows.

    A key has one timer at most: when it fires too early for the newest row, it is set again.
    """

    schema: str

    def __init__(self, keep: int):
        # Parsed here, since workers have no session to do so.
        self.keep, self.kinds = keep, (StructType.fromDDL(self.schema), StructType.fromDDL("at bigint"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value, self.until = (handle.getValueState(n, k) for n, k in zip(("value", "until"), self.kinds, strict=True))

    def known(self, fresh: tuple) -> tuple:
        return tuple(self.value.get()) if self.value.exists() else fresh

    def remember(self, value: tuple, newest: int, timers) -> None:
        at = max(newest + self.keep, timers.getCurrentWatermarkInMs() + 1)
        if not self.until.exists():
            self.handle.registerTimer(at)
        self.value.update(value)
        self.until.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (at,) = self.until.get()
        if at > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(at)
        else:
            self.value.clear()
            self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def _keep(retention: str) -> int:
    return pd.Timedelta(retention).value // 1_000_000


def _all_millis(column: pd.Series) -> np.ndarray:
    return column.to_numpy("datetime64[ms]").astype(np.int64)


class _TaskFold(_Remembered):
    schema = "status string, stage string, percent double, n_steps int, heartbeat_ms bigint, cancel boolean, applied bigint"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows, ["ts", "seq"])
        status, stage, percent, steps, beat, cancel, applied = self.known(("running", None, None, 0, 0, False, 0))
        at, op = _all_millis(frame["ts"]), frame["op"].to_numpy()
        if status == "running":
            n = len(frame)
            first = lambda hit: int(np.argmax(hit)) if hit.any() else n
            finish = first(op == "finish")
            stop = 0 if cancel else min(finish, first(op == "cancel"))
            # Progress counts up to the first cancel; cancels and the first finish count up to that finish.
            place = np.arange(n)
            moved = (op == "progress") & (place < stop)
            named = frame["stage"].where(moved & frame["stage"].fillna("").ne("").to_numpy()).dropna().to_numpy()
            if len(named):
                before = np.concatenate([[stage], named[:-1]])
                left = (before != named) & (before != "queued") & pd.notna(before) & (before != "")
                steps, stage = steps + int(left.sum()), named[-1]
            if moved.any():
                last = frame["percent"].to_numpy()[np.flatnonzero(moved)[-1]]
                percent = None if pd.isna(last) else float(last)
            told = (moved | ((op == "heartbeat") & (place < stop)) | (op == "cancel")) & (place < finish) | (place == finish)
            if told.any():
                beat = int(at[np.flatnonzero(told)[-1]])
            cancel = cancel or bool((op[:finish] == "cancel").any())
            if finish < n:
                status = "cancelled" if cancel else frame["status"].iloc[finish]
                if status == "completed":
                    percent, steps = 100.0, steps + 1
        applied += len(frame)
        self.remember((status, stage, percent, steps, beat, cancel, applied), int(at.max()), timerValues)
        yield pd.DataFrame(
            {
                "task_id": [key[0]], "status": [status], "stage": [stage], "percent": [percent], "n_steps": [steps],
                "heartbeat_ms": [beat], "cancel_requested": [cancel], "applied": [applied],
            }
        )


def fold_tasks(feed: DataFrame, delay: str = "1 hour", retention: str = RETENTION) -> DataFrame:
    """Command feed (task_id, ts, seq, op, stage, percent, status) -> current state per task, in update mode.

    Same rules as the batch twin ``fold_task_log``: cancel wins over a late finish, a finished task is final.
    ``applied`` grows with every update.  State of a task goes after ``retention`` of event time without rows.
    """
    return feed.withWatermark("ts", delay).groupBy("task_id").transformWithStateInPandas(
        _TaskFold(_keep(retention)),
        "task_id long, status string, stage string, percent double, n_steps int, heartbeat_ms long, cancel_requested boolean, applied long",
        "Update",
        "EventTime",
    )


def fence_stream(feed: DataFrame, leases: DataFrame) -> DataFrame:
    """Stream-static join: only updates that carry the current lease of a running task pass."""
    return fence_leases(feed, leases)


def fence_versions(
    feed: DataFrame, leases: DataFrame, delay: str = "10 minutes", hold: str = "15 minutes"
) -> DataFrame:
    """Updates that carry the lease that was in force at their own time, while leases change.

    ``feed``: task_id, seq, ts, lease_id; ``leases``: task_id, lease_id, granted_at, status, a row per version.  A version is in
    force until the task's next one, and for ``hold`` at most (holders renew it); only a ``running`` one lets updates pass.
    Both feeds may be late by ``delay``: an update is decided when the watermark of both is ``hold`` past it, so an old holder
    is refused even if its update arrives before the news of the change.  Leases older than ``hold`` and decided updates
    leave the state.
    """
    updates = feed.withWatermark("ts", delay)
    versions = leases.select(
        F.col("task_id").alias("__task"), F.col("lease_id").alias("__lease"), "granted_at", F.col("status").alias("__status")
    ).withWatermark("granted_at", delay)
    in_force = (F.col("task_id") == F.col("__task")) & (F.col("granted_at") <= F.col("ts")) & (
        F.col("granted_at") > F.col("ts") - F.expr(f"INTERVAL {hold}")
    )
    # Of versions granted at the same time the last by name and status decides, so that the result is one.
    newest = F.struct("granted_at", "__lease", "__status")
    decided = (
        updates.join(versions, in_force)
        .groupBy("ts", "task_id", "seq", "lease_id")
        .agg(F.max(newest).alias("__v"))
    )
    passes = (F.col("__v.__status") == "running") & (F.col("__v.__lease") == F.col("lease_id")) & (F.col("lease_id") != "")
    return decided.where(passes).select("task_id", "seq", "ts", "lease_id")


class _Snapshots(_Remembered):
    schema = "newest bigint, shown string, ended boolean"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, shown, ended = self.known((-1, None, False))
        frame = _in_order(rows, ["ts", "seq"])
        arrived = int(_all_millis(frame["ts"]).max())
        percent = frame["percent"]
        frame = frame[frame["status"].isin(STATUSES) & (percent.isna() | percent.between(0, 100))]
        if not ended and len(frame):
            at = frame["updated_at"].to_numpy("datetime64[us]").astype(np.int64)
            floor = np.maximum.accumulate(np.concatenate([[newest], at]))[:-1]
            fresh = at >= floor
            end = fresh & frame["status"].isin(TERMINAL).to_numpy()
            if end.any():
                ended, fresh = True, fresh & (np.arange(len(at)) <= np.argmax(end))
            frame, at = frame[fresh], at[fresh]
            if len(at):
                content = np.array([f"{a}|{s}|{p}" for a, s, p in zip(at, frame["status"], frame["percent"], strict=True)], object)
                changed = content != np.concatenate([[shown], content[:-1]])
                newest, shown, frame = int(at[-1]), content[-1], frame[changed]
                if len(frame):
                    yield frame[["task_id", "seq", "updated_at", "status", "percent"]]
        self.remember((newest, shown, ended), arrived, timerValues)


def snapshot_stream(feed: DataFrame, delay: str = "1 hour", retention: str = RETENTION) -> DataFrame:
    """Arrivals (task_id, ts, seq, updated_at, status, percent) -> accepted snapshots that changed.

    Older ``updated_at`` than the newest accepted one is dropped; nothing follows a terminal snapshot.  What was newest
    and whether a task has ended is remembered for ``retention`` of event time after its last row.
    """
    return feed.withWatermark("ts", delay).groupBy("task_id").transformWithStateInPandas(
        _Snapshots(_keep(retention)),
        "task_id long, seq long, updated_at timestamp, status string, percent double",
        "Append",
        "EventTime",
    )


class _Rising(_Remembered):
    schema = "best double"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (best,) = self.known((-1.0,))
        frame = _in_order(rows, ["seq"])
        percent = frame["percent"].to_numpy(float)
        reached = np.maximum.accumulate(np.concatenate([[best], percent]))
        self.remember((float(reached[-1]),), int(_all_millis(frame["arrived"]).max()), timerValues)
        risen = frame[percent > reached[:-1]]
        if len(risen):
            yield risen[["op_id", "seq", "percent"]]


def progress_stream(lines: DataFrame, idle: str = RETENTION) -> DataFrame:
    """Tool log lines (op_id, seq, line, duration, scale) -> strictly rising percent per operation.

    Lines carry no time of their own: the time of their arrival stands in, and the state of an operation lives for ``idle``
    after its last line.
    """
    percent = line_percent(F.col("line"), F.col("duration"), F.col("scale"))
    return (
        lines.select("op_id", "seq", percent.alias("percent"), F.current_timestamp().alias("arrived"))
        .where(F.col("percent").isNotNull())
        .withWatermark("arrived", "0 seconds")
        .groupBy("op_id")
        .transformWithStateInPandas(_Rising(_keep(idle)), "op_id long, seq long, percent double", "Append", "EventTime")
    )
