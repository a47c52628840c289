"""Structured Streaming forms: live counts, idle sessions, throttled and latest frames, periodic sync and its retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import BACKOFF_MAX_MS, BACKOFF_MIN_MS, BUSY_MS, FRAME_GAP_MS, IDLE_HOURS


def live_counts(registrations: DataFrame) -> DataFrame:
    """Registrations by status, re-emitted as they change (output mode complete)."""
    return registrations.groupBy("syncStatus").agg(F.count("*").alias("n"))


def idle_sessions(events: DataFrame, late: str = "1 hour", hours: int = IDLE_HOURS) -> DataFrame:
    """Sessions of events (user_id, ts); one closes when the watermark has passed ``hours`` after its last event."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", f"{hours} hours"))
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("closes"), "n")


def throttled_frames(frames: DataFrame, gap_ms: int = FRAME_GAP_MS) -> DataFrame:
    """Frames (stream, ts_ms, frame_id) at least ``gap_ms`` after the last one taken; the last time taken is each stream's only state."""

    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat([b[["ts_ms", "frame_id"]] for b in batches], ignore_index=True).sort_values(["ts_ms", "frame_id"])  # times and ids of one micro-batch
        keep = []
        for t in rows["ts_ms"]:
            ok = last is None or t - last >= gap_ms
            keep.append(ok)
            last = int(t) if ok else last
        state.update((last,))
        out = rows[keep]
        out.insert(0, "stream", key[0])
        yield out

    rows = frames.select("stream", "ts_ms", "frame_id")
    return rows.groupBy("stream").applyInPandasWithState(take, rows.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def periodic(source: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, every: str = "15 minutes") -> DataStreamWriter:
    """A sync that runs every so often. ``send`` gets a batch and its number; it must do nothing for a number already done, as a batch may come again."""
    return source.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def keep_latest(events: DataFrame, late: str = "0 seconds", busy_ms: int = BUSY_MS) -> DataFrame:
    """Frames handed to a consumer that takes one at a time: (stream, frame_id, at), when each is handed over.

    ``events`` (stream, at, kind, frame_id) are frames ('frame') and the consumer's word that it is
    done ('done'). While it is busy one frame waits, the newest; those before it are dropped, across
    micro-batches too. A consumer that says nothing for ``busy_ms`` counts as done, once the
    watermark has passed that time. Events of a micro-batch are taken in order of time.
    """

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until, waiting = state.get if state.exists else (-1, -1)
        out = []

        def free(at: int) -> None:
            nonlocal until, waiting
            if waiting >= 0:
                out.append((key[0], waiting, at))
                until, waiting = at + busy_ms, -1
            else:
                until = -1

        def silent_until(at: int) -> None:
            while until >= 0 and until <= at:
                free(until)

        if state.hasTimedOut:
            silent_until(state.getCurrentWatermarkMs())
        for at, kind, frame in sorted(row for b in batches for row in zip(b["ms"].tolist(), b["kind"], b["frame_id"], strict=True)):
            silent_until(at)
            if kind == "done":
                free(at)
            elif until < 0:
                out.append((key[0], int(frame), at))
                until = at + busy_ms
            else:
                waiting = int(frame)
        state.update((until, waiting))
        if until >= 0:
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["stream", "frame_id", "at"]).astype({"stream": "int64", "frame_id": "int64", "at": "int64"})

    rows = events.select("stream", "at", F.unix_millis("at").alias("ms"), "kind", "frame_id").withWatermark("at", late)
    return rows.groupBy("stream").applyInPandasWithState(admit, "stream long, frame_id long, at long", "until long, waiting long", "append", GroupStateTimeout.EventTimeTimeout)


def backoff_ms(failures: int) -> int:
    """The wait after so many failures in a row: doubling from the shortest to the longest."""
    return min(BACKOFF_MAX_MS, BACKOFF_MIN_MS << min(failures - 1, 62))


def retries(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """When jobs are to run: (name, attempt, due), the first time at once and again after each failure, waiting twice as long each time.

    ``events`` (name, at, kind): 'start' asks for a run, 'failed' and 'done' tell how one went. One
    job of a name lives at a time; a start that meets a live one is dropped and the live one
    kept. Event time is the clock: a try is due when the watermark has passed its time, by a timer.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, due = state.get if state.exists else (-1, -1)  # -1: no live job; no timer
        out = []

        def fire(now: int) -> None:
            nonlocal due
            if 0 <= due <= now:
                out.append((key[0], failures + 1, due))
                due = -1

        if state.hasTimedOut:
            fire(state.getCurrentWatermarkMs())
        order = {"failed": 0, "done": 1, "start": 2}
        for at, _, kind in sorted((at, order[k], k) for b in batches for at, k in zip(b["ms"].tolist(), b["kind"], strict=True)):
            fire(at)
            if kind == "start" and failures < 0:
                failures = 0
                out.append((key[0], 1, at))
            elif kind == "failed" and failures >= 0 and due < 0:
                failures += 1
                due = at + backoff_ms(failures)
            elif kind == "done" and failures >= 0:
                failures, due = -1, -1
        if failures < 0:
            if state.exists:
                state.remove()
        else:
            state.update((failures, due))
            if due >= 0:
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["name", "attempt", "due"]).astype({"name": "object", "attempt": "int32", "due": "int64"})

    rows = events.select("name", "at", F.unix_millis("at").alias("ms"), "kind").withWatermark("at", late)
    return rows.groupBy("name").applyInPandasWithState(run, "name string, attempt int, due long", "failures int, due long", "append", GroupStateTimeout.EventTimeTimeout)

