"""Job events and timers, as streams with state and as batch twins.

Streams: a watermark bounds the state; each function works on any streaming frame with the same
columns. Batch twins give the same rows over a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("done", "review", "rejected", "failed")


def watch_folder(spark: SparkSession, folder: str, pattern: str = "*.png", per_trigger: int = 1000) -> DataFrame:
    """Newly dropped files as queued jobs: a file stream without the contents."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select(F.sha1("path").alias("job_id"), "path", F.col("modificationTime").alias("ts"), F.col("length").alias("bytes"), F.lit("queued").alias("status"))


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def latest_state(jobs: DataFrame) -> DataFrame:
    """Latest status of every job, ties by event number; batch twin of ``stream_latest_state``."""
    last = F.max(F.struct("ts", "event_id", "status"))
    return jobs.groupBy("job_id").agg(F.count(F.lit(1)).alias("events"), last.alias("m")).select("job_id", "events", F.col("m.status").alias("status"), F.col("m.event_id").alias("event_id"))


def stream_latest_state(jobs: DataFrame, late: str = "1 day") -> DataFrame:
    """Latest status of every job, updated batch by batch with keyed state; a job without events
    leaves the state when the watermark passes its last event by the allowed lateness."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        events, ts, event_id, status = state.get if state.exists else (0, -1, -1, "")
        for rows in batches:
            events += len(rows)
            for t, i, s in zip(_micros(rows["ts"]), rows["event_id"], rows["status"]):
                if (t, i) > (ts, event_id):
                    ts, event_id, status = int(t), int(i), s
        state.update((events, ts, event_id, status))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, ts // 1000 + 1))
        yield pd.DataFrame({"job_id": [key[0]], "events": [events], "status": [status], "event_id": [event_id]})

    held = jobs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return held.groupBy("job_id").applyInPandasWithState(fold, "job_id long, events long, status string, event_id long", "events long, ts long, event_id long, status string", "update", GroupStateTimeout.EventTimeTimeout)


def open_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs whose latest status is not final."""
    return latest_state(jobs).filter(~F.col("status").isin(*TERMINAL)).select("job_id", "status")


def stream_open_jobs(jobs: DataFrame, stalled_minutes: int = 60, late: str = "1 day") -> DataFrame:
    """A row for each job that had events in a batch: ``open`` or ``closed`` by its latest status, and
    ``stalled`` when the watermark has passed an open job's last event by the minutes given. A job
    leaves the state when it has stalled, or when the watermark passes its final event."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, event_id, status = state.get if state.exists else (-1, -1, "")
        row = lambda kind: pd.DataFrame({"job_id": [key[0]], "status": [status], "event_id": [event_id], "kind": [kind]})
        if state.hasTimedOut:
            state.remove()
            if status not in TERMINAL:
                yield row("stalled")
            return
        for rows in batches:
            ts, event_id, status = max([(ts, event_id, status), *zip(_micros(rows["ts"]).tolist(), rows["event_id"].tolist(), rows["status"])])
        final = status in TERMINAL
        state.update((ts, event_id, status))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, ts // 1000 + 1 + (0 if final else stalled_minutes * 60_000)))
        yield row("closed" if final else "open")

    held = jobs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return held.groupBy("job_id").applyInPandasWithState(fold, "job_id long, status string, event_id long, kind string", "ts long, event_id long, status string", "append", GroupStateTimeout.EventTimeTimeout)


def keep_versions(jobs: DataFrame, most: int = 8) -> DataFrame:
    """The last ``most`` successes of every job, newest first."""
    by = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return jobs.filter("status = 'done'").withColumn("version", F.row_number().over(by)).filter(F.col("version") <= most).select("job_id", "version", "event_id")


def stream_versions(jobs: DataFrame, most: int = 8, expiry_minutes: int = 3650 * 1440, late: str = "30 days") -> DataFrame:
    """Twin of ``keep_versions`` and ``restored`` for a stream: for each job of a batch one row with its
    last ``most`` successes, newest first (``versions``), and one for each failure with the success
    that it falls back to among those kept (``restored_id``). The state of a job is a list of at most
    ``most`` entries; it is given up when the watermark has passed the job's last event by ``expiry_minutes``."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last, kept = state.get if state.exists else (0, -1, [])
        good = [tuple(map(int, v.split(":"))) for v in kept]
        failed = []
        for rows in batches:
            seen += len(rows)
            marks = list(zip(_micros(rows["ts"]).tolist(), rows["event_id"].tolist(), rows["status"]))
            last = max([last, *(m[0] for m in marks)])
            good = sorted(good + [m[:2] for m in marks if m[2] == "done"], reverse=True)
            failed += [(m[1], next((i for t, i in good if (t, i) < m[:2]), None)) for m in sorted(marks) if m[2] == "failed"]
            good = good[:most]
        state.update((seen, last, [f"{t}:{i}" for t, i in good]))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, last // 1000 + expiry_minutes * 60_000))
        out = [(key[0], seen, [i for _, i in good], None, None), *((key[0], seen, None, f, r) for f, r in failed)]
        yield pd.DataFrame(out, columns=["job_id", "seen", "versions", "failed_id", "restored_id"]).astype({"failed_id": "Int64", "restored_id": "Int64"})

    held = jobs.filter("status IN ('done', 'failed')").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return held.groupBy("job_id").applyInPandasWithState(fold, "job_id long, seen long, versions array<long>, failed_id long, restored_id long", "seen long, last long, kept array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def late_events(query: StreamingQuery) -> int:
    """Rows that the states of a query dropped because they were behind its watermark, over its recent batches."""
    return sum(int(s["numRowsDroppedByWatermark"] or 0) for p in query.recentProgress for s in p["stateOperators"])


def restored(jobs: DataFrame) -> DataFrame:
    """Failures, with the success that each falls back to (null without one before it)."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    good = F.last(F.when(F.col("status") == "done", F.col("event_id")), ignorenulls=True).over(w)
    return jobs.withColumn("restored_id", good).filter("status = 'failed'").select("job_id", "event_id", "restored_id")


def timer_pairs(clicks: DataFrame) -> DataFrame:
    """Seconds from each start click (user_id, ts, event_id) to the next click of the user, at least 1."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.greatest(F.lit(1), F.unix_timestamp(F.lead("ts").over(w).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp")))
    return clicks.withColumn("seconds", seconds).withColumn("has_next", F.lead("event_id").over(w).isNotNull()).filter("event_type = 'click' AND has_next").select("user_id", "event_id", F.col("seconds").cast("long").alias("seconds"))


def stream_timer_pairs(clicks: DataFrame, late: str = "1 day") -> DataFrame:
    """Twin of ``timer_pairs`` for a stream: seconds from each start click to the next event of the
    user. A user has one open timer; events that arrive after a later one are passed over, and an
    open timer is given up when the watermark passes it."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ts, event_id, started = state.get if state.exists else (-1, -1, False)
        marks = sorted(m for rows in batches for m in zip(_micros(rows["ts"]).tolist(), rows["event_id"].tolist(), rows["event_type"]))
        out = []
        for t, i, kind in marks:
            if (t, i) < (ts, event_id):
                continue
            if started:
                out.append((key[0], event_id, max(1, t // 1_000_000 - ts // 1_000_000)))
            ts, event_id, started = t, i, kind == "click"
        state.update((ts, event_id, started))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, ts // 1000 + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "seconds"])

    held = clicks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return held.groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_id long, seconds long", "ts long, event_id long, started boolean", "append", GroupStateTimeout.EventTimeTimeout)


def recent_jobs(jobs: DataFrame, most: int = 60) -> DataFrame:
    """The most recent events (a report's limit)."""
    return jobs.orderBy(F.desc("ts"), F.desc("event_id")).limit(most).select("event_id", "job_id", "status")


def windowed_counts(jobs: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    """Events by status and window; with ``late`` under a watermark, for streams."""
    held = jobs.withColumn("ts", F.col("ts").cast("timestamp"))
    held = held.withWatermark("ts", late) if late else held
    return held.groupBy(F.window("ts", size).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "status", "n")
