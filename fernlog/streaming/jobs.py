"""Structured Streaming over log lines and progress events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fernlog.functions import scalars as S
from fernlog.operators.intelligence import BurstQueue
from fernlog.operators.logs import K, log_timeline, parse_log_a

#: Stages after which a session doesn't go on.
ENDED = ("completed", "failed", "cancelled")


def stream_timeline(lines: DataFrame, tz: str = "UTC") -> DataFrame:
    """Warnings and worse as they arrive; no state, append mode."""
    return log_timeline(parse_log_a(lines, tz))


def stream_bursts(parsed: DataFrame, n: int = 5, seconds: int = 60, slide: int = 10, late: str = "10 minutes") -> DataFrame:
    """Windows of ``seconds`` with n errors or more, one every ``slide`` seconds, for each file.

    It approximates the exact bursts: windows begin at fixed times. Rows later than ``late`` are dropped and the state is
    bounded by it.
    """
    errors = parsed.where(F.col("ts").isNotNull() & F.col("level").isin("ERROR", "CRITICAL")).withWatermark("ts", late)
    by = errors.groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds"), *K).agg(F.count("*").alias("errors"))
    return by.where(F.col("errors") >= n).select(*K, F.col("window.start").alias("started_at"), F.col("window.end").alias("ended_at"), "errors")


def stream_sessions(progress: DataFrame) -> DataFrame:
    """Latest stage and sequence of each session, and whether it has ended; update or complete mode.

    ``progress`` has session_id, sequence, stage. The state is a row for each session.
    """
    by = progress.groupBy("session_id").agg(F.max("sequence").alias("sequence"), F.max_by("stage", "sequence").alias("stage"), F.count("*").alias("events"))
    return by.withColumn("ended", F.col("stage").isin(*ENDED))


def stream_patterns(parsed: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Errors by normalised message in tumbling windows of event time."""
    errors = parsed.where(F.col("ts").isNotNull() & F.col("level").isin("ERROR", "CRITICAL")).withWatermark("ts", late)
    by = errors.groupBy(F.window("ts", width), "bundle_id", S.normalize_message(F.col("message")).alias("fingerprint")).agg(F.count("*").alias("errors"))
    return by.select("bundle_id", F.col("window.start").alias("started_at"), "fingerprint", "errors")


def stream_exact_bursts(parsed: DataFrame, n: int = 5, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """The bursts of ``error_bursts`` as they come about, for files whose times rise with the lines; append mode.

    Errors wait until the watermark has passed them and then enter their file's queue by time and line, so that it doesn't matter in
    which order they arrive; those later than ``late`` are dropped. The state of a file is what waits and the queue; it is dropped when nothing
    waits and the window has passed.
    """
    rows = parsed.where(F.col("ts").isNotNull() & F.col("level").isin("ERROR", "CRITICAL")).withWatermark("ts", late)
    rows = rows.select(*K, "line_no", "ts", F.unix_micros("ts").alias("us"))
    window = seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, queue = [], BurstQueue(n, window)
        if state.exists:
            times, lines, held = state.get
            waiting = list(zip(times, lines, strict=True))
            queue.times.extend(held)
        for b in batches:
            waiting += zip(b["us"].tolist(), b["line_no"].tolist(), strict=True)
        now = state.getCurrentWatermarkMs() * 1000
        due = sorted(x for x in waiting if x[0] <= now)
        waiting = [x for x in waiting if x[0] > now]
        found = [(*key, line, head, us, n) for us, line in due if (head := queue.add(us)) is not None]
        # what is older than the window before the watermark will have left when the next error comes
        while queue.times and queue.times[0] < now - window:
            queue.times.popleft()
        if waiting or queue.times:
            state.update(([us for us, _ in waiting], [line for _, line in waiting], list(queue.times)))
            until = min(us for us, _ in waiting) if waiting else queue.times[-1] + window
            state.setTimeoutTimestamp(max(until, now) // 1000 + 1)
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=[*K, "line_no", "a", "b", "errors"])

    out = "bundle_id string, artifact string, line_no bigint, a bigint, b bigint, errors bigint"
    held = "times array<bigint>, lines array<bigint>, queue array<bigint>"
    bursts = rows.groupBy(*K).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    return bursts.select(*K, "line_no", F.timestamp_micros("a").alias("started_at"), F.timestamp_micros("b").alias("ended_at"), "errors")


def stream_live_sessions(progress: DataFrame, keep: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``stream_sessions`` with a state that ends: a row for each batch in which a session moved on; update mode.

    ``progress`` has session_id, sequence, stage and ts. A session's state is dropped ``keep`` after its last event once it has ended, and
    after a day without any; events of lower sequence count but don't move it back.
    """
    rows = progress.withWatermark("ts", late).select("session_id", "sequence", "stage", F.unix_millis("ts").alias("ms"), "ts")
    kept = int(pd.Timedelta(keep).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sequence, stage, events, last = state.get if state.exists else (-1, "", 0, 0)
        for b in batches:
            events += len(b)
            last = max(last, int(b["ms"].max()))
            top = b.loc[b["sequence"].idxmax()]
            if top["sequence"] >= sequence:
                sequence, stage = int(top["sequence"]), top["stage"]
        ended = stage in ENDED
        state.update((sequence, stage, events, last))
        state.setTimeoutTimestamp(max(last + (kept if ended else 86_400_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, sequence, stage, events, ended)], columns=["session_id", "sequence", "stage", "events", "ended"])

    out = "session_id bigint, sequence bigint, stage string, events bigint, ended boolean"
    return rows.groupBy("session_id").applyInPandasWithState(step, out, "sequence bigint, stage string, events bigint, last bigint", "update", GroupStateTimeout.EventTimeTimeout)
