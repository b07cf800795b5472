"""Live forms: bursts of input as session windows, bursts closed early by boundary events, and journals that grow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What ends a burst at once.
BOUNDARIES = ("target_changed", "focus_unavailable", "selection_navigation", "pointer_selection_boundary", "pointer_context_boundary", "clipboard_changed", "return_pressed")
BURST = "key string, began_at timestamp, ended_at timestamp, n_events long, closed_by string"
_STATE = "began double, last double, n long"


def bursts(events: DataFrame, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Bursts of a key's events less than ``gap`` apart; works on batches and streams.

    ``late`` is how far an event may come behind the newest one: a stream holds a burst until the watermark passes its
    end, and events later than that are dropped. The batch result of all events is what the stream converges to.
    """
    rows = events.withWatermark("ts", late)
    return rows.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.min("ts").alias("began_at"), F.max("ts").alias("last_at")).select(*keys, "began_at", "last_at", "n_events")


def bounded_bursts(events: DataFrame, gap_seconds: float, late: str) -> DataFrame:
    """Bursts that a boundary event of the key ends at once; without one they end when the gap passes.

    events: (key string, ts timestamp, hint string), a stream. One small state a key: the open burst's times and count.
    Inside a micro-batch events are taken in order of time. One that comes behind the open burst's beginning by less than the gap
    belongs to it; one that comes earlier is a burst of its own, closed as ``late``. Events behind the watermark are
    dropped here: take marked_late first to keep them apart.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        began, last, n = state.get if state.exists else (0.0, 0.0, 0)

        def close(why: str) -> None:
            out.append((key[0], pd.Timestamp(began, unit="s"), pd.Timestamp(last, unit="s"), n, why))

        if state.hasTimedOut:
            close("gap")
            n = 0
        else:
            for ts, hint in sorted((t.timestamp(), h or "") for b in batches for t, h in zip(b["ts"], b["hint"], strict=True)):
                if n and began - ts >= gap_seconds:
                    out.append((key[0], pd.Timestamp(ts, unit="s"), pd.Timestamp(ts, unit="s"), 1, "late"))
                    continue
                if n and ts - last >= gap_seconds:
                    close("gap")
                    n = 0
                if hint in BOUNDARIES:
                    if n:
                        close(hint)
                    n = 0
                    continue
                began, last, n = (min(began, ts), max(last, ts), n + 1) if n else (ts, ts, 1)
        if n:
            state.update((began, last, n))
            state.setTimeoutTimestamp(max(int((last + gap_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "began_at", "ended_at", "n_events", "closed_by"])

    rows = events.select("key", "ts", "hint").withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(step, BURST, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def marked_late(events: DataFrame, late_seconds: float) -> DataFrame:
    """(key, ts, hint, is_late): a stream's events with those that come more than ``late_seconds`` behind the newest one of their key
    in an earlier micro-batch. None is dropped: late ones can go to a table of their own. One number a key is kept."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = seen = state.get[0] if state.exists else float("-inf")
        for b in batches:
            at = b["ts"].map(lambda t: t.timestamp())
            yield b.assign(is_late=at < newest - late_seconds)[["key", "ts", "hint", "is_late"]]
            seen = max(seen, at.max())
        state.update((seen,))

    rows = events.select("key", "ts", "hint")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, hint string, is_late boolean", "newest double", "append", GroupStateTimeout.NoTimeout)


def follow_journal(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A growing folder of journals as a stream of (session_id, record_type, raw)."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.where(F.trim("value") != "").select(F.get_json_object("value", "$.sessionID").alias("session_id"), F.get_json_object("value", "$.recordType").alias("record_type"), F.col("value").alias("raw"))


def overtaken_reads(reads: DataFrame, writes: DataFrame, late: str, longest: str) -> DataFrame:
    """Stream-stream: reads (key, read_id, last_activity, captured_at) with a later write input (key, write_id, input_at)
    between their activity and their capture. Both sides' state ends ``longest`` after the watermark."""
    r, w = reads.withWatermark("captured_at", late).alias("r"), writes.withWatermark("input_at", late).alias("w")
    on = F.expr(f"r.key = w.key AND w.input_at > r.last_activity AND w.input_at <= r.captured_at AND w.input_at >= r.captured_at - INTERVAL {longest}")
    return r.join(w, on).select("r.key", "r.read_id", "w.write_id", "w.input_at")


def compact(rows: DataFrame) -> DataFrame:
    """A line for each event (kind, app_name, content) as a follower shows it: the first eight lines of a read, one of a write."""
    lines = F.slice(F.split("content", "\n"), 1, 8)
    shown = F.when(F.col("kind") == "read", F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  "), x)), "\n")).otherwise(F.regexp_replace("content", r"\s+", " "))
    return rows.select(F.format_string("%s %s\n%s", F.upper("kind"), F.coalesce("app_name", F.lit("-")), shown).alias("value"))
