"""Time-driven jobs as batch functions of ``now``, and their streaming forms.

Event-time windows and watermarks are extensions; the engine's own jobs are daily batches.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from colloquy.operators.review import TTL_HOURS, expire_stale
from colloquy.operators.rollups import digest_sections

END_OF_DAY, SWEEP = "18:00", "02:00"


def due_jobs(now: dt.datetime, last: dt.datetime, times: dict[str, str]) -> list[str]:
    """Names of daily jobs with a time of day after ``last`` and up to ``now``."""
    out, day = [], last.date()
    while day <= now.date():
        for name, clock in times.items():
            at = dt.datetime.combine(day, dt.time.fromisoformat(clock), tzinfo=now.tzinfo)
            if last < at <= now:
                out.append(name)
        day += dt.timedelta(days=1)
    return out


def end_of_day(items: DataFrame, now: dt.datetime) -> DataFrame:
    return digest_sections(items, now.date())


def sweep(extractions: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    return expire_stale(extractions, now)


class ExpiryProcessor(StatefulProcessor):
    """Pending items that no decision reaches within their time expire."""

    def __init__(self, hours: int = TTL_HOURS):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "since long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in batch.sort_values("ts").itertuples():
                if r.event_type == "created":
                    since = int(r.ts.timestamp() * 1000)
                    self.open.update((since,))
                    self.handle.registerTimer(since + self.hours * 3_600_000)
                elif r.event_type in ("approved", "rejected"):
                    self.open.clear()
        yield pd.DataFrame(columns=["extraction_id", "event_type", "expired_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            self.open.clear()
            yield pd.DataFrame([(key[0], "expired", pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))], columns=["extraction_id", "event_type", "expired_at"])

    def close(self) -> None:
        pass


def expiry_stream(events: DataFrame, hours: int = TTL_HOURS, delay: str = "1 hour") -> DataFrame:
    """Expiry events of a stream of review events (extraction_id, event_type, ts)."""
    keyed = events.withWatermark("ts", delay).groupBy("extraction_id")
    return keyed.transformWithStateInPandas(ExpiryProcessor(hours), "extraction_id string, event_type string, expired_at timestamp", "append", "EventTime")


def append_once(events: DataFrame, keys: list[str], path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Append a stream to an event log, each key once within the watermark."""
    unique = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    return unique.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keyed_upserts(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Every batch replaces the partitions of its keys, so a batch that is run again changes nothing."""
    from colloquy.sources.sinks import replace_partitions

    return stream.writeStream.foreachBatch(lambda df, _: replace_partitions(df, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Extension: counts and sums by event type in event-time windows; works on streams and tables."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    told = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return told.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Extension: sessions of a user."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    told = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return told.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
