"""Attempt windows and budgets over streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def attempt_stream(events: DataFrame, limit: int = 20, minutes: int = 15, watermark: str = "15 minutes") -> DataFrame:
    """client_key, ts, id, attempt, allowed of a stream (client_key, ts, id): windows from a key's first attempt.

    The state of a key is its window's start and count; it goes when event time has passed
    the window. Rows of a micro-batch are taken in order of time.
    """
    import pandas as pd

    span = pd.Timedelta(minutes=minutes)

    def count(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begin, n = state.get if state.exists else (None, 0)
        begin = None if begin is None else pd.Timestamp(begin, unit="us")
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        found = []
        for ts in rows["ts"]:
            if begin is None or ts - begin > span:
                begin, n = ts, 0
            n += 1
            found.append(n)
        micros = begin.value // 1000
        state.update((micros, n))
        state.setTimeoutTimestamp(max(micros // 1000 + minutes * 60_000 + 1, state.getCurrentWatermarkMs() + 1))
        rows["attempt"] = found
        rows["allowed"] = rows["attempt"] <= limit
        rows["client_key"] = key[0]
        yield rows[["client_key", "ts", "id", "attempt", "allowed"]]

    kind = dict(events.dtypes)
    shape = f"client_key {kind['client_key']}, ts timestamp, id {kind['id']}, attempt int, allowed boolean"
    timed = events.select("client_key", F.col("ts").cast("timestamp").alias("ts"), "id").withWatermark("ts", watermark)
    return timed.groupBy("client_key").applyInPandasWithState(count, shape, "begin long, n int", "append", GroupStateTimeout.EventTimeTimeout)


def daily_counts(events: DataFrame, limit: int = 400, zone: str = "America/Los_Angeles", watermark: str = "1 day") -> DataFrame:
    """day, requests, allowed of a stream (ts in UTC): a day of ``zone`` is final once the watermark passes it."""
    local = events.select(F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone).alias("local")).withWatermark("local", watermark)
    days = local.groupBy(F.window("local", "1 day")).agg(F.count("*").alias("requests"))
    return days.select(F.to_date("window.start").alias("day"), "requests", F.least(F.col("requests"), F.lit(max(0, limit))).alias("allowed"))
