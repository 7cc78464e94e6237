"""Limits over time: attempts in a window from the first, daily budgets, spacing of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.fold import sorted_fold


def attempts(rows: DataFrame, limit: int = 20, minutes: int = 15, key: str = "client_key") -> DataFrame:
    """``rows`` (key, ts, id) with attempt, allowed: a key's window starts at its first attempt and isn't renewed.

    Rejected attempts count as well. An ordered fold that streams a key's attempts.
    """
    longest = minutes * 60_000_000

    def start():
        begin, n = None, 0

        def step(at):
            nonlocal begin, n
            fresh = begin is None or at - begin > longest
            begin, n = (at, 1) if fresh else (begin, n + 1)
            return (n,)

        return step

    timed = rows.select(key, "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("__at"))
    return sorted_fold(timed, [key], ["__at", "id"], ["__at"], start, "attempt int").drop("__at").withColumn("allowed", F.col("attempt") <= limit)


def daily_budget(rows: DataFrame, limit: int = 400, zone: str = "America/Los_Angeles") -> DataFrame:
    """``rows`` (ts in UTC, id) with day (of ``zone``) and allowed: the day's first ``limit`` requests; none for 0.

    The place of a day's last allowed request comes from a group limit, which tasks take before
    they meet; every request is then compared with it. Requests of one time and id are allowed alike.
    """
    timed = rows.withColumn("day", F.to_date(F.from_utc_timestamp(F.col("ts"), zone)))
    if limit <= 0:
        return timed.withColumn("allowed", F.lit(False))
    first = timed.select("day", "ts", "id").withColumn("__n", F.row_number().over(Window.partitionBy("day").orderBy("ts", "id"))).where(F.col("__n") <= limit)
    last = first.groupBy("day").agg(F.max(F.struct("ts", "id")).alias("__last")).select(F.col("day").alias("__day"), "__last")
    placed = timed.join(last, F.col("day").eqNullSafe(F.col("__day")), "left")
    return placed.withColumn("allowed", F.struct("ts", "id") <= F.col("__last")).drop("__day", "__last")


def spacing(rows: DataFrame, seconds: float, key: str = "client_key") -> DataFrame:
    """``rows`` (key, ts, id) with start_s: seconds (epoch) at which each request may start, ``seconds`` apart.

    max over the requests so far of arrival + seconds * requests since.
    """
    order = Window.partitionBy(key).orderBy("ts", "id")
    gap = round(seconds * 1_000_000)
    timed = rows.withColumn("__t", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("__i", F.row_number().over(order).cast("long"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return timed.withColumn("start_us", F.max(F.col("__t") - F.col("__i") * gap).over(so_far) + F.col("__i") * gap).drop("__t", "__i")
