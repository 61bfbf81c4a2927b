"""Incident events as a stream: duplicates, episodes by quiet gaps, cursors; and the batch equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUIET_SECONDS = 3600


def distinct_events(events: DataFrame, route: str, event_id: str, ts: str, late: str = "2 minutes") -> DataFrame:
    """Each (route, event id) once. A stream keeps ids for as long as late events may come."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([route, event_id])
    first = Window.partitionBy(route, event_id).orderBy(ts)
    return events.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def episodes(events: DataFrame, family: str, ts: str, event_id: str, quiet: int = QUIET_SECONDS) -> DataFrame:
    """(family, episode, started, ended, n): an episode ends with a quiet gap of over `quiet` seconds."""
    order = Window.partitionBy(family).orderBy(ts, event_id)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(order)
    rows = events.select(family, ts, event_id, F.when(gap > quiet * 1_000_000, 1).otherwise(0).alias("_new"))
    rows = rows.withColumn("episode", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(family, "episode").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def stream_episodes(events: DataFrame, family: str, ts: str, quiet: int = QUIET_SECONDS, late: str | None = "2 minutes") -> DataFrame:
    """The same episodes over a stream, each sent when the watermark has passed its quiet gap (late:
    None if the stream has a watermark, as after distinct_events). A gap of exactly `quiet` seconds still joins, as in the batch form (one microsecond more than the gap)."""
    window = F.session_window(F.col(ts), F.lit(f"{quiet} seconds 1 microsecond"))
    marked = events.withWatermark(ts, late) if late else events
    rows = marked.groupBy(F.col(family), window.alias("w"))
    return rows.agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n")).drop("w")


def cursor_window(now: Column, cursor: Column) -> tuple[Column, Column]:
    """What the next poll reads: from two minutes before the cursor (a day back without one) to an
    hour after it, now at most."""
    start = F.coalesce(cursor - F.expr("INTERVAL 2 MINUTES"), now - F.expr("INTERVAL 24 HOURS"))
    return start, F.least(now, F.coalesce(cursor + F.expr("INTERVAL 1 HOUR"), now))


def backoff_seconds(attempts: Column) -> Column:
    """10 s doubled each time, an hour at most; none after five attempts."""
    return F.when(attempts < 5, F.least(F.lit(3600.0), 10 * F.pow(F.lit(2.0), attempts)))


def bursts(changes: DataFrame, repo: str, ts: str, event_id: str, quiet: int = 5, longest: int = 60) -> DataFrame:
    """Debounced re-index runs: a burst ends after `quiet` seconds without a change, and every
    `longest` seconds of a burst run on their own."""
    order = Window.partitionBy(repo).orderBy(ts, event_id)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.when(at - F.lag(at).over(order) > quiet * 1_000_000, 1).otherwise(0)
    rows = changes.select(repo, ts, event_id, new.alias("_n")).withColumn("burst", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    since = (at - F.min(at).over(Window.partitionBy(repo, "burst"))) / F.lit(1e6)
    return rows.withColumn("run", F.floor(since / longest)).groupBy(repo, "burst", "run").agg(F.min(ts).alias("started"), F.count("*").alias("n"))
