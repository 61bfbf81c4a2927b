"""The watcher's rules, for a stream's micro-batches and for batches alike: windows, events, caps, retries, freshness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import running_sum
from .episodes import backoff_seconds

MOST_ROWS, MOST_QUEUED, MOST_ATTEMPTS, STALE_DAYS = 1000, 500, 5, 7


def poll(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds"):
    """Starts the polling query: one batch at a time, `handle` gets each with its number. Offsets are committed to
    the checkpoint after the batch, so a batch may come again and handle must be idempotent (see distinct_events)."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def bisect(seconds: DataFrame, start: int, end: int, most: int = MOST_ROWS) -> int:
    """The end of the longest window from start that holds under `most` rows, halving from `end`; seconds has t and n, counts
    by whole second. Raises where one second holds that many, so that the cursor stays."""
    while seconds.filter((F.col("t") >= start) & (F.col("t") <= end)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] >= most:
        if end - start <= 1:
            raise ValueError(f"over {most} rows a second: refine the filter")
        end = (start + end) // 2
    return end


def windows(seconds: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(t, window): seconds (t, n) dealt to windows in order, each with under `most` rows where one second allows.

    A running sum over ranges of the time deals the rows."""
    summed = running_sum(seconds.select("t", "n"), "t", F.col("n"), "upto")
    return summed.select("t", F.floor((F.col("upto") - 1) / most).alias("window"))


def issue_events(issues: DataFrame, now: Column) -> DataFrame:
    """Incident events of issues (id, title, last_seen, first_seen, status, status_changed, count, level); one without a time has none."""
    solved = F.col("status") == "resolved"
    return issues.filter("last_seen IS NOT NULL").select(
        F.concat_ws(":", "id", F.col("last_seen").cast("string"), F.col("count").cast("string"), F.coalesce("status", F.lit("undefined"))).alias("event_id"), F.col("id").alias("incident_id"), F.col("title").alias("fingerprint"),
        F.when(solved, F.coalesce("status_changed", now)).otherwise(F.col("last_seen")).alias("occurred_at"), F.coalesce("level", F.lit("error")).alias("severity"), F.when(solved, "resolved").otherwise("active").alias("state"),
        F.coalesce("status_changed", "first_seen").alias("episode"),
    )


def log_events(logs: DataFrame) -> DataFrame:
    """Incident events of log records (index, document_id, ts, event_code, message, level, trace_id, request_id, order_id, error_code,
    reason, http_status): known by document or by a digest, grouped by order, trace, request or code."""
    digest = F.sha2(F.encode(F.coalesce("message", F.lit("")), "UTF-8"), 256)
    code = lambda c: F.when(F.col(c).rlike(r"^[a-zA-Z0-9_.-]{1,128}$"), F.col(c))
    status = F.when(F.col("http_status").between(100, 599), F.col("http_status").cast("string"))
    whole = F.sha2(F.encode(F.to_json(F.array("index", F.col("ts").cast("string"), "event_code", "message")), "UTF-8"), 256)
    tag = F.concat_ws("; ", F.concat(F.lit("HTTP "), status), code("error_code"), code("reason"))
    hint = F.trim(F.concat(F.coalesce("event_code", F.lit("")), F.lit(" "), F.coalesce("message", F.lit("")), F.when(tag != "", F.concat(F.lit(" ["), tag, F.lit("]"))).otherwise("")))
    return logs.select(
        F.when(F.col("document_id").isNotNull(), F.concat_ws(":", "index", "document_id")).otherwise(whole).alias("event_id"), F.coalesce("order_id", "trace_id", "request_id", "event_code", digest).alias("incident_id"),
        F.concat_ws(":", F.coalesce("event_code", digest), code("error_code"), code("reason"), status).alias("fingerprint"), F.col("ts").alias("occurred_at"), F.substring(hint, 1, 2000).alias("hint"),
        F.when(F.col("message").rlike("(?i)exhaust|fatal"), "critical").otherwise(F.col("level")).alias("severity"), F.lit("active").alias("state"), F.coalesce("trace_id", "request_id").alias("correlation_id"),
    )


def accepting(jobs: DataFrame, usage: DataFrame, most: int = MOST_QUEUED) -> DataFrame:
    """(route, queued, accepts): whether a route takes events: its queue of jobs (route, status) is under the cap and its day's
    budget (usage: route, investigations, calls, most_investigations, most_calls) not spent."""
    queued = jobs.groupBy("route").agg(F.count(F.when(~F.col("status").isin("done", "cancelled"), 1)).alias("queued"))
    spent = usage.select("route", ((F.col("investigations") >= F.col("most_investigations")) | (F.col("calls") >= F.col("most_calls"))).alias("spent"))
    rows = queued.join(spent, "route", "full").fillna(0, ["queued"]).fillna(False, ["spent"])
    return rows.select("route", "queued", ((F.col("queued") < most) & ~F.col("spent")).alias("accepts"))


def retries(jobs: DataFrame) -> DataFrame:
    """(id, status, wait) of failed jobs (id, attempts): seconds to the next attempt, none after the last."""
    return jobs.select("id", F.when(F.col("attempts") >= MOST_ATTEMPTS, "failed").otherwise("waiting").alias("status"), backoff_seconds(F.col("attempts")).alias("wait"))


def reconcile(jobs: DataFrame, offsets: DataFrame, batch: int = 5) -> DataFrame:
    """(route, id, next): which unresolved jobs (route, id, resolved_at, seq) each route (route, at) asks for again: `batch` from its
    place on, and the place after, back at the start when the end is reached."""
    place = F.row_number().over(Window.partitionBy("route").orderBy("seq", "id")) - 1
    rows = jobs.filter("resolved_at IS NULL").select("route", "id", place.alias("place"), F.count("*").over(Window.partitionBy("route")).alias("n"))
    hit = rows.join(offsets, "route", "left").fillna(0, ["at"]).filter((F.col("place") >= F.col("at")) & (F.col("place") < F.col("at") + batch))
    return hit.select("route", "id", F.when(F.col("at") + batch >= F.col("n"), 0).otherwise(F.col("at") + batch).cast("int").alias("next"))


def freshness(evidence: DataFrame, indexed_at: Column, now: Column) -> DataFrame:
    """One row: the span and sources of runtime evidence (source, ts), and the age of the index in hours and whether it is stale."""
    runtime = F.col("source").isin("logs", "metrics", "state", "queue")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(indexed_at.cast("timestamp"))) / F.lit(3.6e9)
    spans = evidence.agg(F.min(F.when(runtime, F.col("ts"))).alias("from"), F.max(F.when(runtime, F.col("ts"))).alias("to"), F.array_sort(F.collect_set(F.when(runtime, F.col("source")))).alias("sources"))
    return spans.select("*", age.alias("index_hours"), F.coalesce(age > STALE_DAYS * 24, F.lit(False)).alias("index_stale"))
