"""State of tables and queues: freshness, status profiles, queue signals, consumer lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_HOURS, LEGACY_HOURS = 48.0, 2160.0
#: Fixed value: statuses that point to trouble.
ANOMALOUS = "(?i)fail|error|stuck|timeout|disconn|inactive|stale|cancel|dead|broken|pending|retry|unhealthy"


def age_class(hours: Column, stale: float = STALE_HOURS, legacy: float = LEGACY_HOURS) -> Column:
    return F.when(hours.isNull(), "unknown").when(hours >= legacy, "legacy").when(hours >= stale, "stale").otherwise("active")


def profile(rows: DataFrame, name: str, status: str, date: str, now: Column, anomalous: str = ANOMALOUS, top: int = 25) -> DataFrame:
    """One row per status of a table (the `top` most frequent): its count, whether it is anomalous,
    and the table's count, last activity, age in hours and freshness class."""
    counts = rows.groupBy(F.col(status).cast("string").alias("status")).agg(F.count("*").alias("n"), F.max(date).alias("last"))
    whole = counts.agg(F.sum("n").alias("total"), F.max("last").alias("last_activity"))
    age = F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_activity").cast("timestamp"))) / F.lit(3.6e9), F.lit(0.0))
    out = counts.drop("last").orderBy(F.desc("n"), "status").limit(top).crossJoin(F.broadcast(whole))  # whole is one row
    out = out.withColumn("age_hours", age).withColumn("class", age_class(F.col("age_hours")))
    return out.select(F.lit(name).alias("collection"), "status", "n", F.coalesce(F.col("status").rlike(anomalous), F.lit(False)).alias("anomalous"), "total", "last_activity", "age_hours", "class")


def matches_terms(name: Column, terms: list[str]) -> Column:
    """Whether a container's name has to do with any of the terms of at least four characters; without terms it has."""
    if not terms:
        return F.lit(True)
    low = F.lower(name)
    single = F.regexp_replace(low, "s$", "")
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: (F.length(t) >= 4) & (F.contains(low, t) | F.contains(t, single)))


def redis_signals(prefixes: DataFrame) -> DataFrame:
    """(db, kind, n, relevance) of sampled key prefixes (db, keys, prefix, n): a summary of each database
    that has keys, and its lock and rate-limit keys."""
    rows = prefixes.filter("keys > 0")
    lock, limit = F.col("prefix").rlike("(?i)lock"), F.col("prefix").rlike("(?i)rate.?limit|throttle")
    sums = rows.groupBy("db").agg(F.max("keys").alias("keys"), F.sum(F.when(lock, F.col("n"))).alias("locks"), F.sum(F.when(limit, F.col("n"))).alias("limits"))
    signal = lambda kind, n, r: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), F.lit(r).alias("relevance"))
    found = F.array(signal("summary", F.col("keys"), 0.4), F.when(F.col("locks") > 0, signal("locks", F.col("locks"), 0.6)), F.when(F.col("limits") > 0, signal("rate-limit", F.col("limits"), 0.6)))
    return sums.select("db", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("s")).select("db", "s.kind", "s.n", "s.relevance")


def state_signals(profiles: DataFrame, terms: list[str]) -> DataFrame:
    """Signals of profile() rows: anomalies (kept if relevant to the terms, or of an active table),
    and staleness of relevant tables."""
    relevant = matches_terms(F.col("collection"), terms)
    legacy = F.col("class") == "legacy"
    rows = profiles.withColumn("relevant", relevant)
    odd = rows.filter(F.col("anomalous") & (F.col("relevant") | (F.col("class") == "active")))
    score = F.when(legacy, 0.25).when(F.col("relevant"), 0.85).otherwise(0.5)
    odd = odd.select("collection", F.lit("anomaly").alias("kind"), "status", "n", "class", score.alias("relevance"))
    old = rows.filter(F.col("relevant") & F.col("class").isin("stale", "legacy")).select("collection", F.lit("stale").alias("kind"), F.lit(None).cast("string").alias("status"), F.col("total").alias("n"), "class", F.when(legacy, 0.25).otherwise(0.6).alias("relevance")).distinct()
    return odd.union(old)


def queue_signals(queues: DataFrame) -> DataFrame:
    """(queue, kind, relevance, n) of queue counts: queue, waiting, active, failed, delayed,
    oldest_waiting_ms, newest_failed_age_ms, top_share and top_age_ms (of the most frequent failure reason)."""
    c = F.col
    stale = c("newest_failed_age_ms") > 3_600_000
    signal = lambda kind, score, n: F.struct(F.lit(kind).alias("kind"), score.cast("double").alias("relevance"), n.cast("long").alias("n"))
    starved = (c("waiting") >= 10) & (c("active") == 0)
    found = F.array(
        F.when(starved, signal("worker-starvation", F.lit(0.7), c("waiting")))
        .when(c("waiting") > 1000, signal("backlog", F.lit(0.88), c("waiting")))
        .when(c("waiting") > 100, signal("backlog", F.lit(0.8), c("waiting"))),
        F.when(c("oldest_waiting_ms") > 300_000, signal("oldest-job", F.when(c("oldest_waiting_ms") > 3_600_000, 0.85).otherwise(0.75), c("oldest_waiting_ms"))),
        F.when(c("failed") > 20, signal("failed-spike", F.when(stale, 0.5).when(c("failed") > 100, 0.85).otherwise(0.75), c("failed"))),
        F.when(c("delayed") > 50, signal("delayed-accumulation", F.lit(0.7), c("delayed"))),
        F.when((c("failed") > 0) & (F.floor(c("top_share") * 100 + 0.5) >= 30), signal("failed-breakdown", F.when(c("top_age_ms") > 3_600_000, 0.5).otherwise(0.82), F.floor(c("top_share") * 100 + 0.5))),
        signal("summary", F.lit(0.4), c("waiting")),
    )
    out = queues.select("queue", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("s"))
    return out.select("queue", "s.kind", "s.relevance", "s.n")


def failed_breakdown(failures: DataFrame, key: str, reason: str, at: str, tie: str, last: int = 20) -> DataFrame:
    """Reasons (first line, 120 characters) among the `last` failures of each key: count and newest time."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))
    text = F.substring(F.substring_index(F.col(reason), "\n", 1), 1, 120).alias("reason")
    return failures.withColumn("_r", place).filter(F.col("_r") <= last).groupBy(key, text).agg(F.count("*").alias("n"), F.max(at).alias("newest"))


def lag(ends: DataFrame, committed: DataFrame, keys: list[str]) -> DataFrame:
    """End offset, committed offset and lag per partition; the lag is null if either is unknown or it would be negative."""
    out = ends.join(committed, keys, "left")
    return out.withColumn("lag", F.when(F.col("end_offset") >= F.col("committed"), F.col("end_offset") - F.col("committed")))


def key_prefixes(keys: DataFrame, column: str, sample: int = 500, top: int = 25) -> DataFrame:
    """Counts of the part before the first colon among the first `sample` keys in order."""
    first = keys.select(column).orderBy(column).limit(sample)
    return first.groupBy(F.substring_index(column, ":", 1).alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(top)
