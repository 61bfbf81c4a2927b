"""Queries and projections of further sources: structured logs, cloud logs, user reports, shops, brokers; and
how relevant an item of each is to a hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_LEVELS = ["error", "warn", "fatal"]


def _wanted(terms: list[str], least: int = 3, most: int | None = None) -> list[str]:
    return [t.strip() for t in terms if len(t.strip()) >= least][:most]


def _search(text: Column, terms: list[str]) -> Column:
    """Whether a text holds one of the terms of three characters or more, case aside; true without any."""
    words = _wanted(terms)
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(text), w)) if words else F.lit(True)


def _bounded(limit: int) -> int:
    return min(max(limit, 1), 1000)


def recent(rows: DataFrame, terms: list[str], limit: int = 100) -> DataFrame:
    """The newest rows (ts, level, message) that hold a term."""
    return rows.filter(_search(F.col("message"), terms)).orderBy(F.desc("ts"), "id").limit(_bounded(limit))


def top_signatures(rows: DataFrame, terms: list[str], limit: int = 10) -> DataFrame:
    """(message, level, n, newest): the most frequent messages of error levels."""
    bad = rows.filter(F.lower("level").isin(ERROR_LEVELS) & _search(F.col("message"), terms))
    return bad.groupBy("message", "level").agg(F.count("*").alias("n"), F.max("ts").alias("newest")).orderBy(F.desc("n"), "message", "level").limit(_bounded(limit))


def recent_errors(rows: DataFrame, terms: list[str], limit: int = 5) -> DataFrame:
    """A few of the newest rows of error levels."""
    return recent(rows.filter(F.lower("level").isin(ERROR_LEVELS)), terms, limit)


def cloud_rows(rows: DataFrame, since: Column | None, until: Column, terms: list[str], limit: int = 200) -> DataFrame:
    """The newest rows (ts, message) of a window, both ends included and a day long unless since is given, that
    hold one of the first eight terms. A window that ends before it begins has no rows."""
    start = since if since is not None else until - F.expr("INTERVAL 24 HOURS")
    return recent(rows.filter(F.col("ts").between(start, until)), _wanted(terms, most=8), limit)


def report_window(reports: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """Reports (created: text) of a window, both ends included. One whose time cannot be read stays, and a bound
    that cannot be read bounds nothing."""
    at = F.try_to_timestamp("created")
    lo, hi = (F.try_to_timestamp(F.lit(x).cast("string")) for x in (since, until))
    return reports.filter(at.isNull() | ((lo.isNull() | (at >= lo)) & (hi.isNull() | (at <= hi))))


def failing_requests(tail: Column, most: int = 5) -> Column:
    """The first `most` failed entries of array<struct<method, url, ok, status>>."""
    bad = F.filter(tail, lambda r: F.coalesce(~r["ok"], F.lit(False)) | F.coalesce(r["status"] >= 500, F.lit(False)))
    return F.slice(bad, 1, most)


def browser_frame(stack: Column) -> Column:
    """struct<function, file, line> of the first frame of a browser's stack that is code of the page: not a package,
    an extension, or native."""
    lines = F.transform(F.split(stack, "\n"), lambda x: F.trim(x))
    v8, named = r"^at\s+(?:(.*?)\s*\()?([^()]+?)\)?$", r"^(.*)@(.+)$"
    part = lambda s, i: F.when(s.startswith("at "), F.regexp_extract(s, v8, i)).otherwise(F.regexp_extract(s, named, i))
    skipped = lambda place: (place == "") | place.rlike(r"node_modules|\[native code\]|<anonymous>|(?i)^[a-z-]+-extension://")
    where = r"^(?:[a-z]+://[^/]+)?(.*?)(?::(\d+))?(?::\d+)?$"
    frames = F.transform(lines, lambda s: F.struct(F.nullif(F.trim(part(s, 1)), F.lit("")).alias("function"), part(s, 2).alias("place")))
    first = F.get(F.filter(frames, lambda f: ~skipped(f["place"])), F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["function"].alias("function"), F.regexp_extract(first["place"], where, 1).alias("file"), F.regexp_extract(first["place"], where, 2).try_cast("int").alias("line")))


def result_count(data: Column) -> Column:
    """How many items the connections of a GraphQL answer (JSON text) list, by edges or else nodes; null without any."""
    parts = F.map_values(F.from_json(data, "map<string, string>"))
    size = lambda v, key: F.size(F.from_json(F.get_json_object(v, f"$.{key}"), "array<string>"))
    many = lambda v, key: F.when(F.get_json_object(v, f"$.{key}").startswith("["), size(v, key))
    counts = F.filter(F.transform(parts, lambda v: F.coalesce(many(v, "edges"), many(v, "nodes"))), lambda n: n.isNotNull())
    return F.when(F.size(counts) > 0, F.aggregate(counts, F.lit(0), lambda a, n: a + n))


def bound_variables(static: Column, bind: Column, since: Column, until: Column) -> Column:
    """A query's variables (map) with the window's ends, where the query asks for them."""
    window = F.map_filter(F.create_map(F.lit("from"), since, F.lit("to"), until), lambda k, v: v.isNotNull())
    base = F.map_filter(static, lambda k, v: ~(bind & F.map_contains_key(window, k)))
    return F.when(bind, F.map_concat(base, window)).otherwise(static)


def broker_counts(queues: DataFrame) -> DataFrame:
    """(queue, active, dead, scheduled, valid) of a broker's answers (queue, json); counts must not be negative."""
    at = lambda name: F.get_json_object("json", f"$.properties.countDetails.{name}").try_cast("long")
    rows = queues.select("queue", at("activeMessageCount").alias("active"), at("deadLetterMessageCount").alias("dead"), at("scheduledMessageCount").alias("scheduled"))
    return rows.withColumn("valid", F.coalesce((F.col("active") >= 0) & (F.col("dead") >= 0) & (F.col("scheduled") >= 0), F.lit(False)))


def issue_page(issues: DataFrame, after: str | None, size: int = 100) -> DataFrame:
    """A page of issues (id, last_seen, ...), the newest first, behind the issue `after`; the last id is the next cursor."""
    rows = issues
    if after is not None:
        mark = issues.filter(F.col("id") == after).select(F.col("last_seen").alias("mark_at"), F.col("id").alias("mark"))
        rows = issues.join(mark, (F.col("last_seen") < F.col("mark_at")) | ((F.col("last_seen") == F.col("mark_at")) & (F.col("id") > F.col("mark")))).drop("mark_at", "mark")
    return rows.orderBy(F.desc("last_seen"), "id").limit(size)


def _fresh(at: Column, now: Column) -> Column:
    """.1 within a day, .05 within a week."""
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(3.6e9)
    return F.when(hours <= 24, 0.1).when(hours <= 168, 0.05).otherwise(0.0)


def _score(base: Column, hay: Column, terms: list[str], *more: Column) -> Column:
    hit = F.when(_search(hay, terms), 0.2).otherwise(0.0) if _wanted(terms) else F.lit(0.0)
    return F.least(F.greatest(sum(more, base + hit), F.lit(0.5)), F.lit(0.95))


def issue_relevance(hay: Column, last_seen: Column, count: Column, has_frame: Column, terms: list[str], now: Column) -> Column:
    return _score(F.lit(0.6), hay, terms, _fresh(last_seen, now), F.when(count >= 1000, 0.1).when(count >= 100, 0.05).otherwise(0.0), F.when(has_frame, 0.05).otherwise(0.0))


def log_relevance(hay: Column, at: Column, level: Column, count: Column, terms: list[str], now: Column) -> Column:
    by_level = F.when(F.lower(level).isin("error", "fatal", "critical"), 0.1).when(F.lower(level).isin("warn", "warning"), 0.05).otherwise(0.0)
    return _score(F.lit(0.6), hay, terms, _fresh(at, now), by_level, F.when(count >= 10, 0.1).otherwise(0.0))


def report_relevance(hay: Column, at: Column, occurrences: Column, terms: list[str], now: Column) -> Column:
    return _score(F.lit(0.6), hay, terms, _fresh(at, now), F.when(occurrences >= 3, 0.05).otherwise(0.0))


def shop_relevance(configured: Column, hay: Column, terms: list[str]) -> Column:
    return _score(F.coalesce(configured, F.lit(0.6)), hay, terms)
