"""Source payloads to rows: metric JSON, tabular responses, cloud logs, stack frames, git logs, log documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.logs import LEVELS, level_label
from ..operators.scan import running_sum

RANGE_JSON = "struct<status: string, data: struct<resultType: string, result: array<struct<metric: map<string, string>, values: array<array<string>>, value: array<string>>>>>"


def sample_value(text: Column) -> Column:
    """Metric sample text to double; NaN and the infinities are values, other words null."""
    named = F.when(text == "NaN", float("nan")).when(text.isin("+Inf", "Inf"), float("inf")).when(text == "-Inf", float("-inf"))
    return F.coalesce(named, text.try_cast("double"))


def metric_samples(payloads: DataFrame, column: str = "body") -> DataFrame:
    """Range and instant responses -> (labels, t, v); a payload that is no such JSON gives no rows."""
    j = payloads.select(F.from_json(column, RANGE_JSON).alias("j")).select(F.explode("j.data.result").alias("r"))
    values = F.coalesce("r.values", F.when(F.col("r.value").isNotNull(), F.array("r.value")))
    rows = j.select(F.col("r.metric").alias("labels"), F.explode(values).alias("x"))
    return rows.select("labels", F.get("x", F.lit(0)).try_cast("double").alias("t"), sample_value(F.get("x", F.lit(1))).alias("v"))


def tabular(payloads: DataFrame, column: str = "body") -> DataFrame:
    """{fields: [...], columns: [[...], ...]} or {fields, rows: [[...], ...]} -> (payload, row, field, value)."""
    kind = "struct<fields: array<string>, columns: array<array<string>>, rows: array<array<string>>>"
    j = payloads.select(F.monotonically_increasing_id().alias("payload"), F.from_json(column, kind).alias("j"))
    by_row = j.filter("j.rows IS NOT NULL").select("payload", "j.fields", F.posexplode("j.rows").alias("row", "cells"))
    a = by_row.select("payload", "row", F.posexplode("cells").alias("i", "value"), "fields")
    by_column = j.filter("j.rows IS NULL").select("payload", "j.fields", F.posexplode("j.columns").alias("i", "cells"))
    b = by_column.select("payload", F.posexplode("cells").alias("row", "value"), "i", "fields")
    return a.unionByName(b).select("payload", "row", F.get("fields", F.col("i")).alias("field"), "value")


#: Where a cloud log row may keep its message, time and severity, first one wins.
MESSAGE, TIME, SEVERITY = ["message", "textPayload", "Message", "@message", "log"], ["timestamp", "TimeGenerated", "@timestamp", "time"], ["severity", "level", "SeverityLevel", "levelname"]


def _first(json: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.get_json_object(json, f"$['{n}']") for n in names])


def level_name(text: Column) -> Column:
    """A label or a number to one of the six levels; unknown words are info."""
    low = F.lower(F.trim(text))
    word = F.when(low.isin("warning", "warn", "notice"), "warn").when(low.isin("err", "error"), "error").when(low.isin("critical", "fatal", "emergency", "alert", "panic"), "fatal").when(low.isin(*LEVELS), low)
    number = low.try_cast("double")
    return F.when(number.isNotNull(), level_label(number)).otherwise(F.coalesce(word, F.lit("info")))


def cloud_records(rows: DataFrame, column: str = "body") -> DataFrame:
    """(id, ts, level, message): a message that is JSON itself hands on its own message and level."""
    j = F.col(column)
    rows = rows.select(j.alias("body"), _first(j, MESSAGE).alias("m"), _first(j, TIME).alias("t"), _first(j, SEVERITY).alias("s"))
    inner = F.when(F.col("m").startswith("{"), F.col("m"))
    text = F.coalesce(_first(inner, ["message", "msg"]), F.col("m"))
    level = level_name(F.coalesce(_first(inner, SEVERITY), F.col("s")))
    return rows.select(F.sha2("body", 256).alias("id"), F.col("t").try_cast("timestamp_ntz").alias("ts"), level.alias("level"), text.alias("message"))


FRAMES = "array<struct<filename: string, `function`: string, lineno: int, in_app: boolean>>"


def top_frame(frames: Column) -> Column:
    """The last in-app frame of a JSON array of stack frames, or else the last frame, as file:line."""
    f = F.from_json(frames, FRAMES)
    own = F.filter(f, lambda x: x["in_app"])
    best = F.when(F.size(own) > 0, F.element_at(own, -1)).when(F.size(f) > 0, F.element_at(f, -1))
    return F.concat_ws(":", best["filename"], best["lineno"].cast("string"))


def git_log(lines: DataFrame, repo: str | None = None) -> DataFrame:
    """(seq, line) of a log whose commits start with `commit|hash|author|date|title` and go on with
    file names -> (hash, author, at, title, files). repo: a column that keeps logs
    of several repositories apart; one repository's log is one ordered text, numbered by ranges of seq."""
    by = [repo] if repo else []
    head = F.col("line").startswith("commit|")
    if repo:
        rows = lines.withColumn("block", F.sum(head.cast("int")).over(Window.partitionBy(repo).orderBy("seq")))
    else:
        rows = running_sum(lines, "seq", head.cast("int"), "block")
    rows = rows.filter("block > 0 AND line <> ''")
    parts = F.split(F.max(F.when(head, F.col("line"))), r"\|", 5)
    files = F.transform(F.sort_array(F.collect_list(F.when(~head, F.struct("seq", "line")))), lambda x: x["line"])
    out = rows.groupBy(*by, "block").agg(parts.alias("p"), files.alias("files"))
    return out.select(*by, F.get("p", F.lit(1)).alias("hash"), F.get("p", F.lit(2)).alias("author"), F.get("p", F.lit(3)).try_cast("timestamp_ntz").alias("at"), F.get("p", F.lit(4)).alias("title"), "files")


def log_documents(rows: DataFrame, column: str = "body") -> DataFrame:
    """JSON log documents of either common layout -> ts, level, message, code, service, trace_id and
    up to 16 context fields."""
    j = F.col(column)
    own = ["time", "@timestamp", "level", "log", "msg", "message", "code", "event", "service", "trace", "traceId"]
    plain = F.map_filter(F.coalesce(F.from_json(j, "map<string, string>"), F.create_map().cast("map<string, string>")), lambda k, v: ~k.isin(*own) & v.isNotNull())
    context = F.map_from_entries(F.slice(F.array_sort(F.map_entries(plain)), 1, 16))
    at = lambda *paths: F.coalesce(*[F.get_json_object(j, p) for p in paths])
    return rows.select(
        at("$['@timestamp']", "$.time").try_cast("timestamp_ntz").alias("ts"), level_name(at("$.log.level", "$.level")).alias("level"), at("$.message", "$.msg").alias("message"),
        at("$.event.code", "$.code").alias("code"), at("$.service.name", "$.service").alias("service"), at("$.trace.id", "$.traceId").alias("trace_id"), context.alias("context"),
    )


def tail_error(detail: Column) -> Column:
    """The most message-like text of an error object, at most 300 characters."""
    j = F.coalesce(*[F.get_json_object(detail, f"$.{p}") for p in ("err.message", "error.message", "err.cause.message", "error.reason", "err", "error", "detail", "reason")])
    return F.substring(j, 1, 300)


def state_fields(columns: list[str]) -> tuple[str | None, str | None]:
    """The date and the status field of a table by name; the first candidate that is there."""
    dates = ["updated_at", "updatedAt", "last_run_started_at", "modified_at", "created_at", "createdAt", "timestamp", "date", "o_orderdate", "ts"]
    statuses = ["status", "state", "last_run_status", "o_orderstatus", "event_type"]
    have = {c: c for c in columns}
    return next((have[c] for c in dates if c in have), None), next((have[c] for c in statuses if c in have), None)
