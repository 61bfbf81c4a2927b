"""Queries of log, metric, state and queue operators on the driver tables.

Stand-ins: an event is a log row (code = type and k modulo 10, service = user), hourly and daily
event series are metrics, orders are a stateful table and, by priority, queues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs, metrics, state
from ..session import table
from .common import Registry

def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _logs(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "fatal").when(F.col("event_type") == "signup", "warn").otherwise("info")
    return table(spark, d, "events").select(
        F.concat_ws("-", "event_type", (_k() % 10).cast("string")).alias("code"),
        level.alias("level"),
        F.concat_ws(" ", F.lit("user"), F.col("user_id").cast("string"), "event_type").alias("message"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 13).cast("string")).alias("service"),
        "ts",
        F.col("event_id").alias("seq"),
        "value",
        _k().alias("k"),
        "user_id",
        "event_type",
    )


_LOGS = """logs AS (
  SELECT event_type || '-' || (CAST(json_extract(props, '$.k') AS INTEGER) % 10) AS code,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'fatal' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level,
    'user ' || user_id || ' ' || event_type AS message, 'svc-' || (user_id % 13) AS service, ts, event_id AS seq, value,
    CAST(json_extract(props, '$.k') AS INTEGER) AS k, user_id, event_type FROM events)"""
STOP, WEEK = "TIMESTAMP_NTZ '2024-01-30 00:00:00'", "INTERVAL 7 DAYS"


def _range() -> tuple:
    stop = F.expr(STOP)
    return stop - F.expr(WEEK), stop


query = Registry()


_SIGS = """SELECT code AS key, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen,
  max_by(level, (ts, seq)) AS level, max_by(message, (ts, seq)) AS message
  FROM rows GROUP BY code"""
_SVC = """svc AS (SELECT key, list(service ORDER BY r) AS services FROM (
  SELECT code AS key, service, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, service) AS r FROM rows GROUP BY code, service)
  WHERE r <= 10 GROUP BY key)"""


@query("agg_analyze_errors", f"""WITH {_LOGS},
win AS (SELECT TIMESTAMP '2024-01-23' AS a, TIMESTAMP '2024-01-30' AS b, TIMESTAMP '2024-01-16' AS z),
rows AS (SELECT logs.* FROM logs, win WHERE ts BETWEEN a AND b AND level IN ('error', 'fatal')),
{_SVC}, sigs AS ({_SIGS}),
base AS (SELECT code AS key, count(*) AS m FROM logs, win WHERE ts BETWEEN z AND a AND level IN ('error', 'fatal') GROUP BY code)
SELECT s.key, n, first_seen, last_seen, services, level, message, coalesce(m, 0) AS baseline_n, m IS NULL AS is_new, n / m AS ratio,
  CASE WHEN m IS NULL THEN 'new' WHEN n / m >= 1.5 THEN 'spike' ELSE 'steady' END AS tag
FROM (SELECT * FROM sigs ORDER BY n DESC, key LIMIT 25) s LEFT JOIN base USING (key) LEFT JOIN svc USING (key)""")
def analyze_errors(spark: SparkSession, d: str) -> DataFrame:
    return logs.analyze_errors(_logs(spark, d), *_range())


@query("agg_error_signatures", f"WITH {_LOGS}, rows AS (SELECT * FROM logs WHERE level IN ('error', 'fatal')), {_SVC}, sigs AS ({_SIGS}) SELECT sigs.*, services FROM sigs LEFT JOIN svc USING (key) ORDER BY n DESC, key LIMIT 25")
def error_signatures(spark: SparkSession, d: str) -> DataFrame:
    return logs.signatures(logs.at_least(_logs(spark, d), "error"))


@query("agg_error_buckets", f"WITH {_LOGS} SELECT service AS key, count(*) AS n FROM logs WHERE level IN ('error', 'fatal') GROUP BY 1 ORDER BY n DESC, key LIMIT 20")
def error_buckets(spark: SparkSession, d: str) -> DataFrame:
    return logs.buckets(_logs(spark, d), "service")


@query("join_error_delta", f"""WITH {_LOGS},
c AS (SELECT code AS key, count(*) AS n FROM logs WHERE ts BETWEEN TIMESTAMP '2024-01-23' AND TIMESTAMP '2024-01-30' AND k < 45 GROUP BY 1),
b AS (SELECT code AS key, count(*) AS n FROM logs WHERE ts BETWEEN TIMESTAMP '2024-01-16' AND TIMESTAMP '2024-01-23' AND k >= 5 GROUP BY 1)
SELECT key, coalesce(b.n, 0) AS baseline_n, coalesce(c.n, 0) AS current_n, coalesce(c.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN c USING (key)""")
def error_delta(spark: SparkSession, d: str) -> DataFrame:
    rows, (a, b) = _logs(spark, d), _range()
    count = lambda x: x.groupBy(F.col("code").alias("key")).agg(F.count("*").alias("n"))
    week = F.expr(WEEK)
    return logs.deltas(count(logs.between(rows, a - week, a).filter("k >= 5")), count(logs.between(rows, a, b).filter("k < 45")))


@query("agg_entity", """SELECT entity, n, (SELECT count(DISTINCT json_extract_string(props, '$.k')) FROM events WHERE event_type = 'error') > 20 AS capped FROM (
  SELECT json_extract_string(props, '$.k') AS entity, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) ORDER BY n DESC, entity LIMIT 20""")
def entity(spark: SparkSession, d: str) -> DataFrame:
    return logs.entities(_logs(spark, d).filter("event_type = 'error'"), "k")


@query("agg_duration", "SELECT event_type AS dimension, avg(value) AS avg_ms, quantile_disc(value, 0.95) AS p95_ms, count(*) AS n, min(value) AS min_ms, max(value) AS max_ms FROM events WHERE value IS NOT NULL GROUP BY 1")
def duration(spark: SparkSession, d: str) -> DataFrame:
    return logs.durations(table(spark, d, "events"), "event_type", "value")


@query("src_es_search", f"WITH {_LOGS} SELECT code, level, message, service, ts, seq FROM logs WHERE ts BETWEEN TIMESTAMP '2024-01-23' AND TIMESTAMP '2024-01-30' AND level IN ('warn', 'error', 'fatal') ORDER BY ts DESC, seq DESC LIMIT 50")
def es_search(spark: SparkSession, d: str) -> DataFrame:
    return logs.search(_logs(spark, d), *_range(), level="warn").select("code", "level", "message", "service", "ts", "seq")


@query("flt_where_text", f"WITH {_LOGS} SELECT seq, code, message FROM logs WHERE service = 'svc-3' AND lower(message || chr(10) || code) LIKE '%error-4%'")
def where_text(spark: SparkSession, d: str) -> DataFrame:
    return logs.text_match(logs.where(_logs(spark, d), {"service": "svc-3"}), "ERROR-4", broad=True).select("seq", "code", "message")


@query("prj_level", "SELECT event_id, CASE WHEN v >= 60 THEN 'fatal' WHEN v >= 50 THEN 'error' WHEN v >= 40 THEN 'warn' WHEN v >= 30 THEN 'info' WHEN v >= 20 THEN 'debug' ELSE 'trace' END AS level FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) + 10 AS v FROM events)")
def level(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", logs.level_label(_k() + 10).alias("level"))


@query("fn_duration_ms", """SELECT event_id, text, CASE m WHEN 0 THEN k * 60000.0 + s * 1000 WHEN 1 THEN k * 1.0 WHEN 2 THEN s * 1.0 WHEN 3 THEN s + 0.5 END AS ms FROM (
  SELECT event_id, m, k, s, CASE m WHEN 0 THEN k || 'm' || s || 's' WHEN 1 THEN '~' || k || 'ms' WHEN 2 THEN s || '' WHEN 3 THEN s || '.5 ms' ELSE k || ' markets' END AS text FROM (
  SELECT event_id, event_id % 5 AS m, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_id % 60 AS s FROM events))""")
def duration_ms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("event_id", "event_id % 5 AS m", "CAST(get_json_object(props, '$.k') AS INT) AS k", "event_id % 60 AS s")
    text = F.expr("CASE m WHEN 0 THEN k || 'm' || s || 's' WHEN 1 THEN '~' || k || 'ms' WHEN 2 THEN s || '' WHEN 3 THEN s || '.5 ms' ELSE k || ' markets' END")
    return rows.select("event_id", text.alias("text")).withColumn("ms", logs.duration_ms(F.col("text")))


def _series(spark: SparkSession, d: str, seconds: int) -> DataFrame:
    return metrics.bucketed(table(spark, d, "events"), "event_type", "ts", seconds, F.count("*"))


_HOURS = "series AS (SELECT event_type AS series, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS t, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2)"


@query("src_prom_range", f"WITH {_HOURS} SELECT * FROM series")
def prom_range(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d, 3600)


@query("agg_summary", f"WITH {_HOURS} SELECT series, min(v) AS min_v, max(v) AS max_v, avg(v) AS avg_v, arg_max(v, t) AS last_v, count(*) AS n FROM series GROUP BY 1")
def summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(_series(spark, d, 3600))


@query("win_spikes", f"""WITH {_HOURS}, s AS (SELECT series, sum(v) AS s, count(*) AS n, avg(v) AS mean_v, stddev_pop(v) AS std_v FROM series GROUP BY 1)
SELECT series, t, v, mean_v, std_v, (v - (s - v) / (n - 1)) / std_v AS z FROM series JOIN s USING (series) WHERE n >= 2 AND std_v > 0 AND (v - (s - v) / (n - 1)) / std_v > 3""")
def spikes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.spikes(_series(spark, d, 3600))


_DAYS = """days AS (SELECT event_type || '-' || (user_id % 20) AS series, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS t, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2),
b AS (SELECT series, avg(v) AS baseline_avg FROM days WHERE t >= 1705276800 AND t < 1705881600 GROUP BY 1),
c AS (SELECT series, avg(v) AS current_avg FROM days WHERE t >= 1705881600 AND t < 1706486400 GROUP BY 1),
cmp AS (SELECT series, current_avg, coalesce(baseline_avg, 0) AS baseline_avg, current_avg - coalesce(baseline_avg, 0) AS delta,
  CASE WHEN coalesce(baseline_avg, 0) = 0 THEN CASE WHEN current_avg > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END ELSE current_avg / baseline_avg END AS ratio FROM c LEFT JOIN b USING (series))"""


def _compared(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("series", F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string")))
    days = metrics.bucketed(rows, "series", "ts", 86400, F.count("*"))
    return metrics.compare(days.filter("t >= 1705276800 AND t < 1705881600"), days.filter("t >= 1705881600 AND t < 1706486400"))


@query("join_window_cmp", f"WITH {_DAYS} SELECT *, ratio >= 1.5 AS is_spike FROM cmp")
def window_cmp(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d)


@query("win_anomaly", f"""WITH {_DAYS}, k AS (SELECT *, CASE split_part(series, '-', 1) WHEN 'error' THEN 'error-rate' WHEN 'click' THEN 'throughput' WHEN 'view' THEN 'queue' WHEN 'purchase' THEN 'latency' ELSE 'other' END AS kind FROM cmp)
SELECT series, kind, ratio, CASE WHEN kind = 'latency' AND ratio >= 1.5 THEN 'latency-spike' WHEN kind = 'queue' AND (ratio >= 1.5 OR current_avg > baseline_avg) AND delta > 0 THEN 'queue-growth'
 WHEN kind = 'throughput' AND ratio > 0 AND ratio <= 0.67 THEN 'throughput-drop' WHEN kind = 'error-rate' AND ratio >= 1.5 THEN 'error-rate-change' WHEN ratio >= 1.5 OR (ratio > 0 AND ratio <= 0.67) THEN 'change' ELSE 'none' END AS anomaly FROM k""")
def anomaly(spark: SparkSession, d: str) -> DataFrame:
    first = F.substring_index("series", "-", 1)
    kind = F.when(first == "error", "error-rate").when(first == "click", "throughput").when(first == "view", "queue").when(first == "purchase", "latency").otherwise("other")
    rows = _compared(spark, d).withColumn("kind", kind)
    return rows.select("series", "kind", "ratio", metrics.anomaly(F.col("kind")).alias("anomaly"))


@query("agg_bimodal", f"""WITH {_DAYS}, a AS (SELECT count(*) AS total, count(*) FILTER (ratio >= 1.1 AND NOT isinf(ratio)) AS high_n, count(*) FILTER (ratio > 0 AND ratio <= 0.9) AS low_n, count(*) FILTER (isinf(ratio) OR ratio = 0) AS degenerate_n,
 median(ratio) FILTER (ratio >= 1.1 AND NOT isinf(ratio)) AS high_ratio, median(ratio) FILTER (ratio > 0 AND ratio <= 0.9) AS low_ratio FROM cmp)
SELECT *, high_n / total AS high_share, (low_n + degenerate_n) / total AS low_share,
 total >= 3 AND high_n >= 1 AND low_n + degenerate_n >= 2 AND (low_n + degenerate_n) / total >= 0.2 AND (high_n >= 2 OR high_n / total >= 0.2) AND NOT coalesce(low_n > 0 AND high_ratio / low_ratio < 2, false) AS bimodal FROM a""")
def bimodal(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bimodal(_compared(spark, d), spike=1.1, drop=0.9)


@query("agg_quartiles", "SELECT l_returnflag, min(l_extendedprice) AS min_v, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median_v, quantile_cont(l_extendedprice, 0.75) AS q3, max(l_extendedprice) AS max_v, count(*) AS n FROM lineitem GROUP BY 1")
def quartiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.quartiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


@query("agg_histogram", """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), w AS (SELECT lo, (hi - lo) / 10 AS w FROM e),
c AS (SELECT least(CAST(floor((value - lo) / w) AS INTEGER), 9) AS bin, count(*) AS n FROM events, w GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, lo + r.bin * w AS lo, lo + (r.bin + 1) * w AS hi, coalesce(n, 0) AS n FROM range(0, 10) r(bin) CROSS JOIN w LEFT JOIN c ON c.bin = r.bin""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(table(spark, d, "events"), "value")


_PROFILE = """profile AS (SELECT 'orders' AS collection, CASE o_orderstatus WHEN 'F' THEN 'Job Failed' WHEN 'P' THEN 'pending' ELSE 'open' END AS status, count(*) AS n, o_orderstatus IN ('F', 'P') AS anomalous, sum(count(*)) OVER () AS total, max(max(o_orderdate)) OVER () AS last_activity,
 date_diff('second', max(max(o_orderdate)) OVER (), TIMESTAMP '2001-08-05') / 3600.0 AS age_hours, 'stale' AS class FROM orders GROUP BY o_orderstatus)"""


@query("agg_state", f"WITH {_PROFILE} SELECT collection, status, n, anomalous, CAST(total AS BIGINT) AS total, last_activity, age_hours, class FROM profile")
def state_profile(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "orders").withColumn("status", F.expr("CASE o_orderstatus WHEN 'F' THEN 'Job Failed' WHEN 'P' THEN 'pending' ELSE 'open' END"))
    return state.profile(named, "orders", "status", "o_orderdate", F.expr("TIMESTAMP_NTZ '2001-08-05'"))


@query("sc_state_signals", f"WITH {_PROFILE} SELECT collection, 'anomaly' AS kind, status, n, class, 0.85 AS relevance FROM profile WHERE anomalous UNION ALL SELECT DISTINCT collection, 'stale', NULL, CAST(total AS BIGINT), class, 0.6 FROM profile")
def state_signals(spark: SparkSession, d: str) -> DataFrame:
    return state.state_signals(state_profile(spark, d), ["order"])


@query("sc_queue_signals", """WITH q AS (SELECT o_orderpriority AS queue, count(*) FILTER (o_orderstatus = 'O') AS waiting, CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE count(*) FILTER (o_orderstatus = 'P') END AS active, count(*) FILTER (o_orderstatus = 'F') AS failed,
 count(*) FILTER (o_totalprice > 400000) AS delayed, date_diff('second', min(o_orderdate) FILTER (o_orderstatus = 'O'), TIMESTAMP '2001-08-05') * 1000.0 AS oldest, date_diff('second', max(o_orderdate) FILTER (o_orderstatus = 'F'), TIMESTAMP '2001-08-05') * 1000.0 AS newest FROM orders GROUP BY 1)
SELECT queue, 'worker-starvation' AS kind, CAST(0.7 AS DOUBLE) AS relevance, waiting AS n FROM q WHERE waiting >= 10 AND active = 0
UNION ALL SELECT queue, 'backlog', CASE WHEN waiting > 1000 THEN 0.88 ELSE 0.8 END, waiting FROM q WHERE waiting > 100 AND NOT (waiting >= 10 AND active = 0)
UNION ALL SELECT queue, 'oldest-job', CASE WHEN oldest > 3600000 THEN 0.85 ELSE 0.75 END, CAST(oldest AS BIGINT) FROM q WHERE oldest > 300000
UNION ALL SELECT queue, 'failed-spike', CASE WHEN newest > 3600000 THEN 0.5 WHEN failed > 100 THEN 0.85 ELSE 0.75 END, failed FROM q WHERE failed > 20
UNION ALL SELECT queue, 'delayed-accumulation', 0.7, delayed FROM q WHERE delayed > 50
UNION ALL SELECT queue, 'failed-breakdown', 0.5, 40 FROM q WHERE failed > 0
UNION ALL SELECT queue, 'summary', 0.4, waiting FROM q""")
def queue_signals(spark: SparkSession, d: str) -> DataFrame:
    has = lambda s: F.col("o_orderstatus") == s
    n = lambda c: F.count(F.when(c, 1))
    age = lambda t: (F.unix_seconds(F.expr("TIMESTAMP '2001-08-05'")) - F.unix_seconds(t.cast("timestamp"))) * 1000.0
    active = F.when(F.col("queue").startswith("1"), 0).otherwise(F.col("active"))
    q = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("queue")).agg(
        n(has("O")).alias("waiting"), n(has("P")).alias("active"), n(has("F")).alias("failed"), n(F.col("o_totalprice") > 400000).alias("delayed"),
        age(F.min(F.when(has("O"), F.col("o_orderdate")))).alias("oldest_waiting_ms"), age(F.max(F.when(has("F"), F.col("o_orderdate")))).alias("newest_failed_age_ms"),
    )
    return state.queue_signals(q.withColumn("active", active).withColumn("top_share", F.lit(0.4)).withColumn("top_age_ms", F.col("newest_failed_age_ms")))


@query("agg_failed_breakdown", "SELECT user_id, reason, count(*) AS n, max(ts) AS newest FROM (SELECT user_id, substr(props, 1, 120) AS reason, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'error') WHERE r <= 20 GROUP BY 1, 2")
def failed_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return state.failed_breakdown(table(spark, d, "events").filter("event_type = 'error'"), "user_id", "props", "ts", "event_id")


@query("src_kafka", "SELECT part, e AS end_offset, c AS committed, CASE WHEN e >= c THEN e - c END AS lag FROM (SELECT o_orderpriority AS part, max(o_orderkey) AS e, max(o_orderkey) FILTER (o_orderstatus = 'F' AND o_orderpriority NOT LIKE '5%') AS c FROM orders GROUP BY 1)")
def kafka(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "part")
    ends = o.groupBy("part").agg(F.max("o_orderkey").alias("end_offset"))
    return state.lag(ends, o.filter("o_orderstatus = 'F' AND part NOT LIKE '5%'").groupBy("part").agg(F.max("o_orderkey").alias("committed")), ["part"])


@query("src_redis_scan", "SELECT split_part(key, ':', 1) AS prefix, count(*) AS n FROM (SELECT event_type || ':' || event_id AS key FROM events ORDER BY key LIMIT 500) GROUP BY 1 ORDER BY n DESC, prefix LIMIT 25")
def redis_scan(spark: SparkSession, d: str) -> DataFrame:
    return state.key_prefixes(table(spark, d, "events").select(F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("key")), "key")
