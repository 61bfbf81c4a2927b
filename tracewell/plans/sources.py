"""Queries of stores and connectors on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import connectors, metrics
from ..session import table
from ..sources import stores
from .common import Registry

query = Registry()
NOW = "TIMESTAMP_NTZ '2024-01-30 00:00:00'"


def _store(spark: SparkSession, d: str, allowed: list[str] | None = None) -> stores.Store:
    orders = table(spark, d, "orders").withColumnsRenamed({"o_orderdate": "created_at", "o_orderstatus": "status"})
    events = table(spark, d, "events").withColumnsRenamed({"ts": "timestamp", "event_type": "state"})
    return stores.Store({"orders": orders, "events": events, "customer": table(spark, d, "customer"), "nation": table(spark, d, "nation")}, allowed)


@query("src_postgres", "SELECT 'orders' AS collection, count(*) AS n, 'created_at' AS date_field, max(o_orderdate) AS newest, 'status' AS status_field FROM orders UNION ALL SELECT 'events', count(*), 'timestamp', max(ts), 'state' FROM events UNION ALL SELECT 'customer', count(*), NULL, NULL, NULL FROM customer")
def postgres(spark: SparkSession, d: str) -> DataFrame:
    """Count, date column, newest row and status column of each table on the allow list."""
    return _store(spark, d, ["orders", "events", "customer"]).overview()


@query("src_mongo", "SELECT coalesce(CAST(c_nationkey AS VARCHAR), '(none)') AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def mongo(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).values("customer", "c_nationkey")


@query("src_sqlserver", "SELECT max(ts) AS newest FROM events")
def sqlserver(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).newest("events", "timestamp")


@query("src_firestore", "SELECT count(*) AS n FROM nation")
def firestore(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).count("nation")


@query("src_es_fieldcaps", "SELECT * FROM (VALUES ('level', 'user_id', 'bigint is no text'), ('message', 'body', 'missing; of that kind: event_type, props'), ('host', 'node', 'missing; of that kind: event_type, props')) v(role, field, problem)")
def fieldcaps(spark: SparkSession, d: str) -> DataFrame:
    roles = {"time": ("ts", "timestamp"), "level": ("user_id", "text"), "message": ("body", "text"), "host": ("node", "text"), "value": ("value", "number")}
    return spark.createDataFrame(stores.field_check(table(spark, d, "events"), roles), "role string, field string, problem string")


@query("src_es_indices", "SELECT * FROM (VALUES ('tw_logs_events', true), ('tw_logs_orders', true)) v(index, temporary)")
def es_indices(spark: SparkSession, d: str) -> DataFrame:
    for name in ("events", "orders"):
        table(spark, d, name).createOrReplaceTempView(f"tw_logs_{name}")
    return stores.indices(spark, "tw_logs_*")


@query("src_minified", "SELECT doc_id AS path, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 5000)) > 0 AS minified FROM documents")
def minified(spark: SparkSession, d: str) -> DataFrame:
    return stores.minified(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query("src_manifest", """SELECT * FROM (SELECT r_regionkey || '/package.json' AS path, p.package, p.dev FROM region, (VALUES ('axios', false), ('left-pad', false), ('jest', true)) p(package, dev)
 UNION ALL SELECT r_regionkey || '/requirements-dev.txt', p.package, false FROM region, (VALUES ('flask'), ('numpy'), ('pandas')) p(package) UNION ALL SELECT r_regionkey || '/pyproject.toml', p.package, false FROM region, (VALUES ('pyspark'), ('typing_extensions')) p(package))""")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    texts = [
        ("package.json", '{"name": "x", "dependencies": {"axios": "^1", "left-pad": "1"}, "devDependencies": {"jest": "*"}}'), ("requirements-dev.txt", "# tools\nflask==2.0\n  NumPy>=1 ; python_version > '3'\n-r base.txt\n\npandas[all]\n"),
        ("pyproject.toml", '[project]\nname = "x"\ndependencies = [\n  "pyspark>=4",\n  \'typing_extensions\',\n]\n[tool.x]\nother = ["no"]\n'), ("setup.py", "install_requires=['no']"),
    ]
    files = spark.createDataFrame(texts, "name string, content string")
    regions = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("root"), F.explode(F.array(*[F.lit(n) for n, _ in texts])).alias("name"))
    return stores.manifest_packages(regions.join(files, "name").select(F.concat_ws("/", "root", "name").alias("path"), "content"))


query.cases("src_config", "settings map<string, string>", [({"logs": "http://x", "metrics": ""}, ["logs"]), ({"queue": "redis", "logs": "y"}, ["logs", "queue"]), ({}, []), (None, [])], lambda m: stores.environment(m, ["logs", "metrics", "queue"]), None)


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id AS id", "ts", "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'warn' WHEN 'signup' THEN 'Fatal' ELSE 'info' END AS level", "event_type || ' of ' || user_id AS message")


_LOGS = "l AS (SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'warn' WHEN 'signup' THEN 'Fatal' ELSE 'info' END AS level, event_type || ' of ' || user_id AS message FROM events)"


@query("src_axiom", f"WITH {_LOGS} SELECT message, level, count(*) AS n, max(ts) AS newest FROM l WHERE level <> 'info' AND (contains(message, 'error') OR contains(message, 'sign')) GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def axiom(spark: SparkSession, d: str) -> DataFrame:
    return connectors.top_signatures(_logs(spark, d), ["Error", "sign", "of"])


@query("src_axiom_recent", f"WITH {_LOGS} SELECT * FROM l WHERE level <> 'info' ORDER BY ts DESC, id LIMIT 5")
def axiom_recent(spark: SparkSession, d: str) -> DataFrame:
    return connectors.recent_errors(_logs(spark, d), [])


@query("src_axiom_search", f"WITH {_LOGS} SELECT * FROM l WHERE contains(message, 'purchase') ORDER BY ts DESC, id LIMIT 1000")
def axiom_search(spark: SparkSession, d: str) -> DataFrame:
    return connectors.recent(_logs(spark, d), ["PURCHASE"], 5000)


@query("src_cloudlogs", f"WITH {_LOGS} SELECT * FROM l WHERE ts BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-01-30' AND (contains(message, 'view') OR contains(message, 'click')) ORDER BY ts DESC, id LIMIT 200")
def cloudlogs(spark: SparkSession, d: str) -> DataFrame:
    terms = ["view", "click", "aaa", "bbb", "ccc", "ddd", "eee", "fff", "error"]
    return connectors.cloud_rows(_logs(spark, d), None, F.expr(NOW), terms)


@query("src_lens", "SELECT event_id AS id FROM events WHERE event_id % 9 = 0 OR ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def lens(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "events").selectExpr("event_id AS id", "IF(event_id % 9 = 0, 'yesterday', CAST(ts AS STRING)) AS created")
    return connectors.report_window(reports, "2024-01-10", "2024-01-12 00:00:00").select("id")


query.cases("fn_browser_frame", "stack string", [
    ("Error: x\n    at pay (https://shop.io/static/app.js:10:5)\n    at go (https://shop.io/b.js:1:1)", "pay /static/app.js 10"), ("    at https://shop.io/app.js:7:2", "- /app.js 7"), ("pay@https://shop.io/app.js:3:1", "pay /app.js 3"),
    ("Error\n    at x (https://shop.io/node_modules/a.js:1:1)\n    at y (chrome-extension://abc/b.js:2:2)\n    at z (<anonymous>)\n    at real (https://shop.io/c.js:4:4)", "real /c.js 4"), ("no frames", None), (None, None),
], lambda s: F.when(connectors.browser_frame(s).isNotNull(), F.concat_ws(" ", F.coalesce(connectors.browser_frame(s)["function"], F.lit("-")), connectors.browser_frame(s)["file"], connectors.browser_frame(s)["line"].cast("string"))))
query.cases("fn_failing_requests", "tail array<struct<method: string, url: string, ok: boolean, status: int>>", [
    ([("GET", "/a", True, 200), ("POST", "/b", False, None), ("GET", "/c", None, 503), ("GET", "/d", True, 499)], ["/b", "/c"]), ([], []), ([("GET", f"/{i}", False, 0) for i in range(7)], ["/0", "/1", "/2", "/3", "/4"]),
], lambda t: F.transform(connectors.failing_requests(t), lambda r: r["url"]))
query.cases("src_shopify", "data string", [
    ('{"orders": {"edges": [1, 2, 3]}, "shop": {"name": "x"}, "products": {"nodes": [{"id": 1}]}}', 4), ('{"orders": {"edges": []}}', 0), ('{"shop": {"name": "x"}}', None), ('{"a": 1}', None), ("{}", None), (None, None), ('{"o": {"edges": [1], "nodes": [1, 2]}}', 1),
], connectors.result_count)
query.cases("fn_bound_variables", "static map<string, string>, bind boolean, since string, until string", [
    ({"a": "1", "from": "x"}, True, "s", "u", "a=1,from=s,to=u"), ({"a": "1"}, False, "s", "u", "a=1"), ({"to": "x"}, True, "s", None, "from=s,to=x"), ({}, True, None, None, ""),
], lambda m, b, s, u: F.array_join(F.array_sort(F.transform(F.map_entries(connectors.bound_variables(m, b, s, u)), lambda e: F.concat_ws("=", e["key"], e["value"]))), ","))


@query("src_servicebus", "SELECT o_orderpriority AS queue, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'F') AS dead, CASE WHEN o_orderpriority LIKE '1%' THEN -1 ELSE count(*) FILTER (o_orderstatus = 'P') END AS scheduled, o_orderpriority NOT LIKE '1%' AS valid FROM orders GROUP BY 1")
def servicebus(spark: SparkSession, d: str) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    q = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("queue")).agg(n("O").alias("o"), n("F").alias("f"), n("P").alias("p"))
    details = F.struct(F.col("o").alias("activeMessageCount"), F.col("f").alias("deadLetterMessageCount"), F.when(F.col("queue").startswith("1"), -1).otherwise(F.col("p")).alias("scheduledMessageCount"))
    return connectors.broker_counts(q.select("queue", F.to_json(F.struct(F.struct(F.lit("Active").alias("status"), details.alias("countDetails")).alias("properties"))).alias("json")))


@query("src_sentry_issues", "WITH i AS (SELECT 'i' || user_id AS id, max(ts) AS last_seen, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY last_seen DESC, id) AS r FROM i) SELECT id, last_seen, n FROM o WHERE r > (SELECT r FROM o WHERE id = 'i13') ORDER BY r LIMIT 20")
def sentry_issues(spark: SparkSession, d: str) -> DataFrame:
    """The page of issues behind the one of user 13."""
    e = table(spark, d, "events").filter("event_type = 'error'")
    return connectors.issue_page(e.groupBy(F.concat(F.lit("i"), "user_id").alias("id")).agg(F.max("ts").alias("last_seen"), F.count("*").alias("n")), "i13", 20)


_FRESH = "CASE WHEN date_diff('microsecond', ts, TIMESTAMP '2024-01-30') / 3.6e9 <= 24 THEN 0.1 WHEN date_diff('microsecond', ts, TIMESTAMP '2024-01-30') / 3.6e9 <= 168 THEN 0.05 ELSE 0 END"
_HIT = "CASE WHEN event_type IN ('view', 'error') THEN 0.2 ELSE 0 END"


@query("sc_relevance", f"""SELECT event_id, least(greatest(0.6 + {_HIT} + {_FRESH} + CASE WHEN value >= 1000 THEN 0.1 WHEN value >= 100 THEN 0.05 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 0.05 ELSE 0 END, 0.5), 0.95) AS issue,
 least(greatest(0.6 + {_HIT} + {_FRESH} + CASE event_type WHEN 'error' THEN 0.1 WHEN 'click' THEN 0.05 ELSE 0 END + CASE WHEN value >= 10 THEN 0.1 ELSE 0 END, 0.5), 0.95) AS log,
 least(greatest(0.6 + {_HIT} + {_FRESH} + CASE WHEN value >= 3 THEN 0.05 ELSE 0 END, 0.5), 0.95) AS report, least(greatest(CASE WHEN event_id % 3 = 0 THEN 0.2 WHEN event_id % 3 = 1 THEN 0.9 ELSE 0.6 END + {_HIT}, 0.5), 0.95) AS shop FROM events""")
def relevance(spark: SparkSession, d: str) -> DataFrame:
    c, terms, now = F.col, ["VIEW", "error", "up"], F.expr(NOW)
    level = F.when(c("event_type") == "error", "Fatal").when(c("event_type") == "click", "warning").otherwise("info")
    return table(spark, d, "events").select(
        "event_id", connectors.issue_relevance(c("event_type"), c("ts"), c("value"), c("event_id") % 2 == 0, terms, now).alias("issue"), connectors.log_relevance(c("event_type"), c("ts"), level, c("value"), terms, now).alias("log"),
        connectors.report_relevance(c("event_type"), c("ts"), c("value"), terms, now).alias("report"), connectors.shop_relevance(F.when(c("event_id") % 3 == 0, 0.2).when(c("event_id") % 3 == 1, 0.9), c("event_type"), terms).alias("shop"),
    )


@query("sc_redis_signals", """WITH p AS (SELECT CAST(user_id % 4 AS INTEGER) AS db, event_type AS prefix, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT db, CASE WHEN db = 3 THEN 0 ELSE sum(n) * 2 END AS keys FROM p GROUP BY 1)
SELECT db, 'summary' AS kind, CAST(keys AS BIGINT) AS n, 0.4 AS relevance FROM k WHERE keys > 0 UNION ALL SELECT db, 'locks', CAST(sum(n) AS BIGINT), 0.6 FROM p WHERE db < 3 AND prefix = 'click' GROUP BY 1 UNION ALL SELECT db, 'rate-limit', CAST(sum(n) AS BIGINT), 0.6 FROM p WHERE db < 3 AND prefix = 'view' GROUP BY 1""")
def redis_signals(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import state

    p = table(spark, d, "events").groupBy((F.col("user_id") % 4).cast("int").alias("db"), F.expr("CASE event_type WHEN 'click' THEN 'userLocks' WHEN 'view' THEN 'Rate-Limit' ELSE event_type END").alias("prefix")).agg(F.count("*").alias("n"))
    keys = p.groupBy("db").agg((F.sum("n") * 2).alias("keys")).withColumn("keys", F.when(F.col("db") == 3, 0).otherwise(F.col("keys")))
    return state.redis_signals(p.join(keys, "db"))


_DASH = """{"panels": [{"id": 1, "type": "graph", "title": "Jobs %s", "targets": [{"expr": "sum(x)"}, {"expr": ""}], "datasource": {"uid": "prom"}, "fieldConfig": {"defaults": {"unit": "s"}}},
 {"type": "row", "id": 9, "panels": [{"id": 2, "type": "stat", "title": "Errors", "datasource": "loki", "targets": []}, {"id": 3, "type": "row", "panels": [{"id": "4", "type": "graph", "targets": [{"expr": "rate(a[5m])"}]}]}]}, {"id": 5, "type": "row"}]}"""


@query("src_grafana", """SELECT CAST(r_regionkey AS VARCHAR) AS uid, p.* FROM region, (VALUES (1, 'Jobs', 'graph', 's', 'prom', ['sum(x)'], 'queue'), (2, 'Errors', 'stat', 'none', 'loki', [], 'error-rate'), (4, '', 'graph', 'none', '', ['rate(a[5m])'], 'throughput')) p(id, title, type, unit, datasource, exprs, kind)""")
def grafana(spark: SparkSession, d: str) -> DataFrame:
    boards = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("uid"), F.lit(_DASH.replace(" %s", "")).alias("json"))
    return metrics.panels(boards)
