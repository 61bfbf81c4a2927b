"""Queries of views and of the watcher on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import views
from ..session import table
from ..streaming import episodes, watch
from . import codegraph
from .common import Registry

query = Registry()
NOW = "TIMESTAMP_NTZ '2024-01-30 00:00:00'"

_PATHS = ["src/orders/a.py", "src/Orders/b.py", "src/_ext/c.py", "tests/d.py", "src/pay/e.py", "root.py"]
_PATH = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PATHS)) + " END"


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_size AS community", f"{_PATH} AS path", "p_partkey")


@query("gr_comm_label", f"""WITH m AS (SELECT p_size AS community, regexp_replace(split_part({_PATH}, '/', -2), '^[_.]+', '') AS f, {_PATH} AS path FROM part), g AS (SELECT community, lower(f) AS low, min(f) AS shown, count(*) AS n, lower(f) = 'tests' AS aside FROM m WHERE contains(path, '/') GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, low) AS r FROM (SELECT *, min(aside) OVER (PARTITION BY community) AS level FROM g) WHERE aside = level)
SELECT community, array_to_string(list_sort(list(upper(shown[1]) || shown[2:])), '+') AS name FROM t WHERE r <= 2 GROUP BY 1""")
def comm_label(spark: SparkSession, d: str) -> DataFrame:
    return views.subsystem_names(_members(spark, d).select("community", "path"))


_NAMES = "CASE community % 4 WHEN 0 THEN 'Sqs+sqs' WHEN 1 THEN '_ext' WHEN 2 THEN 'Tests' ELSE 'Pay+Orders' END"
_SUB = f"""sub AS (SELECT community, CASE community % 4 WHEN 0 THEN 'Sqs' WHEN 1 THEN 'ext' WHEN 2 THEN 'Tests' ELSE 'Pay+Orders' END AS name, count(*) AS members, avg(CASE WHEN p_partkey % 6 = 3 THEN 1.0 ELSE 0 END) > 0.6 OR community % 4 = 2 AS testy FROM (SELECT p_size AS community, p_partkey FROM part) GROUP BY 1),
top AS (SELECT * FROM sub ORDER BY testy, members DESC, name, community LIMIT 12)"""


@query("sort_subsystems", f"WITH {_SUB} SELECT * FROM top")
def subsystems(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    return views.subsystems(m.select("community").distinct().selectExpr("community", f"{_NAMES} AS name"), m.select("community", "path"))


@query("x_architecture", f"""WITH {_SUB} SELECT 'labels' AS section, CASE WHEN p_size % 2 = 0 THEN 'function' ELSE 'class' END AS name, count(*) AS n FROM part WHERE p_size % 5 <> 0 GROUP BY 2 UNION ALL SELECT 'subsystems', name, members FROM top
 UNION ALL SELECT 'queues', o_orderpriority, count(DISTINCT o_custkey) + count(DISTINCT o_orderstatus) FROM orders GROUP BY 2 UNION ALL (SELECT 'flows', 'f' || l_suppkey, count(*) FROM lineitem GROUP BY l_suppkey ORDER BY 3 DESC, 2 LIMIT 20)
 UNION ALL SELECT 'fragile', 'dead code', count(*) FROM part WHERE p_retailprice > 950 UNION ALL SELECT 'fragile', 'close couplings', count(*) FROM (SELECT 1 FROM lineitem WHERE l_discount >= 0.07)""")
def architecture(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    nodes = table(spark, d, "part").selectExpr("IF(p_size % 5 = 0, 'Embedding', IF(p_size % 2 = 0, 'function', 'class')) AS label", "p_size AS community", f"{_PATH} AS path", "p_retailprice > 950 AS is_dead")
    items = table(spark, d, "lineitem")
    flows = items.groupBy(F.expr("'f' || l_suppkey").alias("flow")).agg(F.count("*").alias("steps"))
    queues = table(spark, d, "orders").selectExpr("o_orderpriority AS queue", "o_custkey AS producer", "o_orderstatus AS worker")
    return views.architecture(nodes, items.selectExpr("'coupled_with' AS rel", "l_discount * 10 AS strength"), m.select("community").distinct().selectExpr("community", f"{_NAMES} AS name"), flows, queues)


@query("x_onboard", "WITH t AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS w FROM part WHERE p_size = 7 UNION SELECT 'widget') SELECT p_partkey AS id, p_name AS name FROM part WHERE lower(split_part(p_name, ' ', 1)) IN (SELECT w FROM t WHERE length(w) >= 3) OR lower(split_part(p_name, ' ', 2)) IN (SELECT w FROM t)")
def onboard(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    symbols = p.filter("p_size = 7").select(F.split("p_name", " ")[0].alias("name"), F.lit("src/lib").alias("path"))
    return views.of_area(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "name", views.area_tokens("Widget", symbols))


_MEM = "CASE o_orderkey % 3 WHEN 0 THEN 'src/pay/' || o_custkey % 9 || '|queue-backlog|q' WHEN 1 THEN '|retry-storm|' ELSE 'src/other|x|' END"


@query("x_memory_view", f"""WITH m AS (SELECT o_orderpriority AS project, {_MEM} AS signature, o_orderkey % 11 = 0 AS tagged, o_totalprice / 500000 AS confidence, 'q' || o_orderkey % 4 AS q FROM orders), s AS (SELECT * FROM m WHERE project LIKE '1%' AND (starts_with(signature, 'src/pay') OR tagged))
SELECT 'recurring' AS kind, signature AS key, count(*) AS n FROM s WHERE signature <> '|retry-storm|' GROUP BY 2 HAVING count(*) >= 2 UNION ALL SELECT 'queues', q, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'weak', 'low confidence', count(*) FROM s WHERE confidence < 0.5""".replace("'queues', q", "'queue', q"))
def memory_view(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    m = o.selectExpr("o_orderkey AS id", "o_orderpriority AS project", f"{_MEM} AS signature", "IF(o_orderkey % 11 = 0, array('src/pay'), array('x')) AS tags", "o_totalprice / 500000 AS confidence", "array('q' || o_orderkey % 4) AS queues")
    return views.memory_view(m, "1-URGENT", "src/pay")


@query("x_change_timeline", "SELECT CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place, o_orderkey AS sha, o_orderdate AS \"at\", 2 AS files FROM orders WHERE o_orderpriority LIKE '%URGENT%'")
def change_timeline(spark: SparkSession, d: str) -> DataFrame:
    return views.change_timeline(table(spark, d, "orders").selectExpr("o_orderkey AS sha", "o_orderdate AS at", "array('svc/' || o_orderpriority || '/a.ts', 'b.ts') AS files"), "urgent")


@query("x_line_range_commits", "SELECT DISTINCT p_partkey AS span, l_orderkey AS sha FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity <= p_size + 10 AND l_quantity + 3 >= p_size")
def line_range_commits(spark: SparkSession, d: str) -> DataFrame:
    hunks = table(spark, d, "lineitem").selectExpr("l_orderkey AS sha", "l_partkey AS file", "l_quantity AS start", "l_quantity + 3 AS stop")
    return views.range_commits(hunks, table(spark, d, "part").selectExpr("p_partkey AS span", "p_partkey AS file", "p_size AS lo", "p_size + 10 AS hi"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS flow", "l_linenumber AS step", "'p' || l_partkey AS id")


@query("gr_flows_for", "SELECT DISTINCT 'p' || a.l_partkey AS symbol, a.l_orderkey AS flow, (SELECT list('p' || b.l_partkey ORDER BY b.l_linenumber, 'p' || b.l_partkey) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey) AS steps FROM lineitem a JOIN part ON p_partkey = a.l_partkey WHERE p_size = 9")
def flows_for(spark: SparkSession, d: str) -> DataFrame:
    return views.flows_for(table(spark, d, "part").filter("p_size = 9").selectExpr("'p' || p_partkey AS id"), _steps(spark, d))


@query("x_proc_members", "SELECT 'p' || l_partkey AS id, min(l_orderkey) AS flow FROM lineitem GROUP BY 1")
def proc_members(spark: SparkSession, d: str) -> DataFrame:
    return views.first_process(_steps(spark, d))


@query("x_text_gen", f"""WITH {codegraph._E}, {codegraph._N}, b AS (SELECT id, label, name, CASE WHEN id LIKE 's%' THEN 'sig ' || id END AS signature FROM n), x AS (SELECT source AS id, rel, list_sort(list(DISTINCT name)) AS o FROM e JOIN n ON n.id = target GROUP BY 1, 2), y AS (SELECT target AS id, list_sort(list(DISTINCT name)) AS o FROM e JOIN n ON n.id = source WHERE rel = 'calls' GROUP BY 1)
SELECT id, concat_ws(chr(10), concat_ws(' ', label, name), 'in src/' || id, signature, (SELECT 'calls: ' || array_to_string(o, ', ') FROM x WHERE x.id = b.id AND rel = 'calls'), (SELECT 'called by: ' || array_to_string(o, ', ') FROM y WHERE y.id = b.id), (SELECT 'uses: ' || array_to_string(o, ', ') FROM x WHERE x.id = b.id AND rel = 'uses_type'), CASE WHEN id LIKE 'p%' THEN 'codes: ERR_PAY, ER_' || upper(id) || '_X' END) AS text FROM b""")
def text_gen(spark: SparkSession, d: str) -> DataFrame:
    n = codegraph.nodes(spark, d).selectExpr("id", "label", "name", "'src/' || id AS path", "IF(id LIKE 's%', 'sig ' || id, NULL) AS signature", "IF(id LIKE 'p%', 'raise ERR_PAY or ER_' || upper(id) || '_X, not ABC nor ERR_PAY', NULL) AS content")
    return views.embedding_text(n, codegraph.edges(spark, d))


@query("x_reexport", "SELECT 'alias:index/' || p_size || ':' || p_name AS id, p_name AS name, 'index/' || p_size AS path, 'p' || p_partkey AS target FROM part WHERE p_size % 2 = 0 AND NOT EXISTS (SELECT 1 FROM part x WHERE x.p_name = part.p_name AND x.p_size = part.p_size AND x.p_partkey % 5 = 0) AND p_partkey % 5 <> 0")
def reexport(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    symbols = p.selectExpr("'p' || p_partkey AS id", "p_name AS name", "IF(p_partkey % 5 = 0, 'index/', 'src/') || p_size AS path")
    exports = p.filter("p_size % 2 = 0").selectExpr("'index/' || p_size AS path", "p_name AS name", "'src/' || p_size AS source").distinct()
    return views.reexports(exports, symbols)


@query("x_source_knowledge", "SELECT category, id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS r FROM (SELECT CASE event_type WHEN 'view' THEN 'functions' WHEN 'click' THEN 'functions' WHEN 'error' THEN 'types' END AS category, event_id AS id FROM events)) WHERE category IS NOT NULL AND r <= 5000")
def source_knowledge(spark: SparkSession, d: str) -> DataFrame:
    return views.knowledge(table(spark, d, "events").selectExpr("event_type AS label", "event_id AS id"), {"functions": ["view", "click"], "types": ["error"]})


@query("x_integrations", "SELECT p_brand AS system, list_sort(list(DISTINCT p_type)) AS repos, CAST(count(DISTINCT p_type) AS INTEGER) AS n FROM part WHERE p_size > 5 GROUP BY 1")
def integrations(spark: SparkSession, d: str) -> DataFrame:
    return views.integrations(table(spark, d, "part").selectExpr("p_type AS repo", "IF(p_size > 5, p_brand, NULL) AS system"))


_PACKET = "e AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS inv, o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS priority, o_totalprice AS relevance, CASE WHEN o_orderkey % 4 > 0 THEN 'f' || o_custkey % 20 END AS file FROM orders)"


@query("sort_packet", f"""WITH {_PACKET}, a AS (SELECT inv, 'evidence' AS kind, CAST(id AS VARCHAR) AS id, row_number() OVER (PARTITION BY inv ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, relevance DESC, id) AS place FROM e),
f AS (SELECT inv, 'file' AS kind, file AS id, row_number() OVER (PARTITION BY inv ORDER BY count(*) DESC, max(relevance) DESC, file) AS place FROM e WHERE file IS NOT NULL GROUP BY inv, file) SELECT inv, kind, id, CAST(place AS INTEGER) AS place FROM a WHERE place <= 8 UNION ALL SELECT inv, kind, id, CAST(place AS INTEGER) FROM f WHERE place <= 5""")
def packet(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").selectExpr("CAST(o_orderkey % 5 AS INT) AS inv", "CAST(o_orderkey AS STRING) AS id", "CASE o_orderkey % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS priority", "o_totalprice AS relevance", "IF(o_orderkey % 4 > 0, 'f' || o_custkey % 20, NULL) AS file")
    return views.packet(e, 8, 5)


query.cases("sc_dispatch", "parameters string", [("(order, regionId)", True), ("(region: string)", True), ("(regional: string)", False), ("(tenant_id)", True), ("(x, y)", False), ("(localeCode?: string)", True), ("", False)], views.dispatch)


@query("set_multi_repo", "(SELECT 'docs' AS repo, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE contains(lower(text), 'tion') ORDER BY doc_id LIMIT 30) UNION ALL (SELECT 'pages', CAST(page_id AS VARCHAR) FROM pages WHERE contains(lower(html), 'tion') ORDER BY page_id LIMIT 30)")
def multi_repo(spark: SparkSession, d: str) -> DataFrame:
    frames = {"docs": table(spark, d, "documents").selectExpr("doc_id AS id", "text"), "gone": None, "pages": table(spark, d, "pages").selectExpr("page_id AS id", "html AS text")}
    return views.searched(frames, "text", ["TION"], 30)


def _seconds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t")).agg(F.count("*").alias("n"))


@query("st_bisect", "SELECT t, CAST(floor((sum(n) OVER (ORDER BY t) - 1) / 100) AS BIGINT) AS window FROM (SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, count(*) AS n FROM events GROUP BY 1)".replace("AS window", "AS \"window\""))
def bisect(spark: SparkSession, d: str) -> DataFrame:
    return watch.windows(_seconds(spark, d), 100)


_ISSUES = "i AS (SELECT 'i' || user_id AS id, 't' || user_id AS title, min(ts) AS first_seen, CASE WHEN user_id % 7 <> 0 THEN max(ts) END AS last_seen, count(*) AS n FROM events GROUP BY user_id)"


@query("st_to_event", f"""WITH {_ISSUES} SELECT id || ':' || strftime(last_seen, '%Y-%m-%d %H:%M:%S') || ':' || n || ':' || CASE n % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'open' ELSE 'undefined' END AS event_id, id AS incident_id, title AS fingerprint, CASE WHEN n % 3 = 0 THEN TIMESTAMP '2024-01-30' ELSE last_seen END AS occurred_at,
 CASE WHEN n % 2 = 0 THEN 'fatal' ELSE 'error' END AS severity, CASE WHEN n % 3 = 0 THEN 'resolved' ELSE 'active' END AS state, first_seen AS episode FROM (SELECT id, title, first_seen, date_trunc('second', last_seen) AS last_seen, n FROM i) WHERE last_seen IS NOT NULL""")
def issue_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last"), F.count("*").alias("count"))
    issues = e.selectExpr("'i' || user_id AS id", "'t' || user_id AS title", "first_seen", "IF(user_id % 7 <> 0, CAST(date_trunc('second', last) AS TIMESTAMP_NTZ), NULL) AS last_seen", "count", "CASE count % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'open' END AS status", "CAST(NULL AS TIMESTAMP_NTZ) AS status_changed", "IF(count % 2 = 0, 'fatal', NULL) AS level")
    return watch.issue_events(issues, F.expr(NOW))


@query("st_log_event", """SELECT CASE WHEN event_id % 3 = 0 THEN sha256('["logs","' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","E' || event_id % 5 || '","disk exhausted"]') ELSE 'logs:' || event_id END AS event_id, CASE WHEN event_id % 4 = 0 THEN 'o' || user_id WHEN event_id % 4 = 1 THEN 't' || user_id ELSE 'E' || event_id % 5 END AS incident_id,
 'E' || event_id % 5 || ':' || CASE WHEN event_id % 2 = 0 THEN 'PAY-1' ELSE 'x_y:503' END AS fingerprint, ts AS occurred_at, 'E' || event_id % 5 || CASE WHEN event_id % 3 = 0 THEN ' disk exhausted' ELSE ' slow' END || CASE WHEN event_id % 2 = 0 THEN ' [PAY-1]' ELSE ' [HTTP 503; x_y]' END AS hint,
 CASE WHEN event_id % 3 = 0 THEN 'critical' ELSE 'error' END AS severity, 'active' AS state, CASE WHEN event_id % 4 = 1 THEN 't' || user_id WHEN event_id % 4 = 2 THEN 'r' END AS correlation_id FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)""".replace("WHEN event_id % 4 = 1 THEN 't' || user_id ELSE 'E'", "WHEN event_id % 4 = 1 THEN 't' || user_id WHEN event_id % 4 = 2 THEN 'r' ELSE 'E'"))
def log_events(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "events").selectExpr(
        "'logs' AS index", "IF(event_id % 3 = 0, NULL, CAST(event_id AS STRING)) AS document_id", "CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ) AS ts", "'E' || event_id % 5 AS event_code", "IF(event_id % 3 = 0, 'disk exhausted', 'slow') AS message", "'error' AS level",
        "IF(event_id % 4 = 1, 't' || user_id, NULL) AS trace_id", "IF(event_id % 4 = 2, 'r', NULL) AS request_id", "IF(event_id % 4 = 0, 'o' || user_id, NULL) AS order_id", "IF(event_id % 2 = 0, 'PAY-1', 'no code!') AS error_code", "IF(event_id % 2 = 0, NULL, 'x_y') AS reason", "IF(event_id % 2 = 0, 42, 503) AS http_status",
    )
    return watch.log_events(logs)


@query("st_backpressure", "SELECT o_orderpriority AS route, count(*) FILTER (o_orderstatus <> 'F') AS queued, count(*) FILTER (o_orderstatus <> 'F') < 300 AND o_orderpriority NOT LIKE '3%' AS accepts FROM orders GROUP BY 1 UNION ALL SELECT 'idle', 0, true")
def backpressure(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "orders").selectExpr("o_orderpriority AS route", "IF(o_orderstatus = 'F', 'done', 'queued') AS status")
    usage = jobs.select("route").distinct().selectExpr("route", "IF(route LIKE '3%', 10, 9) AS investigations", "0 AS calls", "10 AS most_investigations", "5 AS most_calls")
    idle = usage.limit(1).selectExpr("'idle' AS route", "0 AS investigations", "0 AS calls", "1 AS most_investigations", "1 AS most_calls")
    return watch.accepting(jobs, usage.union(idle), 300)


@query("st_retry", "SELECT event_id AS id, CASE WHEN event_id % 8 >= 5 THEN 'failed' ELSE 'waiting' END AS status, CASE WHEN event_id % 8 < 5 THEN least(3600, 10 * pow(2, event_id % 8)) END AS wait FROM events")
def retry(spark: SparkSession, d: str) -> DataFrame:
    return watch.retries(table(spark, d, "events").selectExpr("event_id AS id", "event_id % 8 AS attempts"))


@query("st_reconcile", "WITH j AS (SELECT o_orderpriority AS route, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_orderstatus = 'P'), s AS (SELECT *, CASE WHEN route LIKE '1%' THEN 0 WHEN route LIKE '2%' THEN 5 ELSE greatest(n - 3, 0) END AS a FROM j) SELECT route, id, CAST(CASE WHEN a + 5 >= n THEN 0 ELSE a + 5 END AS INTEGER) AS next FROM s WHERE p >= a AND p < a + 5".replace("AS next", 'AS "next"'))
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "orders").selectExpr("o_orderpriority AS route", "o_orderkey AS id", "IF(o_orderstatus = 'P', NULL, o_orderdate) AS resolved_at", "o_orderdate AS seq")
    offsets = jobs.filter("resolved_at IS NULL").groupBy("route").agg(F.count("*").alias("n")).filter("route NOT LIKE '1%'").selectExpr("route", "CAST(IF(route LIKE '2%', 5, greatest(n - 3, 0)) AS INT) AS at")
    return watch.reconcile(jobs, offsets)


@query("st_freshness", "SELECT min(ts) FILTER (event_type <> 'view') AS \"from\", max(ts) FILTER (event_type <> 'view') AS \"to\", ['logs', 'metrics', 'queue'] AS sources, 216.0 AS index_hours, true AS index_stale FROM events")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("CASE event_type WHEN 'view' THEN 'code' WHEN 'error' THEN 'logs' WHEN 'click' THEN 'metrics' ELSE 'queue' END AS source", "ts")
    return watch.freshness(e, F.expr("TIMESTAMP_NTZ '2024-01-21 00:00:00'"), F.expr(NOW))


@query("st_cursor", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-01-29' ELSE ts - INTERVAL 2 MINUTE END AS start, CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-01-30' ELSE least(TIMESTAMP '2024-01-30', ts + INTERVAL 1 HOUR) END AS stop FROM events")
def cursor(spark: SparkSession, d: str) -> DataFrame:
    start, stop = episodes.cursor_window(F.expr(NOW), F.expr("IF(event_id % 5 = 0, NULL, ts)"))
    return table(spark, d, "events").select("event_id", start.alias("start"), stop.alias("stop"))
