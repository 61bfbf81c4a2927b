"""Queries of source parsers, sinks and change operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, graph
from ..sources import parsers, sinks
from ..session import table
from . import codegraph
from .common import Registry

query = Registry()


@query("src_prom_parse", "SELECT event_type AS kind, CAST(event_id AS DOUBLE) AS t, CASE event_id % 50 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) ELSE value END AS v FROM events")
def prom_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every event as the answer to an instant query; an event without a type, id or value has a null there."""
    v = "CASE event_id % 50 WHEN 0 THEN 'NaN' WHEN 1 THEN '+Inf' ELSE CAST(value AS STRING) END"
    metric = "to_json(map('kind', event_type), map('ignoreNullFields', 'false'))"
    one = "'{\"metric\":' || " + metric + " || ',\"value\":[' || coalesce(CAST(event_id AS STRING), 'null') || ',' || coalesce('\"' || " + v + " || '\"', 'null') || ']}'"
    body = table(spark, d, "events").selectExpr("'{\"status\":\"success\",\"data\":{\"resultType\":\"vector\",\"result\":[' || " + one + " || ']}}' AS body")
    return parsers.metric_samples(body).select(F.col("labels")["kind"].alias("kind"), "t", "v")


@query("src_axiom_tab", "SELECT CAST(r AS INTEGER) AS row, field, value FROM (SELECT event_id % 2 AS r, 'type' AS field, event_type AS value FROM events WHERE event_id < 4 UNION ALL SELECT event_id % 2, 'user', CAST(user_id AS VARCHAR) FROM events WHERE event_id < 4)")
def axiom_tab(spark: SparkSession, d: str) -> DataFrame:
    """The first four events, two in a response by rows and two in one by columns."""
    e = table(spark, d, "events").filter("event_id < 4")
    pair = e.groupBy(F.floor(F.col("event_id") / 2).alias("p")).agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", F.col("user_id").cast("string").alias("u")))).alias("x"))
    rows = F.to_json(F.struct(F.array(F.lit("type"), F.lit("user")).alias("fields"), F.transform("x", lambda v: F.array(v["event_type"], v["u"])).alias("rows")))
    columns = F.to_json(F.struct(F.array(F.lit("type"), F.lit("user")).alias("fields"), F.array(F.col("x.event_type"), F.col("x.u")).alias("columns")))
    return parsers.tabular(pair.select(F.when(F.col("p") == 0, rows).otherwise(columns).alias("body"))).drop("payload")


_SEV = "CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'CRITICAL' WHEN 'signup' THEN '40' WHEN 'view' THEN 'verbose' ELSE 'debug' END"


@query("src_cloudnorm", "SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'fatal' WHEN 'signup' THEN 'warn' WHEN 'view' THEN 'info' ELSE 'debug' END AS level, 'm' || event_id AS message FROM events")
def cloudnorm(spark: SparkSession, d: str) -> DataFrame:
    inner = "CASE WHEN event_id % 2 = 0 THEN '\"m' || event_id || '\"' ELSE '\"{\\\\\"message\\\\\":\\\\\"m' || event_id || '\\\\\"}\"' END"
    body = table(spark, d, "events").selectExpr("event_id", "'{\"TimeGenerated\":\"' || ts || '\",\"severity\":\"' || " + _SEV + " || '\",\"textPayload\":' || " + inner + " || '}' AS body")
    out = parsers.cloud_records(body)
    return out.select(F.substring("message", 2, 20).cast("long").alias("event_id"), "ts", "level", "message")


@query("src_sentry_frame", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a.py:' || event_id WHEN 1 THEN 'lib.py:7' ELSE '' END AS frame FROM events")
def sentry_frame(spark: SparkSession, d: str) -> DataFrame:
    own = "'[{\"filename\":\"a.py\",\"lineno\":' || event_id || ',\"in_app\":true},{\"filename\":\"lib.py\",\"lineno\":7,\"in_app\":false}]'"
    frames = F.expr(f"CASE event_id % 3 WHEN 0 THEN {own} WHEN 1 THEN replace({own}, 'true', 'false') ELSE '[]' END")
    return table(spark, d, "events").select("event_id", parsers.top_frame(frames).alias("frame"))


@query("src_git_log", "SELECT 'h' || o_orderkey AS hash, 'c' || o_custkey AS author, o_orderdate AS at_, o_orderpriority AS title, list('p' || l_partkey ORDER BY l_linenumber, l_partkey) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '2001-07-01' GROUP BY ALL")
def git_log(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '2001-07-01'")
    items = table(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    heads = items.select(F.col("l_orderkey").alias("o_orderkey")).distinct().join(o, "o_orderkey").selectExpr("o_orderkey * 1000 AS base", "0L AS n", "0L AS m", "concat_ws('|', 'commit', 'h' || o_orderkey, 'c' || o_custkey, o_orderdate, o_orderpriority) AS line")
    files = items.selectExpr("l_orderkey * 1000 AS base", "CAST(l_linenumber AS BIGINT) AS n", "l_partkey AS m", "'p' || l_partkey AS line")
    lines = heads.union(files).selectExpr("named_struct('base', base, 'n', n, 'm', m) AS seq", "line")
    return parsers.git_log(lines).withColumnRenamed("at", "at_")


@query("prj_lognorm", "SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' ELSE 'info' END AS level, 'm' || event_id AS message, event_type AS code, 's' || user_id AS service, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def lognorm(spark: SparkSession, d: str) -> DataFrame:
    k = "get_json_object(props, '$.k')"
    pino = "'{\"time\":\"' || ts || '\",\"level\":' || CASE event_type WHEN 'error' THEN 50 WHEN 'click' THEN 45 ELSE 30 END || ',\"msg\":\"m' || event_id || '\",\"code\":\"' || event_type || '\",\"service\":\"s' || user_id || '\",\"k\":' || " + k + " || '}'"
    ecs = "'{\"@timestamp\":\"' || ts || '\",\"log\":{\"level\":\"' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'warning' ELSE 'odd' END || '\"},\"message\":\"m' || event_id || '\",\"event\":{\"code\":\"' || event_type || '\"},\"service\":{\"name\":\"s' || user_id || '\"},\"k\":\"' || " + k + " || '\"}'"
    out = parsers.log_documents(table(spark, d, "events").selectExpr(f"IF(event_id % 2 = 0, {pino}, {ecs}) AS body"))
    return out.select(F.substring("message", 2, 20).cast("long").alias("event_id"), "ts", "level", "message", "code", "service", F.col("context")["k"].cast("int").alias("k"))


@query("sink_graph_upsert", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -c_custkey - 1, c_acctbal FROM customer")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    late = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    twice = late.selectExpr("o_orderkey", "o_totalprice + 1 AS o_totalprice", "1 AS seq").union(late.selectExpr("o_orderkey", "o_totalprice + 2", "2"))
    new = table(spark, d, "customer").selectExpr("-c_custkey - 1 AS o_orderkey", "c_acctbal AS o_totalprice", "1 AS seq")
    return sinks.upserted(base, twice.union(new), ["o_orderkey"])


@query("sink_flags", "SELECT c_custkey AS id, c_name AS name, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS busy FROM customer")
def flags(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "true AS busy")
    return sinks.flagged(nodes, table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), "busy").select("id", "name", "busy")


@query("sink_jsonl")
def jsonl(spark: SparkSession, d: str) -> DataFrame:
    return sinks.json_lines(table(spark, d, "labels"), "doc_id")


@query("agg_contributors", "SELECT lower('C' || o_custkey % 40) AS who, count(*) AS n, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, max_by('c' || o_custkey, (o_orderdate, o_orderkey)) AS name FROM orders GROUP BY 1")
def contributors(spark: SparkSession, d: str) -> DataFrame:
    return changes.contributors(table(spark, d, "orders").selectExpr("'C' || o_custkey % 40 AS email", "'c' || o_custkey AS name", "o_orderdate AS at", "o_orderkey AS hash"))


@query("agg_timeline_owner", "SELECT o_orderpriority AS area, min_by(w, (-n, w)) AS owner, max(n) / sum(n) AS share, least(max(n) / sum(n), 0.95) AS confidence FROM (SELECT o_orderpriority, 'c' || o_custkey % 5 AS w, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def timeline_owner(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("area"), F.expr("'c' || o_custkey % 5").alias("who")).agg(F.count("*").alias("n"))
    return changes.owner(counts, "area")


@query("agg_what_changed", "SELECT count(*) FILTER (k NOT IN (0, 1, 2)) AS runtime, count(*) FILTER (k = 0) AS test, count(*) FILTER (k = 1) AS docs, count(*) FILTER (k = 2) AS config FROM (SELECT page_id % 5 AS k FROM pages)")
def what_changed(spark: SparkSession, d: str) -> DataFrame:
    return changes.kinds_changed(table(spark, d, "pages").selectExpr("CASE page_id % 5 WHEN 0 THEN 'tests/x.py' WHEN 1 THEN 'readme.md' WHEN 2 THEN 'package.json' WHEN 3 THEN 'vendor/x.c' ELSE 'src/x.py' END AS path"))


@query("x_git_bounded", "SELECT * FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place, o_totalprice AS size, sum(o_totalprice) OVER (ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders) WHERE running <= 5000000 AND place <= 200")
def git_bounded(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200)
    return changes.within_budget(o.selectExpr("o_orderkey AS id", "CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS place", "o_totalprice AS size"), 5_000_000, 200)


OWNERS = """
# everything, then the more special
*               @all
/LARGE/         @large @big
*ONOMY/7     @seven
SMALL*/**/1*    @ones
**/13
docs/           @docs
"""


@query("x_codeowners", """SELECT path, CASE WHEN regexp_matches(path, '^SMALL[^/]*/(.+/)?1[^/]*$') THEN ['@ones'] WHEN regexp_matches(path, '^[^/]*ONOMY/7$') THEN ['@seven'] WHEN starts_with(path, 'LARGE/') THEN ['@large', '@big'] ELSE ['@all'] END AS owners,
 CASE WHEN regexp_matches(path, '^SMALL[^/]*/(.+/)?1[^/]*$') THEN 'SMALL*/**/1*' WHEN regexp_matches(path, '^[^/]*ONOMY/7$') THEN '*ONOMY/7' WHEN starts_with(path, 'LARGE/') THEN '/LARGE/' ELSE '*' END AS pattern
 FROM (SELECT p_type || '/' || p_size || '/' || p_partkey AS path FROM part UNION ALL SELECT p_type || '/' || p_size FROM part)""")
def codeowners(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    paths = p.selectExpr("p_type || '/' || p_size || '/' || p_partkey AS path").union(p.selectExpr("p_type || '/' || p_size"))
    return changes.code_owners(paths, OWNERS)


@query("agg_per_segment", "SELECT event_type AS base, count(DISTINCT user_id) AS segments FROM events WHERE user_id % 3 = 0 GROUP BY 1 HAVING count(DISTINCT user_id) >= 2")
def per_segment(spark: SparkSession, d: str) -> DataFrame:
    return changes.per_segment(table(spark, d, "events").selectExpr("IF(user_id % 3 = 0, event_type || ':' || user_id, event_type) AS queue"))


@query("x_report_list", "SELECT o_orderkey AS id, o_orderpriority AS project, o_orderdate AS at_ FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 15")
def report_list(spark: SparkSession, d: str) -> DataFrame:
    return changes.report_page(table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS project", "o_orderdate AS at"), "1-URGENT", 15).withColumnRenamed("at", "at_")


@query("win_topk_per_key", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return changes.top_per_key(rows, "l_suppkey", [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)


@query("x_name_index", "SELECT p_name AS name, list(p_partkey ORDER BY p_partkey) AS ids FROM part GROUP BY 1")
def name_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.array_sort(F.collect_list("p_partkey")).alias("ids"))


@query("x_file_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def file_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))


@query("agg_cross_proc", f"WITH {codegraph._E}, {codegraph._N}, m AS (SELECT DISTINCT source AS process, community FROM e JOIN n ON n.id = e.target WHERE rel = 'calls') SELECT process, list_sort(list(community)) AS communities FROM m GROUP BY 1 HAVING count(*) > 1")
def cross_proc(spark: SparkSession, d: str) -> DataFrame:
    e, n = codegraph.edges(spark, d), codegraph.nodes(spark, d)
    rows = e.filter("rel = 'calls'").join(n.select(F.col("id").alias("target"), "community"), "target")
    return rows.groupBy(F.col("source").alias("process")).agg(F.array_sort(F.collect_set("community")).alias("communities")).filter("size(communities) > 1")


@query("gr_dirty", f"WITH {codegraph._E}, dirty AS (SELECT unnest(['s1', 'p5']) AS id) SELECT id FROM dirty UNION SELECT target FROM e WHERE rel = 'calls' AND source IN (SELECT id FROM dirty) UNION SELECT source FROM e WHERE rel = 'calls' AND target IN (SELECT id FROM dirty)")
def dirty(spark: SparkSession, d: str) -> DataFrame:
    ids = codegraph._ids(spark, "s1", "p5")
    return ids.union(graph.edge_neighbors(codegraph.edges(spark, d).filter("rel = 'calls'"), ids).select("id")).distinct()
