"""Queries of rule and flow operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, evidence, flows, rules
from ..session import table
from . import codegraph, investigation, observability
from .common import Registry

query = Registry()


@query("flt_since", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 90) * 60 WHEN 1 THEN (event_id % 90) * 3600 WHEN 2 THEN (event_id % 90) * 86400 ELSE 604800 END AS seconds FROM events")
def since(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("CASE event_id % 4 WHEN 0 THEN event_id % 90 || 'm' WHEN 1 THEN event_id % 90 || 'h' WHEN 2 THEN event_id % 90 || 'd' ELSE 'soon' END")
    return table(spark, d, "events").select("event_id", rules.since_seconds(t).alias("seconds"))


@query("flt_record", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O' ORDER BY 1, 2 LIMIT 5")
def record(spark: SparkSession, d: str) -> DataFrame:
    return rules.record_read(table(spark, d, "orders"), {"o_custkey": 7, "o_orderstatus": "O"}, ["o_orderkey", "o_totalprice"], 5)


@query("flt_refine", f"WITH {investigation._EV} SELECT id FROM ev WHERE (contains(lower(id || ' ' || category), 'queue') OR contains(lower(id || ' ' || category), 'error')) AND NOT contains(lower(id || ' ' || category), 'summary')")
def refine(spark: SparkSession, d: str) -> DataFrame:
    ev = investigation.gather(spark, d).withColumn("title", F.col("id"))
    return rules.focus(ev, ["queue", "error"], ["summary"]).select("id")


@query("flt_files_containing", "SELECT word, path FROM (SELECT word, doc_id AS path, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS r FROM documents, (VALUES ('nation'), ('token'), ('the')) w(word) WHERE regexp_matches(regexp_replace(text, '(?m)^\\s*(?://|#|\\*).*$', '', 'g'), '(^|[^A-Za-z0-9_])' || word || '([^A-Za-z0-9_]|$)')) WHERE r <= 20")
def files_containing(spark: SparkSession, d: str) -> DataFrame:
    return rules.files_containing(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")), ["nation", "token", "the"], 20)


@query("src_redis_role", "SELECT CASE event_type WHEN 'error' THEN 'queue' WHEN 'click' THEN 'lock' WHEN 'view' THEN 'rate-limit' ELSE 'cache' END AS role, count(*) AS n FROM events GROUP BY 1")
def redis_role(spark: SparkSession, d: str) -> DataFrame:
    p = F.expr("CASE event_type WHEN 'error' THEN 'bull' WHEN 'click' THEN 'userlock' WHEN 'view' THEN 'ratelimit' ELSE event_type END").alias("prefix")
    return rules.redis_roles(table(spark, d, "events").groupBy(p).agg(F.count("*").alias("n")))


@query("sc_route", f"WITH {investigation._EV} SELECT * FROM (VALUES (0, 'queue', 'inspect workers and backlog'), (1, 'database', 'check table state'), (2, 'deployment', 'compare the release'), (3, 'logs', 'open the signatures'), (4, 'metrics', 'open the panels')) r(place, category, step) WHERE category IN (SELECT category FROM ev WHERE priority <> 'info')".replace("SELECT * FROM (VALUES", "SELECT place, step FROM (VALUES"))
def route(spark: SparkSession, d: str) -> DataFrame:
    return rules.routes(investigation.gather(spark, d))


@query("sc_missing", f"WITH {investigation._EV} SELECT kind FROM (VALUES ('log'), ('metric'), ('queue-state'), ('redis-key'), ('trace')) w(kind) WHERE kind NOT IN (SELECT kind FROM ev)")
def missing(spark: SparkSession, d: str) -> DataFrame:
    return rules.missing_kinds(investigation.gather(spark, d), ["log", "metric", "queue-state", "redis-key", "trace"])


@query("sc_chains", f"WITH {investigation._EV} SELECT queue, count(*) AS n, least(avg(relevance) + 0.1 * (count(*) - 1), 1) AS strength FROM ev WHERE queue IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def chains(spark: SparkSession, d: str) -> DataFrame:
    return rules.chains(investigation.gather(spark, d))


@query("sc_ceiling", "SELECT event_id, CASE WHEN s < 0.2 THEN 0.6 WHEN s < 0.5 THEN 0.6 + (s - 0.2) / 0.3 * 0.18 WHEN s < 0.85 THEN 0.78 + (s - 0.5) / 0.35 * 0.22 ELSE 1 END AS ceiling FROM (SELECT event_id, least(greatest((event_id % 130 - 10) / 100, 0), 1) AS s FROM events)")
def ceiling(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", evidence.cause_ceiling((F.col("event_id") % 130 - 10) / 100).alias("ceiling"))


_CALLS = "k AS (SELECT * FROM e WHERE rel = 'calls')"


@query("gr_entry_points", f"WITH {codegraph._E}, {codegraph._N}, {_CALLS} SELECT id FROM n WHERE id IN (SELECT source FROM k) AND id NOT IN (SELECT target FROM k)")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    return flows.entry_points(codegraph.nodes(spark, d), codegraph.edges(spark, d))


def _flows(spark: SparkSession, d: str) -> DataFrame:
    return flows.flows(codegraph.edges(spark, d), codegraph._ids(spark, "s1", "s2", "p3"))


@query("gr_flows")
def gr_flows(spark: SparkSession, d: str) -> DataFrame:
    """A node's turn depends on what the nodes before it took, which SQL cannot express; the tests walk it step by step."""
    return _flows(spark, d)


def _near(spark: SparkSession, d: str) -> DataFrame:
    """Flows of one step: every caller with what it calls."""
    calls = codegraph.edges(spark, d).filter("rel = 'calls'")
    return calls.select(F.col("source").alias("entry"), F.col("target").alias("id")).union(calls.select("source", "source")).distinct()


_NEAR = f"WITH {codegraph._E}, {codegraph._N}, fl AS (SELECT source AS entry, target AS id FROM e WHERE rel = 'calls' UNION SELECT source, source FROM e WHERE rel = 'calls')"


@query("gr_flow_kind", _NEAR + " SELECT entry, CASE count(DISTINCT community) WHEN 0 THEN 'unknown' WHEN 1 THEN 'intra' ELSE 'cross' END AS kind FROM fl LEFT JOIN n USING (id) GROUP BY 1")
def flow_kind(spark: SparkSession, d: str) -> DataFrame:
    return flows.flow_kind(_near(spark, d), codegraph.nodes(spark, d))


@query("agg_flow_rank", _NEAR + " SELECT entry, count(DISTINCT id) AS n FROM fl WHERE id LIKE 'p1%' GROUP BY 1")
def flow_rank(spark: SparkSession, d: str) -> DataFrame:
    return flows.flow_rank(_near(spark, d), codegraph.nodes(spark, d).filter("id LIKE 'p1%'").select("id"))


@query("gr_flow_dedupe")
def flow_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return flows.distinct_flows(_flows(spark, d))


#: Parts as functions and methods in turn: label, name, path, class, exported, entry, decorators.
_KINDS = [
    ("function", "plain", "src/a.py", None, False, False, []), ("method", "open", "src/c.py", "Shown", False, False, []), ("method", "_hidden", "src/c.py", "Shown", False, False, []), ("function", "job", "src/a.py", None, False, False, ["app.task"]),
    ("function", "kept", "src/a.py", None, False, False, ["functools.cache"]), ("function", "check", "tests/x.py", None, False, False, []), ("method", "__init__", "src/a.py", "Other", False, False, []), ("function", "begin", "src/a.py", None, False, True, []),
    ("method", "size", "src/a.py", "Other", False, False, ["property"]), ("function", "api", "src/a.py", None, True, False, []), ("method", "run", "src/a.py", "Impl", False, False, []), ("method", "run", "src/a.py", "Runner", False, False, []),
]


@query("gr_dead_code", f"""WITH {codegraph._E}, k AS (SELECT 'p' || p_partkey AS id, p_partkey % 12 AS k FROM part), live AS (SELECT target FROM e LEFT JOIN k ON k.id = e.source WHERE rel = 'calls' AND confidence = 1 AND coalesce(k, 0) <> 5)
SELECT id, CASE k WHEN 0 THEN 'plain' WHEN 2 THEN '_hidden' ELSE 'kept' END AS name FROM k WHERE k IN (0, 2, 4) AND id NOT IN (SELECT target FROM live)
UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 1 AND 's' || s_suppkey NOT IN (SELECT target FROM live) AND 's' || s_suppkey NOT IN (SELECT target FROM e WHERE rel = 'uses_type' AND confidence = 1)""")
def dead_code(spark: SparkSession, d: str) -> DataFrame:
    kinds = spark.createDataFrame([(i, *x) for i, x in enumerate(_KINDS)], "k long, label string, name string, path string, class_name string, exported boolean, entry boolean, decorators array<string>")
    parts = table(spark, d, "part").selectExpr("'p' || p_partkey AS id", "p_partkey % 12 AS k").join(kinds, "k").drop("k").withColumns({"bases": F.array().cast("array<string>"), "protocol": F.lit(False)})
    named = "'class' AS label", "'src/s.py' AS path", "CAST(NULL AS STRING) AS class_name", "false AS entry", "CAST(array() AS array<string>) AS decorators"
    classes = table(spark, d, "supplier").selectExpr("'s' || s_suppkey AS id", "s_name AS name", *named, "false AS exported", "IF(s_suppkey % 3 = 1, array('Enum'), CAST(array() AS array<string>)) AS bases", "false AS protocol")
    more = spark.createDataFrame([("c1", "Shown", True, False), ("c2", "Runner", True, True)], "id string, name string, exported boolean, protocol boolean").selectExpr("*", *named, "CAST(array() AS array<string>) AS bases").withColumn("path", F.lit("src/c.py"))
    sure = codegraph.edges(spark, d).filter("confidence = 1")  # with all the edges nothing is dead
    return flows.dead_code(parts.unionByName(classes).unionByName(more), sure)


@query("gr_begins", f"""WITH {codegraph._E}, k AS (SELECT 'p' || p_partkey AS id, p_partkey % 12 AS k FROM part)
SELECT id FROM k WHERE k IN (2, 4, 8) OR k IN (0, 3, 5, 9) AND id NOT IN (SELECT target FROM e WHERE rel = 'calls')""")
def begins(spark: SparkSession, d: str) -> DataFrame:
    kinds = [("x", "tests/a.py", "python", None, True), ("x", "src/a.py", "python", None, False), ("main", "src/a.py", "python", None, False), ("cli", "src/a.rs", "rust", None, False), ("x", "src/a.py", "python", "@router.get('/')\ndef x(): pass", False), ("x", "src/cli.py", "python", None, False),
             ("handler", "tests/h.ts", "typescript", None, False), ("x", "src/a.ts", "typescript", None, False), ("x", "src/index.ts", "typescript", None, True), ("x", "src/a.ts", "typescript", None, True), ("index", "src/a.go", "go", None, False), ("y", "src/main.rs", "rust", None, False)]
    kinds[0] = ("main", "src/lib.rs", "rust", None, False)
    known = spark.createDataFrame([(i, *x) for i, x in enumerate(kinds)], "k long, name string, path string, language string, content string, exported boolean")
    nodes = table(spark, d, "part").selectExpr("'p' || p_partkey AS id", "p_partkey % 12 AS k", "'function' AS label").join(known, "k")
    return flows.begins(nodes, codegraph.edges(spark, d))


@query("gr_review_risk", f"""WITH {codegraph._E}, {codegraph._N}, c AS (SELECT 'o' || n_regionkey AS change, 'p' || p_partkey AS id, p_size || '.py' AS path FROM part JOIN nation ON p_partkey % 25 = n_nationkey WHERE p_size <= 3),
cp AS (SELECT a || '.py' AS a, a + 1 || '.py' AS b, CASE WHEN a % 2 = 0 THEN 0.4 ELSE 0.6 END AS strength FROM range(0, 60) r(a)), two AS (SELECT a, b FROM cp WHERE strength >= 0.5 UNION SELECT b, a FROM cp WHERE strength >= 0.5),
m AS (SELECT change, count(DISTINCT b) AS missing FROM c JOIN two ON path = a WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.change = c.change AND x.path = b) GROUP BY 1), dp AS (SELECT change, count(DISTINCT source) AS dependents FROM c JOIN e ON target = id AND rel = 'calls' WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.change = c.change AND x.id = source) GROUP BY 1),
en AS (SELECT change, count(DISTINCT id) AS entries FROM c WHERE id IN ('p7', 'p31', 'p32', 'p64') GROUP BY 1), co AS (SELECT change, count(DISTINCT community) AS communities FROM c JOIN n USING (id) GROUP BY 1),
t AS (SELECT change, coalesce(entries, 0) AS entries, coalesce(missing, 0) AS missing, coalesce(dependents, 0) AS dependents, coalesce(communities, 0) AS communities FROM (SELECT DISTINCT change FROM c) LEFT JOIN en USING (change) LEFT JOIN m USING (change) LEFT JOIN dp USING (change) LEFT JOIN co USING (change)),
u AS (SELECT *, CAST(least(entries + missing + dependents // 10 + CASE WHEN communities > 1 THEN 2 ELSE 0 END, 10) AS INTEGER) AS score FROM t) SELECT *, CASE WHEN score <= 3 THEN 'LOW' WHEN score <= 6 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM u""")
def review_risk(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").selectExpr("n_nationkey", "'o' || n_regionkey AS change")
    changes = table(spark, d, "part").filter("p_size <= 3").withColumn("n_nationkey", F.expr("CAST(p_partkey % 25 AS INT)")).join(nation, "n_nationkey").selectExpr("change", "'p' || p_partkey AS id", "p_size || '.py' AS path")
    coupled = spark.range(60).selectExpr("id || '.py' AS a", "id + 1 || '.py' AS b", "IF(id % 2 = 0, 0.4, 0.6) AS strength")
    return flows.review_risk(changes, codegraph.edges(spark, d), codegraph._ids(spark, "p7", "p31", "p32", "p64"), coupled, codegraph.nodes(spark, d))


@query("gr_test_impact", f"WITH RECURSIVE {codegraph._E}, {codegraph._N}, r(id, depth) AS (SELECT 'p1', 0 UNION SELECT source, depth + 1 FROM r JOIN e ON target = id WHERE depth < 4 AND rel = 'calls'), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY 1) SELECT id, depth, depth <= 2 AS direct FROM m WHERE depth > 0 AND id LIKE 's%'")
def test_impact(spark: SparkSession, d: str) -> DataFrame:
    nodes = codegraph.nodes(spark, d).selectExpr("id", "IF(id LIKE 's%', 'tests/a.py', 'src/a.py') AS path")
    return flows.tests_of(codegraph.edges(spark, d), nodes, codegraph._ids(spark, "p1"))


@query("ml_labels", "SELECT project, resolved, count(*) AS n FROM (" + "WITH " + investigation._V + " SELECT * FROM c) GROUP BY 1, 2")
def ml_labels(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.current_verdicts(investigation._verdicts(spark, d)).groupBy("project", "resolved").agg(F.count("*").alias("n"))
