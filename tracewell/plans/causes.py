"""Queries of hypotheses, candidate causes, findings and the evidence graph, over an investigation for each region.

Every investigation has the items of one list but for each fourth, so each region misses others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import causes
from ..session import table
from .common import Registry, literal

query = Registry()

SCHEMA = "nr long, id string, kind string, queue string, signal string, direct boolean, level string, ratio double, message string, n long, code string, producer string, worker string, services array<string>, collection string, symbol string, file string, flow string, steps array<string>"
COLUMNS = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]


def _item(id_: str, kind: str, **more) -> dict:
    return {"id": id_, "kind": kind} | more


ITEMS = [
    _item("c1", "commit", signal="range", n=4), _item("c2", "commit", signal="per-commit", n=1), _item("l1", "log", signal="seed", direct=True, level="error", ratio=3.0, message="retrying charge", n=1000, code="E_CHARGE", services=["api", "pay"]),
    _item("l2", "log", direct=False, level="error", ratio=9.0, message="retry storm elsewhere", n=50, code="E_OTHER", services=["web"]), _item("l3", "log", signal="callee", direct=True, level="warn", ratio=2.0, message="attempt 3 failed: ECONNREFUSED", n=20, code="W_RETRY", services=[]),
    _item("l4", "log", signal="hint", direct=True, level=None, ratio=1.0, message="slow page", n=10, code="W_SLOW"), _item("q1", "queue-state", queue="mail", signal="backlog"), _item("q2", "queue-state", queue="mail", signal="worker-starvation"),
    _item("q3", "queue-state", queue="ship", signal="backlog"), _item("q4", "queue-state", queue="ship", signal="failed-breakdown", message="connection refused", direct=False, n=30), _item("e1", "queue-edge", queue="mail", producer="place", worker="send"),
    _item("e2", "queue-edge", queue="ship", producer="place", worker=None), _item("m1", "metric", signal="latency", services=["api"]), _item("m2", "metric", queue="ship", signal="queue-growth"), _item("m3", "metric", signal="bimodal-population"),
    _item("m4", "metric", signal="error-rate-change", services=["pay"]), _item("s1", "state", signal="anomaly", collection="orders"), _item("s2", "state", signal="legacy", collection="carts"), _item("s3", "state", signal="stale", collection="users"),
    _item("d1", "duration"), _item("y1", "symbol", symbol="chargeCard", file="src/pay.ts"), _item("y2", "symbol", symbol="", file="src/none.ts"), _item("f1", "flow", flow="checkout", steps=["place", "chargeCard", ""]), _item("g1", "config-change"), _item("i1", "impact"),
]
#: Facts by region: queues, change evidence, relevance, focus, maintenance, affected, seed and impact evidence, data flow, structural question, vague, benign, seed score, low confidence.
FACTS_SCHEMA = "inv int, queues array<string>, changed string, change_relevant boolean, focus int, maintenance boolean, affected int, seed string, impact string, data_flow double, source_impact boolean, vague boolean, benign boolean, seed_score double, low_confidence boolean"
FACTS = [
    (0, ["mail", "ship"], "c1", True, 3, False, 5, "y1", "i1", 0.2, False, False, False, 0.9, False), (1, ["mail"], "c1", True, 20, False, 2, "y1", "i1", None, False, False, None, None, False),
    (2, [], "c1", False, None, False, 9, "y1", None, None, False, True, False, 0.7, True), (3, ["ship", "none"], "c1", True, 7, True, 40, "y1", "i1", 0.18, True, False, False, 0.2, False), (4, ["mail", "ship"], None, None, None, None, 0, None, None, None, None, True, True, None, None),
]


def _rows(rows: list[tuple], names: list[str]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ") v(" + ", ".join(names) + ")"


_EV = f"""ev AS (SELECT r_regionkey AS inv, v.* FROM region, {_rows([tuple({"nr": i, **x}.get(c) for c in COLUMNS) for i, x in enumerate(ITEMS)], COLUMNS)} WHERE (nr + r_regionkey) % 4 <> 0),
facts AS (SELECT * FROM {_rows(FACTS, [x.strip().split(" ")[0] for x in FACTS_SCHEMA.split(",")])})"""


def items(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([tuple({"nr": i, **x}.get(c) for c in COLUMNS) for i, x in enumerate(ITEMS)], SCHEMA)
    spots = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("inv"))
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("inv"))
    return spots.join(regions, "inv").filter("(nr + inv) % 4 <> 0").withColumn("seq", F.col("nr"))


def facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FACTS, FACTS_SCHEMA)


_LIST = lambda test: f"list_sort(coalesce((SELECT list(id) FROM ev WHERE ev.inv = f.inv AND {test}), []))"
_RETRY = "kind = 'log' AND ratio >= 2 AND direct AND regexp_matches(message, '(?i)retry|attempt')"
_LATENCY = "kind = 'metric' AND signal IN ('latency', 'error-rate-change')"
_HYP = f"""hyp AS (
 SELECT inv, 'deployment-regression' AS category, NULL AS queue, 0 AS seq, CASE WHEN len(x) = 0 OR NOT coalesce(change_relevant, true) THEN 0.15 WHEN coalesce(focus, 0) > 14 THEN 0.25 WHEN vague THEN 0.3 ELSE 0.5 END AS prior,
  CASE WHEN coalesce(change_relevant, true) AND coalesce(focus, 0) <= 14 AND NOT vague THEN x ELSE [] END AS supports, [] AS contradicts FROM (SELECT f.*, {_LIST("id = 'c1'")} AS x FROM facts f)
 UNION ALL SELECT inv, 'queue-backlog', queue, 1, CASE WHEN len(x) > 0 THEN 0.7 ELSE 0.35 END, x, [] FROM (SELECT f.inv, f.queue, {_LIST("queue = f.queue AND signal = 'backlog'")} AS x FROM (SELECT inv, unnest(queues) AS queue FROM facts) f)
 UNION ALL SELECT inv, 'worker-slowdown', queue, 2, CASE WHEN len(x) > 0 THEN 0.55 ELSE 0.3 END, x, [] FROM (SELECT f.inv, f.queue, {_LIST("queue = f.queue AND signal IN ('worker-starvation', 'queue-growth')")} AS x FROM (SELECT inv, unnest(queues) AS queue FROM facts) f)
 UNION ALL SELECT inv, 'external-api-latency', NULL, 3, CASE WHEN len(x) > 0 THEN 0.55 ELSE 0.2 END, x, [] FROM (SELECT f.*, {_LIST(_LATENCY)} AS x FROM facts f)
 UNION ALL SELECT inv, 'retry-storm', NULL, 4, CASE WHEN len(x) > 0 THEN 0.35 ELSE 0.15 END, x, y FROM (SELECT f.*, {_LIST(f"({_RETRY} OR signal = 'backlog')")} AS x, {_LIST("signal = 'worker-starvation'")} AS y FROM facts f)
 UNION ALL SELECT inv, 'infrastructure', NULL, 5, CASE WHEN len(x) > 0 THEN 0.35 ELSE 0.15 END, x, [] FROM (SELECT f.*, {_LIST(f"(id = 's1' OR signal = 'worker-starvation' OR {_LATENCY})")} AS x FROM facts f)
 UNION ALL SELECT inv, 'benign-variance', NULL, 6, 0.1, x, y FROM (SELECT f.*, {_LIST("id IN ('d1', 'm3')")} AS x, {_LIST("kind = 'log' AND direct AND level = 'error'")} AS y FROM facts f) WHERE len(x) > 0 OR coalesce(benign, false))"""


@query("sc_hypotheses", f"WITH {_EV}, {_HYP} SELECT inv, concat_ws(':', category, queue) AS id, category, queue, CAST(prior AS DOUBLE) AS prior, supports, contradicts, seq FROM hyp")
def hypotheses(spark: SparkSession, d: str) -> DataFrame:
    return causes.hypotheses(items(spark, d), facts(spark))


QUEUES = [(i, q, w, a) for i in range(5) for q, w, a in (("mail", 12 + 400 * i, i), ("ship", 101 + i, 2), ("idle", 9, 0))]
_QUEUES = f"q AS (SELECT * FROM {_rows(QUEUES, ['inv', 'queue', 'waiting', 'active'])})"
_HITS = "hits AS (SELECT inv, count(*) AS hits FROM ev WHERE kind = 'queue-edge' GROUP BY 1)"
_TOUCHED = "CASE WHEN focus IS NULL THEN 0.18 WHEN focus <= 4 THEN 0.45 WHEN focus <= 8 THEN 0.38 WHEN focus <= 14 THEN 0.3 ELSE 0.2 END"
_CAUSES = f"""fx AS (SELECT f.*, CASE WHEN h.hits > 0 THEN 0.05 ELSE 0 END AS bonus FROM facts f LEFT JOIN hits h USING (inv)),
lead AS (SELECT * FROM ev WHERE signal IN ('seed', 'callee') QUALIFY row_number() OVER (PARTITION BY inv ORDER BY signal = 'seed' DESC) = 1),
cause AS (
 SELECT f.inv, 'queue-backlog:' || f.queue AS id, 'queue-backlog' AS category, CASE WHEN waiting >= 10 AND active = 0 THEN 0.45 ELSE 0.45 + least(waiting / 5000, 0.2) END AS base, {_LIST("kind = 'queue-state' AND queue = f.queue")} AS ids FROM q f WHERE waiting >= 10 AND active = 0 OR waiting > 100
 UNION ALL SELECT f.inv, 'queue-path:' || f.queue, 'queue-path', 0.35, list_filter([f.id, x.impact], lambda i: i IS NOT NULL) FROM ev f JOIN facts x USING (inv) WHERE kind = 'queue-edge'
 UNION ALL SELECT inv, 'deployment-regression', 'deployment-regression', (CASE WHEN change_relevant THEN {_TOUCHED} ELSE 0.18 END + bonus) * CASE WHEN change_relevant AND maintenance THEN 0.5 ELSE 1 END, [changed, seed] FROM fx WHERE changed IS NOT NULL AND NOT source_impact
 UNION ALL SELECT inv, 'blast-radius', 'blast-radius', 0.15 + bonus, [impact, seed] FROM fx WHERE affected >= 3 AND impact IS NOT NULL
 UNION ALL SELECT inv, 'seed-data-flow', 'data-flow', data_flow, [seed] FROM fx WHERE data_flow IS NOT NULL AND NOT source_impact
 UNION ALL SELECT f.inv, 'seed-emitted-error', 'error-correlation', CASE WHEN l.level = 'error' THEN 0.6 ELSE 0.42 END + least(0.025 * log10(l.n), 0.1) - CASE WHEN l.signal = 'callee' THEN 0.18 ELSE 0 END, list_append({_LIST("signal IN ('seed', 'callee')")}, f.seed) FROM facts f JOIN lead l USING (inv) WHERE f.seed IS NOT NULL
 UNION ALL SELECT inv, 'hint-matched-signal', 'error-correlation', 0.56 + least(0.03 * log10(n), 0.1), [id] FROM ev WHERE signal = 'hint' AND inv NOT IN (SELECT inv FROM lead)
 UNION ALL SELECT f.inv, 'error-correlation', 'error-correlation', 0.3, {_LIST("kind = 'log' AND direct")}[1:3] FROM hits f WHERE len({_LIST("kind = 'log' AND direct")}) > 0
 UNION ALL SELECT f.inv, 'dependency-failure', 'infrastructure', 0.5, {_LIST("kind = 'log' AND direct")}[1:3] FROM ev f WHERE id = 'l3'
 UNION ALL SELECT f.inv, 'dependency-failure', 'infrastructure', 0.34, ['q4'] FROM ev f WHERE id = 'q4' AND inv NOT IN (SELECT inv FROM ev WHERE id = 'l3')
 UNION ALL SELECT f.inv, 'data-state-anomaly', 'data-state-anomaly', 0.22, {_LIST("id IN ('s1', 's3')")} FROM facts f WHERE len({_LIST("id IN ('s1', 's3')")}) > 0
 UNION ALL SELECT f.inv, 'metric-latency', 'external-api-latency', 0.45, {_LIST(_LATENCY)} FROM facts f WHERE len({_LIST(_LATENCY)}) > 0
 UNION ALL SELECT f.inv, 'metric-queue-growth', 'queue-backlog', 0.4, ['m2'] FROM ev f WHERE id = 'm2')"""


@query("sc_cause_inputs", f"WITH {_EV}, {_QUEUES}, {_HITS}, {_CAUSES} SELECT inv, id, category, CAST(base AS DOUBLE) AS base, ids FROM cause")
def cause_inputs(spark: SparkSession, d: str) -> DataFrame:
    return causes.cause_inputs(items(spark, d), spark.createDataFrame(QUEUES, "inv int, queue string, waiting int, active int"), facts(spark))


_FIND = f"""fin AS (SELECT inv, 'seed' AS finding, 'observation' AS kind, round(CASE WHEN low_confidence THEN least(coalesce(seed_score, 0.3), 0.4) ELSE least(greatest(coalesce(seed_score, 0.75), 0.5), 0.95) END, 2) AS confidence, [seed] AS ids FROM facts WHERE seed IS NOT NULL
 UNION ALL SELECT inv, 'flows', 'observation', 0.6, ['f1'] FROM ev WHERE id = 'f1' UNION ALL SELECT inv, 'blast-radius', 'observation', 0.4 + least(affected, 20) / 40, [impact] FROM facts WHERE affected > 0 AND impact IS NOT NULL
 UNION ALL SELECT f.inv, 'commits', 'observation', 0.3 + sum(n) / 20, [min(id)] FROM ev f WHERE kind = 'commit' GROUP BY 1 UNION ALL SELECT inv, 'config-change', 'observation', 0.4, ['g1'] FROM ev WHERE id = 'g1'
 UNION ALL SELECT inv, 'queue:' || queue, 'correlation', 0.7, [id] FROM ev WHERE kind = 'queue-edge')"""


@query("sc_findings", f"WITH {_EV}, {_FIND} SELECT inv, finding, kind, round(confidence, 3) AS confidence, ids FROM fin")
def findings(spark: SparkSession, d: str) -> DataFrame:
    return causes.findings(items(spark, d), facts(spark))


@query("sc_f7_uncertainty", f"WITH {_EV}, {_QUEUES}, {_HITS}, {_CAUSES}, u(kind, confidence, eid) AS (VALUES ('correlation', 0.3, 'c1'), ('correlation', 0.55, 'l1'), ('hypothesis', 0.7, 'q1'), ('observation', 0.1, 'm1')) SELECT inv, id, round(-(0.6 - max(u.confidence)) * 0.1, 3) AS delta FROM (SELECT inv, id, unnest(ids) AS eid FROM cause) x JOIN u USING (eid) WHERE kind <> 'observation' GROUP BY 1, 2 HAVING max(u.confidence) < 0.6")
def uncertainty(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, k, c, [e]) for i in range(5) for k, c, e in (("correlation", 0.3, "c1"), ("correlation", 0.55, "l1"), ("hypothesis", 0.7, "q1"), ("observation", 0.1, "m1"))]
    return causes.uncertainty(cause_inputs(spark, d), spark.createDataFrame(rows, "inv int, kind string, confidence double, ids array<string>"))


_NODES = """seen(inv, id, node, type) AS (SELECT inv, id, 'ev:' || id, 'evidence' FROM ev UNION ALL SELECT inv, id, 'queue:' || queue, 'queue' FROM ev WHERE kind IN ('queue-edge', 'queue-state') UNION ALL SELECT inv, id, 'service:' || producer, 'service' FROM ev WHERE producer IS NOT NULL
 UNION ALL SELECT inv, id, 'worker:' || worker, 'worker' FROM ev WHERE worker IS NOT NULL UNION ALL SELECT inv, id, 'collection:' || collection, 'collection' FROM ev WHERE collection IS NOT NULL UNION ALL SELECT inv, id, 'deployment:' || id, 'deployment' FROM ev WHERE kind = 'commit'
 UNION ALL SELECT inv, id, 'symbol:' || symbol, 'symbol' FROM ev WHERE symbol <> '' UNION ALL SELECT inv, id, 'file:' || file, 'file' FROM ev WHERE symbol <> '' UNION ALL SELECT inv, id, 'flow:' || flow, 'flow' FROM ev WHERE flow IS NOT NULL
 UNION ALL SELECT inv, id, 'service:' || unnest(services), 'service' FROM ev UNION ALL SELECT inv, NULL, 'symbol:' || s, 'symbol' FROM (SELECT inv, unnest(steps) AS s FROM ev) WHERE s <> ''),
nodes AS (SELECT inv, node, type, list_sort(coalesce(list(DISTINCT id) FILTER (id IS NOT NULL), [])) AS ids FROM seen GROUP BY 1, 2, 3)"""


@query("gr_build", f"WITH {_EV}, {_NODES} SELECT * FROM nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return causes.evidence_graph(items(spark, d))[0]


@query("gr_build_edges", f"""WITH {_EV} SELECT inv, source, type, target, list_sort(list(DISTINCT id)) AS ids FROM (
 SELECT inv, id, 'ev:' || id AS source, 'observed_in' AS type, unnest(list_filter([CASE WHEN kind IN ('queue-edge', 'queue-state') THEN 'queue:' || queue END, 'collection:' || collection, CASE WHEN kind = 'commit' THEN 'deployment:' || id END, CASE WHEN symbol <> '' THEN 'symbol:' || symbol END, 'flow:' || flow], lambda x: x IS NOT NULL)) AS target FROM ev
 UNION ALL SELECT inv, id, 'ev:' || id, CASE kind WHEN 'metric' THEN 'metric_from' ELSE 'observed_in' END, 'service:' || unnest(services) FROM ev UNION ALL SELECT inv, id, 'service:' || producer, 'emits', 'queue:' || queue FROM ev WHERE producer IS NOT NULL
 UNION ALL SELECT inv, id, 'queue:' || queue, 'consumes', 'worker:' || worker FROM ev WHERE worker IS NOT NULL UNION ALL SELECT inv, id, 'symbol:' || symbol, 'in_file', 'file:' || file FROM ev WHERE symbol <> ''
 UNION ALL SELECT inv, id, 'symbol:' || s, 'symbol_in_flow', 'flow:' || flow FROM (SELECT inv, id, flow, unnest(steps) AS s FROM ev) WHERE s <> '') GROUP BY 1, 2, 3, 4""")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return causes.evidence_graph(items(spark, d))[1]


@query("sc_f9_context", f"WITH {_EV}, {_QUEUES}, {_HITS}, {_CAUSES} SELECT DISTINCT inv, id, 0.04 AS delta FROM (SELECT inv, id, unnest(ids) AS eid FROM cause) JOIN (SELECT inv, id AS eid FROM ev WHERE list_contains(services, 'api')) USING (inv, eid)")
def context(spark: SparkSession, d: str) -> DataFrame:
    nodes = graph_nodes(spark, d).withColumn("implicated", F.col("type") == "service")
    return causes.context(cause_inputs(spark, d), nodes, "api")


@query("sc_f10_history", f"WITH {_EV}, {_QUEUES}, {_HITS}, {_CAUSES}, {_NODES}, p(node, n) AS (VALUES ('symbol:chargeCard', 2), ('file:src/pay.ts', 1), ('symbol:place', 0), ('service:api', 9)) SELECT inv, x.id, round(least(count(DISTINCT node) * 0.04, 0.1), 3) AS delta FROM (SELECT inv, id, unnest(ids) AS eid FROM cause) x JOIN (SELECT inv, node, unnest(ids) AS eid FROM nodes JOIN p USING (node) WHERE type IN ('symbol', 'file') AND n > 0) USING (inv, eid) GROUP BY 1, 2")
def history(spark: SparkSession, d: str) -> DataFrame:
    prior = spark.createDataFrame([("symbol:chargeCard", 2), ("file:src/pay.ts", 1), ("symbol:place", 0), ("service:api", 9)], "node string, n int")
    return causes.history(cause_inputs(spark, d), graph_nodes(spark, d), prior)


@query("sort_headline", f"""WITH {_EV}, {_QUEUES}, {_HITS}, {_CAUSES}, r AS (SELECT *, row_number() OVER (PARTITION BY inv ORDER BY id) AS place, len(list_filter(ids, lambda i: i IN ('y1', 'l1'))) > 0 AS l FROM cause)
SELECT inv, (SELECT id FROM r WHERE r.inv = f.inv ORDER BY base DESC, place LIMIT 1) AS top, (SELECT id FROM r WHERE r.inv = f.inv AND base >= 0.2 ORDER BY l DESC, base DESC, place LIMIT 1) AS headline, coalesce((SELECT bool_or(l) FROM r WHERE r.inv = f.inv AND base >= 0.2), false) AS linked FROM facts f""")
def headline(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    ranked = cause_inputs(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("inv").orderBy("id"))).withColumnRenamed("base", "score")
    linked = items(spark, d).select("inv", F.col("id").alias("eid")).filter("eid IN ('y1', 'l1')").union(facts(spark).selectExpr("inv", "'y1'")).distinct()
    return causes.headline(ranked, linked)


query.cases("fn_noise_commit", "author string, subject string", [
    ("dependabot[bot]", "x", True), ("Ann", "Bump lodash from 1 to 2", True), ("Ann", "Merge branch 'x'", True), ("Ann", "chore(release): 1.2", True), ("Ann", "docs(api): fix", True), ("Ann", "style: tabs", True), ("Ann", "run prettier", True),
    ("Ann", "update readme", True), ("Ann", "update readme endpoint", False), ("Ann", "fix: charge twice", False), ("Ann", "chore(deps-dev): x", True), ("renovate", "y", True), ("Ann", "merged orders feature", False), ("Ann", "clean up the format of logs", True), ("Ann", "test orders", False),
], causes.noise_commit)


@query("x_regression_focus", "WITH c AS (SELECT o_orderkey % 20 + 1 AS files, o_orderpriority AS p FROM orders WHERE o_custkey % 5 = 3 AND o_orderpriority NOT LIKE '5%' AND o_orderstatus <> 'P') SELECT min(files) AS focus, bool_and(p LIKE '4%') AS maintenance, CASE WHEN min(files) <= 4 THEN 0.45 WHEN min(files) <= 8 THEN 0.38 WHEN min(files) <= 14 THEN 0.3 ELSE 0.2 END AS score FROM c")
def regression_focus(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits: the customer names a file, the priority the subject, bots write the pending ones."""
    subject = "CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN 'docs: readme' WHEN '4' THEN 'fix typo in charge' ELSE 'change charge' END AS subject"
    files = "transform(sequence(0, CAST(o_orderkey % 20 AS INT)), i -> IF(i = 0, concat('pay', o_custkey % 5, '.ts'), concat('lib/x', i, '.ts'))) AS files"
    commits = table(spark, d, "orders").selectExpr("IF(o_orderstatus = 'P', 'renovate', 'Ann') AS author", subject, files)
    return causes.regression_focus(commits, "src/pay3.ts")
