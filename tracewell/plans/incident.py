"""An investigation end to end on the driver tables: seeds, data flow, hypotheses, causes, chains and findings, each from the one before.

Stand-ins: each document is a symbol with a source text made around its own text; it calls the symbols of half and a third of its number.
Orders are commits (the customer names the file), their priorities queues; events are logs; the newest twenty commits mark files as changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import detail
from ..operators import causes, chains, dataflow, evidence, graph, rules
from ..session import cut_lineage, table
from ..streaming import polling, watcher
from . import investigation
from . import observability as obs
from .common import Registry, literal

query = Registry()

_NAME = "CASE {i} % 3 WHEN 0 THEN 'save' WHEN 1 THEN 'load' ELSE 'task' END || {i}"
#: Source texts by the symbol's number modulo 16; {h} is the name of the symbol of half its number.
BODIES = [
    "'setInterval(run, ' || n_chars || ')'", "'schedule(\"*/5 * * * *\", run)'", "'start({ pollInterval: ' || (n_chars + 10) || ' })'", "'start({ pollInterval: config.every, tickMs })'",
    "'db.query(\"SELECT a FROM t WHERE code = $1\", [x])'", "'db.query(\"SELECT a FROM t WHERE note LIKE b AND code = $1\")'", "'users.findOne({ email: x })'", "'state.items.push(x)' || chr(10) || 'state.n === ' || n_chars",
    "'state.total = ' || n_chars", "'if (cache.hit === 2) cache.miss = 1'", "'await ready()' || chr(10) || '  ' || {h} || '(x)' || chr(10) || 'done()'", "'if (retryCount > ' || (n_chars % 7) || ') stop()'", "'if (shallowEqual(a, b)) return'",
    "'if (i < 10 && idx > 3 && size > 9 && maxTries >= 5) go()'", "'/* setInterval(run, 5000) */ // WHERE a = $1 ' || chr(10) || ' nothing here'", "''",
]
_BODY = "CASE doc_id % 16 " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(BODIES)) + " END || CASE WHEN doc_id % 16 = 15 THEN 'return 1' WHEN doc_id % 2 = 0 THEN chr(10) || coalesce(text, '') ELSE chr(10) || '/* ' || coalesce(text, '') || ' */' END"
_BODY = _BODY.replace("{h}", f"({_NAME.format(i='@half')})")
_SYMBOL = ["'function:' || doc_id AS id", f"{_NAME.format(i='doc_id')} AS name", "'src/m' || doc_id % 40 || '.ts' AS file", "CASE WHEN doc_id % 6 = 2 THEN 'state reducer' ELSE 'plain' END AS signature"]


def symbols(spark: SparkSession, d: str) -> DataFrame:
    body = _BODY.replace("@half", "CAST(floor(doc_id / 2) AS BIGINT)")
    return table(spark, d, "documents").selectExpr("doc_id", "n_chars", *_SYMBOL, "IF(doc_id % 5 = 0, array('lib/redux'), array()) AS imports", f"{body} AS body")


_SY = f"sy AS (SELECT doc_id AS i, n_chars, {', '.join(_SYMBOL)}, CASE WHEN doc_id % 5 = 0 THEN ['lib/redux'] ELSE [] END AS imports, {_BODY.replace('@half', '(doc_id // 2)')} AS body FROM documents)"


def calls(spark: SparkSession, d: str) -> DataFrame:
    targets = F.expr("array(named_struct('target', floor(doc_id / 2), 'seq', 0), named_struct('target', floor(doc_id / 3), 'seq', 1))")
    rows = table(spark, d, "documents").select("doc_id", F.inline(targets))
    rows = rows.filter("target <> doc_id").groupBy("doc_id", "target").agg(F.min("seq").alias("seq"))
    return rows.selectExpr("'function:' || doc_id AS source", "'function:' || target AS target", "seq")


_CALLS = "ca AS (SELECT 'function:' || i AS source, 'function:' || t AS target, min(q) AS seq, t FROM (SELECT i, i // 2 AS t, 0 AS q FROM sy UNION ALL SELECT i, i // 3, 1 FROM sy) WHERE t <> i GROUP BY i, t)"

_L = literal
_first = lambda p: f"regexp_extract(t, {_L(p)}, 0)"
_trim = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_made = lambda test, p, m, n, a, b: f"CASE WHEN {test} THEN {{'pattern': '{p}', 'matched': substr({_trim(m)}, 1, {n}), 'about': {a}, 'base': CAST({b} AS DOUBLE)}} END"
_last = "regexp_extract(regexp_extract(l, '^([A-Za-z_$][\\w.$]*)\\s*\\(', 1), '([^.]*)$', 1)"
_LOOSE = f"""[l FOR l IN [{_trim('x')} FOR x IN string_split(t, chr(10))] IF regexp_matches(l, {_L(dataflow.CALL)}) AND NOT regexp_matches(l, {_L(dataflow.STATEMENT)}) AND NOT contains(l, '.then(') AND NOT contains(l, '.catch(') AND NOT contains(l, 'await ')
 AND NOT regexp_matches({_last}, {_L(dataflow.TALKS)}) AND (regexp_matches({_last}, {_L(dataflow.WRITES)}) OR ends_with({_last}, 'Async')) AND (list_contains(callees, {_last}) OR list_contains(callees, regexp_extract(l, '^([A-Za-z_$][\\w.$]*)\\s*\\(', 1)))][1]"""
_BOUND = f"[m FOR m IN regexp_extract_all(t, {_L(dataflow.COMPARED)}, 0) IF CAST(regexp_extract(m, {_L(dataflow.COMPARED)}, 2) AS DOUBLE) NOT IN (0, 1) AND regexp_matches(regexp_extract(m, {_L(dataflow.COMPARED)}, 1), {_L(dataflow.BOUNDS)}) AND NOT regexp_matches(regexp_extract(m, {_L(dataflow.COMPARED)}, 1), {_L(dataflow.INDEX)})][1]"
_ASSIGN = f"[m FOR m IN regexp_extract_all(t, {_L(dataflow.ASSIGNED)}, 0) IF NOT ends_with(m, '==')][1]"
_FOUND = f"""{_SY}, {_CALLS}, cn AS (SELECT source AS id, list(sy.name) AS callees FROM ca JOIN sy ON sy.id = target GROUP BY 1),
tx AS (SELECT sy.*, coalesce(callees, []) AS callees, regexp_replace(regexp_replace(body, {_L(dataflow.BLOCK_COMMENT)}, ' ', 'g'), {_L(dataflow.LINE_COMMENT)}, ' ', 'g') AS t FROM sy LEFT JOIN cn USING (id)),
mt AS (SELECT *, {_first(dataflow.SQL_EQUAL)} AS q, coalesce({_ASSIGN}, nullif({_first(dataflow.METHOD)}, '')) AS a, {_LOOSE} AS w, {_BOUND} AS c,
 (regexp_matches(concat_ws(' ', name, file, signature), {_L(dataflow.MUTATING)}) OR len([x FOR x IN imports IF regexp_matches(x, {_L(dataflow.STATE_LIBRARY)})]) > 0) AND NOT regexp_matches(t, {_L(dataflow.NEW_REFERENCE)}) AS keeps FROM tx),
fd AS (SELECT i, id, coalesce(
 {_made(f"{_first(dataflow.TIMER)} <> ''", 'fixed-cadence', _first(dataflow.TIMER), 48, "'interval'", 0.2)}, {_made(f"{_first(dataflow.CRON)} <> ''", 'fixed-cadence', _first(dataflow.CRON), 48, "'cron'", 0.2)},
 {_made(f"{_first(dataflow.CADENCE)} <> '' AND NOT regexp_matches({_first(dataflow.CADENCE)}, {_L(dataflow.CONFIGURED)})", 'fixed-cadence', _first(dataflow.CADENCE), 40, "'cadence'", 0.2)},
 {_made(f"q <> '' AND NOT regexp_matches(q, {_L(dataflow.SQL_NORMALISED)})", 'exact-match-query', 'q', 48, "'sql'", 0.2)}, {_made(f"{_first(dataflow.ORM_FIND)} <> ''", 'exact-match-query', _first(dataflow.ORM_FIND), 40, "'field'", 0.2)},
 {_made("keeps AND a IS NOT NULL", 'in-place-mutation', 'a', 40, "regexp_extract(a, '^\\w+', 0)", 0.2)}, {_made(f"regexp_matches(t, {_L(dataflow.AWAIT)}) AND w IS NOT NULL", 'unawaited-async-write', 'w', 60, _last.replace('(l,', '(w,'), 0.19)},
 {_made(f"{_first(dataflow.EQUALITY)} <> ''", 'hardcoded-bound', _first(dataflow.EQUALITY), 40, f"regexp_extract(t, {_L(dataflow.EQUALITY)}, 1)", 0.18)},
 {_made("c IS NOT NULL", 'hardcoded-bound', 'c', 40, f"regexp_extract(c, {_L(dataflow.COMPARED)}, 1)", 0.2)}) AS f FROM mt WHERE length(body) >= 40)"""


@query("sc_dataflow", f"WITH {_FOUND} SELECT id, f.pattern AS pattern, f.matched AS matched, f.about AS about, f.base AS base FROM fd WHERE f IS NOT NULL")
def data_flow(spark: SparkSession, d: str) -> DataFrame:
    """What every symbol's source shows."""
    names = symbols(spark, d).select(F.col("id").alias("target"), "name")
    called = calls(spark, d).join(names, "target").groupBy(F.col("source").alias("id")).agg(F.collect_set("name").alias("callees"))
    c = F.col
    rows = symbols(spark, d).join(called, "id", "left").select("id", dataflow.finding(c("body"), c("name"), c("file"), c("signature"), c("imports"), c("callees")).alias("f"))
    return rows.filter("f IS NOT NULL").select("id", "f.*")


_NEAR = f"""{_FOUND}, nr AS (SELECT inv, id, min(r) AS rank FROM (@seeds UNION ALL SELECT inv, target, 4 + row_number() OVER (PARTITION BY inv ORDER BY seq, target) FROM (@seeds) s JOIN ca ON source = s.id WHERE r = 1) WHERE r <= 8 GROUP BY 1, 2),
hit AS (SELECT inv, id, CAST(rank AS INTEGER) AS rank, f FROM nr JOIN fd USING (id) WHERE f IS NOT NULL QUALIFY row_number() OVER (PARTITION BY inv ORDER BY rank) = 1)"""
_FIFTY = "SELECT i % 50 AS inv, id, i // 50 + 1 AS r FROM sy WHERE i // 50 < 4"


@query("sc_dataflow_across", f"WITH {_NEAR.replace('@seeds', _FIFTY)} SELECT inv, id, rank, f.pattern AS pattern, f.matched AS matched, f.about AS about, f.base AS base FROM hit")
def data_flow_across(spark: SparkSession, d: str) -> DataFrame:
    """Fifty investigations whose seeds are the symbols of one remainder, by number."""
    seeds = table(spark, d, "documents").selectExpr("doc_id % 50 AS inv", "'function:' || doc_id AS id", "CAST(floor(doc_id / 50) AS INT) + 1 AS place")
    return dataflow.across(dataflow.contexts(seeds, calls(spark, d), symbols(spark, d)))


TOKENS = ["save", "m7"]


def _newest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20)


_FILE = "'src/m' || o_custkey % 40 || '.ts'"
_NEWEST = f"nw AS (SELECT *, {_FILE} AS file FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)"


@query("sort_seeds", f"""WITH {_SY}, {_NEWEST} SELECT CAST(row_number() OVER (ORDER BY score DESC, place, id) AS INTEGER) AS place, id, file, score FROM (
 SELECT id, file, 5 + i % 30 AS place, CAST(2.0 * (i % 8) / 8 + CASE WHEN n_chars // 40 <= 3 THEN -3 ELSE 0 END + CASE WHEN file IN (SELECT file FROM nw) THEN 5 ELSE 0 END + 2 * CAST(contains(name || ' ' || file, 'save') AS INT) + 2 * CAST(contains(name || ' ' || file, 'm7') AS INT) AS DOUBLE) AS score FROM sy) ORDER BY score DESC, place, id LIMIT 10""")
def seeds(spark: SparkSession, d: str) -> DataFrame:
    """The ten symbols where an investigation of saving in module 7 should begin, the first at place 1."""
    rows = symbols(spark, d).selectExpr("id", "name", "file AS path", "1 AS start_line", "1 + CAST(floor(n_chars / 40) AS INT) AS end_line", "5 + CAST(doc_id % 30 AS INT) AS place", "(doc_id % 8) / 8.0D AS rank_score")
    best = rules.seeds(rows, TOKENS, _newest(spark, d).selectExpr(f"{_FILE} AS path"))
    order = Window.orderBy(F.desc("score"), "place", "id")  # of ten rows
    return best.select(F.row_number().over(order).alias("place"), "id", F.col("path").alias("file"), "score")


def _commits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits on their customer's file and others, as many as their key says."""
    files = f"transform(sequence(0, CAST(o_orderkey % 20 AS INT)), j -> IF(j = 0, {_FILE}, concat('lib/x', j, '.ts'))) AS files"
    return table(spark, d, "orders").selectExpr("IF(o_orderstatus = 'P', 'renovate', 'Ann') AS author", "IF(o_orderpriority LIKE '4%', 'fix typo in charge', 'change charge') AS subject", files, "o_orderkey", "o_orderdate")


def gather(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, facts, queues) of the investigation: the gathered evidence with what each item says, one row of facts, the queues' state."""
    top = cut_lineage(seeds(spark, d))
    one = top.filter("place = 1").select(F.col("id").alias("seed_id"), F.col("file").alias("seed_file"), F.col("score").alias("seed_points"))
    graph_edges = cut_lineage(calls(spark, d).withColumn("rel", F.lit("calls")))
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    near = graph_edges.join(one.withColumnRenamed("seed_id", "source"), "source").select(number(F.col("target")).alias("n"))
    codes = near.agg(F.collect_set(F.concat(F.lit("error-"), (F.col("n") % 10).cast("string"))).alias("callee_codes"))
    affected = graph.traverse(graph_edges, one.select(F.col("seed_id").alias("id")), 3, outgoing=False).agg(F.count("*").cast("int").alias("affected"))
    seed = cut_lineage(one.crossJoin(codes).crossJoin(affected))  # three frames of one row each
    base = investigation.gather(spark, d).drop("seq")
    logs = obs.analyze_errors(spark, d).select(F.concat(F.lit("log:"), "key").alias("id"), F.col("key").alias("code"), "level", "message", F.col("n").alias("log_n"), "services")
    queue_kinds = obs.queue_signals(spark, d).select(F.concat(F.lit("queue:"), "queue", F.lit(":"), "kind").alias("id"), F.col("kind").alias("says"), F.col("n").alias("queue_n"))
    state_kinds = obs.state_signals(spark, d).select(F.concat_ws(":", F.lit("state"), "collection", "kind", "status").alias("id"), F.col("kind").alias("holds"), "collection")
    metric_kinds = obs.anomaly(spark, d).select(F.concat(F.lit("metric:"), "series").alias("id"), F.regexp_replace("anomaly", "latency-spike", "latency").alias("shows"))
    rows = base.join(logs, "id", "left").join(queue_kinds, "id", "left").join(state_kinds, "id", "left").join(metric_kinds, "id", "left").crossJoin(F.broadcast(seed))
    own = F.concat(F.lit("error-"), (number(F.col("seed_id")) % 10).cast("string"))
    linked = F.when(F.col("code") == own, "seed").when(F.array_contains("callee_codes", F.col("code")), "callee").when(F.col("code").startswith("purchase"), "hint")
    none = lambda kind="string": F.lit(None).cast(kind)
    rows = rows.select(
        F.lit(1).alias("inv"), "id", "source", "kind", "relevance", "ts", "is_new", "ratio", F.when(F.col("kind") != "commit", F.col("queue")).alias("queue"), "service", "category", "priority",
        F.when(F.col("kind") == "log", linked).otherwise(F.coalesce("says", "holds", "shows")).alias("signal"), F.coalesce(F.col("code").startswith("error"), F.lit(False)).alias("direct"), "level", "message", "code",
        F.coalesce("log_n", "queue_n", F.lit(1)).cast("long").alias("n"), (F.col("says") == "worker-starvation").alias("stalled"), "collection", "services", none().alias("producer"), none().alias("worker"),
        none().alias("symbol"), none().alias("file"), none().alias("flow"), none("array<string>").alias("steps"),
    )
    blank = {c: none(k) for c, k in rows.dtypes}
    made = lambda df, **cols: df.select(*[cols.get(c, blank[c]).cast(k).alias(c) for c, k in rows.dtypes])
    people = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("queue")).agg(F.min("o_custkey").alias("least"), F.max("o_custkey").alias("most"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("waiting"), F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("running"))
    people = cut_lineage(people.withColumn("active", F.when(F.col("queue").startswith("1"), 0).otherwise(F.col("running"))))
    code = {"inv": F.lit(1), "source": F.lit("code"), "category": F.lit("code"), "priority": F.lit("info"), "direct": F.lit(False), "n": F.lit(1)}
    who = lambda c: F.concat(F.lit("customer:"), F.col(c).cast("string"))
    parts = [
        rows,
        made(people, **code, id=F.concat(F.lit("edge:"), "queue"), kind=F.lit("queue-edge"), relevance=F.lit(0.6), queue=F.col("queue"), producer=who("least"), worker=who("most")),
        made(seed, **code, id=F.concat(F.lit("symbol:"), "seed_id"), kind=F.lit("symbol"), relevance=F.lit(0.7), symbol=F.col("seed_id"), file=F.col("seed_file")),
        made(seed, **code, id=F.concat(F.lit("impact:"), "seed_id"), kind=F.lit("impact"), relevance=F.lit(0.6)),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("inv").orderBy("id")  # an investigation's evidence is bounded: each source hands over a limited list
    found = cut_lineage(found.withColumn("seq", F.row_number().over(order)))
    file = seed.first()["seed_file"]
    focus = causes.regression_focus(_commits(spark, d), file).select("focus", "maintenance")
    touched = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    newest = _newest(spark, d)
    changed = newest.agg(F.coalesce(F.max_by(F.when(F.expr(_FILE) == file, F.col("o_orderkey")), F.when(F.expr(_FILE) == file, F.struct("o_orderdate", "o_orderkey"))), touched).alias("key"))
    flow = dataflow.across(dataflow.contexts(top.select(F.lit(1).alias("inv"), "id", "place"), calls(spark, d), symbols(spark, d))).agg(F.max("base").alias("data_flow"))
    lists = found.filter("kind = 'queue-state'").agg(F.array_sort(F.collect_set("queue")).alias("queues"))
    facts = seed.crossJoin(focus).crossJoin(changed).crossJoin(flow).crossJoin(lists)  # one row each
    facts = facts.select(
        F.lit(1).alias("inv"), "queues", F.concat(F.lit("commit:"), F.col("key").cast("string")).alias("changed"), F.col("focus").isNotNull().alias("change_relevant"), "focus", "maintenance", "affected",
        F.concat(F.lit("symbol:"), "seed_id").alias("seed"), F.concat(F.lit("impact:"), "seed_id").alias("impact"), "data_flow", F.lit(False).alias("source_impact"), F.lit(False).alias("vague"), F.lit(False).alias("benign"),
        F.least(F.col("seed_points") / 20, F.lit(1.0)).alias("seed_score"), (F.col("seed_points") < 1).alias("low_confidence"),
    )
    return found, cut_lineage(facts), people.select(F.lit(1).alias("inv"), "queue", "waiting", "active")


def _explained(found: DataFrame, facts: DataFrame) -> DataFrame:
    """The hypotheses with verdicts."""
    open_ = causes.hypotheses(found, facts)
    judged = evidence.validate(open_.drop("inv").withColumn("seq", F.struct("seq", "id")), found)
    return open_.join(judged.select("id", "place", "verdict", "confidence", "supporting", "contradicting"), "id")


def _nodes(found: DataFrame) -> DataFrame:
    """The evidence graph's nodes, implicated by what hangs on them or one hop on."""
    nodes, edges = causes.evidence_graph(found)
    items = nodes.filter("type <> 'evidence'").select("inv", "node", F.explode("ids").alias("id")).join(found.select("inv", "id", "relevance", "priority"), ["inv", "id"])
    links = edges.filter("type NOT IN ('observed_in', 'metric_from')").select(F.col("source").alias("a"), F.col("target").alias("b"))
    hit = evidence.implication(items.select("node", "relevance", "priority"), links)
    return nodes.join(hit, "node", "left").withColumn("implicated", F.coalesce("implicated", F.lit(False)))



_TOP = f"""{_NEWEST}, top10 AS (SELECT row_number() OVER (ORDER BY score DESC, place, id) AS place, id, file, score FROM (
 SELECT id, file, 5 + i % 30 AS place, CAST(2.0 * (i % 8) / 8 + CASE WHEN n_chars // 40 <= 3 THEN -3 ELSE 0 END + CASE WHEN file IN (SELECT file FROM nw) THEN 5 ELSE 0 END + 2 * CAST(contains(name || ' ' || file, 'save') AS INT) + 2 * CAST(contains(name || ' ' || file, 'm7') AS INT) AS DOUBLE) AS score FROM sy) ORDER BY score DESC, place, id LIMIT 10),
sd AS (SELECT id AS seed_id, file AS seed_file, score AS points, CAST(split_part(id, ':', 2) AS BIGINT) AS sn FROM top10 WHERE place = 1),
rc(id, depth) AS (SELECT seed_id, 0 FROM sd UNION SELECT source, depth + 1 FROM rc JOIN ca ON target = rc.id WHERE depth < 3)"""
_Q = obs.query.oracles
_XV = f"""{_NEAR.replace('@seeds', 'SELECT 1 AS inv, id, place AS r FROM top10 WHERE place <= 4').replace(', nr AS (', f', {_TOP}, nr AS (', 1)},
pq AS (SELECT o_orderpriority AS queue, min(o_custkey) AS lo, max(o_custkey) AS hi, count(*) FILTER (o_orderstatus = 'O') AS waiting, CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE count(*) FILTER (o_orderstatus = 'P') END AS active FROM orders GROUP BY 1),
xw AS (SELECT e.id, e.source, e.kind, e.relevance, e.ts, e.is_new, e.ratio, CASE WHEN e.kind <> 'commit' THEN e.queue END AS queue, e.service, e.category, e.priority,
  CASE WHEN e.kind = 'log' THEN CASE WHEN l.key = 'error-' || sn % 10 THEN 'seed' WHEN l.key IN (SELECT 'error-' || t % 10 FROM ca JOIN sd x ON source = x.seed_id) THEN 'callee' WHEN starts_with(l.key, 'purchase') THEN 'hint' END ELSE coalesce(q.kind, s.kind, replace(m.anomaly, 'latency-spike', 'latency')) END AS signal,
  coalesce(starts_with(l.key, 'error'), false) AS direct, l.level, l.message, l.key AS code, coalesce(l.n, q.n, 1) AS n, q.kind = 'worker-starvation' AS stalled, s.collection, l.services, NULL AS producer, NULL AS worker, NULL AS symbol, NULL AS file
  FROM ev e CROSS JOIN sd LEFT JOIN ({_Q['agg_analyze_errors']}) l ON e.id = 'log:' || l.key LEFT JOIN ({_Q['sc_queue_signals']}) q ON e.id = 'queue:' || q.queue || ':' || q.kind
  LEFT JOIN ({_Q['sc_state_signals']}) s ON e.id = concat_ws(':', 'state', s.collection, s.kind, s.status) LEFT JOIN ({_Q['win_anomaly']}) m ON e.id = 'metric:' || m.series
 UNION ALL SELECT 'edge:' || queue, 'code', 'queue-edge', 0.6, NULL, NULL, NULL, queue, NULL, 'code', 'info', NULL, false, NULL, NULL, NULL, 1, NULL, NULL, NULL, 'customer:' || lo, 'customer:' || hi, NULL, NULL FROM pq
 UNION ALL SELECT 'symbol:' || seed_id, 'code', 'symbol', 0.7, NULL, NULL, NULL, NULL, NULL, 'code', 'info', NULL, false, NULL, NULL, NULL, 1, NULL, NULL, NULL, NULL, NULL, seed_id, seed_file FROM sd
 UNION ALL SELECT 'impact:' || seed_id, 'code', 'impact', 0.6, NULL, NULL, NULL, NULL, NULL, 'code', 'info', NULL, false, NULL, NULL, NULL, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM sd),
xv AS MATERIALIZED (SELECT * FROM xw),
rf AS (SELECT min(o_orderkey % 20 + 1) AS focus, coalesce(bool_and(o_orderpriority LIKE '4%'), false) AS maintenance FROM orders, sd WHERE {_FILE} = seed_file AND o_orderstatus <> 'P'),
fc AS MATERIALIZED (SELECT (SELECT list_sort(list(DISTINCT queue)) FROM xv WHERE kind = 'queue-state') AS queues, 'commit:' || coalesce((SELECT o_orderkey FROM nw, sd WHERE nw.file = seed_file ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1), (SELECT o_orderkey FROM nw ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)) AS changed,
 focus IS NOT NULL AS change_relevant, focus, maintenance, (SELECT count(DISTINCT id) - 1 FROM rc) AS affected, 'symbol:' || seed_id AS seed, 'impact:' || seed_id AS impact, (SELECT max(f.base) FROM hit) AS data_flow, least(points / 20, 1) AS seed_score, points < 1 AS low_confidence FROM sd, rf)"""
_XV = f"WITH RECURSIVE {investigation._EV}, {_XV}"


@query("inc_evidence", f"{_XV} SELECT *, 1 AS inv FROM xv")
def incident_evidence(spark: SparkSession, d: str) -> DataFrame:
    return gather(spark, d)[0].drop("flow", "steps", "seq")


@query("inc_facts", f"{_XV} SELECT queues, changed, change_relevant, focus, maintenance, affected, seed, impact, data_flow, seed_score, low_confidence FROM fc")
def incident_facts(spark: SparkSession, d: str) -> DataFrame:
    return gather(spark, d)[1].drop("inv", "source_impact", "vague", "benign")


_ids = lambda test: f"coalesce((SELECT list_sort(list(id)) FROM xv WHERE {test}), [])"
_SLOW_METRIC = "kind = 'metric' AND signal IN ('latency', 'error-rate-change')"
_HY = f"""h0 AS (
 SELECT 'deployment-regression' AS id, 'deployment-regression' AS category, NULL AS queue, 0 AS seq, CASE WHEN len(x) = 0 OR NOT change_relevant THEN 0.15 WHEN focus > 14 THEN 0.25 ELSE 0.5 END AS prior, CASE WHEN change_relevant AND coalesce(focus, 0) <= 14 THEN x ELSE [] END AS supports, [] AS contradicts FROM (SELECT *, {_ids("kind = 'commit'")} AS x FROM fc)
 UNION ALL SELECT 'queue-backlog:' || q, 'queue-backlog', q, 1, CASE WHEN len(x) > 0 THEN 0.7 ELSE 0.35 END, x, [] FROM (SELECT q, {_ids("queue = q AND kind = 'queue-state' AND signal = 'backlog'")} AS x FROM (SELECT unnest(queues) AS q FROM fc))
 UNION ALL SELECT 'worker-slowdown:' || q, 'worker-slowdown', q, 2, CASE WHEN len(x) > 0 THEN 0.55 ELSE 0.3 END, x, [] FROM (SELECT q, {_ids("queue = q AND (kind = 'queue-state' AND signal = 'worker-starvation' OR kind = 'metric' AND signal = 'queue-growth')")} AS x FROM (SELECT unnest(queues) AS q FROM fc))
 UNION ALL SELECT 'external-api-latency', 'external-api-latency', NULL, 3, CASE WHEN len(x) > 0 THEN 0.55 ELSE 0.2 END, x, [] FROM (SELECT {_ids(_SLOW_METRIC)} AS x)
 UNION ALL SELECT 'retry-storm', 'retry-storm', NULL, 4, CASE WHEN len(x) > 0 THEN 0.35 ELSE 0.15 END, x, y FROM (SELECT {_ids(f"kind = 'log' AND ratio >= 2 AND direct AND regexp_matches(coalesce(message, ''), {_L(causes.RETRY)}) OR kind = 'queue-state' AND signal = 'backlog'")} AS x, {_ids("kind = 'queue-state' AND signal = 'worker-starvation'")} AS y)
 UNION ALL SELECT 'infrastructure', 'infrastructure', NULL, 5, CASE WHEN len(x) > 0 THEN 0.35 ELSE 0.15 END, x, [] FROM (SELECT {_ids(f"kind = 'state' AND coalesce(signal, '') NOT IN ('stale', 'legacy') OR kind = 'queue-state' AND signal = 'worker-starvation' OR {_SLOW_METRIC}")} AS x)),
h1 AS (SELECT *, len(supports) AS supporting, len(contradicts) AS contradicting, least(greatest(prior + 0.15 * (1 - pow(0.6, len(supports))) / 0.4 - 0.3 * len(contradicts), 0), 1) AS r, CASE WHEN len(contradicts) = 0 AND len(supports) > 0 THEN array_to_string(supports, '|') END AS k FROM h0),
hy AS MATERIALIZED (SELECT *, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) >= 2 THEN least(r, 0.75) ELSE r END AS confidence,
 CASE WHEN contradicting > 0 AND r < 0.1 THEN 'eliminated' WHEN contradicting > 0 THEN 'weakened' WHEN supporting > 0 THEN 'supported' ELSE 'unconfirmed' END AS verdict FROM h1)"""


@query("inc_hypotheses", f"{_XV}, {_HY} SELECT id, category, queue, CAST(prior AS DOUBLE) AS prior, supports, contradicts, supporting, contradicting, verdict, confidence FROM hy")
def incident_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """The competing explanations of the gathered evidence, judged."""
    found, facts, _ = gather(spark, d)
    return _explained(found, facts).select("id", "category", "queue", "prior", "supports", "contradicts", "supporting", "contradicting", "verdict", "confidence")


_ND = """n0(id, node, type) AS (SELECT id, 'queue:' || queue, 'queue' FROM xv WHERE kind IN ('queue-edge', 'queue-state') AND queue IS NOT NULL UNION ALL SELECT id, 'service:' || producer, 'service' FROM xv WHERE producer IS NOT NULL UNION ALL SELECT id, 'worker:' || worker, 'worker' FROM xv WHERE worker IS NOT NULL
 UNION ALL SELECT id, 'collection:' || collection, 'collection' FROM xv WHERE kind = 'state' AND collection IS NOT NULL UNION ALL SELECT id, 'deployment:' || id, 'deployment' FROM xv WHERE kind = 'commit' UNION ALL SELECT id, 'symbol:' || symbol, 'symbol' FROM xv WHERE symbol IS NOT NULL UNION ALL SELECT id, 'file:' || file, 'file' FROM xv WHERE file IS NOT NULL
 UNION ALL SELECT id, 'service:' || unnest(services), 'service' FROM xv WHERE kind IN ('log', 'metric')),
n1 AS (SELECT node, type, list(id) AS ids, max(CASE WHEN priority <> 'info' THEN relevance ELSE 0 END) AS own FROM n0 JOIN xv USING (id) GROUP BY 1, 2),
ln AS (SELECT 'service:' || producer AS a, 'queue:' || queue AS b FROM xv WHERE producer IS NOT NULL UNION SELECT 'queue:' || queue, 'worker:' || worker FROM xv WHERE worker IS NOT NULL UNION SELECT 'symbol:' || symbol, 'file:' || file FROM xv WHERE symbol IS NOT NULL),
l2 AS (SELECT a, b FROM ln UNION SELECT b, a FROM ln),
nd AS MATERIALIZED (SELECT node, type, ids, greatest(own, coalesce((SELECT max(o.own) * 0.7 FROM l2 JOIN n1 o ON o.node = a WHERE b = n1.node), 0)) AS score FROM n1)"""


@query("inc_nodes", f"{_XV}, {_ND} SELECT node, type, score, score >= 0.6 AS implicated FROM nd")
def incident_nodes(spark: SparkSession, d: str) -> DataFrame:
    """What the evidence hangs on, and whether it is implicated."""
    return _nodes(gather(spark, d)[0]).filter("type <> 'evidence'").select("node", "type", "score", "implicated")


def _step(category: str, slot: int, role: str, ids: str, keep: bool, node: str) -> str:
    return f"SELECT id, category, confidence, {slot} AS slot, '{role}' AS role, {ids} AS ids, {node} AS node FROM kd WHERE category = '{category}'" + ("" if keep else f" AND len({ids}) > 0")


_hit = lambda *types: "coalesce(" + ", ".join(f"(SELECT min(node) FROM nd WHERE type = '{t}' AND score >= 0.6)" for t in types) + ")"
_any = lambda t: f"(SELECT min(node) FROM nd WHERE type = '{t}')"
_own = "CASE WHEN queue IS NULL THEN (SELECT min(node) FROM nd WHERE type = 'queue' AND score >= 0.6) ELSE (SELECT node FROM nd WHERE node = 'queue:' || queue) END"
_first_of = lambda a, b: f"CASE WHEN len({a}) > 0 THEN {a} ELSE {b} END"
_STEPS = [
    _step("deployment-regression", 0, "trigger", "commits", True, _any("deployment")), _step("deployment-regression", 1, "propagation", "code", False, _any("symbol")), _step("deployment-regression", 2, "symptom", "logs || metrics", False, _hit("service")),
    _step("queue-backlog", 0, "trigger", "edges", True, _own), _step("queue-backlog", 1, "propagation", "states", False, _own), _step("queue-backlog", 2, "symptom", "logs || metrics", False, _hit("worker", "service")),
    _step("worker-slowdown", 0, "trigger", _first_of("(stalled || metrics)", "states"), True, _hit("worker")), _step("worker-slowdown", 1, "propagation", "states", False, _own), _step("worker-slowdown", 2, "symptom", "logs", False, _hit("service")),
    _step("external-api-latency", 0, "trigger", "metrics", True, _hit("service")), _step("external-api-latency", 1, "propagation", "logs", False, _hit("service")), _step("external-api-latency", 2, "symptom", "states", False, _hit("queue")),
    _step("infrastructure", 0, "trigger", _first_of("(tables || metrics)", "states"), True, _hit("collection", "database", "queue")), _step("infrastructure", 1, "propagation", "states", False, _hit("worker", "service")), _step("infrastructure", 2, "symptom", "logs", False, _hit("service")),
    _step("retry-storm", 0, "trigger", "logs", True, _hit("service")), _step("retry-storm", 1, "propagation", "states", False, _hit("queue")), _step("retry-storm", 2, "symptom", "metrics", False, _hit("service")),
]
_of = lambda test: f"[i FOR i IN supports IF i IN (SELECT id FROM xv WHERE {test})]"
_kinds = lambda name, test: f"coalesce(list_sort(list(xv.id) FILTER ({test})), []) AS {name}"
_CH = f"""kd AS MATERIALIZED (SELECT h.id, h.category, h.queue, h.confidence, {', '.join(_kinds(n, t) for n, t in [('commits', "kind = 'commit'"), ('code', "kind IN ('symbol', 'impact')"), ('logs', "kind = 'log'"), ('metrics', "kind = 'metric'"), ('edges', "kind = 'queue-edge'"), ('states', "kind = 'queue-state'"), ('stalled', "kind = 'queue-state' AND stalled"), ('tables', "kind = 'state'")])}
 FROM (SELECT *, unnest(supports) AS s FROM hy WHERE verdict IN ('supported', 'weakened')) h JOIN xv ON xv.id = h.s GROUP BY 1, 2, 3, 4),
ch AS (SELECT *, string_agg(role, ' > ') OVER (PARTITION BY id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS path FROM ({' UNION ALL '.join(_STEPS)}))"""


@query("sc_cause_chains", f"{_XV}, {_HY}, {_ND}, {_CH} SELECT id, category, confidence, CAST(slot AS INTEGER) AS slot, role, ids, node, path FROM ch")
def cause_chains(spark: SparkSession, d: str) -> DataFrame:
    """Trigger, propagation and symptom of each explanation that stands."""
    found, facts, _ = gather(spark, d)
    explained, nodes = (cut_lineage(x.repartition(1)) for x in (_explained(found, facts), _nodes(found)))  # some dozen rows that are read often
    return chains.cause_chains(explained, found, nodes).drop("inv")


_VOL = lambda rate: f"least({rate} * log10(greatest(n, 1)), 0.1)"
_tier = "CASE WHEN level IN ('error', 'fatal', 'critical') THEN 'error' ELSE 'other' END"
_CI = f"""jam AS (SELECT * FROM pq WHERE waiting >= 10 AND active = 0 OR waiting > 100),
led AS (SELECT id, signal, n FROM xv WHERE signal IN ('seed', 'callee') ORDER BY signal = 'callee', n DESC, id LIMIT 1), hin AS (SELECT id, n FROM xv WHERE signal = 'hint' AND NOT EXISTS (SELECT 1 FROM led) ORDER BY n DESC, id LIMIT 1),
ci AS MATERIALIZED (SELECT 'queue-backlog:' || q AS id, 'queue-backlog' AS category, CAST(CASE WHEN waiting >= 10 AND active = 0 THEN 0.45 ELSE 0.45 + least(waiting / 5000, 0.2) END AS DOUBLE) AS base, {_ids("kind = 'queue-state' AND queue = q")} AS ids FROM (SELECT queue AS q, waiting, active FROM jam)
 UNION ALL SELECT 'queue-path:' || queue, 'queue-path', 0.35, [id, impact] FROM xv, fc WHERE kind = 'queue-edge'
 UNION ALL SELECT 'deployment-regression', 'deployment-regression', (CASE WHEN change_relevant THEN CASE WHEN focus <= 4 THEN 0.45 WHEN focus <= 8 THEN 0.38 WHEN focus <= 14 THEN 0.3 ELSE 0.2 END ELSE 0.18 END + 0.05) * CASE WHEN change_relevant AND maintenance THEN 0.5 ELSE 1 END, [changed, seed] FROM fc
 UNION ALL SELECT 'blast-radius', 'blast-radius', 0.2, [impact, seed] FROM fc WHERE affected >= 3 UNION ALL SELECT 'seed-data-flow', 'data-flow', data_flow, [seed] FROM fc WHERE data_flow IS NOT NULL
 UNION ALL SELECT 'seed-emitted-error', 'error-correlation', 0.6 + {_VOL(0.025)} - CASE WHEN signal = 'callee' THEN 0.18 ELSE 0 END, list_append({_ids("signal IN ('seed', 'callee')")}, seed) FROM led, fc
 UNION ALL SELECT 'hint-matched-signal', 'error-correlation', 0.6 + {_VOL(0.03)}, [id] FROM hin
 UNION ALL SELECT 'error-correlation', 'error-correlation', 0.3, x[1:3] FROM (SELECT {_ids("kind = 'log' AND direct")} AS x) WHERE len(x) > 0
 UNION ALL SELECT 'data-state-anomaly', 'data-state-anomaly', 0.22, x[1:3] FROM (SELECT {_ids("kind = 'state' AND signal IN ('anomaly', 'stale')")} AS x) WHERE len(x) > 0
 UNION ALL SELECT 'metric-latency', 'external-api-latency', 0.45, x FROM (SELECT {_ids(_SLOW_METRIC)} AS x) WHERE len(x) > 0 UNION ALL SELECT 'metric-queue-growth', 'queue-backlog', 0.4, x FROM (SELECT {_ids("kind = 'metric' AND signal = 'queue-growth'")} AS x) WHERE len(x) > 0)"""


@query("inc_causes", f"{_XV}, {_CI} SELECT id, category, base, ids FROM ci")
def incident_causes(spark: SparkSession, d: str) -> DataFrame:
    """The candidate causes with base scores."""
    found, facts, queues = gather(spark, d)
    return causes.cause_inputs(found, queues, facts).drop("inv")


SERVICE = "svc-3"
_PRIOR = "p0 AS (SELECT 'symbol:function:' || doc_id AS node, count(*) AS n FROM labels WHERE toxic = 1 GROUP BY 1 UNION ALL SELECT 'file:src/m' || doc_id % 40 || '.ts', count(*) FROM labels WHERE toxic = 1 GROUP BY 1)"
_RK = f"""x0 AS (SELECT DISTINCT ci.id AS cause, base, unnest(ids) AS eid FROM ci), n2 AS (SELECT unnest(ids) AS eid, node, type, score FROM nd),
f0 AS (SELECT cause AS id, max(base) AS base, avg(CASE priority WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.75 WHEN 'low' THEN 0.5 END * relevance) FILTER (priority <> 'info') AS quality, count(DISTINCT source) AS sources, max((SELECT max(score) FROM n2 WHERE n2.eid = x0.eid)) AS node, max(ts) AS newest,
 max(CASE WHEN kind = 'log' THEN CASE WHEN is_new THEN 0.05 WHEN ratio >= 3 THEN 0.03 ELSE 0 END ELSE 0 END) AS repeats, count(*) FILTER (kind NOT IN ('symbol', 'flow', 'impact', 'queue-edge')) AS plain, count(*) FILTER (relevance >= 0.85 AND kind NOT IN ('symbol', 'flow', 'impact', 'queue-edge')) AS strong,
 avg(DISTINCT CASE source WHEN 'logs' THEN 0.9 WHEN 'queue' THEN 0.9001 WHEN 'state' THEN 0.85 WHEN 'metrics' THEN 0.8 WHEN 'history' THEN 0.6 ELSE 0.7 END) AS rely FROM x0 JOIN xv ON xv.id = x0.eid GROUP BY 1),
f1 AS (SELECT *, date_diff('microsecond', newest, TIMESTAMP '2024-01-30') / 3.6e9 AS age, (SELECT affected FROM fc) AS blast,
 EXISTS (SELECT 1 FROM x0 JOIN n2 USING (eid) WHERE cause = f0.id AND node = 'service:{SERVICE}' AND score >= 0.6) AS asked, (SELECT count(DISTINCT n2.node) FROM x0 JOIN n2 USING (eid) JOIN p0 ON p0.node = n2.node WHERE cause = f0.id AND n > 0) AS known FROM f0),
f2 AS (SELECT id, base, sources, CASE WHEN quality IS NULL THEN -0.05 WHEN abs(round(quality - 0.5, 3)) < 0.01 THEN 0 ELSE round(quality - 0.5, 3) END + CASE WHEN sources >= 3 THEN 0.1 WHEN sources = 2 THEN 0.05 ELSE 0 END + coalesce(round(node * 0.1, 3), 0)
 + round(CASE WHEN newest IS NULL OR age < -1.0 / 12 THEN 0 WHEN age <= 1 THEN 0.05 WHEN age <= 24 THEN 0.02 WHEN age <= 72 THEN 0 WHEN age <= 168 THEN -0.02 ELSE -0.05 END + repeats, 3) + CASE WHEN plain = 0 THEN -0.05 WHEN strong > 0 THEN 0.03 ELSE 0 END + CASE WHEN rely >= 0.8 THEN 0.03 WHEN rely < 0.5 THEN -0.03 ELSE 0 END
 + CASE WHEN round(least(blast / 20, 1) * 0.05, 3) >= 0.005 THEN round(least(blast / 20, 1) * 0.05, 3) ELSE 0 END + CASE WHEN asked THEN 0.04 ELSE 0 END + round(least(known * 0.04, 0.1), 3) AS f FROM f1),
rk AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM (SELECT id, category, base, least(greatest(f2.base + f, 0), CASE WHEN sources <= 1 THEN 0.84 ELSE 1 END) AS score, ids FROM f2 JOIN ci USING (id, base)))"""
_CONF = investigation._CONF.replace("FROM ev)", "FROM xv)").replace("kind = 'commit' THEN 'structural'", "kind NOT IN ('log', 'metric', 'queue-state', 'redis-key', 'state') THEN 'structural'")
_GAPS = "least(coalesce((SELECT greatest(0.3, 1 - sum(impact)) FROM (VALUES (0.1, 'log'), (0.1, 'metric'), (0.1, 'queue-state'), (0.08, 'state'), (0.08, 'commit'), (0.07, 'trace'), (0.05, 'owner')) v(impact, kind) WHERE kind NOT IN (SELECT kind FROM xv)), 1), (SELECT CASE WHEN s < 0.2 THEN 0.6 WHEN s < 0.5 THEN 0.6 + (s - 0.2) / 0.3 * 0.18 WHEN s < 0.85 THEN 0.78 + (s - 0.5) / 0.35 * 0.22 ELSE 1 END FROM (SELECT max(score) AS s FROM rk)))"


@query("investigation", f"""{_XV}, {_ND}, {_CI}, {_PRIOR}, {_RK}, {_CONF},
lk AS (SELECT id AS eid FROM xv WHERE kind = 'symbol' OR signal IN ('seed', 'callee')), hl AS (SELECT rk.id, score, place, bool_or(eid IN (SELECT eid FROM lk)) AS on_seed FROM (SELECT *, unnest(ids) AS eid FROM rk) rk GROUP BY 1, 2, 3),
nm AS (SELECT id FROM hl WHERE score >= 0.2 ORDER BY on_seed DESC, score DESC, place LIMIT 1)
SELECT CAST(place AS INTEGER) AS place, id, category, score, {investigation._BAND} AS band, id = (SELECT id FROM nm) AS headline, least(0.5 * confidence + 0.5 * CASE WHEN low_confidence THEN 0.3 ELSE 1 END, {_GAPS}, CASE WHEN low_confidence THEN 0.45 ELSE 1 END) AS overall FROM rk, conf, fc ORDER BY place LIMIT 8""")
def full_investigation(spark: SparkSession, d: str) -> DataFrame:
    """The best causes of the gathered evidence by all ten factors, which one to name, and the overall confidence."""
    found, facts, queues = gather(spark, d)
    inputs = causes.cause_inputs(found, queues, facts)
    inputs = cut_lineage(inputs.repartition(1))  # some dozen rows that are read often
    nodes = cut_lineage(_nodes(found).repartition(1))
    prior = table(spark, d, "labels").filter("toxic = 1").select(F.explode(F.array(F.expr("'symbol:function:' || doc_id"), F.expr("'file:src/m' || doc_id % 40 || '.ts'"))).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    deltas = [("f_uncertainty", causes.uncertainty(inputs, causes.findings(found, facts))), ("f_context", causes.context(inputs, nodes, SERVICE)), ("f_history", causes.history(inputs, nodes, prior))]
    rows = inputs.join(facts.select("inv", F.col("affected").alias("blast")), "inv")
    for name, delta in deltas:
        rows = rows.join(delta.select("inv", "id", F.col("delta").alias(name)), ["inv", "id"], "left").fillna(0.0, [name])
    hung = nodes.filter("type <> 'evidence' AND score IS NOT NULL").select(F.explode("ids").alias("eid"), "score")
    ranked = evidence.score_causes(rows.drop("inv"), found, hung, F.expr(investigation.NOW), 50).withColumn("inv", F.lit(1)).join(inputs.select("id", "ids"), "id")
    ranked = cut_lineage(ranked.withColumn("place", F.row_number().over(Window.partitionBy("inv").orderBy(F.desc("score"), "id"))))
    linked = found.filter("kind = 'symbol' OR signal IN ('seed', 'callee')").select("inv", F.col("id").alias("eid"))
    named = causes.headline(ranked, linked).select(F.col("headline").alias("named"))
    ceiling = evidence.gaps(found).agg(F.coalesce(F.max("ceiling"), F.lit(1.0)).alias("gap"))
    one = evidence.confidence(found, F.col("relevance") <= 0.4).crossJoin(ceiling).crossJoin(ranked.agg(F.max("score").alias("best"))).crossJoin(facts.select("seed", "low_confidence")).crossJoin(named)  # one row each
    overall = evidence.overall_confidence(F.col("confidence"), F.col("seed"), F.col("low_confidence"), F.col("gap"), F.col("best"))
    out = ranked.filter("place <= 8").crossJoin(F.broadcast(one))
    return out.select("place", "id", "category", "score", "band", (F.col("id") == F.col("named")).alias("headline"), overall.alias("overall"))


#: Events as incident events: users are families, purchases the word of a worker, sign-ups resolutions; polls bring 400 ids each.
_WATCHED = [
    "concat('r', user_id % 3) AS route", "concat('u', user_id) AS family", "event_id", "ts AS occurred_at", "CASE WHEN user_id % 2 = 0 THEN 'elasticsearch' ELSE 'sentry' END AS source",
    "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'resolved' ELSE 'active' END AS state", "CASE WHEN event_type = 'error' THEN 'error' ELSE 'warn' END AS severity",
    "CASE WHEN user_id % 3 = 0 AND event_id % 4 > 0 THEN concat('e', user_id % 7, '.', event_id % 2) END AS episode", "event_id % 11 = 0 AS required", "CAST(floor((event_id * 7919 % 10007) / 400) AS INT) AS poll",
]


@query("st_watch", f"""WITH RECURSIVE w AS (SELECT {', '.join(_WATCHED)} FROM events),
e AS (SELECT *, epoch_ms(occurred_at) AS at_, row_number() OVER (PARTITION BY route, family ORDER BY poll, epoch_ms(occurred_at), CAST(event_id AS VARCHAR)) AS nr FROM w),
s AS (SELECT route, family, 0 AS nr, 0 AS event_id, 0 AS job, CAST(NULL AS VARCHAR) AS episode, CAST(0 AS BIGINT) AS at_, CAST(NULL AS VARCHAR) AS severity, false AS resolved, CAST(NULL AS VARCHAR) AS status, false AS tried, '' AS action FROM (SELECT DISTINCT route, family FROM e)
 UNION ALL SELECT route, family, nr, event_id, CASE WHEN opens THEN job + 1 ELSE job END, CASE WHEN opens THEN e_ep ELSE ep END, CASE WHEN done OR late THEN at_ ELSE e_at END, CASE WHEN done OR late THEN sev ELSE e_sev END, CASE WHEN done OR late THEN res ELSE shut END,
  CASE WHEN done THEN CASE WHEN job > 0 THEN 'done' END WHEN opens THEN CASE WHEN shut AND NOT required THEN 'cancelled' ELSE 'pending' END WHEN late THEN status WHEN again OR tell THEN 'pending' ELSE status END, CASE WHEN opens THEN false WHEN done THEN job > 0 ELSE tried END,
  CASE WHEN done THEN CASE WHEN job > 0 THEN 'done' ELSE 'ignored' END WHEN opens THEN CASE WHEN shut AND NOT required THEN 'closed' ELSE 'open' END WHEN late THEN 'late' WHEN again THEN 'reopen' WHEN tell THEN 'notify' WHEN shut THEN 'resolve' ELSE 'update' END FROM (
  SELECT *, NOT again AND status = 'done' AND e_sev <> sev AS tell FROM (SELECT *, NOT done AND NOT late AND (job = 0 OR NOT shut AND (res AND (e_ep IS NULL OR e_ep IS DISTINCT FROM ep) OR e_ep IS NOT NULL AND e_ep IS DISTINCT FROM ep OR source = 'elasticsearch' AND e_at - at_ > 3600000)) AS opens,
   NOT tried AND status IN ('cancelled', 'done') AND (required OR NOT shut AND res) AS again FROM (
   SELECT e.route, e.family, e.nr, e.event_id, e.source, e.required, e.episode AS e_ep, e.at_ AS e_at, e.severity AS e_sev, e.state = 'done' AS done, e.state = 'resolved' AS shut, s.job > 0 AND e.state <> 'done' AND e.at_ < s.at_ AS late, s.job, s.episode AS ep, s.at_, s.severity AS sev, s.resolved AS res, s.status, s.tried
   FROM s JOIN e ON e.route = s.route AND e.family = s.family AND e.nr = s.nr + 1))))
SELECT route, family, CAST(event_id AS VARCHAR) AS event_id, CAST(job AS BIGINT) AS job, action, status, CASE WHEN job > 0 THEN resolved END AS resolved FROM s WHERE nr > 0""")
def watched(spark: SparkSession, d: str) -> DataFrame:
    """What each event did to its family's jobs, in the order in which polls brought them."""
    return watcher.watch(table(spark, d, "events").selectExpr(*_WATCHED), "poll")


#: Log documents made of an event's properties ({p}: k as text), and what each says: its path and text.
_DOCS = [
    ('{"error": {"stack_trace": "at x", "message": "bad {p}"}}', "error.message", "bad {p}"), ('{"context": {"note": "ok", "order": {"failure_reason": "no stock {p}", "failure_code": "E"}}}', "context.order.failure_reason", "no stock {p}"),
    ('{"err": {"cause": {"name": "X", "more": {"text": "deep {p}"}}}}', "err.cause.more.text", "deep {p}"), ('{"exception": " boom {p}\\\\n at line 2 "}', "exception", "boom {p}"), ('{"error": {"code": "E1", "request_id": "{p}", "n": 7}}', None, None),
    ('{"error": {"message": "said {p}"}, "detail": {"error_text": "other {p}", "text": "no"}}', "detail.error_text", "other {p}"), ('{"error": {"a": {"b": {"c": {"d": {"e": "too deep {p}"}}}}}}', None, None), ('{"error": {"stack": "trace", "zeta": "plain {p}", "eta": "first {p}"}}', "error.eta", "first {p}"),
    ('{"context": {"user_error": "undefined", "reason": " {p} gone "}, "reason": "not a root"}', "context.reason", "{p} gone"), ('no json {p}', None, None), ('{"detail": {"why": {"text": "configured {p}"}}, "error": {"message": "m {p}"}}', "detail.why.text", "configured {p}"),
]
_by_event = lambda rows, sql: "CASE event_id % " + str(len(rows)) + " " + " ".join(f"WHEN {i} THEN {sql(r)}" for i, r in enumerate(rows)) + " END"
_filled = lambda t: "CAST(NULL AS STRING)" if t is None else "concat('" + t.replace("{p}", f"', {{p}}, '") + "')"


@query("prj_detail", "SELECT event_id, " + _by_event(_DOCS, lambda r: _filled(r[2]).replace("STRING", "VARCHAR")).replace("{p}", "json_extract_string(props, '$.k')") + " AS detail, " + _by_event(_DOCS, lambda r: "NULL" if r[1] is None else f"'{r[1]}'") + " AS detail_path FROM events")
def details(spark: SparkSession, d: str) -> DataFrame:
    """Why each log document says that something failed; its message is `said k`, and detail.why.text is configured."""
    k = "get_json_object(props, '$.k')"
    rows = table(spark, d, "events").selectExpr("event_id", _by_event(_DOCS, lambda r: _filled(r[0])).replace("{p}", k) + " AS body", f"concat('said ', {k}) AS message")
    return detail.with_detail(rows, "body", F.col("message"), ("detail.none", "detail.why.text")).select("event_id", "detail", "detail_path")


_BEGIN, _NOW, _MOST, _SPAN = 1704067200, 1706745600, 50, 86400  # January 2024
_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"


@query("st_halving", f"""WITH RECURSIVE s AS (SELECT user_id % 5 AS route, {_SECONDS} AS t, count(*) AS n FROM events GROUP BY 1, 2),
h AS (SELECT route, 0 AS poll, CAST({_BEGIN - polling.OVERLAP} AS BIGINT) AS a, CAST(least({_NOW}, {_BEGIN + _SPAN}) AS BIGINT) AS b, 0 AS halved FROM (SELECT DISTINCT route FROM s)
 UNION ALL SELECT route, CASE WHEN n >= {_MOST} THEN poll ELSE poll + 1 END, CASE WHEN n >= {_MOST} THEN a ELSE b - {polling.OVERLAP} END, CASE WHEN n >= {_MOST} THEN (a + b) // 2 ELSE least({_NOW}, b + {_SPAN}) END, CASE WHEN n >= {_MOST} THEN halved + 1 ELSE 0 END
 FROM (SELECT h.*, (SELECT coalesce(sum(n), 0) FROM s WHERE s.route = h.route AND t BETWEEN a AND b) AS n FROM h) WHERE n >= {_MOST} OR b < {_NOW})
SELECT route, CAST(poll AS INTEGER) AS poll, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end", CAST((SELECT coalesce(sum(n), 0) FROM s WHERE s.route = h.route AND t BETWEEN a AND b) AS BIGINT) AS n
FROM h QUALIFY row_number() OVER (PARTITION BY route, poll ORDER BY halved DESC) = 1""")
def halved_polls(spark: SparkSession, d: str) -> DataFrame:
    """The polls of a month by five routes, a day ahead each and under fifty rows."""
    seconds = table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("route"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).agg(F.count("*").alias("n"))
    return polling.polls(seconds, _BEGIN, _NOW, _MOST, _SPAN)
