"""Queries of the full-text index and of the reranker's features, on documents and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import questions, reranker, search, walkthrough
from ..operators.textindex import TextIndex
from ..session import new_folder, table
from . import searching
from .common import Registry, literal

query = Registry()


@query("se_fts_index", searching.query.oracles["se_fts"])
def fts_index(spark: SparkSession, d: str) -> DataFrame:
    """The same search over the written index, which is built first."""
    index = TextIndex(new_folder(spark)).write(table(spark, d, "documents"), "doc_id")
    return index.search(spark, searching.TERMS, 60).withColumn("score", F.round("score", 9))


_CANDIDATES = [
    "doc_id % 97 AS inv", "doc_id AS id", "doc_id % 100 / 100.0D AS final_score", "doc_id % 8 / 8.0D AS confidence", "CASE WHEN doc_id % 9 > 0 THEN doc_id % 3 / 4.0D END AS base_score", "quality",
    "slice(array(source, lang, 'a', 'b'), 1, CAST(doc_id % 4 AS INT)) AS ids", "slice(array(source, lang), 1, CAST(doc_id % 3 AS INT)) AS nodes",
    "array(named_struct('factor', concat('r', doc_id % 5), 'delta', doc_id % 7 / 8.0D), named_struct('factor', lang, 'delta', 0.25D), named_struct('factor', concat('r', doc_id % 2), 'delta', -0.125D)) AS explanations",
]


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as candidate causes."""
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").selectExpr(*_CANDIDATES)


_VOCABULARY = """c AS (SELECT doc_id % 97 AS inv, doc_id AS id, doc_id, lang FROM labels JOIN documents USING (doc_id)),
e AS (SELECT inv, id, 'r' || doc_id % 5 AS factor, doc_id % 7 / 8.0 AS delta FROM c UNION ALL SELECT inv, id, lang, 0.25 FROM c UNION ALL SELECT inv, id, 'r' || doc_id % 2, -0.125 FROM c),
v AS (SELECT CAST(row_number() OVER (ORDER BY grp, key) - 1 AS INTEGER) AS place, key FROM (SELECT 0 AS grp, NULL AS key WHERE false UNION ALL SELECT 1, 'f:' || factor FROM (SELECT DISTINCT factor FROM e WHERE factor IS NOT NULL)))"""


@query("ml_vocabulary", f"WITH {_VOCABULARY} SELECT place + 5 AS place, key FROM v UNION ALL SELECT * FROM (VALUES (0, 'finalScore'), (1, 'confidence'), (2, 'baseScore'), (3, 'evidenceCount'), (4, 'affectedCount')) s(place, key)")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return reranker.vocabulary(candidates(spark, d))


@query("ml_features", f"""WITH {_VOCABULARY}, s AS (SELECT inv, id, place + 5 AS place, sum(delta) AS value FROM e JOIN v ON key = 'f:' || factor GROUP BY 1, 2, 3
 UNION ALL SELECT inv, id, 0, doc_id % 100 / 100.0 FROM c UNION ALL SELECT inv, id, 1, doc_id % 8 / 8.0 FROM c UNION ALL SELECT inv, id, 2, CASE WHEN doc_id % 9 > 0 THEN doc_id % 3 / 4.0 ELSE 0 END FROM c UNION ALL SELECT inv, id, 3, doc_id % 4 FROM c UNION ALL SELECT inv, id, 4, doc_id % 3 FROM c)
SELECT inv, id, coalesce(list(place ORDER BY place) FILTER (value <> 0), []) AS places, coalesce(list(CAST(value AS DOUBLE) ORDER BY place) FILTER (value <> 0), []) AS "values" FROM s GROUP BY 1, 2""")
def features(spark: SparkSession, d: str) -> DataFrame:
    return reranker.features(candidates(spark, d))


@query("ml_rerank")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by a model of whether their document is good; sixty epochs."""
    rows = candidates(spark, d)
    marked = reranker.features(rows).join(rows.select("inv", "id", "quality"), ["inv", "id"])
    size = reranker.vocabulary(rows).count()
    weights, bias = reranker.fit(marked, size, "quality", epochs=60)
    return reranker.scored(marked, weights, bias).select("inv", "id", "quality", "score")


#: Questions asked in turns of conversations, each followed by what the turn says; customers are explanations and gaps of twenty reports.
_ASKED = ["What contradicts the backlog?", "Does anything argue against a redis outage?", "rule out retry", "what is missing", "Which gaps are there? ", "why not higher", "Are you sure about the deploy", "evidence against it", "tell me more", "WHAT ELSE", "refute the external latency claim", "disprove worker stalls or the worker stall"]
_KIND = ["'queue-backlog'", "'worker-slowdown'", "'deployment-regression'", "'external-api-latency'", "'retry-storm'", "'benign-variance'"]
_pick = lambda values, by: "CASE " + by + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
_SAID = "concat(" + _pick([f"'{q}'" for q in _ASKED], f"(conv_id + turn) % {len(_ASKED)}") + ", ' ', coalesce(text, ''))"
_IMPACT = "CAST(CASE c_custkey % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.08 WHEN 2 THEN 0.07 ELSE 0.05 END AS DOUBLE)"
_DIM = _pick(["'logs'", "'state'", "'traces'", "'owner'"], "c_custkey % 4")
_VERDICT = _pick(["'supported'", "'weakened'", "'unconfirmed'", "'eliminated'"], "c_nationkey % 4")
_word = lambda words: "\\b(?:" + words.replace(" ", "|") + ")\\b"
_QA = f"""q AS (SELECT conv_id || ':' || turn AS question, conv_id % 25 AS report, {_SAID} AS text FROM conversations),
h AS (SELECT c_custkey % 20 AS report, {_pick(_KIND, 'c_custkey // 20 % 6')} AS category, {_VERDICT} AS verdict, ['e1', 'e2', 'gone'][1:CAST(c_custkey // 7 % 4 AS INT)] AS contradicts FROM customer WHERE c_custkey // 20 % 6 <> 3 OR c_custkey % 20 < 9),
g AS (SELECT DISTINCT c_custkey % 20 AS report, {_DIM} AS dimension, {_IMPACT} AS impact FROM customer WHERE c_custkey % 20 < 11 AND c_custkey % 3 = 0),
k AS (SELECT *, CASE WHEN regexp_matches(text, '{questions.KINDS['confidence']}') THEN 'confidence' WHEN regexp_matches(text, '{questions.KINDS['contradicts']}') THEN 'contradicts' WHEN regexp_matches(text, '{questions.KINDS['missing-evidence'].replace("'", "''")}') THEN 'missing-evidence' END AS kind,
 CASE {' '.join(f"WHEN lower(trim(text)) = '{t}' OR regexp_matches(text, '(?i){_word(w)}') THEN '{t}'" for t, (w, _) in questions.TOPICS.items())} END AS topic FROM q),
m AS (SELECT *, CASE topic {' '.join(f"WHEN '{t}' THEN '{c}'" for t, (_, c) in questions.TOPICS.items())} END AS category FROM k WHERE kind IS NOT NULL),
a AS (SELECT DISTINCT report, category, unnest(contradicts) AS id FROM h), s AS (SELECT * FROM a WHERE id <> 'gone'),
x AS (SELECT *, topic IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h WHERE h.report = m.report AND h.category = m.category) AS unmet FROM m),
y AS (SELECT *, coalesce(CASE WHEN kind = 'contradicts' THEN CASE WHEN unmet THEN (SELECT list(DISTINCT category ORDER BY category) FROM h WHERE h.report = x.report) WHEN topic IS NOT NULL THEN (SELECT list(DISTINCT id ORDER BY id) FROM s WHERE s.report = x.report AND s.category = x.category) ELSE (SELECT list(DISTINCT id ORDER BY id) FROM s WHERE s.report = x.report) END
  WHEN kind = 'confidence' THEN (SELECT list(dimension ORDER BY impact DESC, dimension) FROM g WHERE g.report = x.report) ELSE (SELECT list(dimension ORDER BY dimension) FROM g WHERE g.report = x.report) END, []) AS items,
 coalesce(CASE WHEN kind = 'contradicts' AND topic IS NOT NULL THEN (SELECT list(DISTINCT verdict ORDER BY verdict) FROM h WHERE h.report = x.report AND h.category = x.category) WHEN kind = 'confidence' THEN (SELECT list(DISTINCT category ORDER BY category) FROM h WHERE h.report = x.report AND verdict IN ('weakened', 'unconfirmed')) END, []) AS verdicts FROM x)"""


@query("x_qa", f"""WITH {_QA} SELECT question, report, kind, topic, CASE kind WHEN 'contradicts' THEN CASE WHEN unmet THEN 'not-evaluated' WHEN len(items) > 0 THEN 'contradicted' ELSE 'uncontradicted' END WHEN 'confidence' THEN CASE WHEN len(items) > 0 THEN 'capped' ELSE 'uncapped' END ELSE CASE WHEN len(items) > 0 THEN 'gaps' ELSE 'no-gaps' END END AS answer,
 CAST(len(items) AS INTEGER) AS n, items, verdicts, CASE WHEN kind = 'confidence' AND report < 20 THEN report / 20.0 END AS confidence, CASE WHEN kind = 'confidence' AND report < 20 THEN 1 - coalesce((SELECT sum(impact) FROM g WHERE g.report = y.report), 0) END AS ceiling FROM y""")
def answered(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of the conversations as a question about a saved report."""
    people = table(spark, d, "customer")
    asked = table(spark, d, "conversations").selectExpr("concat(conv_id, ':', turn) AS question", "conv_id % 25 AS report", f"{_SAID} AS text")
    told = people.filter("floor(c_custkey / 20) % 6 <> 3 OR c_custkey % 20 < 9").selectExpr("c_custkey % 20 AS report", "c_custkey AS id", f"{_pick(_KIND, 'CAST(floor(c_custkey / 20) % 6 AS INT)')} AS category", f"{_VERDICT} AS verdict", "slice(array('e1', 'e2', 'gone'), 1, CAST(floor(c_custkey / 7) % 4 AS INT)) AS contradicts")
    known = spark.range(20).select(F.col("id").alias("report"), F.explode(F.array(F.lit("e1"), F.lit("e2"))).alias("id"))
    gaps = people.filter("c_custkey % 20 < 11 AND c_custkey % 3 = 0").selectExpr("c_custkey % 20 AS report", f"{_DIM} AS dimension", f"{_IMPACT} AS impact").distinct()
    sums = gaps.groupBy("report").agg(F.sum("impact").alias("lost"))
    totals = people.selectExpr("c_custkey % 20 AS report").distinct().join(sums, "report", "left").selectExpr("report", "report / 20.0D AS confidence", "1 - coalesce(lost, 0) AS ceiling")
    return questions.answers(asked, told, known, gaps, totals)


#: Parts and customers as symbols with labels, paths and bodies, orders as memories of one day.
_NAMED = ["CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'folder' ELSE 'method' END AS label", "CASE p_partkey % 7 WHEN 0 THEN '_' WHEN 1 THEN '#' ELSE '' END || p_name AS name"]


@query("sort_name_contains", f"""SELECT id, name, CAST(0.5 AS DOUBLE) AS score FROM (SELECT p_partkey AS id, {', '.join(_NAMED)} FROM part) WHERE contains(lower(name), 'o') AND label <> 'folder'
 ORDER BY left(name, 1) IN ('_', '#'), length(name), label NOT IN ('class', 'interface'), id LIMIT 60""")
def sorted_names(spark: SparkSession, d: str) -> DataFrame:
    return search.name_contains(table(spark, d, "part").selectExpr("p_partkey AS id", *_NAMED), "O", 60)


_SYMBOLS = ["c_custkey AS id", "c_mktsegment AS name", "CASE c_custkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'process' WHEN 2 THEN 'function' ELSE 'method' END AS label", "CASE c_custkey % 5 WHEN 0 THEN 'tests/a.ts' WHEN 1 THEN 'src/a_test.go' WHEN 2 THEN 'src/contests/a.ts' ELSE 'src/a.ts' END AS path", "repeat('x', CAST(c_custkey % 17 AS INT)) AS body"]


@query("sort_exact", f"""SELECT id, name, CAST(1.0 AS DOUBLE) AS score FROM (SELECT {', '.join(_SYMBOLS)} FROM customer) WHERE lower(name) = 'building' AND label <> 'process'
 ORDER BY CASE WHEN path IN ('tests/a.ts', 'src/a_test.go') THEN 10 ELSE 0 END + CASE WHEN label = 'class' THEN 1 ELSE 0 END, length(body), id LIMIT 200""")
def sorted_exact(spark: SparkSession, d: str) -> DataFrame:
    return search.exact_name(table(spark, d, "customer").selectExpr(*_SYMBOLS), "Building", 200)


_MEMORIES = ["o_orderkey AS id", "CAST(floor(o_totalprice / 100000) AS DOUBLE) / 8 AS confidence", "o_orderkey % 3 / 4.0 AS relevance", "CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS verified_at", "CASE o_orderstatus WHEN 'P' THEN 'possibly-stale' WHEN 'F' THEN 'rejected' ELSE 'active' END AS status", "o_orderkey % 50 = 0 AS pinned"]


@query("sort_recalled", f"""SELECT id, rank FROM (SELECT *, confidence * CASE WHEN status = 'possibly-stale' THEN 0.5 ELSE 1 END + CASE WHEN pinned THEN 1 ELSE 0 END AS rank FROM (SELECT {', '.join(_MEMORIES)} FROM orders)) WHERE status <> 'rejected'
 ORDER BY rank DESC, relevance DESC, confidence DESC, verified_at DESC NULLS LAST, id LIMIT 100""")
def sorted_recalled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr(*_MEMORIES, "TIMESTAMP_NTZ '2001-08-05' AS at")
    return search.recall_memory(rows, F.expr("TIMESTAMP_NTZ '2001-08-05'"), 100)


#: Documents as symbols: some store, some call outside, some log; seven in a row make a flow, eleven another; every sixth is a class.
_WORDS = ["order.save", "charge", "axios.post", "getLogger", "api.call", "users.find", "emit", "build", "httpGet", "persist", "x", "queue.push"]
_BEHAVES = ["doc_id AS id", f"{_pick([f"'{w}'" for w in _WORDS], f'doc_id % {len(_WORDS)}')} AS name", "CASE WHEN doc_id % 17 = 3 THEN 'lib/telemetry.ts' WHEN doc_id % 19 = 4 THEN 'src/order.repository.ts' ELSE 'src/m' || doc_id % 40 || '.ts' END AS file"]
_WALK = f"""sy AS (SELECT {', '.join(_BEHAVES)} FROM documents),
fl AS (SELECT 'f' || id // 7 AS flow, id % 7 AS step, id FROM sy WHERE id // 7 % 3 > 0 UNION ALL SELECT 'g' || id // 11, id % 11, id FROM sy WHERE id % 5 = 1),
be AS (SELECT id, flow FROM fl JOIN (SELECT flow, count(*) AS n FROM fl GROUP BY 1) USING (flow) WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, flow) = 1),
po AS (SELECT p.*, y.name, y.file, be.flow, regexp_matches(y.name, {literal(walkthrough.STORES)}) OR regexp_matches(y.file, {literal(walkthrough.STORES)}) AS keeps, regexp_matches(y.name, {literal(walkthrough.CALLS_OUT)}) OR regexp_matches(y.file, {literal(walkthrough.CALLS_OUT)}) AS asks FROM (
 SELECT be.id, fl.id AS step_id, 0 AS part, step AS at_ FROM be JOIN fl USING (flow) UNION ALL SELECT id, id, 0, 0 FROM sy WHERE id NOT IN (SELECT id FROM be)
 UNION ALL SELECT id, id // 2, 1, 0 FROM sy WHERE id // 2 <> id UNION ALL SELECT id, id // 3, 1, 1 FROM sy WHERE id // 3 <> id AND id // 3 <> id // 2 UNION ALL SELECT id, id + k, 2, k FROM sy, (VALUES (1), (2)) v(k) WHERE id % 6 = 0) p
 JOIN sy y ON y.id = p.step_id LEFT JOIN be ON be.id = p.id WHERE NOT regexp_matches(y.name, {literal(walkthrough.NOISE_NAME)}) AND NOT regexp_matches(y.file, {literal(walkthrough.NOISE_FILE)})),
on_ AS (SELECT * FROM po QUALIFY row_number() OVER (PARTITION BY id, name, file ORDER BY part, at_, step_id) = 1),
ch AS (SELECT id, list(name ORDER BY part, at_, step_id) AS steps FROM po WHERE CASE WHEN flow IS NULL THEN part < 2 ELSE part = 0 END GROUP BY 1),
me AS (SELECT id, list(name ORDER BY part, at_, step_id) AS methods FROM on_ WHERE part = 2 GROUP BY 1),
ke AS (SELECT id, list(name ORDER BY part, at_, step_id)[1:6] AS stores FROM on_ WHERE keeps GROUP BY 1),
ou AS (SELECT on_.id, list(name ORDER BY part, at_, step_id)[1:6] AS calls_out FROM on_ LEFT JOIN ke USING (id) WHERE asks AND NOT coalesce(list_contains(stores, name), false) GROUP BY 1)"""


@query("x_behavior", f"""WITH {_WALK} SELECT sy.id, CASE WHEN len(steps) > 1 THEN CASE WHEN flow IS NOT NULL THEN 'flow' ELSE 'calls' END WHEN len(methods) > 0 THEN 'class' ELSE 'alone' END AS kind, flow, coalesce(steps[1], sy.name) AS entry,
 CASE WHEN coalesce(len(steps), 0) <= 1 AND len(methods) > 0 THEN methods ELSE coalesce(steps, []) END AS steps, coalesce(stores, []) AS stores, coalesce(calls_out, []) AS calls_out
 FROM sy LEFT JOIN be USING (id) LEFT JOIN ch USING (id) LEFT JOIN me USING (id) LEFT JOIN ke USING (id) LEFT JOIN ou USING (id)""")
def behaviour(spark: SparkSession, d: str) -> DataFrame:
    """How every symbol works."""
    docs = table(spark, d, "documents")
    f = docs.filter("floor(doc_id / 7) % 3 > 0").selectExpr("concat('f', floor(doc_id / 7)) AS flow", "doc_id % 7 AS step", "doc_id AS id")
    g = docs.filter("doc_id % 5 = 1").selectExpr("concat('g', floor(doc_id / 11)) AS flow", "doc_id % 11 AS step", "doc_id AS id")
    targets = "array(named_struct('target', floor(doc_id / 2), 'seq', 0), named_struct('target', floor(doc_id / 3), 'seq', 1))"
    called = docs.selectExpr("doc_id AS source", f"inline({targets})").filter("target <> source").groupBy("source", "target").agg(F.min("seq").alias("seq"))
    members = docs.filter("doc_id % 6 = 0").selectExpr("doc_id AS id", "inline(array(named_struct('method', doc_id + 1, 'seq', 1), named_struct('method', doc_id + 2, 'seq', 2)))")
    return walkthrough.walkthroughs(docs.selectExpr("doc_id AS id"), docs.selectExpr(*_BEHAVES), f.union(g), called, members)
