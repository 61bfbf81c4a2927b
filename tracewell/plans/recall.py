"""Queries of memory and look-up operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import changes, memory
from ..session import table
from . import codegraph, investigation, observability
from .common import Registry

query = Registry()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id AS id", "text AS content")


@query("se_exact_content", "SELECT doc_id AS id, length(text) AS size FROM documents WHERE contains(text, 'token = ') ORDER BY 2, 1 LIMIT 20")
def exact_content(spark: SparkSession, d: str) -> DataFrame:
    return memory.exact_content(_docs(spark, d), "token = ")


@query("se_decorator_arg", "SELECT event_id AS id FROM events WHERE event_type = 'click' OR CAST(json_extract(props, '$.k') AS INTEGER) = 7")
def decorator_arg(spark: SparkSession, d: str) -> DataFrame:
    a = "'[\"' || event_type || '\",\"' || IF(event_type = 'click' OR get_json_object(props, '$.k') = '7', 'GET', 'post') || '\"]'"
    return memory.argument_search(table(spark, d, "events").selectExpr("event_id AS id", a + " AS args"), "get")


@query("se_colocated", "WITH m AS (SELECT doc_id AS id, instr(text, 'the ') AS a, text FROM documents WHERE instr(text, 'the ') > 0) SELECT id, unnest(list_distinct(regexp_extract_all(substr(text, greatest(a - 200, 1), least(a - 1, 200) + 204), '[A-Z][A-Z0-9]{3,}'))) AS code FROM m")
def colocated(spark: SparkSession, d: str) -> DataFrame:
    return memory.colocated_codes(_docs(spark, d), "the ")


@query("se_group_process", "SELECT p_partkey AS id, p_retailprice AS score, (SELECT min(l_suppkey) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45) AS process FROM part WHERE p_size = 7")
def group_process(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").selectExpr("l_partkey AS id", "l_suppkey AS process")
    return memory.by_process(table(spark, d, "part").filter("p_size = 7").selectExpr("p_partkey AS id", "p_retailprice AS score"), steps)


@query("se_embed_missing", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embed_missing(spark: SparkSession, d: str) -> DataFrame:
    return memory.to_embed(_docs(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("id")))


@query("se_stale_vec", "SELECT vec_id AS id FROM embeddings WHERE label <> 3 OR vec_id % 5 = 0")
def stale_vec(spark: SparkSession, d: str) -> DataFrame:
    return memory.stale_vectors(table(spark, d, "embeddings").selectExpr("vec_id AS id", "label AS scheme", "IF(vec_id % 5 = 0, IF(vec_id % 2 = 0, NULL, 'old'), 'new') AS model"), 3, "new")


_MEM = "m AS (SELECT o_orderkey AS id, 'sig-' || (o_custkey % 300) AS signature, CASE o_orderstatus WHEN 'O' THEN 'yes' WHEN 'F' THEN 'no' ELSE 'partly' END AS verdict, o_orderpriority AS cause FROM orders)"


@query("se_contradiction", f"WITH {_MEM}, h AS (SELECT signature, verdict, cause, min(id) AS id FROM m GROUP BY 1, 2, 3) SELECT a.id AS a, b.id AS b FROM h a JOIN h b USING (signature) WHERE a.id < b.id AND ((a.verdict = 'yes' AND b.verdict = 'no') OR (a.verdict = 'no' AND b.verdict = 'yes') OR (a.verdict = 'yes' AND b.verdict = 'yes' AND a.cause <> b.cause))")
def contradiction(spark: SparkSession, d: str) -> DataFrame:
    return memory.contradictions(table(spark, d, "orders").selectExpr("o_orderkey AS id", "'sig-' || (o_custkey % 300) AS signature", "CASE o_orderstatus WHEN 'O' THEN 'yes' WHEN 'F' THEN 'no' ELSE 'partly' END AS verdict", "o_orderpriority AS cause"))


@query("se_capture", """WITH o AS (SELECT 'c' || o_custkey % 50 AS signature, 'i' || o_orderkey AS i, o_orderdate AS t FROM orders), m AS (SELECT signature, count(*) AS n FROM o WHERE t < TIMESTAMP '1996-01-01' AND signature <> 'c7' GROUP BY 1), f AS (SELECT signature, count(*) AS n, list(i ORDER BY t, i) AS x FROM o WHERE t >= TIMESTAMP '1999-01-01' GROUP BY 1)
SELECT signature, coalesce(m.n, 0) + coalesce(f.n, 0) AS n, len(x) > 20 AS full_list, x[-1] AS newest FROM m FULL JOIN f USING (signature)""")
def capture(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").selectExpr("'c' || o_custkey % 50 AS signature", "'i' || o_orderkey AS investigation", "o_orderdate AS at")
    m = o.filter("at < TIMESTAMP_NTZ '1996-01-01' AND signature <> 'c7'").groupBy("signature").agg(F.count("*").alias("n"), F.array().cast("array<string>").alias("investigations"))
    out = memory.captured(m, o.filter("at >= TIMESTAMP_NTZ '1999-01-01'"))
    return out.select("signature", "n", (F.size("investigations") == 20).alias("full_list"), F.element_at("investigations", -1).alias("newest"))


@query("se_hint_signal", f"SELECT key, s AS score FROM (SELECT key, n, CASE WHEN key = 'error-3' THEN 1000 ELSE 0 END + CASE WHEN contains(lower(message), 'user 1') THEN 10 ELSE 0 END + CASE WHEN contains(lower(message), 'purchase') THEN 10 ELSE 0 END AS h, h + least(log10(n), 9) AS s FROM ({observability.query.oracles['agg_analyze_errors']})) WHERE n >= 2 AND h > 0 ORDER BY s DESC, key LIMIT 1")
def hint_signal(spark: SparkSession, d: str) -> DataFrame:
    return memory.best_signal(observability.analyze_errors(spark, d), ["error-3"], ["User 1", "purchase"])


@query("se_knowledge", "SELECT p_partkey AS id, p_type AS category FROM part WHERE contains(lower(p_name || chr(10) || p_brand), 'gear') ORDER BY list_position(['SMALL', 'LARGE', 'ECONOMY'], p_type) NULLS FIRST, p_partkey LIMIT 20")
def knowledge(spark: SparkSession, d: str) -> DataFrame:
    return memory.knowledge(table(spark, d, "part").selectExpr("p_partkey AS id", "p_type AS category", "p_name", "p_brand"), "Gear", ["p_name", "p_brand"], ["SMALL", "LARGE", "ECONOMY"])


@query("join_imports", f"WITH {codegraph._E} SELECT source AS file, target AS other, 'imports' AS direction FROM e WHERE rel = 'uses_type' AND source = 'p7' UNION ALL SELECT target, source, 'imported-by' FROM e WHERE rel = 'uses_type' AND target = 's3'")
def imports(spark: SparkSession, d: str) -> DataFrame:
    e = codegraph.edges(spark, d).withColumn("rel", F.expr("IF(rel = 'uses_type', 'imports', rel)"))
    return memory.imports_of(e, codegraph._ids(spark, "p7", "s3").withColumnRenamed("id", "file"))


@query("join_inbound_cross", f"WITH {codegraph._E}, {codegraph._N} SELECT source, target, rel, a.community AS from_file, b.community AS file FROM e JOIN n b ON b.id = target JOIN n a ON a.id = source WHERE b.community = 2 AND a.community <> 2")
def inbound(spark: SparkSession, d: str) -> DataFrame:
    n = codegraph.nodes(spark, d).withColumnRenamed("community", "file")
    return memory.inbound_from_elsewhere(codegraph.edges(spark, d), n, n.filter("file = 2").select("file").distinct())


@query("join_import_resolve", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_type || '/' || p_size || '.py' ELSE p_type || '/' || p_size || '/index.ts' END AS path FROM part WHERE p_size <= 30")
def import_resolve(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    files = p.filter("p_size <= 30").selectExpr("p_type || '/' || p_size || IF(p_size % 2 = 0, '.py', '/index.ts') AS path").union(p.filter("p_size <= 30 AND p_size % 2 = 0").selectExpr("p_type || '/' || p_size || '/__init__.py'"))
    return memory.resolved_imports(p.selectExpr("p_partkey AS id", "p_type || '.' || p_size AS module"), files)


@query("join_corpus", f"WITH {investigation._V}, k AS (SELECT id, investigation, CASE WHEN investigation IS NULL OR investigation >= 60 THEN 'unjoinable' WHEN resolved = 'partly' THEN 'quarantined' ELSE 'row' END AS route FROM c) SELECT id, route FROM k")
def corpus(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.evaluation import current_verdicts

    v = current_verdicts(investigation._verdicts(spark, d)).withColumn("resolved", F.expr("NULLIF(resolved, 'partly')"))
    reports = spark.range(60).select(F.col("id").alias("investigation"))
    return memory.routed_corpus(v, reports).select("id", "route")


@query("agg_prior_incidents", "WITH r AS (SELECT o_orderkey AS id FROM orders WHERE o_totalprice / 500000 >= 0.5 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50) SELECT l_suppkey AS node, count(DISTINCT id) AS n FROM r JOIN lineitem ON l_orderkey = id GROUP BY 1")
def prior_incidents(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("nodes"))
    o = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderdate AS at", "o_totalprice / 500000 AS confidence")
    return memory.prior_incidents(o.join(nodes, "id", "left"))


@query("st_state", """WITH e AS (SELECT user_id, event_id, ts, event_id + CASE WHEN event_id % 11 = 0 THEN 400 ELSE 0 END AS arrived, CASE WHEN event_type = 'purchase' THEN 'resolved' ELSE 'active' END AS state FROM events),
x AS (SELECT *, coalesce(ts < max(ts) OVER (PARTITION BY user_id ORDER BY arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS l, coalesce(state = 'active' AND lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'resolved', false) AS r FROM e)
SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(state, (ts, event_id)) = 'resolved' AS resolved, count(*) FILTER (l) AS late, count(*) FILTER (r) AS reopened FROM x GROUP BY 1""")
def st_state(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("user_id", "event_id", "ts", "event_id + IF(event_id % 11 = 0, 400, 0) AS arrived", "IF(event_type = 'purchase', 'resolved', 'active') AS state")
    return memory.job_states(e, "user_id", [F.col("ts"), F.col("event_id")])


@query("set_jaccard", "WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS k FROM conversations) SELECT conv_id, a.turn, coalesce(len(list_intersect(a.k, b.k)) / nullif(len(list_distinct(list_concat(a.k, b.k))), 0), 0) AS overlap FROM t a JOIN t b USING (conv_id) WHERE b.turn = a.turn + 1")
def set_jaccard(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("k"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("k").alias("k2"))
    return t.join(after, ["conv_id", "turn"]).select("conv_id", "turn", text.jaccard(F.col("k"), F.col("k2")).alias("overlap"))


@query("sc_recall_quality", "SELECT avg(CASE WHEN vec_id % 10 < 9 THEN 1.0 ELSE 0 END) FILTER (label <> 0) AS hit_rate, avg(CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 0 END) FILTER (label = 0) AS no_match_rate, false AS passes FROM embeddings")
def recall_quality(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "embeddings").selectExpr("vec_id AS id", "IF(label = 0, NULL, label) AS expected", "CASE WHEN label = 0 THEN IF(vec_id % 2 = 0, CAST(array() AS array<int>), array(1)) WHEN vec_id % 10 < 9 THEN array(99, label) ELSE array(97, 98, 99, label) END AS found")
    return changes.recall_quality(cases)


@query("agg_async_bound", "SELECT o_orderpriority AS queue, list_sort(list(DISTINCT o_custkey)) AS producers, list_sort(list(DISTINCT 'w' || o_orderstatus) FILTER (o_orderstatus <> 'P')) AS workers FROM orders GROUP BY 1")
def async_bound(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "orders").selectExpr("o_orderpriority AS queue", "o_custkey AS producer", "IF(o_orderstatus = 'P', NULL, 'w' || o_orderstatus) AS worker")
    return changes.queue_sides(edges)


@query("agg_distinct_callables", f"WITH {codegraph._E}, {codegraph._N} SELECT count(DISTINCT source) AS n FROM e JOIN n ON id = source WHERE rel = 'calls' AND label = 'function'")
def callables(spark: SparkSession, d: str) -> DataFrame:
    functions = codegraph.nodes(spark, d).filter("label = 'function'").select(F.col("id").alias("source"))
    return codegraph.edges(spark, d).filter("rel = 'calls'").join(functions, "source", "left_semi").agg(F.countDistinct("source").alias("n"))


@query("agg_file_comm", f"WITH {codegraph._N} SELECT name AS file, community, count(*) AS n FROM n GROUP BY 1, 2")
def file_comm(spark: SparkSession, d: str) -> DataFrame:
    return codegraph.nodes(spark, d).groupBy(F.col("name").alias("file"), "community").agg(F.count("*").alias("n"))


@query("set_evidence_union", f"WITH {investigation._EV} SELECT source, kind, count(*) AS n FROM ev GROUP BY 1, 2")
def evidence_union(spark: SparkSession, d: str) -> DataFrame:
    return investigation.gather(spark, d).groupBy("source", "kind").agg(F.count("*").alias("n"))
