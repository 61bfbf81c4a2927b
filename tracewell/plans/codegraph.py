"""Queries of graph, join and set operators on the driver tables.

Stand-in graph: parts are functions and suppliers classes; a returned item makes its part call the
supplier, an accepted one the supplier call the part, any other makes the part use the supplier's
type. A supplier's community is its region, a part's its size modulo 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import communities, graph
from ..session import table
from .common import Registry

query = Registry()


def edges(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    flag = F.col("l_returnflag")
    rows = table(spark, d, "lineitem").select(
        F.when(flag == "A", s).otherwise(p).alias("source"), F.when(flag == "A", p).otherwise(s).alias("target"), F.when(flag == "N", "uses_type").otherwise("calls").alias("rel"), "l_quantity"
    )
    return rows.groupBy("source", "target", "rel").agg((F.max("l_quantity") / 50).alias("confidence"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("community"))
    s = table(spark, d, "supplier").join(nation, "s_nationkey").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("class").alias("label"), F.col("s_name").alias("name"), "community")
    p = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("function").alias("label"), F.col("p_name").alias("name"), (F.col("p_size") % 5).alias("community"))
    return s.unionByName(p)


_E = """e AS (SELECT CASE l_returnflag WHEN 'A' THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS source, CASE l_returnflag WHEN 'A' THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS target,
 CASE l_returnflag WHEN 'N' THEN 'uses_type' ELSE 'calls' END AS rel, max(l_quantity) / 50 AS confidence FROM lineitem GROUP BY 1, 2, 3)"""
_N = """n AS (SELECT 's' || s_suppkey AS id, 'class' AS label, s_name AS name, n_regionkey AS community FROM supplier JOIN nation ON n_nationkey = s_nationkey
 UNION ALL SELECT 'p' || p_partkey, 'function', p_name, p_size % 5 FROM part)"""


def _ids(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query("join_neighbors", f"WITH {_E}, {_N} SELECT source AS of, id, name, confidence FROM e JOIN n ON n.id = target WHERE rel = 'calls' AND source IN ('s1', 's2', 'p7')")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(edges(spark, d), nodes(spark, d), _ids(spark, "s1", "s2", "p7"), "calls")


@query("join_edge_nbr", f"WITH {_E} SELECT source AS of, target AS id, rel, 'out' AS direction FROM e WHERE source IN ('s1', 'p7') UNION ALL SELECT target, source, rel, 'in' FROM e WHERE target IN ('s1', 'p7')")
def edge_nbr(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_neighbors(edges(spark, d), _ids(spark, "s1", "p7"))


@query("join_cross_comm", f"WITH {_E}, {_N} SELECT source, target, rel, a.community AS source_community, b.community AS target_community FROM e JOIN n a ON a.id = source JOIN n b ON b.id = target WHERE a.community <> b.community")
def cross_comm(spark: SparkSession, d: str) -> DataFrame:
    return graph.cross_community(edges(spark, d), nodes(spark, d))


@query("agg_degree", f"WITH {_E}, x AS (SELECT source AS id FROM e UNION ALL SELECT target FROM e) SELECT id, count(*) AS degree FROM x GROUP BY 1 ORDER BY degree DESC, id LIMIT 10")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(edges(spark, d))


@query("agg_counts", f"WITH {_E}, {_N} SELECT 'nodes' AS what, label AS key, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edges', rel, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'confidence', 'calls', CAST(floor(avg(confidence) * 1000 + 0.5) AS BIGINT) FROM e WHERE rel = 'calls'")
def counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.counts(nodes(spark, d), edges(spark, d))


_REACH = "WITH RECURSIVE {e}, r(id, depth) AS (SELECT '{start}', 0 UNION SELECT {to}, depth + 1 FROM r JOIN e ON e.{here} = r.id WHERE depth < {k} AND rel = 'calls'), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)"


@query("gr_traverse", _REACH.format(e=_E, start="p1", to="target", here="source", k=3) + " SELECT * FROM m WHERE depth > 0")
def traverse(spark: SparkSession, d: str) -> DataFrame:
    return graph.traverse(edges(spark, d), _ids(spark, "p1"), 3)


@query("gr_traverse_product", f"WITH RECURSIVE {_E}, {_N}, ok AS (SELECT id FROM n WHERE community <> 2), r(id, depth) AS (SELECT 'p1', 0 UNION SELECT target, depth + 1 FROM r JOIN e ON e.source = r.id WHERE depth < 3 AND rel = 'calls' AND target IN (SELECT id FROM ok)) SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0")
def traverse_product(spark: SparkSession, d: str) -> DataFrame:
    return graph.traverse(edges(spark, d), _ids(spark, "p1"), 3, allowed=nodes(spark, d).filter("community <> 2").select("id"))


@query("gr_impact", _REACH.format(e=_E, start="s1", to="source", here="target", k=3) + " SELECT depth, count(*) AS n FROM m WHERE depth > 0 GROUP BY 1")
def impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(edges(spark, d), _ids(spark, "s1"))


@query("gr_trace", f"""WITH {_E}, u AS (SELECT source AS a, target AS b FROM e WHERE rel = 'calls' UNION SELECT target, source FROM e WHERE rel = 'calls'),
h1 AS (SELECT b AS id, min(['p1', b]) AS path FROM u WHERE a = 'p1' GROUP BY 1),
h2 AS (SELECT b AS id, min(list_append(path, b)) AS path FROM h1 JOIN u ON a = id WHERE b <> 'p1' AND b NOT IN (SELECT id FROM h1) GROUP BY 1),
p AS (SELECT path FROM h1 WHERE id = 'p2' UNION ALL SELECT path FROM h2 WHERE id = 'p2')
SELECT CAST(generate_subscripts(path, 1) - 1 AS INTEGER) AS step, unnest(path) AS id FROM p""")
def trace(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_path(edges(spark, d), "p1", "p2")


@query("gr_cycles")
def cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(edges(spark, d))


@query("gr_community")
def community(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return graph.cohesion(e, graph.communities(e))


@query("gr_modularity", f"""WITH {_E}, {_N}, a AS (SELECT source, target, sum(w) AS w FROM (SELECT source, target, 1.0 AS w FROM e WHERE rel = 'calls' UNION ALL SELECT target, source, 1.0 FROM e WHERE rel = 'calls') GROUP BY 1, 2),
c AS (SELECT x.community AS own, sum(w) AS total, sum(CASE WHEN x.community = y.community THEN w ELSE 0 END) AS inner_ FROM a JOIN n x ON x.id = source JOIN n y ON y.id = target GROUP BY 1)
SELECT sum(inner_) / sum(total) - sum(total * total) / (sum(total) * sum(total)) AS modularity FROM c""")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    """How well the nodes' given communities part the graph."""
    labels = nodes(spark, d).select("id", F.col("community").cast("string").alias("community"))
    return communities.modularity(communities.arcs(edges(spark, d)), labels)


@query("gr_partition")
def partition(spark: SparkSession, d: str) -> DataFrame:
    """The best partition of nations by the trade between them: a supplier's nation calls the nation of the customer."""
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS l_suppkey", "concat('n', s_nationkey) AS source")
    c = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr("o_orderkey AS l_orderkey", "concat('n', c_nationkey) AS target")
    trade = table(spark, d, "lineitem").join(s, "l_suppkey").join(c, "l_orderkey").groupBy("source", "target").agg(F.sum("l_quantity").alias("q"))
    mean = trade.agg(F.avg("q").alias("mean"))  # one row
    return communities.best_communities(trade.crossJoin(F.broadcast(mean)).filter("q > mean").select("source", "target", F.lit("calls").alias("rel")))


@query("gr_insights", f"""WITH {_E}, {_N}, x AS (SELECT source AS id FROM e UNION ALL SELECT target FROM e),
hubs AS (SELECT id, count(*) AS degree FROM x GROUP BY 1 ORDER BY degree DESC, id LIMIT 10)
SELECT 'hub' AS kind, id AS a, NULL AS b, degree AS n FROM hubs
UNION ALL SELECT 'bridge', CAST(a.community AS VARCHAR), CAST(b.community AS VARCHAR), count(*) FROM e JOIN n a ON a.id = source JOIN n b ON b.id = target WHERE a.community <> b.community GROUP BY 2, 3""")
def insights(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    hubs = graph.degrees(e).select(F.lit("hub").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("degree").alias("n"))
    pairs = graph.cross_community(e, nodes(spark, d)).groupBy("source_community", "target_community").agg(F.count("*").alias("n"))
    return hubs.union(pairs.select(F.lit("bridge"), F.col("source_community").cast("string"), F.col("target_community").cast("string"), "n"))


@query("agg_cochange", """WITH r AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem), t AS (SELECT f, count(*) AS total FROM r GROUP BY 1),
p AS (SELECT a.f AS file, b.f AS other, count(*) AS co FROM r a JOIN r b ON a.c = b.c AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT file, other, co, co / greatest(x.total, y.total) AS strength FROM p JOIN t x ON x.f = file JOIN t y ON y.f = other WHERE co / greatest(x.total, y.total) >= 0.08""")
def cochange(spark: SparkSession, d: str) -> DataFrame:
    return graph.cochange(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")), 3, 0.08)


@query("join_hidden_dep", """WITH r AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem),
p AS (SELECT a.f AS file, b.f AS other, count(*) AS co FROM r a JOIN r b ON a.c = b.c AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 3),
i AS (SELECT DISTINCT a.l_partkey AS x, b.l_partkey AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R')
SELECT file, other, co FROM p WHERE NOT EXISTS (SELECT 1 FROM i WHERE x = file AND y = other)""")
def hidden_dep(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"), "l_returnflag")
    imported = graph.cochange(rows.filter("l_returnflag = 'R'"), 1, 0.0).select("file", "other")
    return graph.cochange(rows, 3, 0.0).select("file", "other", "co").join(imported, ["file", "other"], "left_anti")


@query("join_dead_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1999-01-01')")
def dead_anti(spark: SparkSession, d: str) -> DataFrame:
    late = table(spark, d, "orders").filter("o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP_NTZ '1999-01-01'").withColumnRenamed("o_custkey", "c_custkey")
    return graph.unused(table(spark, d, "customer"), late, "c_custkey").select("c_custkey", "c_name")


@query("join_type_semi", "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '2000-01-01')")
def type_semi(spark: SparkSession, d: str) -> DataFrame:
    late = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_shipdate >= TIMESTAMP_NTZ '2000-01-01'").withColumnRenamed("l_partkey", "p_partkey")
    return graph.used(table(spark, d, "part"), late, "p_partkey").select("p_partkey", "p_name")


@query("join_interval", """WITH s AS (SELECT l_orderkey || ':' || l_linenumber AS id, l_partkey AS key, CAST(l_quantity AS INTEGER) AS start, CAST(l_quantity AS INTEGER) + l_linenumber AS stop FROM lineitem)
SELECT id, key, start, stop, lo, hi FROM s JOIN (SELECT p_partkey AS key, p_size AS lo, p_size + 3 AS hi FROM part) USING (key) WHERE start <= hi AND stop >= lo""")
def interval(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "lineitem").selectExpr("l_orderkey || ':' || l_linenumber AS id", "l_partkey AS key", "CAST(l_quantity AS INT) AS start", "CAST(l_quantity AS INT) + l_linenumber AS stop")
    return graph.overlapping(spans, table(spark, d, "part").selectExpr("p_partkey AS key", "p_size AS lo", "p_size + 3 AS hi"), "key").select("id", "key", "start", "stop", "lo", "hi")


@query("join_containing", """WITH s AS (SELECT l_orderkey AS id, l_partkey AS key, CAST(l_quantity AS INTEGER) AS start, CAST(l_quantity AS INTEGER) + l_linenumber AS stop FROM lineitem),
h AS (SELECT p_partkey AS point, id, stop - start AS size, row_number() OVER (PARTITION BY p_partkey ORDER BY stop - start, id) AS r FROM part JOIN s ON key = p_partkey WHERE start <= p_size AND p_size <= stop)
SELECT point, id, size FROM h WHERE r = 1""")
def containing(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "lineitem").selectExpr("l_orderkey AS id", "l_partkey AS key", "CAST(l_quantity AS INT) AS start", "CAST(l_quantity AS INT) + l_linenumber AS stop")
    return graph.containing(spans, table(spark, d, "part").selectExpr("p_partkey AS point", "p_partkey AS key", "p_size AS at"), "key")


@query("set_diff_graph", """WITH b AS (SELECT o_custkey AS id, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), c AS (SELECT o_custkey AS id, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1)
SELECT id, CASE WHEN b.n IS NULL THEN 'added' WHEN c.n IS NULL THEN 'removed' ELSE 'modified' END AS change FROM b FULL JOIN c USING (id) WHERE b.n IS NULL OR c.n IS NULL OR b.n <> c.n OR b.s <> c.s""")
def diff_graph(spark: SparkSession, d: str) -> DataFrame:
    snap = lambda f: table(spark, d, "orders").filter(f).groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("s"))
    return graph.diff(snap("o_orderdate < TIMESTAMP_NTZ '1996-01-01'"), snap("o_orderdate >= TIMESTAMP_NTZ '2001-01-01'"), "id", ["n", "s"])


@query("join_queue", "SELECT coalesce(s_nationkey, c_nationkey) AS queue, s_suppkey AS producer, c_custkey AS worker FROM (SELECT * FROM supplier WHERE s_acctbal > 0) FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON s_nationkey = c_nationkey")
def queue(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "supplier").filter("s_acctbal > 0").selectExpr("s_nationkey AS queue", "s_suppkey AS producer")
    return graph.queue_edges(p, table(spark, d, "customer").filter("c_acctbal > 9000").selectExpr("c_nationkey AS queue", "c_custkey AS worker"))


@query("join_protocol", """WITH h AS (SELECT DISTINCT s_nationkey AS owner, l_returnflag || l_linestatus AS item FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 49), w AS (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS grp, l_returnflag || l_linestatus AS item FROM lineitem WHERE l_quantity = 1)
SELECT h.owner, w.grp AS "group" FROM h JOIN w USING (item) GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM w x WHERE x.grp = w.grp)""")
def protocol(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    item = F.concat("l_returnflag", "l_linestatus").alias("item")
    have = items.filter("l_quantity > 49").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").alias("owner"), item)
    return graph.covers(have, items.filter("l_quantity = 1").select(F.col("l_linenumber").cast("string").alias("group"), item))


@query("join_call_resolve", """WITH sym AS (SELECT p_brand AS name, 'p' || p_partkey AS id, p_type || '/' || p_size AS file FROM part WHERE p_size <= 5), cal AS (SELECT p_partkey AS call, p_brand AS name, p_type || '/' || (p_size % 5) AS file FROM part),
imp AS (SELECT DISTINCT p_type || '/' || (p_size % 5) AS file, p_type || '/' || (p_size % 5 + 1) AS target FROM part), j AS (SELECT call, id, cal.file, sym.file AS place, cal.name FROM cal JOIN sym USING (name)),
g AS (SELECT name FROM sym GROUP BY 1 HAVING count(*) <= 5 AND count(DISTINCT file) <= 3 AND length(name) > 3),
a AS (SELECT call, id, 0 AS rank, 1.0 AS confidence, file, place FROM j WHERE file = place UNION ALL SELECT call, id, 1, 1.0, j.file, place FROM j JOIN imp ON imp.file = j.file AND imp.target = place WHERE j.file <> place UNION ALL SELECT call, id, 2, 0.5, file, place FROM j WHERE name IN (SELECT name FROM g)),
r AS (SELECT *, row_number() OVER (PARTITION BY call ORDER BY rank, CASE WHEN split_part(file, '/', 1) = split_part(place, '/', 1) THEN 1 ELSE 0 END DESC, id) AS nth FROM a)
SELECT call, id, CAST(confidence AS DOUBLE) AS confidence FROM r WHERE nth = 1""")
def call_resolve(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    sym = p.filter("p_size <= 5").selectExpr("p_brand AS name", "'p' || p_partkey AS id", "p_type || '/' || p_size AS file")
    calls = p.selectExpr("p_partkey AS call", "p_brand AS name", "p_type || '/' || (p_size % 5) AS file")
    imports = p.selectExpr("p_type || '/' || (p_size % 5) AS file", "p_type || '/' || (p_size % 5 + 1) AS target").distinct()
    return graph.resolve_calls(calls, sym, imports)
