"""Queries of name resolution and of what changes and incidents share, on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve
from ..session import table
from . import codegraph
from .common import Registry

query = Registry()

_FILE = "CASE p_size % 3 WHEN 0 THEN 'src/' || p_type || '.py' WHEN 1 THEN 'src/' || p_type || '.ts' ELSE 'lib/' || p_type || '.js' END"
_FAM = "CASE WHEN {0} LIKE '%.py' THEN 'py' ELSE 'js' END"


@query("join_receiver", f"""WITH m AS (SELECT 'p' || p_partkey AS id, p_name AS name, p_brand AS receiver, {_FILE} AS place FROM part), c AS (SELECT p_partkey AS call, p_brand AS receiver, p_name AS name, {_FILE.replace('p_size', '(p_size + 1)')} AS file FROM part),
h AS (SELECT call, id, row_number() OVER (PARTITION BY call ORDER BY file <> place, id) AS r FROM c JOIN m USING (name, receiver) WHERE file = place OR {_FAM.format('file')} = {_FAM.format('place')}) SELECT call, id, 0.8 AS confidence FROM h WHERE r = 1""")
def receiver(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    methods = p.selectExpr("'p' || p_partkey AS id", "p_name AS name", "p_brand AS class_name", f"{_FILE} AS file")
    calls = p.selectExpr("p_partkey AS call", "p_brand AS receiver", "p_name AS name", f"{_FILE.replace('p_size', '(p_size + 1)')} AS file")
    return resolve.receivers(calls, methods)


_NAMED = f"s AS (SELECT 'p' || p_partkey AS id, p_name AS name, {_FILE} AS place FROM part), u AS (SELECT p_partkey AS use, p_name AS name, {_FILE.replace('p_size', '(p_size + 2)')} AS file FROM part)"


@query("join_type_resolve", f"WITH {_NAMED} SELECT use, id FROM (SELECT use, id, row_number() OVER (PARTITION BY use ORDER BY file <> place, id) AS r FROM u JOIN s USING (name)) WHERE r = 1")
def type_resolve(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return resolve.named(p.selectExpr("p_partkey AS use", "p_name AS name", f"{_FILE.replace('p_size', '(p_size + 2)')} AS file"), p.selectExpr("'p' || p_partkey AS id", "p_name AS name", f"{_FILE} AS file"))


@query("join_heritage_resolve", f"""WITH s AS (SELECT 'p' || p_partkey AS id, p_name AS name, {_FILE} AS place FROM part), c AS (SELECT DISTINCT p_name AS class_name, CASE p_size % 4 WHEN 0 THEN 'mixes' WHEN 1 THEN 'implements' ELSE 'extends' END AS kind, CASE WHEN p_size > 45 THEN 'Unknown' ELSE split_part(p_name, ' ', 1) || ' bolt' END AS parent, {_FILE} AS file FROM part),
x AS (SELECT * FROM c WHERE kind <> 'mixes'), a AS (SELECT class_name, kind, parent, file, arg_min(id, (file <> place)::INT || id) AS source FROM x JOIN s ON name = class_name GROUP BY 1, 2, 3, 4), b AS (SELECT class_name, kind, parent, file, arg_min(id, (file <> place)::INT || id) AS target FROM x JOIN s ON name = parent GROUP BY 1, 2, 3, 4)
SELECT DISTINCT source, target, kind AS rel FROM a JOIN b USING (class_name, kind, parent, file)""")
def heritage_resolve(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    declared = p.selectExpr("p_name AS class_name", "CASE p_size % 4 WHEN 0 THEN 'mixes' WHEN 1 THEN 'implements' ELSE 'extends' END AS kind", "IF(p_size > 45, 'Unknown', split_part(p_name, ' ', 1) || ' bolt') AS parent", f"{_FILE} AS file").distinct()
    return resolve.heritage(declared, p.selectExpr("'p' || p_partkey AS id", "p_name AS name", f"{_FILE} AS file"))


@query("join_siblings", f"WITH {_NAMED}, h AS (SELECT use AS call, id, count(*) OVER (PARTITION BY use) AS k FROM u JOIN s ON u.name = s.name AND file = place) SELECT call, id, 0.4 AS confidence FROM h WHERE k BETWEEN 2 AND 5")
def siblings(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return resolve.siblings(p.selectExpr("p_partkey AS call", "p_name AS name", f"{_FILE.replace('p_size', '(p_size + 2)')} AS file"), p.selectExpr("'p' || p_partkey AS id", "p_name AS name", f"{_FILE} AS file"))


@query("join_arguments", f"WITH {_NAMED} SELECT use AS call, id, CASE WHEN file = place THEN 0.8 ELSE 0.4 END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY use ORDER BY file <> place, id) AS r FROM u JOIN s USING (name)) WHERE r = 1")
def arguments(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return resolve.arguments(p.selectExpr("p_partkey AS call", "p_name AS name", f"{_FILE.replace('p_size', '(p_size + 2)')} AS file"), p.selectExpr("'p' || p_partkey AS id", "p_name AS name", f"{_FILE} AS file"))


@query("join_heritage", f"WITH {codegraph._E}, {codegraph._N} SELECT source AS id, name AS parent, CASE WHEN confidence > 0.9 THEN 'extends' ELSE 'implements' END AS rel FROM e JOIN n ON n.id = target WHERE rel = 'uses_type' AND source LIKE 'p1%'")
def heritage(spark: SparkSession, d: str) -> DataFrame:
    """The parents of the nodes whose id begins with p1; a use of a type stands in for heritage."""
    from ..operators import graph

    e = codegraph.edges(spark, d).filter("rel = 'uses_type'").withColumn("rel", F.when(F.col("confidence") > 0.9, "extends").otherwise("implements"))
    asked = codegraph.nodes(spark, d).filter("id LIKE 'p1%'").select("id")
    found = asked.join(e.withColumnRenamed("source", "id"), "id").join(codegraph.nodes(spark, d).select(F.col("id").alias("target"), F.col("name").alias("parent")), "target")
    return found.select("id", "parent", "rel")


_PAIRS = "cp AS (SELECT 'f' || l_partkey % 40 AS a, 'f' || (40 + l_suppkey % 40) AS b, max(l_quantity) / 50 AS strength, count(*) AS together FROM lineitem GROUP BY 1, 2)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.expr("'f' || l_partkey % 40").alias("a"), F.expr("'f' || (40 + l_suppkey % 40)").alias("b")).agg((F.max("l_quantity") / 50).alias("strength"), F.count("*").alias("together"))


@query("join_coupled_file", f"WITH {_PAIRS} SELECT * FROM (SELECT a AS file, b AS other, strength, together FROM cp UNION ALL SELECT b, a, strength, together FROM cp) WHERE file IN ('f1', 'f2', 'f41')")
def coupled_file(spark: SparkSession, d: str) -> DataFrame:
    return resolve.coupled_files(_pairs(spark, d), spark.createDataFrame([("f1",), ("f2",), ("f41",)], "file string"))


@query("join_missing_cochange", f"WITH {_PAIRS}, c AS (SELECT n_regionkey AS change, 'f' || n_nationkey AS file FROM nation UNION SELECT n_regionkey, 'f' || (40 + n_nationkey % 4) FROM nation) SELECT change, b AS other, max(strength) AS strength FROM c JOIN (SELECT a, b, strength FROM cp UNION ALL SELECT b, a, strength FROM cp) p ON p.a = c.file WHERE strength >= 0.5 AND NOT EXISTS (SELECT 1 FROM c x WHERE x.change = c.change AND x.file = b) GROUP BY 1, 2")
def missing_cochange(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    changes = n.selectExpr("n_regionkey AS change", "'f' || n_nationkey AS file").union(n.selectExpr("n_regionkey", "'f' || (40 + n_nationkey % 4)")).distinct()
    return resolve.missing_cochange(changes, _pairs(spark, d))


@query("join_raiser", f"""WITH {codegraph._E}, em AS (SELECT 'p' || p_partkey AS id, 'E' || p_size % 7 AS code FROM part UNION ALL SELECT 's' || s_suppkey, 'E' || s_suppkey % 7 FROM supplier), sd AS (SELECT CAST(s_suppkey AS INTEGER) AS inv, 's' || s_suppkey AS id FROM supplier),
r AS (SELECT inv, id, true AS by_seed FROM sd UNION ALL SELECT inv, target, false FROM sd JOIN e ON source = id AND rel = 'calls'), c AS (SELECT inv, 'E' || k AS code FROM sd, range(0, 4) t(k))
SELECT inv, code, id, by_seed FROM (SELECT c.inv, c.code, r.id, by_seed, row_number() OVER (PARTITION BY c.inv, c.code ORDER BY by_seed DESC, r.id) AS n FROM c JOIN r ON r.inv = c.inv JOIN em ON em.id = r.id AND em.code = c.code) WHERE n = 1""")
def raiser(spark: SparkSession, d: str) -> DataFrame:
    s, p = table(spark, d, "supplier"), table(spark, d, "part")
    seeds = s.selectExpr("CAST(s_suppkey AS INT) AS inv", "'s' || s_suppkey AS id")
    codes = seeds.select("inv", F.explode(F.expr("transform(sequence(0, 3), k -> 'E' || k)")).alias("code"))
    emits = p.selectExpr("'p' || p_partkey AS id", "'E' || p_size % 7 AS code").union(s.selectExpr("'s' || s_suppkey", "'E' || s_suppkey % 7"))
    return resolve.raisers(codes, seeds, codegraph.edges(spark, d).filter("rel = 'calls'"), emits)


@query("join_related_incident", """WITH i AS (SELECT o_orderkey AS id, o_orderdate AS "at", CASE WHEN o_orderkey % 2 = 0 THEN ' Hint ' ELSE 'hint ' END || o_custkey % 30 AS hint, CASE o_orderstatus WHEN 'O' THEN 'likely' WHEN 'F' THEN 'highly-likely' ELSE 'possible' END AS band, ['method:m' || o_custkey % 90, 'class:c', 'function:f' || o_orderkey % 50, 'method:m1'] AS seeds FROM orders),
h AS (SELECT id, "at", hint, list_sort(list_filter(list_distinct(seeds[1:3]), lambda s: s IN ('method:m1', 'function:f7', 'class:c', 'method:m2'))) AS s FROM i WHERE band <> 'possible'), g AS (SELECT id, "at", hint, list_filter(s, lambda x: x NOT LIKE 'class%') AS symbols FROM h)
SELECT id, "at", hint, symbols FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(hint)) ORDER BY "at" DESC, id) AS r FROM g WHERE len(symbols) > 0) WHERE r = 1 ORDER BY "at" DESC, id LIMIT 5""")
def related_incident(spark: SparkSession, d: str) -> DataFrame:
    saved = table(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "o_orderdate AS at", "IF(o_orderkey % 2 = 0, ' Hint ', 'hint ') || o_custkey % 30 AS hint", "CASE o_orderstatus WHEN 'O' THEN 'likely' WHEN 'F' THEN 'highly-likely' ELSE 'possible' END AS band",
        "array('method:m' || o_custkey % 90, 'class:c', 'function:f' || o_orderkey % 50, 'method:m1') AS seeds",
    )
    return resolve.related_incidents(saved, codegraph._ids(spark, "method:m1", "function:f7", "class:c", "method:m2"))
