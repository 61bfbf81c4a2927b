"""Queries of search, similarity and text operators on the driver tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import search
from ..session import table
from .common import Registry

query = Registry()
TERMS = ["thing", "nation", "over", "heit"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


_BM25 = """w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
c AS (SELECT id, len(w) AS len, """ + ", ".join(f"len(list_filter(w, lambda x: starts_with(x, '{t}'))) AS f{i}" for i, t in enumerate(TERMS)) + """ FROM w),
s AS (SELECT count(*) AS n, avg(len) AS a, """ + ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(TERMS))) + """ FROM c),
fts AS (SELECT id, """ + " + ".join(f"CASE WHEN f{i} > 0 THEN (CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / a)) ELSE 0 END" for i in range(len(TERMS))) + """ AS score FROM c, s
 WHERE greatest(f0, f1, f2, f3) > 0 ORDER BY score DESC, id LIMIT 60)"""


@query("se_fts", f"WITH {_BM25} SELECT id, round(score, 9) AS score FROM fts")
def fts(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(_docs(spark, d), TERMS, 60, "doc_id").withColumn("score", F.round("score", 9))


@query("se_vector", "SELECT v.vec_id AS id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS similarity FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, id LIMIT 10")
def vector(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id = 0").select("embedding").first()
    hits = search.nearest(v, list(q[0]) if q else [], 10, "vec_id")
    return hits.withColumn("similarity", F.round("similarity", 9))


@query("se_memory_vec", "SELECT id, round(s, 9) AS similarity FROM (SELECT v.vec_id AS id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings v, (SELECT embedding, label FROM embeddings WHERE vec_id = 0) q WHERE v.label = q.label) ORDER BY s DESC, id LIMIT 5")
def memory_vec(spark: SparkSession, d: str) -> DataFrame:
    """Never leaves the query's own repository (here: label)."""
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id = 0").select("embedding", "label").first()
    return search.nearest(v.filter(F.col("label") == q[1]), list(q[0]), 5, "vec_id").withColumn("similarity", F.round("similarity", 9))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("se_fuzzy", "SELECT id, name, greatest(0.3, 1 - 0.3 * d) AS score FROM (SELECT p_partkey AS id, p_name AS name, levenshtein(lower(p_name), 'blue bold') AS d FROM part) WHERE d <= 2 ORDER BY score DESC, id LIMIT 20")
def fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return search.fuzzy(_names(spark, d), "Blue Bold")


@query("se_name_contains", "SELECT p_partkey AS id, p_name AS name, CAST(0.5 AS DOUBLE) AS score FROM part WHERE contains(lower(p_name), 'gizmo') ORDER BY starts_with(p_name, '_'), length(p_name), id LIMIT 20")
def name_contains(spark: SparkSession, d: str) -> DataFrame:
    return search.name_contains(_names(spark, d), "Gizmo")


@query("se_exact_name", "SELECT c_custkey AS id, c_mktsegment AS name, CAST(1.0 AS DOUBLE) AS score FROM customer WHERE lower(c_mktsegment) = 'building' ORDER BY id LIMIT 20")
def exact_name(spark: SparkSession, d: str) -> DataFrame:
    return search.exact_name(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name")), "Building")


@query("se_rrf", f"""WITH {_BM25}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM fts),
b AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS r FROM (SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS n FROM documents WHERE contains(lower(text), 'ation') ORDER BY n DESC, id LIMIT 60)),
x AS (SELECT id, 1.0 / (60 + r) AS s FROM a UNION ALL SELECT id, 1.2 / (60 + r) FROM b) SELECT id, round(sum(s), 9) AS score FROM x GROUP BY 1 ORDER BY sum(s) DESC, id LIMIT 20""")
def rrf(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    a = search.ranked(search.bm25(docs, TERMS, 60, "doc_id"), "fts")
    hits = docs.filter(F.contains(F.lower("text"), F.lit("ation"))).select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(60)
    return search.fuse(a.union(search.ranked(hits, "name")), {"fts": 1.0, "name": 1.2}).withColumn("score", F.round("score", 9))


_CONV = "t AS (SELECT conv_id * 1000 + turn AS id, role, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS tokens FROM conversations)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", text.tokens(F.col("text")).alias("tokens"))


@query("se_recurrence", """WITH t AS (SELECT doc_id AS id, lang, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS k FROM documents), n AS (SELECT id, count(*) AS n FROM t GROUP BY 1),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM t x JOIN t y ON x.lang = y.lang AND x.k = y.k AND x.id < y.id GROUP BY 1, 2)
SELECT a, b, i / (na.n + nb.n - i) AS jaccard FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE i / (na.n + nb.n - i) >= 0.6""")
def recurrence(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select(F.col("doc_id").alias("id"), "lang", text.tokens(F.col("text")).alias("tokens"))
    return search.similar_sets(rows, 0.6, "lang")


QUERY = ["the", "thing", "ouer", "nation", "and", "edes", "re", "of"]
_Q = "['" + "', '".join(QUERY) + "']"


@query("se_recall_similar", f"""WITH {_CONV}, s AS (SELECT id, role AS title, len(list_intersect(tokens, {_Q})) / len(list_distinct(list_concat(tokens, {_Q}))) AS overlap, len(list_intersect(tokens, ['thing', 'ouer', 'nation', 'edes', 're'])) AS shared FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY overlap DESC, id) AS r FROM s WHERE overlap > 0 AND shared >= 1) SELECT id, title, overlap, shared FROM r WHERE r = 1 ORDER BY overlap DESC, id LIMIT 3""")
def recall_similar(spark: SparkSession, d: str) -> DataFrame:
    return search.recall_similar(_turns(spark, d), QUERY, ["the", "and", "of"], "role")


@query("se_hint_match", f"""WITH {_CONV}, n AS (SELECT count(*) AS n FROM t), l AS (SELECT id, unnest(tokens) AS k FROM t), idf AS (SELECT k, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM l, n GROUP BY k, n),
s AS (SELECT id, sum(w) AS own, coalesce(sum(w) FILTER (list_contains({_Q}, k)), 0) AS b, count(*) FILTER (list_contains({_Q}, k)) AS shared FROM l JOIN idf USING (k) GROUP BY 1),
q AS (SELECT coalesce(sum(w), 0) + ({len(QUERY)} - count(*)) * (SELECT ln(1 + (n + 0.5) / 0.5) FROM n) AS qs FROM idf WHERE list_contains({_Q}, k))
SELECT id, shared, 2 * b / (own + qs) AS score, 2 * b / (own + qs) >= 0.45 AS accepted FROM s, q WHERE shared >= 2""")
def hint_match(spark: SparkSession, d: str) -> DataFrame:
    return search.hint_match(_turns(spark, d), QUERY)


@query("se_recall_memory", """SELECT id, rank FROM (SELECT o_orderkey AS id, (o_totalprice / 500000) * pow(0.5, greatest(date_diff('second', o_orderdate, TIMESTAMP '2001-08-05') / 86400.0, 0) / 30) * CASE WHEN o_orderstatus = 'P' THEN 0.5 ELSE 1 END + CASE WHEN o_orderpriority LIKE '1%' AND o_totalprice > 490000 THEN 1 ELSE 0 END AS rank
 FROM orders WHERE o_orderstatus <> 'F') ORDER BY rank DESC, id LIMIT 10""")
def recall_memory(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_totalprice / 500000 AS confidence", "o_orderdate AS at", "CASE o_orderstatus WHEN 'P' THEN 'possibly-stale' WHEN 'F' THEN 'archived' ELSE 'active' END AS status", "o_orderpriority LIKE '1%' AND o_totalprice > 490000 AS pinned")
    return search.recall_memory(m, F.expr("TIMESTAMP_NTZ '2001-08-05'"))


def _sql_redacted() -> str:
    put = lambda r: re.sub(r"\$(\d)", r"\\\1", r)
    q = lambda p: p.replace("'", "''")
    out = "text"
    for p, r in text.SECRETS:
        out = f"regexp_replace({out}, '{q(p)}', '{put(r)}', 'g')"
    out = f"replace(regexp_replace(regexp_replace({out}, '({text.UUID})|{text.CARD}', '\\1' || chr(57540), 'g'), '({text.UUID})' || chr(57540), '\\1', 'g'), chr(57540), '[REDACTED-CARD]')"
    for p, r in text.PERSONAL:
        out = f"regexp_replace({out}, '{q(p)}', '{put(r)}', 'g')"
    return out


@query("fn_redact", f"SELECT doc_id, md5({_sql_redacted()}) AS digest FROM documents")
def redact(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(text.redact(F.col("text"))).alias("digest"))


@query("flt_content_any", "SELECT doc_id FROM documents WHERE contains(lower(text), 'token =') OR contains(lower(text), 'password') ORDER BY doc_id LIMIT 100")
def content_any(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return _docs(spark, d).filter(F.contains(low, F.lit("token =")) | F.contains(low, F.lit("password"))).select("doc_id").orderBy("doc_id").limit(100)


@query("fn_tokens", "SELECT conv_id, turn, list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) >= 4))) AS tokens FROM conversations")
def fn_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_sort(text.tokens(F.col("text"), 4)).alias("tokens"))


@query("win_drop_holdout")
def holdout(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", (text.fnv1a(F.col("doc_id").cast("string")) % 100 < 20).alias("held_out"))
