"""Queries of assessment, startup recall and queue stitching on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assess
from ..session import table
from ..sources import sinks, stitch
from .common import Registry

query = Registry()

_R = "o_orderkey AS id, o_orderkey % 12 AS evidence, o_orderkey % 5 AS hypotheses, least(o_orderkey % 5, o_custkey % 3) AS resolved, o_totalprice / 500000 AS confidence, o_custkey % 8 AS gaps, o_orderkey % 2 AS actions"


@query("sc_quality", f"""WITH r AS (SELECT {_R} FROM orders), v AS (SELECT id, least(evidence / 8, 1) AS a, CASE WHEN hypotheses = 0 THEN 0 ELSE resolved / hypotheses END AS b, confidence AS c, 1 - least(gaps / 6, 1) AS d, CASE WHEN actions > 0 THEN 1 ELSE 0 END AS e FROM r),
s AS (SELECT *, CAST(floor(100 * (0.2 * a + 0.25 * b + 0.25 * c + 0.2 * d + 0.1 * e) + 0.5) AS BIGINT) AS score FROM v)
SELECT id, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade,
 CASE least(a, b, c, d, e) WHEN a THEN 'evidence support' WHEN b THEN 'hypothesis discrimination' WHEN c THEN 'diagnostic calibration' WHEN d THEN 'evidence completeness' ELSE 'actionability' END AS lever FROM s""")
def quality(spark: SparkSession, d: str) -> DataFrame:
    return assess.quality(table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 12 AS evidence", "o_orderkey % 5 AS hypotheses", "least(o_orderkey % 5, o_custkey % 3) AS resolved", "o_totalprice / 500000 AS confidence", "o_custkey % 8 AS gaps", "o_orderkey % 2 AS actions"))


@query("agg_health", """WITH n AS (SELECT count(*) AS symbols, count(*) FILTER (p_retailprice > 1000) AS dead, count(DISTINCT p_size % 20) AS k, count(*) FILTER (p_size % 3 > 0) AS callables FROM part), e AS (SELECT avg(l_discount) FILTER (l_returnflag <> 'N') AS sure, count(*) FILTER (l_returnflag = 'N') AS coupled, count(*) FILTER (l_returnflag = 'N' AND l_tax * 10 > 0.7) AS close FROM lineitem),
u AS (SELECT count(DISTINCT p_partkey) AS used FROM part JOIN orders ON o_orderkey = p_partkey WHERE p_size % 3 > 0),
b AS (SELECT round(100 - dead / symbols * 100, 1) AS dead_code, round(greatest(100 - close / coupled * 200, 0), 1) AS coupling, CASE WHEN k <= 15 THEN round(k / 15 * 100, 1) ELSE greatest(100 - (k - 15) * 2.0, 50) END AS modularity, round(sure * 100, 1) AS confidence, round(least(used / callables * 100, 100), 1) AS coverage FROM n, e, u)
SELECT *, round(0.25 * dead_code + 0.2 * coupling + 0.2 * modularity + 0.2 * confidence + 0.15 * coverage, 1) AS score FROM b""")
def health(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").selectExpr("p_partkey AS id", "CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'method' END AS label", "p_retailprice > 1000 AS is_dead", "p_size % 20 AS community")
    edges = table(spark, d, "lineitem").selectExpr("IF(l_returnflag = 'N', 'coupled_with', 'calls') AS rel", "l_discount AS confidence", "l_tax * 10 AS strength")
    return assess.health(nodes, edges, table(spark, d, "orders").selectExpr("o_orderkey AS id"))


@query("sc_scenario", "SELECT o_orderkey AS id, CAST((o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT + (o_orderkey % 5 = 0)::INT + (o_orderkey % 7 = 0)::INT AS INTEGER) AS passed, 5 AS total FROM orders")
def scenario(spark: SparkSession, d: str) -> DataFrame:
    some = lambda k, v: f"IF(o_orderkey % {k} = 0, array('{v}'), CAST(array() AS array<string>))"
    r = table(spark, d, "orders").selectExpr("o_orderkey AS id", f"{some(2, 's')} AS seeds", f"{some(3, 'q')} AS crossings", "CAST(array() AS array<string>) AS gaps", "CAST(array() AS array<string>) AS actions", f"{some(5, 'commit')} AS kinds", f"{some(7, 'retry-storm')} AS categories")
    return assess.scenario(r, ["seed", "queue-boundary", "commit", "hyp:retry-storm", "something else"])


@query("sort_gaps", "SELECT n_regionkey AS inv, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 5 = 0, n_nationkey % 3 DESC, n_nationkey) AS INTEGER) AS place, CASE WHEN n_nationkey % 5 = 0 THEN 'runtime evidence' ELSE n_name END AS dimension FROM nation")
def gaps(spark: SparkSession, d: str) -> DataFrame:
    return assess.gap_actions(table(spark, d, "nation").selectExpr("n_regionkey AS inv", "IF(n_nationkey % 5 = 0, 'runtime evidence', n_name) AS dimension", "n_nationkey % 3 AS impact", "n_nationkey AS seq"))


@query("sort_reranker", "SELECT o_custkey AS inv, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey) AS INTEGER) AS place FROM orders")
def reranker(spark: SparkSession, d: str) -> DataFrame:
    return assess.reranked(table(spark, d, "orders").selectExpr("o_custkey AS inv", "o_orderkey AS id", "struct(o_orderdate, o_orderkey) AS seq", "o_orderpriority"), F.col("o_orderpriority"))


_SCOPE = "CASE turn % 3 WHEN 0 THEN 'symbol' WHEN 1 THEN 'area' ELSE 'repo' END"


@query("se_jaccard_index", """WITH t AS (SELECT conv_id * 1000 + turn AS id, CASE turn % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS rank, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS k FROM conversations WHERE role = 'user'), q AS (SELECT ['the', 'thing', 'nation', 'and'] AS q)
SELECT id, len(list_intersect(k, q)) / len(list_distinct(list_concat(k, q))) AS score FROM t, q WHERE len(list_intersect(k, q)) > 0 ORDER BY score DESC, rank DESC, id LIMIT 10""")
def jaccard_index(spark: SparkSession, d: str) -> DataFrame:
    return assess.claims_like(table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn AS id", "role AS repo", f"{_SCOPE} AS scope", "text AS claim"), "The thing, nation and the", "user")


_POOL = """p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN 'i' || o_custkey END AS incident, 'Claim ' || o_custkey AS claim, CASE WHEN o_orderkey % 9 = 0 THEN 'rejected' ELSE 'active' END AS status, o_orderdate AS created_at, CASE WHEN o_orderkey % 13 = 0 THEN TIMESTAMP '2030-01-01' END AS seen_at,
 CASE o_orderkey % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'dev' END AS environment, CASE WHEN o_orderkey % 5 = 0 THEN 'E1' WHEN o_orderkey % 5 = 1 THEN 'E2' END AS error_code, CASE WHEN o_orderkey % 11 = 0 THEN 'pay' END AS workflow,
 ['t' || o_custkey % 7, 't' || o_orderkey % 6, '#code' || o_orderkey % 900] AS x, ['u' || o_orderkey % 8, 't1'] AS y FROM orders)"""


@query("se_startup_recall", f"""WITH {_POOL}, d AS (SELECT id, 0 AS h, list_distinct(x) AS k FROM p UNION ALL SELECT id, 1, list_distinct(y) FROM p), n AS (SELECT count(*) AS n FROM d), f AS (SELECT t, count(*) AS df FROM (SELECT unnest(k) AS t FROM d) GROUP BY 1), w AS (SELECT t, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM f, n),
q(t) AS (VALUES ('t1'), ('t3'), ('u2'), ('none'), ('#code77')), qs AS (SELECT sum(coalesce(w, (SELECT ln(1 + (n + 0.5) / 0.5) FROM n))) AS total FROM q LEFT JOIN w USING (t)),
e AS (SELECT id, h, sum(w) AS own, coalesce(sum(w) FILTER (t IN (SELECT t FROM q)), 0) AS b, count(*) FILTER (t IN (SELECT t FROM q)) AS k, coalesce(bool_or(t = '#code77' AND df <= 2), false) AS rare FROM (SELECT id, h, unnest(k) AS t FROM d) JOIN w USING (t) GROUP BY 1, 2),
s AS (SELECT id, coalesce(max(CASE WHEN k >= 2 THEN 2 * b / (own + total) END), 0) AS score, bool_or(rare) AS rare FROM e, qs GROUP BY 1),
m AS (SELECT p.id, coalesce(incident, lower(claim)) AS key, list_filter([CASE WHEN error_code = 'E1' THEN 'error_code' END, CASE WHEN workflow = 'pay' THEN 'workflow' END], lambda z: z IS NOT NULL) AS fields, score, rare FROM p JOIN s USING (id)
 WHERE status = 'active' AND created_at <= TIMESTAMP '2001-06-01' AND seen_at IS NULL AND coalesce(environment, 'prod') = 'prod' AND coalesce(error_code, 'E1') = 'E1'),
r AS (SELECT id, fields, round(len(fields) + score, 9) AS relevance, row_number() OVER (PARTITION BY key ORDER BY round(len(fields) + score, 9) DESC, id) AS r FROM m WHERE len(fields) > 0 OR rare OR score >= 0.45) SELECT id, fields, relevance FROM r WHERE r = 1 ORDER BY relevance DESC, id LIMIT 3""")
def startup_recall(spark: SparkSession, d: str) -> DataFrame:
    pool = table(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "IF(o_orderkey % 4 > 0, 'i' || o_custkey, NULL) AS incident", "'Claim ' || o_custkey AS claim", "IF(o_orderkey % 9 = 0, 'rejected', 'active') AS status", "o_orderdate AS created_at", "IF(o_orderkey % 13 = 0, TIMESTAMP_NTZ '2030-01-01', NULL) AS seen_at", "CAST(NULL AS TIMESTAMP_NTZ) AS verified_at",
        "CASE o_orderkey % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'dev' END AS environment", "CAST(NULL AS STRING) AS service", "'' AS fingerprint", "CASE o_orderkey % 5 WHEN 0 THEN 'E1' WHEN 1 THEN 'E2' END AS error_code", "IF(o_orderkey % 11 = 0, 'pay', NULL) AS workflow", "CAST(NULL AS STRING) AS operation",
        "array(array('t' || o_custkey % 7, 't' || o_orderkey % 6, '#code' || o_orderkey % 900), array('u' || o_orderkey % 8, 't1')) AS hints",
    )
    return assess.startup_recall(pool, {"environment": "prod", "error_code": "E1", "workflow": "pay", "fingerprint": "F"}, ["t1", "t3", "u2", "none", "#code77"], F.expr("TIMESTAMP_NTZ '2001-06-01'"))


_FILES = [
    ("names.ts", "export const MAIL_QUEUE = 'mail'\nexport enum Jobs { SHIP = 'ship', PACK, }\n"), ("produce.ts", "import {MAIL_QUEUE} from './names'\nconst q = new Queue(MAIL_QUEUE)\nconst s = new Queue<Job>(Jobs.SHIP, opts)\nnew Queue('plain')\nnew Queue(unknownName)"),
    ("work.ts", "for (const j of Object.values(Jobs)) { new Worker(j, run) }\nnew Worker('mail', send)"), ("nest.ts", "constructor(@InjectQueue('audio') private q: Queue) {}"), ("nest.proc.ts", "@Processor('audio')\nexport class AudioWorker {}"),
    ("tasks.py", "@app.task(bind=True)\n@retry\ndef send_mail(self):\n    pass\n\n@dramatiq.actor\nasync def resize(x):\n    pass\n"), ("views.py", "send_mail.delay(1)\nresize.send(2)\nother.delay(3)\n"), ("names2.ts", "const MAIL_QUEUE = 'late'"),
]


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The files in a folder of each region."""
    regions = table(spark, d, "region").selectExpr("CAST(r_regionkey AS STRING) AS root").filter("root = '0'")
    return regions.crossJoin(F.broadcast(spark.createDataFrame(_FILES, "name string, content string"))).select(F.concat_ws("/", "root", "name").alias("path"), "content")  # a fixed list


@query("x_stitch", """SELECT queue, '0/' || p AS producer_file, '0/' || w AS worker_file FROM (VALUES ('mail', 'produce.ts', 'work.ts'), ('ship', 'produce.ts', 'work.ts'), ('PACK', NULL, 'work.ts'), ('plain', 'produce.ts', NULL), ('audio', 'nest.ts', 'nest.proc.ts'), ('send_mail', 'views.py', 'tasks.py'), ('resize', 'views.py', 'tasks.py')) v(queue, p, w)""")
def stitched(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return stitch.edges(stitch.declared(files).union(stitch.tasks(files)))


@query("x_const_enum", "SELECT * FROM (VALUES ('MAIL_QUEUE', 'mail'), ('Jobs.SHIP', 'ship'), ('Jobs.PACK', 'PACK')) v(name, value)")
def const_enum(spark: SparkSession, d: str) -> DataFrame:
    return stitch.constants(_files(spark, d))


@query("x_queue_edges", "SELECT 'p' || o_custkey % 3 AS project, o_orderpriority AS queue, o_custkey AS producer FROM orders WHERE o_custkey % 3 <> 1 UNION ALL SELECT 'p1', 'new', s_suppkey FROM supplier")
def queue_edges(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").selectExpr("'p' || o_custkey % 3 AS project", "o_orderpriority AS queue", "o_custkey AS producer")
    return stitch.replaced(base, table(spark, d, "supplier").selectExpr("'new' AS queue", "s_suppkey AS producer"), "p1")


@query("src_git_diff", "SELECT 'r' || o_custkey % 3 AS repo, 'f' || o_orderkey AS path, CASE o_orderstatus WHEN 'O' THEN 'M' WHEN 'F' THEN 'R' ELSE 'A' END AS status FROM orders WHERE o_orderkey % 10 <> 0")
def git_diff(spark: SparkSession, d: str) -> DataFrame:
    line = "CASE WHEN o_orderkey % 10 = 0 THEN '  ' WHEN o_orderstatus = 'O' THEN 'M\tf' || o_orderkey WHEN o_orderstatus = 'F' THEN ' R100\told\tf' || o_orderkey ELSE 'A\tf' || o_orderkey END AS line"
    return stitch.name_status(table(spark, d, "orders").selectExpr("'r' || o_custkey % 3 AS repo", line))


@query("src_git_state", "SELECT 'r' || o_custkey % 3 AS repo, count(*) FILTER (o_orderstatus = 'O') AS staged, count(*) FILTER (o_orderstatus = 'F') AS unstaged, count(*) FILTER (o_orderstatus = 'P') AS untracked, least(count(*) FILTER (o_orderstatus = 'O'), 100) + least(count(*) FILTER (o_orderstatus = 'F'), 100) + least(count(*) FILTER (o_orderstatus = 'P'), 100) AS shown, true AS dirty FROM orders GROUP BY 1")
def git_state(spark: SparkSession, d: str) -> DataFrame:
    return stitch.repo_state(table(spark, d, "orders").selectExpr("'r' || o_custkey % 3 AS repo", "CASE o_orderstatus WHEN 'O' THEN 'staged' WHEN 'F' THEN 'unstaged' ELSE 'untracked' END AS area", "CAST(o_orderkey AS STRING) AS path"))


query.cases("fn_short_stat", "line string", [(" 3 files changed, 12 insertions(+), 4 deletions(-)", "12/4"), (" 1 file changed, 1 insertion(+)", "1/0"), ("", "0/0"), (" 2 files changed, 7 deletions(-)", "0/7")], lambda c: F.concat_ws("/", stitch.short_stat(c)["insertions"], stitch.short_stat(c)["deletions"]))


@query("sink_vec", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 99 ELSE label END AS label FROM embeddings UNION ALL SELECT 1000000 + s_suppkey, 7 FROM supplier")
def sink_vec(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of which a third is written anew and some are new; of two writes the later one stays."""
    e = table(spark, d, "embeddings")
    again = e.filter("vec_id % 3 = 0")
    late = again.selectExpr("vec_id", "embedding", "99 AS label", "2 AS seq").union(again.selectExpr("vec_id", "embedding", "98 AS label", "1 AS seq"))
    new = table(spark, d, "supplier").selectExpr("1000000 + s_suppkey AS vec_id", "CAST(array() AS array<float>) AS embedding", "7 AS label", "1 AS seq")
    return sinks.upserted(e, late.union(new), ["vec_id"]).select("vec_id", "label")


@query("st_incremental", "WITH e AS (SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, l_linenumber AS n FROM lineitem), n AS (SELECT 'p' || p_partkey AS id, 'f' || p_partkey % 10 AS file FROM part UNION ALL SELECT 's' || s_suppkey, 'f' || s_suppkey % 10 FROM supplier) SELECT source, target, n FROM e WHERE source NOT IN (SELECT id FROM n WHERE file = 'f3')")
def incremental(spark: SparkSession, d: str) -> DataFrame:
    """Edges that stay while a file is indexed anew: its own go, those that come from other files wait for their ends."""
    items = table(spark, d, "lineitem").selectExpr("'p' || l_partkey AS source", "'s' || l_suppkey AS target", "l_linenumber AS n")
    nodes = table(spark, d, "part").selectExpr("'p' || p_partkey AS id", "'f' || p_partkey % 10 AS file").union(table(spark, d, "supplier").selectExpr("'s' || s_suppkey", "'f' || s_suppkey % 10"))
    return sinks.without_files(nodes, items, ["f3"])[1]


@query("sink_graph_bulk", "SELECT 'node' AS part, count(*) AS n FROM part UNION ALL SELECT 'edge', count(*) FROM lineitem")
def graph_bulk(spark: SparkSession, d: str) -> DataFrame:
    """The whole graph replaced twice and read back."""
    import uuid

    from ..session import shared_folder

    where = f"{shared_folder(spark)}/bulk-{uuid.uuid4().hex}"
    frames = {"node": table(spark, d, "part").select("p_partkey"), "edge": table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")}
    for df in (*frames.items(), *frames.items()):
        sinks.replace_table(df[1], f"{where}/{df[0]}")
    count = lambda k: spark.read.parquet(f"{where}/{k}").agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n")
    return count("node").union(count("edge"))


@query("sink_report", "SELECT 'reports' AS part, count(*) AS n FROM region UNION ALL SELECT 'evidence', count(*) FROM nation")
def report(spark: SparkSession, d: str) -> DataFrame:
    """Reports and their evidence as tables that keep what other investigations wrote."""
    import uuid

    from ..session import shared_folder

    where = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    for part, df in (("reports", table(spark, d, "region").selectExpr("r_regionkey AS inv", "r_name AS title")), ("evidence", table(spark, d, "nation").selectExpr("n_regionkey AS inv", "n_name AS id"))):
        sinks.save_report(df.filter("inv < 3"), f"{where}/{part}")
        sinks.save_report(df.filter("inv >= 2"), f"{where}/{part}")  # investigation 2 is written again
    count = lambda k: spark.read.parquet(f"{where}/{k}").agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n")
    return count("reports").union(count("evidence"))
