"""Queries of evidence, cause, evaluation and streaming operators, and the investigation as a whole.

Evidence comes from the log, metric, queue and state queries on the driver tables, and from the
newest orders as commits; so the oracles are built over those queries' oracles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, evidence
from ..session import cut_lineage, table
from ..streaming import episodes
from . import observability as obs
from .common import Registry

query = Registry()
NOW = "TIMESTAMP_NTZ '2024-01-30 00:00:00'"


def gather(spark: SparkSession, d: str) -> DataFrame:
    """All evidence with category and priority."""
    none = lambda kind: F.lit(None).cast(kind)
    direct = F.col("key").startswith("error")
    log = F.when(direct, F.when(F.col("is_new"), 0.95).when(F.col("ratio") >= 1.5, 0.9).otherwise(0.85)).otherwise(F.when(F.col("is_new"), 0.7).when(F.col("ratio") >= 1.5, 0.55).otherwise(0.35))
    row = lambda df, id_, source, kind, score, ts=None, new=None, ratio=None, queue=None, service=None: df.select(
        id_.alias("id"), F.lit(source).alias("source"), F.lit(kind).alias("kind"), score.cast("double").alias("relevance"), (ts if ts is not None else none("timestamp_ntz")).alias("ts"),
        (new if new is not None else none("boolean")).alias("is_new"), (ratio if ratio is not None else none("double")).alias("ratio"), (queue if queue is not None else none("string")).alias("queue"), (service if service is not None else none("string")).alias("service"),
    )
    parts = [
        row(obs.analyze_errors(spark, d), F.concat(F.lit("log:"), "key"), "logs", "log", log, F.col("last_seen"), F.col("is_new"), F.col("ratio"), service=F.element_at("services", 1)),
        row(obs.queue_signals(spark, d), F.concat(F.lit("queue:"), "queue", F.lit(":"), "kind"), "queue", "queue-state", F.col("relevance"), queue=F.col("queue")),
        row(obs.state_signals(spark, d), F.concat_ws(":", F.lit("state"), "collection", "kind", "status"), "state", "state", F.col("relevance")),
        row(obs.anomaly(spark, d).filter("anomaly <> 'none'"), F.concat(F.lit("metric:"), "series"), "metrics", "metric", F.lit(0.8)),
        row(table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20), F.concat(F.lit("commit:"), F.col("o_orderkey").cast("string")), "history", "commit", F.lit(0.5), F.col("o_orderdate"), queue=F.col("o_orderpriority")),
    ]
    return evidence.categorised(reduce(DataFrame.union, parts).withColumn("seq", F.lit(0)))


_EV = f"""raw AS (
 SELECT 'log:' || key AS id, 'logs' AS source, 'log' AS kind, CASE WHEN starts_with(key, 'error') THEN CASE WHEN is_new THEN 0.95 WHEN ratio >= 1.5 THEN 0.9 ELSE 0.85 END ELSE CASE WHEN is_new THEN 0.7 WHEN ratio >= 1.5 THEN 0.55 ELSE 0.35 END END AS relevance,
  last_seen AS ts, is_new, ratio, NULL AS queue, services[1] AS service FROM ({obs.query.oracles['agg_analyze_errors']})
 UNION ALL SELECT 'queue:' || queue || ':' || kind, 'queue', 'queue-state', relevance, NULL, NULL, NULL, queue, NULL FROM ({obs.query.oracles['sc_queue_signals']})
 UNION ALL SELECT concat_ws(':', 'state', collection, kind, status), 'state', 'state', relevance, NULL, NULL, NULL, NULL, NULL FROM ({obs.query.oracles['sc_state_signals']})
 UNION ALL SELECT 'metric:' || series, 'metrics', 'metric', 0.8, NULL, NULL, NULL, NULL, NULL FROM ({obs.query.oracles['win_anomaly']}) WHERE anomaly <> 'none'
 UNION ALL (SELECT 'commit:' || o_orderkey, 'history', 'commit', 0.5, o_orderdate, NULL, NULL, o_orderpriority, NULL FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)),
ev AS (SELECT id, source, kind, CAST(relevance AS DOUBLE) AS relevance, ts, is_new, ratio, queue, service, CASE source WHEN 'queue' THEN 'queue' WHEN 'logs' THEN 'logs' WHEN 'metrics' THEN 'metrics' WHEN 'state' THEN 'database' ELSE 'deployment' END AS category,
 CASE WHEN kind = 'commit' THEN CASE WHEN relevance >= 0.8 THEN 'medium' ELSE 'info' END WHEN relevance >= 0.9 THEN 'critical' WHEN relevance >= 0.8 THEN 'high' WHEN relevance >= 0.6 THEN 'medium' WHEN kind IN ('queue-state', 'state') THEN 'info' WHEN relevance >= 0.4 THEN 'low' ELSE 'info' END AS priority FROM raw)"""


@query("prj_evidence", f"WITH {_EV} SELECT *, 0 AS seq FROM ev")
def prj_evidence(spark: SparkSession, d: str) -> DataFrame:
    return gather(spark, d)


@query("win_timeline", f"WITH {_EV} SELECT CAST(row_number() OVER (ORDER BY ts IS NULL, ts, CASE WHEN ts IS NULL THEN CASE kind WHEN 'queue-state' THEN 1 WHEN 'state' THEN 2 WHEN 'metric' THEN 3 ELSE 9 END END, id) AS INTEGER) AS place, id, kind, ts, false AS crossing FROM ev")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    return evidence.timeline(gather(spark, d))


@query("agg_groups", f"WITH {_EV} SELECT 'queue' AS by, queue AS key, count(*) AS n, list_sort(list(id)) AS ids FROM ev WHERE queue IS NOT NULL GROUP BY 2 HAVING count(*) >= 2 UNION ALL SELECT 'service', service, count(*), list_sort(list(id)) FROM ev WHERE service IS NOT NULL GROUP BY 2 HAVING count(*) >= 2 UNION ALL SELECT 'commits', 'all', count(*), list_sort(list(id)) FROM ev WHERE kind = 'commit' HAVING count(*) >= 2")
def groups(spark: SparkSession, d: str) -> DataFrame:
    return evidence.groups(gather(spark, d))


_CONF = "conf AS (SELECT least(sum(least(w, CASE tier WHEN 'runtime' THEN 2.0 ELSE 0.6 END)) / 6, 1.0) AS confidence FROM (SELECT source, tier, sum(relevance * CASE tier WHEN 'runtime' THEN 1.5 ELSE 0.5 END) AS w FROM (SELECT *, CASE WHEN kind = 'commit' THEN 'structural' WHEN relevance <= 0.4 THEN 'ambient' ELSE 'runtime' END AS tier FROM ev) GROUP BY 1, 2))"


@query("agg_confidence", f"WITH {_EV}, {_CONF} SELECT * FROM conf")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence.confidence(gather(spark, d), F.col("relevance") <= 0.4)


def _implied(ev: DataFrame) -> DataFrame:
    """Nodes are queues and services; queues 1 and 2 share work."""
    items = ev.select(F.coalesce("queue", "service").alias("node"), "relevance", "priority").filter("node IS NOT NULL")
    links = ev.sparkSession.createDataFrame([("1-URGENT", "2-HIGH"), ("2-HIGH", "svc-1")], "a string, b string")
    return evidence.implication(items, links)


_IMP = """base AS (SELECT coalesce(queue, service) AS node, max(CASE WHEN priority <> 'info' THEN relevance ELSE 0 END) AS own FROM ev WHERE coalesce(queue, service) IS NOT NULL GROUP BY 1),
imp AS (SELECT node, greatest(own, coalesce((SELECT max(o.own) * 0.7 FROM base o, (VALUES ('1-URGENT', '2-HIGH'), ('2-HIGH', '1-URGENT'), ('2-HIGH', 'svc-1'), ('svc-1', '2-HIGH')) l(a, b) WHERE l.b = base.node AND l.a = o.node), 0)) AS score FROM base)"""


@query("gr_implication", f"WITH {_EV}, {_IMP} SELECT node, score, score >= 0.6 AS implicated FROM imp")
def implication(spark: SparkSession, d: str) -> DataFrame:
    return _implied(gather(spark, d))


def _causes(ev: DataFrame) -> DataFrame:
    """A cause by queue, and one by source: its base score, blast radius and evidence."""
    q = ev.filter("kind = 'queue-state'").groupBy(F.concat(F.lit("queue-backlog:"), "queue").alias("id")).agg(F.lit(0.45).alias("base"), F.count("*").alias("blast"), F.collect_list("id").alias("ids"))
    s = ev.groupBy(F.concat(F.lit("source:"), "source").alias("id")).agg(F.lit(0.3).alias("base"), F.lit(0).cast("long").alias("blast"), F.collect_list("id").alias("ids"))
    every = ev.filter("queue IS NOT NULL").groupBy(F.concat(F.lit("queue-path:"), "queue").alias("id")).agg(F.lit(0.35).alias("base"), F.count("*").alias("blast"), F.collect_list("id").alias("ids"))
    return q.union(s).union(every)


_CAUSES = """x AS (SELECT 'queue-backlog:' || queue AS id, 0.45 AS base, id AS eid, true AS b FROM ev WHERE kind = 'queue-state' UNION ALL SELECT 'source:' || source, 0.3, id, false FROM ev UNION ALL SELECT 'queue-path:' || queue, 0.35, id, true FROM ev WHERE queue IS NOT NULL),
f AS (SELECT x.id, max(base) AS base, count(*) FILTER (b) AS blast, avg(CASE priority WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.75 WHEN 'low' THEN 0.5 END * relevance) FILTER (priority <> 'info') AS quality, count(DISTINCT source) AS sources, max(imp.score) AS node, max(ts) AS newest,
 max(CASE WHEN kind = 'log' THEN CASE WHEN is_new THEN 0.05 WHEN ratio >= 3 THEN 0.03 ELSE 0 END ELSE 0 END) AS repeats, count(*) FILTER (relevance >= 0.85) AS strong,
 avg(DISTINCT CASE source WHEN 'logs' THEN 0.9 WHEN 'queue' THEN 0.9 WHEN 'state' THEN 0.85 WHEN 'metrics' THEN 0.8 WHEN 'history' THEN 0.6 END) AS rely
 FROM x JOIN ev ON ev.id = x.eid LEFT JOIN imp ON imp.node = coalesce(ev.queue, ev.service) GROUP BY 1),
g AS (SELECT id, base, blast, sources, CASE WHEN quality IS NULL THEN -0.05 WHEN abs(round(quality - 0.5, 3)) < 0.01 THEN 0 ELSE round(quality - 0.5, 3) END AS f_quality, CASE WHEN sources >= 3 THEN 0.1 WHEN sources = 2 THEN 0.05 ELSE 0 END AS f_diversity, coalesce(round(node * 0.1, 3), 0) AS f_proximity,
 round(CASE WHEN newest IS NULL OR age < -1.0 / 12 THEN 0 WHEN age <= 1 THEN 0.05 WHEN age <= 24 THEN 0.02 WHEN age <= 72 THEN 0 WHEN age <= 168 THEN -0.02 ELSE -0.05 END + repeats, 3) AS f_runtime, CASE WHEN strong > 0 THEN 0.03 ELSE 0 END AS f_signal, CASE WHEN rely >= 0.8 THEN 0.03 WHEN rely < 0.5 THEN -0.03 ELSE 0 END AS f_reliability,
 CASE WHEN round(least(blast / 20, 1) * 0.05, 3) >= 0.005 THEN round(least(blast / 20, 1) * 0.05, 3) ELSE 0 END AS f_blast FROM (SELECT *, date_diff('microsecond', newest, TIMESTAMP '2024-01-30') / 3.6e9 AS age FROM f)),
causes AS (SELECT *, least(greatest(base + f_quality + f_diversity + f_proximity + f_runtime + f_signal + f_reliability + f_blast, 0), CASE WHEN sources <= 1 THEN 0.84 ELSE 1 END) AS score FROM g)"""
_BAND = "CASE WHEN score >= 0.85 THEN 'highly-likely' WHEN score >= 0.65 THEN 'likely' WHEN score >= 0.4 THEN 'possible' ELSE 'observation' END"


def _ranked(ev: DataFrame, top: int) -> DataFrame:
    nodes = ev.select(F.col("id").alias("eid"), F.coalesce("queue", "service").alias("node")).join(_implied(ev), "node").select("eid", "score")
    return evidence.score_causes(_causes(ev), ev, nodes, F.expr(NOW), top)


@query("sc_cause", f"WITH {_EV}, {_IMP}, {_CAUSES} SELECT *, {_BAND} AS band FROM causes ORDER BY score DESC, id LIMIT 10")
def cause(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(gather(spark, d), 10)


@query("sc_gaps", f"WITH {_EV}, m AS (SELECT * FROM (VALUES ('logs', 0.1, 'log'), ('metrics', 0.1, 'metric'), ('queue', 0.1, 'queue-state'), ('state', 0.08, 'state'), ('deploy', 0.08, 'commit'), ('traces', 0.07, 'trace'), ('owner', 0.05, 'owner')) v(dimension, impact, kind) WHERE kind NOT IN (SELECT kind FROM ev)) SELECT dimension, impact, greatest(0.3, 1 - sum(impact) OVER ()) AS ceiling FROM m")
def gaps(spark: SparkSession, d: str) -> DataFrame:
    return evidence.gaps(gather(spark, d))


_HYP = """hyp AS (SELECT 'queue-backlog:' || queue AS id, 'queue-backlog' AS category, 0.7 AS prior, list(id) FILTER (relevance > 0.6) AS supports, [] AS contradicts, 1 AS seq FROM ev WHERE kind = 'queue-state' GROUP BY queue
 UNION ALL SELECT 'benign-variance', 'benign-variance', 0.1, (SELECT list(id) FROM ev WHERE kind = 'metric'), (SELECT list(id) FROM ev WHERE kind = 'log' AND relevance >= 0.85), 2
 UNION ALL SELECT 'deployment-regression', 'deployment-regression', 0.25, (SELECT list(id) FROM ev WHERE kind = 'commit'), [], 3 UNION ALL SELECT 'external-api-latency', 'external-api-latency', 0.2, ['trace:1'], [], 4)"""


@query("sc_validate", f"""WITH {_EV}, {_HYP}, c AS (SELECT *, coalesce(len(supports), 0) - CASE WHEN id = 'external-api-latency' THEN 1 ELSE 0 END AS s, coalesce(len(contradicts), 0) AS k FROM hyp),
p AS (SELECT *, least(greatest(prior + 0.15 * (1 - pow(0.6, s)) / 0.4 - 0.3 * k, 0), 1) AS r FROM c), q AS (SELECT *, CASE WHEN category = 'benign-variance' AND k > 0 THEN least(r, 0.1) ELSE r END AS confidence FROM p),
v AS (SELECT *, CASE WHEN k > 0 AND confidence < 0.1 THEN 'eliminated' WHEN k > 0 THEN 'weakened' WHEN s > 0 THEN 'supported' ELSE 'unconfirmed' END AS verdict FROM q)
SELECT CAST(row_number() OVER (ORDER BY verdict = 'eliminated', confidence DESC, seq, id) AS INTEGER) AS place, id, category, s AS supporting, k AS contradicting, verdict, confidence FROM v""")
def validate(spark: SparkSession, d: str) -> DataFrame:
    ev = gather(spark, d)
    ids = lambda test: F.collect_list(F.when(test, F.col("id")))
    empty = F.array().cast("array<string>")
    q = ev.filter("kind = 'queue-state'").groupBy("queue").agg(ids(F.col("relevance") > 0.6).alias("supports")).select(F.concat(F.lit("queue-backlog:"), "queue").alias("id"), F.lit("queue-backlog").alias("category"), F.lit(0.7).alias("prior"), "supports", empty.alias("contradicts"), F.lit(1).alias("seq"))
    one = ev.agg(ids(F.col("kind") == "metric").alias("m"), ids((F.col("kind") == "log") & (F.col("relevance") >= 0.85)).alias("l"), ids(F.col("kind") == "commit").alias("c"))
    fixed = [("benign-variance", 0.1, F.col("m"), F.col("l"), 2), ("deployment-regression", 0.25, F.col("c"), empty, 3), ("external-api-latency", 0.2, F.array(F.lit("trace:1")), empty, 4)]
    for name, prior, s, k, seq in fixed:
        q = q.union(one.select(F.lit(name), F.lit(name), F.lit(prior), s, k, F.lit(seq)))
    # Ties of one template go by id.
    return evidence.validate(q.withColumn("seq", F.struct("seq", "id")), ev)


@query("investigate", f"""WITH {_EV}, {_IMP}, {_CAUSES}, {_CONF}, top AS (SELECT id, score FROM causes ORDER BY score DESC, id LIMIT 3), best AS (SELECT max(score) AS s FROM top),
cap AS (SELECT CASE WHEN s < 0.2 THEN 0.6 WHEN s < 0.5 THEN 0.6 + (s - 0.2) / 0.3 * 0.18 WHEN s < 0.85 THEN 0.78 + (s - 0.5) / 0.35 * 0.22 ELSE 1 END AS c FROM best)
SELECT id, score, {_BAND} AS band, least(0.5 * confidence + 0.5, c, 0.88) AS overall FROM top, conf, cap""")
def investigate(spark: SparkSession, d: str) -> DataFrame:
    """The best causes with the overall confidence: half evidence, half a seed found, under the
    ceilings of the best cause and of missing dimensions. Evidence is small and read by several consumers, so it
    is written once, in one part."""
    ev = cut_lineage(gather(spark, d).repartition(1))
    top = _ranked(ev, 3).select("id", "score", "band")
    ceiling = evidence.gaps(ev).agg(F.coalesce(F.max("ceiling"), F.lit(1.0)).alias("gap_ceiling"))
    caps = top.agg(evidence.cause_ceiling(F.max("score")).alias("cause_ceiling"))
    conf = evidence.confidence(ev, F.col("relevance") <= 0.4)
    one_row = conf.crossJoin(ceiling).crossJoin(caps)
    overall = F.least(0.5 * F.col("confidence") + 0.5, "gap_ceiling", "cause_ceiling")
    return top.crossJoin(F.broadcast(one_row)).select("id", "score", "band", overall.alias("overall"))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    rows = table(spark, d, "labels").join(docs, "doc_id")
    return rows.selectExpr("doc_id AS id", "lang AS project", "IF(doc_id % 7 = 0, NULL, doc_id % 97) AS investigation", "n_chars AS at", "CASE WHEN quality = 0 THEN 'no' WHEN toxic = 1 THEN 'partly' ELSE 'yes' END AS resolved", "n_chars", "toxic", "quality")


_V = "v AS (SELECT doc_id AS id, lang AS project, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 97 END AS investigation, n_chars AS at_, CASE WHEN quality = 0 THEN 'no' WHEN toxic = 1 THEN 'partly' ELSE 'yes' END AS resolved, n_chars, toxic, quality FROM labels JOIN documents USING (doc_id)), c AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY coalesce(CAST(investigation AS VARCHAR), 'row:' || id) ORDER BY at_ DESC, id DESC) = 1)"
_ACC = "count(*) AS evaluated, count(*) FILTER (resolved = 'yes') AS yes, count(*) FILTER (resolved = 'partly') AS partly, count(*) FILTER (resolved = 'no') AS no, count(*) FILTER (resolved = 'yes') / count(*) AS accuracy, (count(*) FILTER (resolved = 'yes') + 0.5 * count(*) FILTER (resolved = 'partly')) / count(*) AS weighted FROM c"


@query("agg_outcome", f"WITH {_V} SELECT {_ACC}")
def outcome(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.accuracy(_verdicts(spark, d))


@query("agg_baseline", f"WITH {_V} SELECT project, {_ACC} GROUP BY project")
def baseline(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.accuracy(_verdicts(spark, d), "project")


@query("win_latest", f"WITH {_V} SELECT id, investigation, resolved FROM c")
def latest(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.current_verdicts(_verdicts(spark, d)).select("id", "investigation", "resolved")


@query("agg_separation", f"""WITH {_V}, l AS (SELECT resolved AS target, 'n_chars' AS factor, CAST(n_chars AS DOUBLE) AS v FROM v UNION ALL SELECT resolved, 'toxic', toxic FROM v), s AS (SELECT * FROM l WHERE target IN ('yes', 'no'))
SELECT factor, avg(v) FILTER (target = 'yes') AS mean_yes, avg(v) FILTER (target = 'no') AS mean_no, var_pop(v) FILTER (target = 'yes') AS var_yes, var_pop(v) FILTER (target = 'no') AS var_no,
 avg(v) FILTER (target = 'yes') - avg(v) FILTER (target = 'no') AS separation, (avg(v) FILTER (target = 'yes') - avg(v) FILTER (target = 'no')) / stddev_pop(v) AS effect_size, stddev_pop(v) / abs(avg(v)) AS cv FROM s GROUP BY 1""")
def separation(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.separation(_verdicts(spark, d).withColumnRenamed("resolved", "target"), ["n_chars", "toxic"])


@query("ml_standardize", f"WITH {_V}, s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS sd FROM v) SELECT id, quality, (n_chars - m) / sd AS n_chars FROM v, s")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.standardised(_verdicts(spark, d).select("id", "quality", "n_chars"), ["n_chars"])


@query("ml_logreg")
def logreg(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.standardised(_verdicts(spark, d).select("id", "project", "quality", "n_chars", "toxic"), ["n_chars", "toxic"])
    w, b = evaluation.fit_logistic(rows, ["n_chars", "toxic"], "quality")
    return rows.select("id", "project", "quality", evaluation.logistic_score(w, b, ["n_chars", "toxic"]).alias("score"))


@query("ml_top1")
def top1(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.top1_hit_rate(logreg(spark, d), "project", "score", "quality", "id")


_SESS = "x AS (SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL {gap} AS n FROM events), y AS (SELECT *, sum(CASE WHEN n THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS e FROM x)"


@query("st_episode", "WITH " + _SESS.format(gap="1 HOUR") + " SELECT user_id, CAST(e AS BIGINT) AS episode, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM y GROUP BY 1, 2")
def st_episode(spark: SparkSession, d: str) -> DataFrame:
    return episodes.episodes(table(spark, d, "events"), "user_id", "ts", "event_id")


@query("st_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def st_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return episodes.distinct_events(table(spark, d, "events"), "user_id", "event_type", "ts").select("user_id", "event_type")


@query("st_debounce", "WITH " + _SESS.format(gap="10 HOURS") + ", z AS (SELECT *, floor(date_diff('microsecond', min(ts) OVER (PARTITION BY user_id, e), ts) / 1e6 / 36000) AS run FROM y) SELECT user_id, CAST(e AS BIGINT) AS burst, CAST(run AS BIGINT) AS run, min(ts) AS started, count(*) AS n FROM z GROUP BY 1, 2, 3")
def st_debounce(spark: SparkSession, d: str) -> DataFrame:
    return episodes.bursts(table(spark, d, "events"), "user_id", "ts", "event_id", 36000, 36000)
