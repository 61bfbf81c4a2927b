"""Evidence: priorities, timeline, groups, confidence, implication, hypotheses, cause ranking, gaps.

An evidence frame has id, source, kind, relevance, ts, is_new, ratio, queue, service and seq (input order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRUCTURAL = ("symbol", "flow", "impact", "queue-edge")
RUNTIME = ("log", "metric", "queue-state", "redis-key", "state")
#: Categories by source, weights by priority, reliability by source.
CATEGORIES = {"queue": "queue", "logs": "logs", "metrics": "metrics", "state": "database", "history": "deployment", "code": "code"}
WEIGHTS = {"critical": 1.0, "high": 0.9, "medium": 0.75, "low": 0.5, "info": 0.15}
RELIABILITY = {"logs": 0.9, "queue": 0.9, "state": 0.85, "metrics": 0.8, "code": 0.7, "history": 0.6}
#: Places of kinds without a time.
UNTIMED = {"queue-state": 1, "state": 2, "redis-key": 2, "metric": 3, "queue-edge": 4, "symbol": 5, "flow": 6, "impact": 7}


def _lookup(column: Column, values: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def categorised(evidence: DataFrame) -> DataFrame:
    """evidence with category and priority."""
    kind, r = F.col("kind"), F.col("relevance")
    steps = F.when(r >= 0.9, "critical").when(r >= 0.8, "high").when(r >= 0.6, "medium")
    priority = (
        F.when(kind.isin(*STRUCTURAL), "info")
        .when(kind == "commit", F.when(r >= 0.8, "medium").otherwise("info"))
        .when(kind.isin("queue-state", "state", "redis-key"), steps.otherwise("info"))
        .otherwise(steps.when(r >= 0.4, "low").otherwise("info"))
    )
    category = F.when(kind == "redis-key", "cache").otherwise(_lookup(F.col("source"), CATEGORIES, "code"))
    return evidence.withColumn("category", category).withColumn("priority", priority)


def timeline(evidence: DataFrame) -> DataFrame:
    """place from 1: rows with a time by it, then the rest by kind; ties keep the input order.

    The order is over an incident's evidence, which is small by nature; it needs one sorted task."""
    order = Window.orderBy(F.col("ts").isNull(), "ts", F.when(F.col("ts").isNull(), _lookup(F.col("kind"), UNTIMED, 9)), "seq", "id")
    return evidence.select(F.row_number().over(order).alias("place"), "id", "kind", "ts", (F.col("kind") == "queue-edge").alias("crossing"))


def groups(evidence: DataFrame) -> DataFrame:
    """(by, key, n, ids): evidence that shares a queue or a service, two items at least, and all commits."""
    parts = [evidence.filter(F.col(c).isNotNull()).groupBy(F.lit(c).alias("by"), F.col(c).alias("key")) for c in ("queue", "service")]
    parts.append(evidence.filter("kind = 'commit'").groupBy(F.lit("commits").alias("by"), F.lit("all").alias("key")))
    out = [p.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).filter("n >= 2") for p in parts]
    return out[0].union(out[1]).union(out[2])


def confidence(evidence: DataFrame, ambient: Column) -> DataFrame:
    """One row: evidence confidence; runtime items weigh 1.5 (2.0 a source at most), ambient and
    structural ones .5 (.6 at most), over 6."""
    r = F.least(F.greatest(F.coalesce("relevance", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    runtime = F.col("kind").isin(*RUNTIME)
    tier = F.when(runtime & ambient, "ambient").when(runtime, "runtime").otherwise("structural")
    sums = evidence.groupBy("source", tier.alias("tier")).agg(F.sum(r * F.when(runtime & ~ambient, 1.5).otherwise(0.5)).alias("w"))
    capped = F.least("w", F.when(F.col("tier") == "runtime", 2.0).otherwise(0.6))
    return sums.agg(F.least(F.coalesce(F.sum(capped), F.lit(0.0)) / 6, F.lit(1.0)).alias("confidence"))


def implication(items: DataFrame, links: DataFrame, factor: float = 0.7, least: float = 0.6) -> DataFrame:
    """(node, score, implicated): items (node, relevance, priority) give each node its largest
    relevance that is not info; links (a, b) hand .7 of it one hop on, both ways."""
    base = items.groupBy("node").agg(F.max(F.when(F.col("priority") != "info", F.col("relevance")).otherwise(0.0)).alias("own"))
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    got = both.join(base.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max(F.col("own") * factor).alias("handed"))
    out = base.join(got, "node", "left").select("node", F.greatest("own", F.coalesce("handed", F.lit(0.0))).alias("score"))
    return out.withColumn("implicated", F.col("score") >= least)


def validate(hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """hypotheses (id, category, prior, supports, contradicts, seq) against the evidence present:
    confidence, verdict and place."""
    ids = evidence.select(F.col("id").alias("eid")).distinct()
    support = hypotheses.select("id", F.explode(F.array_distinct("supports")).alias("eid")).join(ids, "eid").groupBy("id").agg(F.array_sort(F.collect_list("eid")).alias("present"))
    against = hypotheses.select("id", F.explode(F.array_distinct("contradicts")).alias("eid")).join(ids, "eid").groupBy("id").agg(F.count("*").alias("contradicting"))
    rows = hypotheses.join(support, "id", "left").join(against, "id", "left").fillna(0, ["contradicting"])
    n = F.coalesce(F.size("present"), F.lit(0))
    rows = rows.withColumn("supporting", F.when(F.col("present").isNull(), 0).otherwise(n))
    gain = 0.15 * (1 - F.pow(F.lit(0.6), F.col("supporting"))) / 0.4
    c = F.least(F.greatest(F.col("prior") + gain - 0.3 * F.col("contradicting"), F.lit(0.0)), F.lit(1.0))
    c = F.when((F.col("category") == "benign-variance") & (F.col("contradicting") > 0), F.least(c, F.lit(0.1))).otherwise(c)
    rows = rows.withColumn("c", c)
    verdict = F.when((F.col("contradicting") > 0) & (F.col("c") < 0.1), "eliminated").when(F.col("contradicting") > 0, "weakened").when(F.col("supporting") > 0, "supported").otherwise("unconfirmed")
    key = F.when((F.col("contradicting") == 0) & (F.col("supporting") > 0), F.array_join("present", "|"))
    rows = rows.withColumn("verdict", verdict).withColumn("key", key)
    cohort = F.count("*").over(Window.partitionBy("key"))
    rows = rows.withColumn("confidence", F.when(F.col("key").isNotNull() & (cohort >= 2), F.least("c", F.lit(0.75))).otherwise(F.col("c")))
    place = F.row_number().over(Window.orderBy(F.col("verdict") == "eliminated", F.desc("confidence"), "seq"))
    return rows.select(place.alias("place"), "id", "category", "supporting", "contradicting", "verdict", "confidence")


def score_causes(causes: DataFrame, evidence: DataFrame, implicated: DataFrame, now: Column, top: int = 3) -> DataFrame:
    """causes (id, base, blast, ids) -> factors, score and band of the best `top`.

    evidence has priority; implicated is (eid, score) of the nodes that evidence hangs on."""
    items = causes.select(F.col("id").alias("cause"), F.explode(F.array_distinct("ids")).alias("eid"))
    e = items.join(evidence.withColumnRenamed("id", "eid"), "eid").join(implicated.groupBy("eid").agg(F.max("score").alias("node")), "eid", "left")
    anomaly, plain = F.col("priority") != "info", ~F.col("kind").isin(*STRUCTURAL)
    weighted = F.avg(F.when(anomaly, _lookup(F.col("priority"), WEIGHTS, 0.5) * F.col("relevance")))
    repeats = F.max(F.when(F.col("kind") == "log", F.when(F.col("is_new"), 0.05).when(F.col("ratio") >= 3, 0.03).otherwise(0.0)).otherwise(0.0))
    facts = e.groupBy("cause").agg(
        weighted.alias("quality"), F.countDistinct("source").alias("sources"), F.max("node").alias("node"), F.max("ts").alias("newest"), repeats.alias("repeats"),
        F.count(F.when(plain, 1)).alias("plain"), F.count(F.when(plain & (F.col("relevance") >= 0.85), 1)).alias("strong"), F.array_distinct(F.collect_list("source")).alias("names"),
    )
    rely = F.aggregate("names", F.lit(0.0), lambda a, s: a + _lookup(s, RELIABILITY, 0.65)) / F.size("names")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / F.lit(3.6e9)
    recent = F.when(age < -1 / 12, 0.0).when(age <= 1, 0.05).when(age <= 24, 0.02).when(age <= 72, 0.0).when(age <= 168, -0.02).when(age.isNotNull(), -0.05).otherwise(0.0)
    f = facts.select(
        F.col("cause").alias("id"), "sources",
        F.when(F.col("quality").isNull(), -0.05).when(F.abs(F.round(F.col("quality") - 0.5, 3)) < 0.01, 0.0).otherwise(F.round(F.col("quality") - 0.5, 3)).alias("f_quality"),
        F.when(F.col("sources") >= 3, 0.1).when(F.col("sources") == 2, 0.05).otherwise(0.0).alias("f_diversity"),
        F.coalesce(F.round(F.col("node") * 0.1, 3), F.lit(0.0)).alias("f_proximity"),
        F.round(recent + F.col("repeats"), 3).alias("f_runtime"),
        F.when(F.col("plain") == 0, -0.05).when(F.col("strong") > 0, 0.03).otherwise(0.0).alias("f_signal"),
        F.when(rely >= 0.8, 0.03).when(rely < 0.5, -0.03).otherwise(0.0).alias("f_reliability"),
    )
    blast = F.round(F.least(F.col("blast") / 20, F.lit(1.0)) * 0.05, 3)
    rows = causes.join(f, "id").withColumn("f_blast", F.when(blast >= 0.005, blast).otherwise(0.0))
    total = F.col("base") + sum((F.col(c) for c in rows.columns if c.startswith("f_")), F.lit(0.0))
    total = F.least(F.greatest(total, F.lit(0.0)), F.when(F.col("sources") <= 1, 0.84).otherwise(1.0))
    rows = rows.withColumn("score", total)
    band = F.when(F.col("score") >= 0.85, "highly-likely").when(F.col("score") >= 0.65, "likely").when(F.col("score") >= 0.4, "possible").otherwise("observation")
    return rows.withColumn("band", band).drop("ids").orderBy(F.desc("score"), "id").limit(top)


#: What a missing dimension costs, and the kinds that show it is there.
DIMENSIONS = [("logs", 0.1, "log"), ("metrics", 0.1, "metric"), ("queue", 0.1, "queue-state"), ("state", 0.08, "state"), ("deploy", 0.08, "commit"), ("traces", 0.07, "trace"), ("owner", 0.05, "owner")]


def gaps(evidence: DataFrame) -> DataFrame:
    """(dimension, impact): dimensions without evidence; no report passes the ceiling 1 - their sum, .3 at least."""
    wanted = evidence.sparkSession.createDataFrame(DIMENSIONS, "dimension string, impact double, kind string")
    missing = wanted.join(evidence.select("kind").distinct(), "kind", "left_anti")
    ceiling = F.greatest(F.lit(0.3), 1 - F.sum("impact").over(Window.partitionBy()))
    return missing.select("dimension", "impact", ceiling.alias("ceiling"))


def cause_ceiling(score: Column) -> Column:
    """The most overall confidence that the best cause's score allows."""
    s = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return F.when(s < 0.2, 0.6).when(s < 0.5, 0.6 + (s - 0.2) / 0.3 * 0.18).when(s < 0.85, 0.78 + (s - 0.5) / 0.35 * 0.22).otherwise(1.0)


def overall_confidence(confidence: Column, seed: Column, low: Column, gap_ceiling: Column, best: Column) -> Column:
    """Half the evidence's confidence, half whether a seed was found (an unsure one counts .3), under the ceilings of missing
    dimensions, of the best cause's score and, for an unsure seed, of .45. A null seed or score is none."""
    half = F.when(seed.isNull(), 0.0).when(F.coalesce(low, F.lit(False)), 0.3).otherwise(1.0)
    sure = F.when(seed.isNotNull() & F.coalesce(low, F.lit(False)), 0.45).otherwise(1.0)
    return F.least(0.5 * confidence + 0.5 * half, gap_ceiling, cause_ceiling(F.coalesce(best, F.lit(0.0))), sure)
