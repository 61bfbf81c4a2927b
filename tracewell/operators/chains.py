"""Cause chains: of a validated explanation the evidence that set it off, carried it on and showed it, by a template of its category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots by category: role, kinds of evidence in order, kinds that stand in where those are missing, whether an
#: empty slot stays, and where the slot's node is looked for (type, whether it must be implicated; "own" is the explanation's queue).
TEMPLATES = {
    "deployment-regression": [
        ("trigger", ["commit"], [], True, [("deployment", False)]),
        ("propagation", ["symbol", "impact"], [], False, [("symbol", False)]),
        ("symptom", ["log", "metric"], [], False, [("service", True)]),
    ],
    "queue-backlog": [
        ("trigger", ["queue-edge"], [], True, [("own", True)]),
        ("propagation", ["queue-state"], [], False, [("own", True)]),
        ("symptom", ["log", "metric"], [], False, [("worker", True), ("service", True)]),
    ],
    "worker-slowdown": [
        ("trigger", ["stalled", "metric"], ["queue-state"], True, [("worker", True)]),
        ("propagation", ["queue-state"], [], False, [("own", True)]),
        ("symptom", ["log"], [], False, [("service", True)]),
    ],
    "external-api-latency": [
        ("trigger", ["metric"], [], True, [("service", True)]),
        ("propagation", ["log"], [], False, [("service", True)]),
        ("symptom", ["queue-state"], [], False, [("queue", True)]),
    ],
    "infrastructure": [
        ("trigger", ["state", "metric"], ["queue-state"], True, [("collection", True), ("database", True), ("queue", True)]),
        ("propagation", ["queue-state"], [], False, [("worker", True), ("service", True)]),
        ("symptom", ["log"], [], False, [("service", True)]),
    ],
    "retry-storm": [
        ("trigger", ["log"], [], True, [("service", True)]),
        ("propagation", ["queue-state"], [], False, [("queue", True)]),
        ("symptom", ["metric"], [], False, [("service", True)]),
    ],
    "other": [
        ("trigger", ["any"], [], True, [("service", True), ("queue", True)]),
        ("symptom", ["log", "metric"], [], False, [("service", True)]),
    ],
}


def _slots() -> list[tuple]:
    return [(c, n, role, keep) for c, steps in TEMPLATES.items() for n, (role, _, _, keep, _) in enumerate(steps)]


def _fits() -> list[tuple]:
    """(category, slot, tag, order, spare): which tags of evidence fill which slot."""
    return [(c, n, tag, i, spare) for c, steps in TEMPLATES.items() for n, (_, kinds, spares, _, _) in enumerate(steps) for spare, tags in ((False, kinds), (True, spares)) for i, tag in enumerate(tags)]


def _places() -> list[tuple]:
    return [(c, n, i, kind, must) for c, steps in TEMPLATES.items() for n, step in enumerate(steps) for i, (kind, must) in enumerate(step[4])]


def _tags(kind: Column, stalled: Column) -> Column:
    """What an item may be put down as: its kind, anything, and a stalled queue."""
    return F.array_compact(F.array(kind, F.lit("any"), F.when((kind == "queue-state") & F.coalesce(stalled, F.lit(False)), F.lit("stalled"))))


def cause_chains(explained: DataFrame, evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """(inv, id, category, confidence, slot, role, ids, node, path): a row per filled slot of each supported or weakened explanation.

    explained (inv, id, category, queue, confidence, verdict, supports) comes from validation, evidence has inv, id, kind and
    stalled (a paused queue or one without an active worker), nodes (inv, node, type, implicated) from the evidence graph.
    A slot takes the supporting items of its kinds, kind by kind in the order of supports; one item may fill two
    slots, and an empty slot is left out unless it is the trigger. Its node is the first by name that its template asks
    for. path is the roles of the whole chain. An unknown category has a trigger of all its support. Ids that are no evidence are dropped."""
    spark = explained.sparkSession
    slots = F.broadcast(spark.createDataFrame(_slots(), "template string, slot int, role string, keep boolean"))  # fixed, under 30 rows each
    fits = F.broadcast(spark.createDataFrame(_fits(), "template string, slot int, tag string, nth int, spare boolean"))
    places = F.broadcast(spark.createDataFrame(_places(), "template string, slot int, nth int, type string, must boolean"))
    known = F.col("category").isin(*[c for c in TEMPLATES if c != "other"])
    live = explained.filter(F.col("verdict").isin("supported", "weakened")).withColumn("template", F.when(known, F.col("category")).otherwise("other"))
    items = live.select("inv", F.col("id").alias("of"), "template", F.posexplode("supports").alias("at", "id"))
    items = items.join(evidence.select("inv", "id", F.explode(_tags(F.col("kind"), F.col("stalled"))).alias("tag")), ["inv", "id"])
    held = items.join(fits, ["template", "tag"]).groupBy("inv", "of", "slot")
    ordered = lambda spare: F.transform(F.array_sort(F.collect_list(F.when(F.col("spare") == spare, F.struct("nth", "at", "id")))), lambda x: x["id"])
    held = held.agg(ordered(False).alias("own"), ordered(True).alias("spare")).select("inv", F.col("of").alias("id"), "slot", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("spare")).alias("ids"))
    rows = live.join(slots, "template").join(held, ["inv", "id", "slot"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    rows = rows.filter(F.col("keep") | (F.size("ids") > 0))
    # Nodes by type, at most one row a type and investigation, beside the one of a queue's own name.
    best = nodes.groupBy("inv", "type").agg(F.min("node").alias("any"), F.min(F.when(F.col("implicated"), F.col("node"))).alias("hit"))
    named = nodes.filter("type = 'queue'").select("inv", F.expr("substring(node, 7)").alias("queue"), F.col("node").alias("own")).distinct()
    sought = rows.select("inv", "id", "template", "slot", "queue").join(places, ["template", "slot"])
    sought = sought.withColumn("real", F.when(F.col("type") == "own", "queue").otherwise(F.col("type"))).join(best.withColumnRenamed("type", "real"), ["inv", "real"], "left")
    sought = sought.join(named, ["inv", "queue"], "left")
    found = F.when((F.col("type") == "own") & F.col("queue").isNotNull(), F.col("own")).when(F.col("must"), F.col("hit")).otherwise(F.col("any"))
    node = sought.withColumn("node", found).filter("node IS NOT NULL").groupBy("inv", "id", "slot").agg(F.min_by("node", "nth").alias("node"))
    chain = rows.join(node, ["inv", "id", "slot"], "left")
    path = chain.groupBy("inv", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "role"))), lambda x: x["role"]), " > ").alias("path"))
    return chain.join(path, ["inv", "id"]).select("inv", "id", "category", "confidence", "slot", "role", "ids", "node", "path")
