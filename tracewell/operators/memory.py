"""Incident memory and code look-ups: contents, arguments, co-located codes, contradictions, captures, knowledge."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_content(docs: DataFrame, token: str, limit: int = 20) -> DataFrame:
    """Documents (id, content) that hold the token verbatim; shorter ones first, then by id."""
    return docs.filter(F.contains("content", F.lit(token))).select("id", F.length("content").alias("size")).orderBy("size", "id").limit(limit)


def argument_search(nodes: DataFrame, value: str, column: str = "args") -> DataFrame:
    """Nodes whose JSON array of decorator arguments has an element equal to the value, case aside."""
    args = F.from_json(F.col(column), "array<string>")
    return nodes.filter(F.coalesce(F.exists(args, lambda a: F.lower(a) == value.lower()), F.lit(False))).select("id")


def colocated_codes(docs: DataFrame, token: str, around: int = 200) -> DataFrame:
    """(id, code): upper-case codes within `around` characters of the token's first place."""
    at = F.instr("content", token)
    near = F.substring(F.col("content"), F.greatest(at - around, F.lit(1)), F.least(at - 1, F.lit(around)) + len(token) + around)
    codes = F.array_distinct(F.regexp_extract_all(near, F.lit(r"[A-Z][A-Z0-9]{3,}"), F.lit(0)))
    return docs.filter(at > 0).select("id", F.explode(codes).alias("code"))


def by_process(hits: DataFrame, steps: DataFrame) -> DataFrame:
    """hits (id, score) under the process they belong to first by name; those of none stay apart."""
    first = steps.groupBy("id").agg(F.min("process").alias("process"))
    return hits.join(first, "id", "left")


def to_embed(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    return nodes.select("id").join(stored.select("id").distinct(), "id", "left_anti")


def stale_vectors(stored: DataFrame, scheme: int, model: str) -> DataFrame:
    return stored.filter((F.col("scheme") != scheme) | (F.col("model") != model) | F.col("model").isNull()).select("id")


def contradictions(memories: DataFrame) -> DataFrame:
    """(a, b): memories of one signature whose verdicts are opposite, or confirmed for different causes.

    A signature's memories meet once per verdict and cause, each by its smallest id, so a frequent
    signature does not pair all its memories."""
    heads = memories.filter("signature IS NOT NULL AND length(signature) >= 4").groupBy("signature", "verdict", "cause").agg(F.min("id").alias("id"))
    other = heads.select("signature", F.col("verdict").alias("v2"), F.col("cause").alias("c2"), F.col("id").alias("b"))
    clash = ((F.col("verdict") == "yes") & (F.col("v2") == "no")) | ((F.col("verdict") == "no") & (F.col("v2") == "yes")) | ((F.col("verdict") == "yes") & (F.col("v2") == "yes") & (F.col("cause") != F.col("c2")))
    return heads.join(other, "signature").filter(clash & (F.col("id") < F.col("b"))).select(F.col("id").alias("a"), "b")


def captured(memories: DataFrame, findings: DataFrame, most: int = 20) -> DataFrame:
    """memories (signature, n, investigations) after findings (signature, investigation, at): seen
    signatures count up and keep their last `most` investigations, others are created."""
    new = findings.groupBy("signature").agg(F.countDistinct("investigation").alias("more"), F.array_sort(F.collect_set(F.struct("at", "investigation"))).alias("x"))
    both = memories.join(new, "signature", "outer")
    ids = F.array_distinct(F.concat(F.coalesce("investigations", F.array().cast("array<string>")), F.coalesce(F.col("x.investigation"), F.array().cast("array<string>"))))
    tail = F.when(F.size(ids) > most, F.slice(ids, -most, most)).otherwise(ids)
    return both.select("signature", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"), tail.alias("investigations"))


def best_signal(signatures: DataFrame, codes: list[str], words: list[str]) -> DataFrame:
    """The one signature (key, message, n) that fits the symptoms best: 1000 for a code, 10 a word, up to 9 for its count; twice seen at least."""
    low = F.lower("message")
    hits = sum((F.when(F.contains(low, F.lit(w.lower())), 10.0).otherwise(0.0) for w in words), F.lit(0.0))
    code = F.when(F.col("key").isin(codes), 1000.0).otherwise(0.0)
    rows = signatures.withColumn("score", code + hits + F.least(F.log10("n"), F.lit(9.0))).filter((F.col("n") >= 2) & (code + hits > 0))
    return rows.orderBy(F.desc("score"), "key").limit(1).select("key", "score")


def knowledge(items: DataFrame, phrase: str, fields: list[str], categories: list[str], limit: int = 20) -> DataFrame:
    """Items whose fields hold the phrase, by the categories' order, then by id."""
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
    hay = F.lower(F.concat_ws("\n", *fields))
    return items.filter(F.contains(hay, F.lit(phrase.lower()))).select("id", "category", place.alias("_p")).orderBy("_p", "id").limit(limit).drop("_p")


def imports_of(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file, other, direction): what the files import and what imports them."""
    e = edges.filter("rel = 'imports'")
    out = e.join(files.withColumnRenamed("file", "source"), "source").select(F.col("source").alias("file"), F.col("target").alias("other"), F.lit("imports").alias("direction"))
    return out.union(e.join(files.withColumnRenamed("file", "target"), "target").select(F.col("target").alias("file"), F.col("source").alias("other"), F.lit("imported-by").alias("direction")))


def inbound_from_elsewhere(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Edges into the files whose source lies in another file."""
    s, t = nodes.select(F.col("id").alias("source"), F.col("file").alias("from_file")), nodes.select(F.col("id").alias("target"), "file")
    return edges.join(t.join(files, "file"), "target").join(s, "source").filter("from_file <> file").select("source", "target", "rel", "from_file", "file")


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (id, module) -> the first file that is there of module.py, module/__init__.py, module.ts and module/index.ts."""
    base = F.regexp_replace("module", r"\.", "/")
    names = F.array(*[F.concat(base, F.lit(x)) for x in (".py", "/__init__.py", ".ts", "/index.ts")])
    rows = imports.select("id", F.posexplode(names).alias("place", "path")).join(files.select("path").distinct(), "path")
    return rows.groupBy("id").agg(F.min_by("path", "place").alias("path"))


def routed_corpus(labels: DataFrame, reports: DataFrame) -> DataFrame:
    """Current labels with where they go: row, quarantined (no verdict on a cause) or unjoinable (no report)."""
    rows = labels.join(reports.select("investigation", F.lit(True).alias("_has")), "investigation", "left")
    kind = F.when(F.col("_has").isNull(), "unjoinable").when(F.col("resolved").isNull(), "quarantined").otherwise("row")
    return rows.withColumn("route", kind).drop("_has")


def prior_incidents(reports: DataFrame, least: float = 0.5, most: int = 50) -> DataFrame:
    """(node, n): how many of the newest `most` confident reports (id, at, confidence, nodes) name each node."""
    recent = reports.filter(F.col("confidence") >= least).orderBy(F.desc("at"), F.desc("id")).limit(most)
    return recent.select("id", F.explode("nodes").alias("node")).groupBy("node").agg(F.countDistinct("id").alias("n"))


def job_states(events: DataFrame, family: Column | str, order: list[Column]) -> DataFrame:
    """Per family the state after all events in time order: its latest event, whether it is resolved,
    how often it was reopened and how many events came late (older than one that had arrived before)."""
    w = Window.partitionBy(family).orderBy(*order)
    arrival = Window.partitionBy(family).orderBy("arrived", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("late", F.coalesce(F.col("ts") < F.max("ts").over(arrival), F.lit(False)))
    rows = rows.withColumn("reopened", F.coalesce((F.col("state") == "active") & (F.lag("state").over(w) == "resolved"), F.lit(False)))
    last = F.max_by(F.struct("event_id", "state"), F.struct("ts", "event_id"))
    out = rows.groupBy(family).agg(last.alias("x"), F.count(F.when(F.col("late"), 1)).alias("late"), F.count(F.when(F.col("reopened"), 1)).alias("reopened"))
    return out.select(family, F.col("x.event_id").alias("event_id"), (F.col("x.state") == "resolved").alias("resolved"), "late", "reopened")


MARKERS = {"payments": r"stripe|adyen|paypal", "mail": r"sendgrid|mailgun|smtp", "storage": r"s3|gcs|minio"}


def external_systems(files: DataFrame, own: list[str], least: int = 2) -> DataFrame:
    """External systems by how many product files (path, content) name them, the repository's own left out."""
    parts = [F.when(F.lower("content").rlike(rf"\b(?:{p})\b"), F.lit(k)) for k, p in MARKERS.items() if not re.search("|".join(own) or "$^", k)]
    found = F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("system")
    return files.select("path", found).groupBy("system").agg(F.countDistinct("path").alias("files")).filter(F.col("files") >= least)
