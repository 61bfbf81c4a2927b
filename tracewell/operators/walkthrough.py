"""How a symbol works: the walk of its richest flow, or of its direct calls, with what it stores and whom it calls outside.

symbols has id, name and file; flows (flow, step, id) the steps of flows; calls (source, target, seq); members (id, method, seq) the methods of classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is stored and what is called outside, by name or file; symbols that say nothing of a behaviour; how many are listed.
STORES = (
    r"(?i)(^|[._])(save|insert|upsert|persist|bulkwrite|find|findone|findmany|aggregate|delete|remove)\b"
    r"|repositor|\brepo\b|\.model|entity|prisma|mongoose|typeorm|knex|\bdao\b|datasource"
)
CALLS_OUT = (
    r"(?i)(^|[._])(request|publish|enqueue|dispatch|emit|notify)\b"
    r"|http|axios|\bapi\b|webhook|\bqueue\b|processor|producer|gateway|\.client\b"
)
NOISE_NAME, NOISE_FILE = r"(?i)^(forcontext|getlogger|child|debug|info|warn|error|log|trace|tracer)$", r"(?i)logger|logging|\.log\b|telemetry"
LISTED = 6


def _matches(pattern: str) -> Column:
    return F.coalesce(F.col("name").rlike(pattern), F.lit(False)) | F.coalesce(F.col("file").rlike(pattern), F.lit(False))


def richest(seeds: DataFrame, flows: DataFrame) -> DataFrame:
    """(id, flow, n): of the flows that a seed is a step of the one with the most steps, the first by name of equals."""
    size = flows.groupBy("flow").agg(F.count("*").alias("n"))
    mine = seeds.select("id").distinct().join(flows.select("id", "flow").distinct(), "id").join(size, "flow")
    return mine.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("less"), "flow", "n")).alias("x")).select("id", "x.flow", "x.n")


def walkthroughs(seeds: DataFrame, symbols: DataFrame, flows: DataFrame, calls: DataFrame, members: DataFrame) -> DataFrame:
    """(id, kind, flow, entry, steps, stores, calls_out) of seeds (id): steps are names in order.

    A flow of two steps or more is walked (`flow`); else the seed and then its callees (`calls`), or, where nothing but the
    seed is left, the methods of the class it is (`class`) or itself (`alone`). Loggers and their like are left out; of the
    lists, the first of equal names in one file stays. stores and calls_out are the first six of the steps, the callees and the methods in that
    order, and nothing is both. A seed that is no symbol gives no row."""
    known = seeds.select("id").distinct().join(symbols.select("id"), "id", "left_semi")
    best = richest(known, flows).filter("n > 1")
    noise = F.coalesce(F.col("name").rlike(NOISE_NAME) | F.col("file").rlike(NOISE_FILE), F.lit(False))
    real = symbols.select(F.col("id").alias("step_id"), "name", "file").filter(~noise)
    place = lambda part, at: F.struct(F.lit(part).alias("part"), F.col(at).cast("long").alias("at"))
    walked = best.join(flows.withColumnRenamed("id", "step_id"), "flow").select("id", "step_id", place(0, "step").alias("place"))
    bare = known.join(best, "id", "left_anti")
    own = bare.select("id", F.col("id").alias("step_id"), F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("at")).alias("place"))
    called = known.join(calls, known["id"] == calls["source"]).select("id", F.col("target").alias("step_id"), place(1, "seq").alias("place"))
    methods = known.join(members, "id").select("id", F.col("method").alias("step_id"), place(2, "seq").alias("place"))
    pool = walked.unionByName(own).unionByName(called).unionByName(methods).join(real, "step_id")
    pool = pool.join(best.select("id", "flow"), "id", "left")
    first = Window.partitionBy("id", "name", "file").orderBy("place", "step_id")
    steps = pool.filter(F.when(F.col("flow").isNull(), F.col("place.part") < 2).otherwise(F.col("place.part") == 0))
    names = lambda rows, name: F.transform(F.array_sort(F.collect_list(F.struct("place", "step_id", "name"))), lambda x: x["name"]).alias(name)
    chain = steps.groupBy("id").agg(names(steps, "steps"))
    once = pool.withColumn("nth", F.row_number().over(first)).filter("nth = 1").withColumn("keeps", _matches(STORES)).withColumn("asks", _matches(CALLS_OUT))
    order = F.array_sort(F.collect_list(F.struct("place", "step_id", "name", "keeps", "asks")))
    listed = once.groupBy("id").agg(order.alias("all"))
    stores = F.slice(F.transform(F.filter("all", lambda x: x["keeps"]), lambda x: x["name"]), 1, LISTED)
    asks = F.filter("all", lambda x: x["asks"] & ~F.array_contains("stores", x["name"]))
    listed = listed.withColumn("stores", stores).withColumn("calls_out", F.slice(F.transform(asks, lambda x: x["name"]), 1, LISTED))
    own_methods = once.filter("place.part = 2").groupBy("id").agg(names(once, "methods"))
    none = F.array().cast("array<string>")
    rows = known.join(best.select("id", "flow"), "id", "left").join(chain, "id", "left").join(listed.select("id", "stores", "calls_out"), "id", "left").join(own_methods, "id", "left")
    rows = rows.join(symbols.select("id", F.col("name").alias("own_name")), "id")
    steps_, methods_ = F.coalesce("steps", none), F.coalesce("methods", none)
    kind = F.when(F.size(steps_) > 1, F.when(F.col("flow").isNotNull(), "flow").otherwise("calls")).when(F.size(methods_) > 0, "class").otherwise("alone")
    entry = F.coalesce(F.get(steps_, F.lit(0)), F.col("own_name"))
    shown = F.when((F.size(steps_) <= 1) & (F.size(methods_) > 0), methods_).otherwise(steps_)
    return rows.select("id", kind.alias("kind"), "flow", entry.alias("entry"), shown.alias("steps"), F.coalesce("stores", none).alias("stores"), F.coalesce("calls_out", none).alias("calls_out"))
