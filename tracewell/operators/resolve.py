"""Resolution of names in code to nodes, and what files and incidents share with a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Endings of one language family.
FAMILIES = {"python": "py|pyi", "script": "ts|tsx|js|jsx|mjs|cjs|mts|cts", "go": "go", "rust": "rs", "java": "java|kt|scala"}


def family(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, ends in FAMILIES.items():
        out = F.when(path.rlike(rf"\.(?:{ends})$"), name).otherwise(out)
    return out


def _first(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def _least(symbols: DataFrame, *by: str) -> DataFrame:
    """The first id of each group of symbols. A name may have any number of them, so names are resolved against these firsts,
    never against all symbols of the name."""
    return symbols.filter(F.col("id").isNotNull()).groupBy(*by).agg(F.min("id").alias("id"))


def receivers(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """(call, id, confidence) of calls receiver.name (call, receiver, name, file) to methods (id, name, class_name, file): one
    of the same file, or else the first of the same language family, at .8."""
    m = methods.select("id", "name", F.col("class_name").alias("receiver"), "file").withColumn("family", family(F.col("file")))
    own = _least(m, "name", "receiver", "file").withColumnRenamed("id", "own")
    kin = _least(m, "name", "receiver", "family").withColumnRenamed("id", "kin")
    hits = calls.withColumn("family", family(F.col("file"))).join(own, ["name", "receiver", "file"], "left").join(kin, ["name", "receiver", "family"], "left")
    hits = hits.select("call", F.col("own").isNull().alias("away"), F.coalesce("own", "kin").alias("id")).filter("id IS NOT NULL")
    return _first(hits, "call", F.col("away"), F.col("id")).select("call", "id", F.lit(0.8).alias("confidence"))


def _resolved(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """(use, id, away) of names in files (use, name, file): see named(); away where no symbol of the name is in the same file.
    Uses meet the first symbol of a name and file and the firsts of the name, never all its symbols."""
    own = symbols.groupBy("name", "file").agg(F.count("*").alias("near"), F.min("id").alias("own"))
    every = own.groupBy("name").agg(F.count("file").alias("filed"), F.min(F.when(F.col("file").isNotNull(), F.col("own"))).alias("other"), F.min("own").alias("any"))
    unknown = F.col("file").isNull() | (F.col("filed") == 0)
    step = F.when(F.col("near").isNotNull(), 0).when(unknown, 2).otherwise(1)
    first = F.when(F.col("step") == 0, F.col("own")).when(F.col("step") == 1, F.col("other")).otherwise(F.col("any"))
    hits = uses.join(own, ["name", "file"], "left").join(every, "name").withColumn("step", step).select("use", "step", first.alias("id"))
    return _first(hits, "use", F.col("step"), F.asc_nulls_last("id")).select("use", "id", (F.col("step") > 0).alias("away"))


def named(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """(use, id) of names in files (use, name, file): the first symbol (id, name, file) of that name in the same file, or
    else in another, or else, where either file is null, the first anywhere. A null id comes after the others."""
    return _resolved(uses, symbols).select("use", "id")


def heritage(declared: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (source, target, rel) of declarations (class_name, kind, parent, file): both ends by named(); only
    extends and implements count, and ends that are unknown give no edge."""
    rows = declared.filter(F.col("kind").isin("extends", "implements")).withColumn("use", F.struct("class_name", "kind", "parent", "file"))
    known = classes.filter("id IS NOT NULL")
    side = lambda column: named(rows.select("use", F.col(column).alias("name"), "file"), known)
    both = side("class_name").withColumnRenamed("id", "source").join(side("parent").withColumnRenamed("id", "target"), "use")
    return both.select("source", "target", F.col("use.kind").alias("rel")).distinct()


def siblings(calls: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """(call, id, confidence): every symbol of a call's name (call, name, file) in its own file, where there are two to
    `most` of them, at .4; one alone is no matter of doubt and more are too many, so those are counted and never paired."""
    size = symbols.groupBy("name", "file").agg(F.count("*").alias("k"))
    rows = calls.select("call", "name", "file").join(size, ["name", "file"])
    doubtful = rows.groupBy("call").agg(F.sum("k").alias("all")).filter(F.col("all").between(2, most)).select("call")
    few = symbols.select("id", "name", "file").join(size.filter(F.col("k") <= most).select("name", "file"), ["name", "file"], "left_semi")
    asked = rows.filter(F.col("k") <= most).join(doubtful, "call", "left_semi")
    return asked.join(few, ["name", "file"]).select("call", "id", F.lit(0.4).alias("confidence"))


def arguments(passed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call, id, confidence): functions handed over as arguments (call, name, file), at .8 of what their name resolves to:
    1 in the same file, .5 elsewhere."""
    found = _resolved(passed.select(F.struct("call", "name", "file").alias("use"), "name", "file"), symbols)
    return found.select("use.call", "id", F.when(F.col("away"), 0.4).otherwise(0.8).alias("confidence"))


def coupled_files(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file, other, strength, together) of coupled pairs (a, b, strength, together) from the side of each of the files (file)."""
    both = edges.select(F.col("a").alias("file"), F.col("b").alias("other"), "strength", "together").union(edges.select("b", "a", "strength", "together"))
    return both.join(files.select("file").distinct(), "file", "left_semi").distinct()


def missing_cochange(changes: DataFrame, edges: DataFrame, least: float = 0.5) -> DataFrame:
    """(change, other, strength): files that usually change with a change's files (change, file) and are not in it."""
    near = coupled_files(edges.filter(F.col("strength") >= least), changes)
    hits = changes.join(near, "file").groupBy("change", "other").agg(F.max("strength").alias("strength"))
    return hits.join(changes.select("change", F.col("file").alias("other")), ["change", "other"], "left_anti")


def raisers(codes: DataFrame, seeds: DataFrame, calls: DataFrame, emits: DataFrame) -> DataFrame:
    """(inv, code, id, by_seed) of observed codes (inv, code): the seed (inv, id) or a function that it calls which emits (id,
    code) the code; the seed before its callees, then by id."""
    reach = seeds.select("inv", "id", F.lit(True).alias("by_seed")).union(
        seeds.join(calls.select(F.col("source").alias("id"), "target"), "id").select("inv", "target", F.lit(False)))
    hits = codes.join(reach, "inv").join(emits, ["id", "code"]).withColumn("k", F.struct("inv", "code"))
    return _first(hits, "k", ~F.col("by_seed"), F.col("id")).select("inv", "code", "id", "by_seed")


def related_incidents(saved: DataFrame, changed: DataFrame, most: int = 5) -> DataFrame:
    """(id, at, hint, symbols) of investigations (id, at, hint, band, seeds) whose cause is likely at least and of whose first
    three seeds one is a changed function or method (id): the newest of each hint, the newest `most`."""
    seeds = saved.filter(F.col("band").isin("likely", "highly-likely")).select("id", "at", "hint", F.explode(F.slice("seeds", 1, 3)).alias("seed"))
    hits = seeds.filter(F.col("seed").rlike("^(?:method|function):")).join(changed.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi")
    rows = hits.groupBy("id", "at", "hint").agg(F.array_sort(F.collect_set("seed")).alias("symbols")).withColumn("key", F.lower(F.trim("hint")))
    return _first(rows, "key", F.desc("at"), F.col("id")).drop("key").orderBy(F.desc("at"), "id").limit(most)
