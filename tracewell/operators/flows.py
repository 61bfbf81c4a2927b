"""Execution flows, dead code, and the risk and tests of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import path_class
from . import graph
from ..session import cut_lineage


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that call something and that nothing calls (see begins() for the rules of languages)."""
    calls = edges.filter("rel = 'calls'")
    callers = calls.select(F.col("source").alias("id")).distinct()
    return nodes.select("id").join(callers, "id", "left_semi").join(calls.select(F.col("target").alias("id")).distinct(), "id", "left_anti")


def flows(edges: DataFrame, entries: DataFrame, depth: int = 6, branch: int = 3, most: int = 25) -> DataFrame:
    """(entry, id, depth, step): what each entry reaches, breadth first: each node hands on to its `branch` best
    calls (by confidence, then target) that the flow has not met before, until it has `most` nodes.

    A level's nodes take their turn in one fold over their best calls; of a node, branch + most of them
    are enough, as at most `most` can have been met."""
    best = Window.partitionBy("source").orderBy(F.desc("confidence"), "target")
    calls = edges.filter("rel = 'calls' AND source <> target").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= branch + most)
    calls = cut_lineage(calls.select(F.col("source").alias("id"), F.col("target").alias("to"), "r"))
    seen = cut_lineage(entries.select(F.col("id").alias("entry"), "id", F.lit(0).alias("depth"), F.lit(1).alias("step")))
    front = seen
    turn = (
        f"aggregate(array_sort(collect_list(struct(step, r, to))), named_struct('got', CAST(array() AS array<string>), 'at', 0, 'n', 0), (a, x) -> "
        f"if((x.step = a.at AND a.n >= {branch}) OR size(a.got) >= max(room) OR array_contains(a.got, x.to), if(x.step = a.at, a, named_struct('got', a.got, 'at', x.step, 'n', 0)), "
        "named_struct('got', array_append(a.got, x.to), 'at', x.step, 'n', if(x.step = a.at, a.n, 0) + 1)), a -> a.got)"
    )
    for hop in range(1, depth + 1):
        size = seen.groupBy("entry").agg(F.count("*").alias("had"))
        step = front.join(calls, "id").join(seen.select("entry", F.col("id").alias("to")), ["entry", "to"], "left_anti").join(size, "entry").withColumn("room", most - F.col("had"))
        met = step.filter("room > 0").groupBy("entry").agg(F.expr(turn).alias("got"), F.max("had").alias("had"))
        front = cut_lineage(met.select("entry", F.posexplode("got").alias("i", "id"), "had").select("entry", "id", F.lit(hop).alias("depth"), (F.col("had") + F.col("i") + 1).cast("int").alias("step")))
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front))
    return seen


def distinct_flows(steps: DataFrame, overlap: float = 0.5) -> DataFrame:
    """(entry): flows kept greedily, longest first, then by entry: one that shares over half of the
    smaller one's nodes with a kept flow goes. Decided level by level: a flow stands once every
    better flow that overlaps it is decided, so no task holds all flows."""
    size = steps.groupBy("entry").agg(F.count("*").alias("n"))
    s = steps.join(size, "entry").select("entry", "id", "n")
    pairs = s.join(s.toDF("other", "id", "m"), "id").filter("entry <> other").groupBy("entry", "n", "other", "m").agg(F.count("*").alias("shared"))
    better = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("entry")))
    beats = cut_lineage(pairs.filter(better & (F.col("shared") > overlap * F.least("n", "m"))).select("entry", "other"))
    left, kept = cut_lineage(size.select("entry")), None
    while not left.isEmpty():
        open_ = beats.join(left.toDF("other"), "other", "left_semi").join(left, "entry", "left_semi")
        stand = cut_lineage(left.join(open_.select("entry").distinct(), "entry", "left_anti"))
        kept = stand if kept is None else cut_lineage(kept.union(stand))
        gone = beats.join(stand.toDF("other"), "other", "left_semi").select("entry").distinct()
        left = cut_lineage(left.join(stand, "entry", "left_anti").join(gone, "entry", "left_anti"))
    return kept if kept is not None else size.select("entry")


def flow_kind(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """intra- or cross-community, or unknown if no step has a community."""
    rows = steps.join(nodes.select("id", "community"), "id", "left").groupBy("entry").agg(F.countDistinct("community").alias("k"))
    return rows.select("entry", F.when(F.col("k") == 0, "unknown").when(F.col("k") == 1, "intra").otherwise("cross").alias("kind"))


def flow_rank(steps: DataFrame, changed: DataFrame) -> DataFrame:
    """Flows by how many changed symbols they run through."""
    return steps.join(changed, "id", "left_semi").groupBy("entry").agg(F.countDistinct("id").alias("n"))


#: Decorators that make a Python function an entry, names and files where programs begin.
PYTHON_ENTRY = r"@app\.route|@router|@click\.command"
TS_ENTRY = r"(?:index\.[tj]sx?|main\.(?:tsx?|js)|app\.(?:tsx?|js)|server\.[tj]s|handler\.[tj]s|route\.tsx?|page\.tsx?|layout\.tsx?)$"
ENTRY_NAMES, ENTRY_FILE = ["main", "cli", "run", "app", "handler", "entrypoint"], r"(?:__main__|cli|main|app)\.py$"


def begins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of nodes (id, label, name, path, language, content, exported) where an execution can begin: by patterns of
    their language, or, if nothing calls them, as exported ones, by their name, or as functions of a start file.
    What is a test begins nothing."""
    c, low = F.col, F.lower(F.coalesce("language", F.lit("")))
    python = low.isin("python", "py", "") | c("path").endswith(".py")
    script = low.isin("typescript", "ts", "") | c("path").rlike(r"\.tsx?$")
    by_pattern = (python & (c("name").startswith("test_") | (c("name") == "main") | F.coalesce("content", F.lit("")).rlike(PYTHON_ENTRY))) | (script & (c("name").isin("handler", "middleware") | (F.coalesce("exported", F.lit(False)) & c("path").rlike(TS_ENTRY))))
    free = F.coalesce("exported", F.lit(False)) | c("name").isin(ENTRY_NAMES) | ((c("label") == "function") & c("path").rlike(ENTRY_FILE))
    called = edges.filter("rel = 'calls'").select(F.col("target").alias("id")).distinct().withColumn("called", F.lit(True))
    rows = nodes.filter(path_class(c("path")) != "test").join(called, "id", "left")
    return rows.filter(by_pattern | (c("called").isNull() & free)).select("id")


#: Decorators that register a function, that only wrap it, and that mark stubs; bases of enums; names that are run from outside.
FRAMEWORK = ["task", "shared_task", "periodic_task", "job", "receiver", "on_event", "handler", "validator", "field_validator", "root_validator", "model_validator", "contextmanager", "asynccontextmanager", "fixture", "route", "endpoint", "command", "hybrid_property"]
PLAIN_DECORATORS = ["functools.wraps", "functools.lru_cache", "functools.cached_property", "functools.cache"]
STUBS = ["overload", "typing.overload", "abstractmethod", "abc.abstractmethod"]
ENUMS = ["Enum", "IntEnum", "StrEnum", "Flag", "IntFlag"]


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name) of functions, methods and classes of product code that no product code calls.

    nodes: id, label, name, path, class_name, exported and, where known, entry, decorators, bases, protocol. A
    call from an unknown node counts. Exempt: entry points, exported ones, public methods of exported
    classes, main, constructors and other special names, tests, public names of __init__.py, classes that a
    type names, registered, property, stub and trait methods, enums. Then spared: a method whose parent
    class has a live one of its name, methods that make a class conform to a protocol, and a protocol's own."""
    more = {"entry": "boolean", "decorators": "array<string>", "bases": "array<string>", "protocol": "boolean"}
    nodes = nodes.select("*", *(F.lit(None).cast(t).alias(c) for c, t in more.items() if c not in nodes.columns))
    c = F.col
    none = F.array().cast("array<string>")
    marks, bases, name = F.coalesce("decorators", none), F.coalesce("bases", none), c("name")
    some = lambda xs, test: F.exists(xs, test)
    registered = some(marks, lambda d: d.isin(FRAMEWORK) | (F.contains(d, F.lit(".")) & ~d.isin(PLAIN_DECORATORS)))
    special = name.rlike(r"^__.+__$|^main$|^test_|^Test[A-Z]") | (c("path").endswith(".go") & name.rlike("^(?:Test|Benchmark|Example|Fuzz)[A-Z]")) | (c("path").endswith("__init__.py") & ~name.startswith("_"))
    exempt = F.coalesce("entry", F.lit(False)) | F.coalesce("exported", F.lit(False)) | special | registered | some(marks, lambda d: d.isin("property", "cfg(test)", "trait_impl", *STUBS)) | ((c("label") == "class") & some(bases, lambda x: x.isin(ENUMS)))
    rows = nodes.filter(c("label").isin("function", "method", "class") & (path_class(c("path")) == "product") & ~exempt)
    shown = nodes.filter("label = 'class' AND exported").select("path", F.col("name").alias("class_name")).distinct()
    public = rows.filter("label = 'method'").filter(~name.rlike("^[_#]")).join(shown, ["path", "class_name"], "left_semi").select("id")
    rows = rows.join(public, "id", "left_anti")
    beside = nodes.filter(path_class(c("path")) != "product").select(F.col("id").alias("source"))
    calls = edges.filter("rel = 'calls'").join(beside, "source", "left_anti").select(F.col("target").alias("id"))
    typed = edges.filter("rel = 'uses_type'").join(nodes.filter("label = 'class'").select(F.col("id").alias("target")), "target", "left_semi").select(F.col("target").alias("id"))
    dead = rows.join(calls.union(typed).distinct(), "id", "left_anti")
    methods = dead.filter("label = 'method'").select("id", "name", "class_name")
    names = nodes.filter("label = 'class'").select(F.col("id").alias("cid"), F.col("name").alias("cname"))
    parents = edges.filter("rel = 'extends'").join(names.toDF("source", "class_name"), "source").join(names.toDF("target", "parent"), "target").select("class_name", "parent").distinct()
    of_class = nodes.filter("label = 'method'").select("id", "name", F.col("class_name").alias("parent"))
    live = of_class.join(dead.select("id"), "id", "left_anti").select("name", "parent").distinct()
    overriding = methods.join(parents, "class_name").join(live, ["name", "parent"], "left_semi").select("id")
    protocols = nodes.filter("label = 'class' AND protocol").select(F.col("name").alias("parent")).distinct()
    asked = of_class.join(protocols, "parent").filter(~F.col("name").rlike("^__.+__$")).select(F.col("parent").alias("protocol"), "name").distinct()
    needed = asked.groupBy("protocol").agg(F.count("*").alias("k"))
    has = of_class.join(protocols, "parent", "left_anti").join(asked, "name").groupBy("protocol", F.col("parent").alias("class_name")).agg(F.countDistinct("name").alias("k"))
    conforming = has.join(needed, ["protocol", "k"]).select("protocol", "class_name").join(asked, "protocol").select("class_name", "name").distinct()
    spared = overriding.union(methods.join(conforming, ["class_name", "name"], "left_semi").select("id")).union(methods.join(protocols.withColumnRenamed("parent", "class_name"), "class_name", "left_semi").select("id"))
    return dead.join(spared.distinct(), "id", "left_anti").select("id", "name")


def tests_of(edges: DataFrame, nodes: DataFrame, changed: DataFrame, depth: int = 4) -> DataFrame:
    """Tests that reach the changed symbols, and whether within two hops."""
    reach = graph.traverse(edges, changed, depth, outgoing=False)
    tests = nodes.filter(path_class(F.col("path")) == "test").select("id")
    return reach.join(tests, "id", "left_semi").select("id", "depth", (F.col("depth") <= 2).alias("direct"))


def review_risk(changes: DataFrame, edges: DataFrame, entries: DataFrame, coupled: DataFrame, communities: DataFrame) -> DataFrame:
    """(change, entries, missing, dependents, communities, score, level) of changes (change, id, path).

    Entry points changed, coupled files (a, b, strength at least .5) that are not part of the change, a tenth of
    the callers outside it, and two more if it runs over communities (id, community); ten at most."""
    touched = changes.select("change", "id").distinct()
    files = changes.select("change", "path").distinct()
    both = coupled.filter("strength >= 0.5").select("a", "b").union(coupled.filter("strength >= 0.5").select("b", "a")).toDF("path", "other").distinct()
    missing = files.join(both, "path").join(files.withColumnRenamed("path", "other"), ["change", "other"], "left_anti").groupBy("change").agg(F.countDistinct("other").alias("missing"))
    callers = touched.withColumnRenamed("id", "target").join(edges.filter("rel = 'calls'"), "target").select("change", F.col("source").alias("id")).join(touched, ["change", "id"], "left_anti").groupBy("change").agg(F.countDistinct("id").alias("dependents"))
    begun = touched.join(entries.select("id").distinct(), "id", "left_semi").groupBy("change").agg(F.count("*").alias("entries"))
    spread = touched.join(communities, "id").groupBy("change").agg(F.countDistinct("community").alias("communities"))
    out = touched.select("change").distinct()
    for part in (begun, missing, callers, spread):
        out = out.join(part, "change", "left")
    out = out.fillna(0)
    score = F.least(F.col("entries") + F.col("missing") + F.floor(F.col("dependents") / 10) + F.when(F.col("communities") > 1, 2).otherwise(0), F.lit(10)).cast("int")
    return out.withColumn("score", score).withColumn("level", F.when(F.col("score") <= 3, "LOW").when(F.col("score") <= 6, "MEDIUM").otherwise("HIGH"))
