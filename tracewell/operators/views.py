"""Views over a code graph and its history: subsystems, architecture, areas, memory by area, timelines, briefings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hints
from ..functions.text import path_class, tokens

#: Folders that name no subsystem unless all members are in such.
DEMOTED = "^(?:tests?|__tests__|unit|acceptance|integration|functional|e2e|spec|specs|fixtures?|testdata|mocks?|pyproject|mypy|setup|conftest|tox|eslint|jest|webpack|tsconfig)(?:[._-].*)?$"
#: Parts of paths that say nothing about an area.
GENERIC_PARTS = ["src", "lib", "app", "index", "main", "test", "tests", "utils", "util", "common", "shared", "core", "packages", "modules", "types"]


def subsystem_names(members: DataFrame) -> DataFrame:
    """(community, name) of members (community, path): the one or two most frequent parent folders, sorted and joined
    by +; test and tool folders count only if there are no others, letters' case does not."""
    parts = F.split("path", "/")
    folder = F.regexp_replace(F.get(parts, F.size(parts) - 2), "^[_.]+", "")
    rows = members.select("community", folder.alias("folder")).filter("folder <> ''").withColumn("low", F.lower("folder"))
    rows = rows.withColumn("aside", F.col("low").rlike(DEMOTED))
    best = rows.groupBy("community", "aside", "low").agg(F.count("*").alias("n"), F.min("folder").alias("shown"))
    pool = best.withColumn("level", F.min("aside").over(Window.partitionBy("community"))).filter("aside = level")
    top = pool.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "low"))).filter("r <= 2")
    named = F.concat(F.upper(F.substring("shown", 1, 1)), F.expr("substring(shown, 2)"))
    return top.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list(named)), "+").alias("name"))


def subsystems(communities: DataFrame, members: DataFrame, most: int = 12) -> DataFrame:
    """(name, members, testy) of communities (community, name): those of tests and other code beside the product last, the larger first."""
    sizes = members.groupBy("community").agg(F.count("*").alias("members"), F.avg((path_class(F.col("path")) != "product").cast("double")).alias("beside"))
    name = F.regexp_replace("name", "^[_.]+", "")
    halves = F.split(name, r"\+")
    clean = F.when((F.size(halves) == 2) & (F.lower(halves[0]) == F.lower(halves[1])), halves[0]).otherwise(name)
    rows = communities.join(sizes, "community").select("community", F.when(clean == "", F.col("name")).otherwise(clean).alias("name"), "members", ((F.col("beside") > 0.6) | F.lower("name").rlike("^tests?$")).alias("testy"))
    return rows.orderBy("testy", F.desc("members"), "name", "community").limit(most)


def architecture(nodes: DataFrame, edges: DataFrame, communities: DataFrame, flows: DataFrame, queues: DataFrame) -> DataFrame:
    """(section, name, n): labels, subsystems, queue boundaries with both sides, key flows (flow, steps) and fragile
    counts; each section is ranked and bounded by itself and an empty one leaves the others."""
    part = lambda df, section, name, n: df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), n.cast("long").alias("n"))
    members = nodes.filter("community IS NOT NULL").select("community", "path")
    sides = queues.groupBy("queue").agg((F.countDistinct("producer") + F.countDistinct("worker")).alias("n"))
    dead = nodes.filter("is_dead").agg(F.count("*").alias("n"))
    parts = [
        part(nodes.filter(F.lower("label") != "embedding").groupBy("label").agg(F.count("*").alias("n")), "labels", F.col("label"), F.col("n")),
        part(subsystems(communities, members), "subsystems", F.col("name"), F.col("members")), part(sides, "queues", F.col("queue"), F.col("n")),
        part(flows.orderBy(F.desc("steps"), "flow").limit(20), "flows", F.col("flow"), F.col("steps")), part(dead, "fragile", F.lit("dead code"), F.col("n")),
        part(edges.filter("rel = 'coupled_with' AND strength >= 0.7").agg(F.count("*").alias("n")), "fragile", F.lit("close couplings"), F.col("n")),
    ]
    return reduce(DataFrame.union, parts)


def area_tokens(area: str, symbols: DataFrame) -> DataFrame:
    """(token): words of the area, and of the names and paths of its symbols (name, path) with three characters or more that are not generic."""
    own = symbols.sparkSession.createDataFrame([(area,)], "area string").select(F.explode(tokens(F.col("area"))).alias("token"))
    found = symbols.select(F.explode(F.concat(tokens(F.col("name")), tokens(F.col("path")))).alias("token"))
    return own.union(found.filter((F.length("token") >= 3) & ~F.col("token").isin(GENERIC_PARTS))).distinct()


def of_area(rows: DataFrame, text: str, area: DataFrame) -> DataFrame:
    """Rows whose text shares a word with the area's tokens."""
    keyed = rows.withColumn("_k", F.struct(*rows.columns)).select("_k", F.explode(tokens(F.col(text))).alias("token"))
    hit = keyed.join(area, "token", "left_semi").select("_k").distinct()
    return hit.select("_k.*")


def memory_view(memories: DataFrame, project: str, area: str) -> DataFrame:
    """(kind, key, n): for memories (id, project, signature, tags, confidence, queues) of an area: signatures that recur,
    queues seen, and how many memories rest on little evidence (confidence under .5)."""
    mine = memories.filter((F.col("project") == project) & (F.startswith("signature", F.lit(area)) | F.array_contains("tags", area.lower())))
    again = mine.filter(hints.usable_signature(F.col("signature")).isNotNull()).groupBy("signature").agg(F.count("*").alias("n")).filter("n >= 2")
    queues = mine.select(F.explode("queues").alias("queue")).groupBy("queue").agg(F.count("*").alias("n"))
    weak = mine.filter("coalesce(confidence, 0) < 0.5").agg(F.count("*").alias("n"))
    return again.select(F.lit("recurring").alias("kind"), F.col("signature").alias("key"), "n").union(queues.select(F.lit("queue"), "queue", "n")).union(weak.select(F.lit("weak"), F.lit("low confidence"), "n"))


def change_timeline(commits: DataFrame, service: str | None) -> DataFrame:
    """(place, sha, at, files) of commits (sha, at, files) that touch a path with the service's name, the newest first."""
    rows = commits.filter(F.exists("files", lambda f: F.contains(F.lower(f), F.lit(service.lower())))) if service else commits
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("at"), "sha"))  # commits of one window, which is small by nature
    return rows.select(place.alias("place"), "sha", "at", F.size("files").alias("files"))


def range_commits(hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(span, sha): commits whose hunks (sha, file, start, stop) touch a span (span, file, lo, hi); ends included."""
    return spans.join(hunks, "file").filter("start <= hi AND stop >= lo").select("span", "sha").distinct()


def flows_for(symbols: DataFrame, steps: DataFrame) -> DataFrame:
    """(symbol, flow, steps): the flows (flow, id, step) of each symbol (id) with all their steps in order."""
    mine = symbols.select(F.col("id").alias("symbol"), "id").join(steps.select("flow", "id"), "id").select("symbol", "flow").distinct()
    whole = steps.groupBy("flow").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "id"))), lambda x: x["id"]).alias("steps"))
    return mine.join(whole, "flow").select("symbol", "flow", "steps")


def first_process(steps: DataFrame) -> DataFrame:
    """(id, flow): of each node the first flow it is a step of."""
    return steps.groupBy("id").agg(F.min("flow").alias("flow"))


def embedding_text(nodes: DataFrame, edges: DataFrame, codes: int = 12) -> DataFrame:
    """(id, text): what is embedded of a node: label and name, path, signature, whom it calls, who calls it, the types it
    uses, and error codes of its content, `codes` at most; parts without anything are left out."""
    names = nodes.select("id", F.col("name").alias("other"))
    side = lambda rel, mine, its, column: edges.filter(F.col("rel") == rel).join(names.withColumnRenamed("id", its), its).groupBy(F.col(mine).alias("id")).agg(F.array_sort(F.collect_set("other")).alias(column))
    rows = nodes
    for part in (side("calls", "source", "target", "calls"), side("calls", "target", "source", "callers"), side("uses_type", "source", "target", "uses")):
        rows = rows.join(part, "id", "left")
    found = F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b"), F.lit(0))), 1, codes)
    listed = lambda title, xs: F.when(F.size(xs) > 0, F.concat(F.lit(title + ": "), F.array_join(xs, ", ")))
    lines = [F.concat_ws(" ", "label", "name"), F.concat(F.lit("in "), F.col("path")), F.col("signature"), listed("calls", F.col("calls")), listed("called by", F.col("callers")), listed("uses", F.col("uses")), listed("codes", found)]
    return rows.select("id", F.concat_ws("\n", *lines).alias("text"))


def reexports(exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, name, path, target) of names that a file (path, name, source) hands on from another file: a stub for each
    that is no symbol (id, name, path) of the file itself and is one of its source."""
    found = exports.join(symbols.select(F.col("id").alias("target"), "name", F.col("path").alias("source")), ["name", "source"])
    own = symbols.select("name", "path")
    return found.join(own, ["name", "path"], "left_anti").select(F.concat_ws(":", F.lit("alias"), "path", "name").alias("id"), "name", "path", "target")


def knowledge(nodes: DataFrame, categories: dict[str, list[str]], most: int = 5000) -> DataFrame:
    """(category, id): nodes by category of their label, `most` of each by id."""
    of = F.lit(None).cast("string")
    for name, labels in categories.items():
        of = F.when(F.col("label").isin(labels), name).otherwise(of)
    rows = nodes.select(of.alias("category"), "id").filter("category IS NOT NULL")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("id"))).filter(F.col("r") <= most).drop("r")


def integrations(profiles: DataFrame) -> DataFrame:
    """(system, repos, n) of external systems that repositories (repo, system) use."""
    return profiles.filter("system IS NOT NULL").groupBy("system").agg(F.array_sort(F.collect_set("repo")).alias("repos")).withColumn("n", F.size("repos"))


def packet(evidence: DataFrame, budget: int, files: int) -> DataFrame:
    """(inv, kind, id, place): a briefing's items (inv, id, priority, relevance, file): the `budget` most important, and
    the `files` files that most of all items name."""
    rank = F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).when(F.col("priority") == "low", 3).otherwise(4)
    by = lambda *order: F.row_number().over(Window.partitionBy("inv").orderBy(*order))
    items = evidence.select("inv", F.lit("evidence").alias("kind"), "id", by(rank, F.desc("relevance"), F.col("id")).alias("place")).filter(F.col("place") <= budget)
    named = evidence.filter("file IS NOT NULL").groupBy("inv", "file").agg(F.count("*").alias("n"), F.max("relevance").alias("r"))
    return items.union(named.select("inv", F.lit("file"), "file", by(F.desc("n"), F.desc("r"), F.col("file")).alias("place")).filter(F.col("place") <= files))


def dispatch(parameters: Column) -> Column:
    """Whether a signature's parameters name a segment that work is dealt by."""
    return parameters.rlike(r"(?i)\b(?:region|market|country|tenant|segment|shard|locale|brand)(?:Id|Code|_id|_code)?\b")


def searched(frames: dict[str, DataFrame | None], column: str, words: list[str], most: int) -> DataFrame:
    """(repo, id): rows of each repository's frame that hold a word, `most` of each; one that cannot be reached has none."""
    some = F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(column), w))
    parts = [df.filter(some).orderBy("id").limit(most).select(F.lit(repo).alias("repo"), F.col("id").cast("string").alias("id")) for repo, df in frames.items() if df is not None]
    return reduce(DataFrame.union, parts)
