"""Queue graphs from source text: constants, enums, queue and worker declarations, tasks and their callers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How scripts and Python declare names, queues and workers.
CONSTANT = r"(?:export\s+)?const\s+([A-Za-z_$][0-9A-Za-z_$]*)\s*=\s*['\"]([^'\"]+)['\"]"
ENUM = r"(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][0-9A-Za-z_$]*)\s*\{([^}]*)\}"
MEMBER = r"([A-Za-z_$][0-9A-Za-z_$]*)\s*(?:=\s*['\"]([^'\"]*)['\"])?"
LOOP = r"for\s*\(\s*(?:const|let|var)\s+([A-Za-z_$][0-9A-Za-z_$]*)\s+of\s+Object\.values\(\s*([A-Za-z_$][0-9A-Za-z_$]*)\s*\)"
NEW_QUEUE = r"new\s+(Queue|Worker)\s*(?:<[^>]*>)?\s*\(\s*(['\"][^'\"]+['\"]|[A-Za-z_$][0-9A-Za-z_$.]*)"
INJECTED, PROCESSOR = r"@InjectQueue\(\s*['\"]([^'\"]+)['\"]", r"@Processor\(\s*['\"]([^'\"]+)['\"]"
TASK, DELAYED = r"@(?:[A-Za-z_][\w.]*\.)?(?:task|shared_task|actor)\b[^\n]*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", r"\b([A-Za-z_]\w*)\.(?:delay|apply_async|send|send_with_options)\s*\("


def _pairs(files: DataFrame, pattern: str, first: str, second: str) -> DataFrame:
    """(path, first, second) of all matches, by the pattern's two groups."""
    found = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("b"))
    return files.select("path", F.explode(found).alias("m")).select("path", F.col("m.a").alias(first), F.col("m.b").alias(second))


def constants(files: DataFrame) -> DataFrame:
    """(name, value): constants and enum members (Enum.MEMBER) of files (path, content); the first by path wins, an enum member
    without a value is named by itself."""
    plain = _pairs(files, CONSTANT, "name", "value").select("path", "name", "value")
    bodies = _pairs(files, ENUM, "enum", "body")
    inner = bodies.withColumnRenamed("body", "content").withColumn("path", F.struct("path", "enum"))
    members = _pairs(inner.select("path", "content"), MEMBER, "member", "value").filter("member <> ''")
    members = members.select("path.path", F.concat_ws(".", "path.enum", "member").alias("name"), F.when(F.col("value") == "", F.col("member")).otherwise(F.col("value")).alias("value"))
    return plain.union(members).groupBy("name").agg(F.min_by("value", F.struct("path", "value")).alias("value"))


def declared(files: DataFrame) -> DataFrame:
    """(queue, side, path): queues that scripts make or inject, and workers that take from them. A name is a text, a constant, an
    enum's member, or a loop's variable, which stands for all members of its enum; what resolves to nothing is left out."""
    known = constants(files)
    made = _pairs(files, NEW_QUEUE, "what", "arg").select("path", F.when(F.col("what") == "Queue", "producer").otherwise("worker").alias("side"), "arg")
    text = made.filter(F.col("arg").rlike("^['\"]")).select(F.regexp_replace("arg", "['\"]", "").alias("queue"), "side", "path")
    names = made.filter(~F.col("arg").rlike("^['\"]"))
    loops = _pairs(files, LOOP, "arg", "enum").distinct()
    looped = names.join(loops, ["path", "arg"]).join(known.filter(F.contains("name", F.lit("."))).select(F.substring_index("name", ".", 1).alias("enum"), F.col("value").alias("queue")), "enum").select("queue", "side", "path")
    resolved = names.join(loops.select("path", "arg"), ["path", "arg"], "left_anti").join(known.withColumnRenamed("name", "arg"), "arg").select(F.col("value").alias("queue"), "side", "path")
    one = lambda pattern, side: files.select(F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("queue"), F.lit(side).alias("side"), "path")
    return text.union(looped).union(resolved).union(one(INJECTED, "producer")).union(one(PROCESSOR, "worker")).distinct()


def tasks(files: DataFrame) -> DataFrame:
    """(queue, side, path): Python task functions by name as workers, and files that send work to one of them."""
    names = lambda pattern: files.select(F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("queue"), "path")
    workers = names(TASK).distinct()
    senders = names(DELAYED).join(workers.select("queue").distinct(), "queue", "left_semi").distinct()
    return workers.select("queue", F.lit("worker").alias("side"), "path").union(senders.select("queue", F.lit("producer"), "path"))


def edges(sides: DataFrame) -> DataFrame:
    """(queue, producer_file, worker_file): every producer with every worker of its queue, one-sided where a side is empty."""
    side = lambda s, c: sides.filter(F.col("side") == s).select("queue", F.col("path").alias(c)).distinct()
    return side("producer", "producer_file").join(side("worker", "worker_file"), "queue", "outer")


def replaced(base: DataFrame, new: DataFrame, project: str) -> DataFrame:
    """The stored edges (project, ...) with a project's own replaced by the new ones."""
    return base.filter(F.col("project") != project).unionByName(new.withColumn("project", F.lit(project)))


def name_status(lines: DataFrame) -> DataFrame:
    """(repo, path, status) of `git diff --name-status` lines (repo, line): a rename counts for its new path."""
    parts = F.split(F.trim("line"), "\t")
    rows = lines.filter(F.trim("line") != "").select("repo", F.element_at(parts, -1).alias("path"), F.substring(parts[0], 1, 1).alias("status"), F.size(parts).alias("n"))
    return rows.filter("n >= 2 AND status <> ''").select("repo", "path", "status")


def repo_state(changes: DataFrame, most: int = 100) -> DataFrame:
    """(repo, dirty, staged, unstaged, untracked, shown) of pending changes (repo, area, path): counts, and the first `most` paths of each area."""
    n = lambda a: F.count(F.when(F.col("area") == a, 1)).alias(a)
    place = F.row_number().over(Window.partitionBy("repo", "area").orderBy("path"))
    rows = changes.withColumn("shown", place <= most)
    out = rows.groupBy("repo").agg(n("staged"), n("unstaged"), n("untracked"), F.count(F.when(F.col("shown"), 1)).alias("shown"))
    return out.withColumn("dirty", F.col("staged") + F.col("unstaged") + F.col("untracked") > 0)


def short_stat(text):
    """struct<insertions, deletions> of a `--shortstat` line."""
    grab = lambda word: F.coalesce(F.regexp_extract(text, rf"(\d+) {word}", 1).try_cast("int"), F.lit(0)).alias(word + "s")
    return F.struct(grab("insertion"), grab("deletion"))
