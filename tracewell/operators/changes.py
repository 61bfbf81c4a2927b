"""Changes and ownership: contributors, what changed, owners, bounded change sets, report scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: names of automated authors.
BOT = r"(?i)\[bot\]|^\s*(?:github-actions|dependabot(?:-preview)?|renovate(?:-bot)?|pre-commit-ci|greenkeeper|snyk-bot|mergify|imgbot|whitesource|codecov|semantic-release-bot|allcontributors)\b"

from ..functions.text import path_class


def contributors(commits: DataFrame) -> DataFrame:
    """(email or else name) -> commits, first, last and the latest display name; commits has email, name, at, hash."""
    who = F.coalesce(F.nullif(F.lower("email"), F.lit("")), F.col("name")).alias("who")
    return commits.groupBy(who).agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max_by("name", F.struct("at", "hash")).alias("name"))


def owner(counts: DataFrame, group: str) -> DataFrame:
    """The maintainer of each group among people: the share of the largest, .95 at most, bots left out."""
    people = counts.filter(~F.col("who").rlike(BOT))
    best = people.groupBy(group).agg(F.min_by("who", F.struct(-F.col("n"), "who")).alias("owner"), (F.max("n") / F.sum("n")).alias("share"))
    return best.withColumn("confidence", F.least("share", F.lit(0.95)))


def kinds_changed(files: DataFrame, path: str = "path") -> DataFrame:
    """One row: changed files by kind."""
    kind = path_class(F.col(path))
    n = lambda *k: F.count(F.when(kind.isin(*k), 1))
    return files.agg(n("product", "vendored", "example").alias("runtime"), n("test").alias("test"), n("docs").alias("docs"), n("config").alias("config"))


def within_budget(commits: DataFrame, budget: int, most: int, repo: str | None = None) -> DataFrame:
    """The first commits by place whose sizes stay within the budget, `most` at most, of each repository where one is named;
    what lies behind the first `most` never reaches the sum."""
    commits = commits.filter(F.col("place") <= most)
    order = Window.partitionBy(repo if repo else F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return commits.withColumn("running", F.sum("size").over(order)).filter((F.col("running") <= budget) & (F.col("place") <= most))


def ownership_rules(content: str) -> list[tuple[str, list[str]]]:
    """(pattern, owners) of a code-owners file in order; comments and patterns without owners are left out."""
    lines = [line.split() for line in content.splitlines() if line.strip() and not line.strip().startswith("#")]
    return [(x[0], x[1:]) for x in lines if len(x) > 1]


def glob_pattern(pattern: str) -> str:
    """A code-owners pattern as a regular expression: a name without a folder holds at any depth, a
    folder for all in it, * within a folder and ** over folders."""
    p = pattern.removeprefix("/")
    if p.endswith("/"):
        return "^" + re.escape(p)
    parts = re.split(r"(\*\*/|\*\*|\*)", p if "/" in p else f"**/{p}")
    return "^" + "".join({"**/": "(?:.+/)?", "**": ".*", "*": "[^/]*"}.get(x, re.escape(x)) for x in parts) + "$"


def code_owners(files: DataFrame, content: str) -> DataFrame:
    """(path, owners, pattern) of files (path): the last matching rule wins; nulls where none does.

    The rules are one expression, so files need no join."""
    owners, which = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for pattern, names in ownership_rules(content):
        hit = F.col("path").rlike(glob_pattern(pattern))
        owners, which = F.when(hit, F.array(*map(F.lit, names))).otherwise(owners), F.when(hit, F.lit(pattern)).otherwise(which)
    return files.select("path", owners.alias("owners"), which.alias("pattern"))


def source_status(evidence: DataFrame, configured: list[str]) -> DataFrame:
    """Every configured source with how much it contributed."""
    wanted = evidence.sparkSession.createDataFrame([(s,) for s in configured], "source string")
    return wanted.join(evidence.groupBy("source").agg(F.count("*").alias("n")), "source", "left").fillna(0, ["n"])


def per_segment(queues: DataFrame, column: str = "queue") -> DataFrame:
    """Queues named base:segment, by base, with at least two segments."""
    parts = F.split(column, ":", 2)
    rows = queues.select(F.get(parts, F.lit(0)).alias("base"), F.get(parts, F.lit(1)).alias("segment")).filter("segment IS NOT NULL AND segment <> ''")
    return rows.groupBy("base").agg(F.countDistinct("segment").alias("segments")).filter("segments >= 2")


def queue_sides(edges: DataFrame) -> DataFrame:
    """(queue, producers, workers) of edges (queue, producer, worker): the distinct ends of each side."""
    side = lambda c: F.array_sort(F.collect_set(c))
    return edges.groupBy("queue").agg(side("producer").alias("producers"), side("worker").alias("workers"))


def recall_quality(cases: DataFrame) -> DataFrame:
    """cases (id, expected or null, found array): top-3 hit rate, no-match rate, and whether both pass (.9, .95)."""
    positive, hit = F.col("expected").isNotNull(), F.array_contains(F.slice("found", 1, 3), F.col("expected"))
    a = F.avg(F.when(positive, hit.cast("double")))
    b = F.avg(F.when(~positive, (F.size("found") == 0).cast("double")))
    out = cases.agg(F.coalesce(a, F.lit(1.0)).alias("hit_rate"), F.coalesce(b, F.lit(1.0)).alias("no_match_rate"))
    return out.withColumn("passes", (F.col("hit_rate") >= 0.9) & (F.col("no_match_rate") >= 0.95))


def report_page(reports: DataFrame, project: str | None, limit: int) -> DataFrame:
    rows = reports.filter(F.col("project") == project) if project else reports
    return rows.orderBy(F.desc("at"), F.desc("id")).limit(limit)


def top_per_key(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")
