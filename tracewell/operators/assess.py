"""Assessment of reports and code bases, and recall of past incidents for a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, tokens

HIDDEN = ["superseded", "rejected", "archived"]


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("F")


def quality(reports: DataFrame) -> DataFrame:
    """(id, score, grade, lever) of reports (id, evidence, hypotheses, resolved, confidence, gaps, actions): five
    components by weight; the lever is the first of the lowest."""
    parts = [
        ("evidence support", 0.2, F.least(F.col("evidence") / 8, F.lit(1.0))), ("hypothesis discrimination", 0.25, F.coalesce(F.try_divide("resolved", F.col("hypotheses").cast("double")), F.lit(0.0))),
        ("diagnostic calibration", 0.25, F.col("confidence")), ("evidence completeness", 0.2, 1 - F.least(F.col("gaps") / 6, F.lit(1.0))), ("actionability", 0.1, F.when(F.col("actions") > 0, 1.0).otherwise(0.0)),
    ]
    score = F.floor(100 * sum((w * v for _, w, v in parts), F.lit(0.0)) + 0.5)
    low = F.array_min(F.array(*[F.struct(v.cast("double").alias("v"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, _, v) in enumerate(parts)]))
    return reports.select("id", score.alias("score"), grade(score).alias("grade"), low["name"].alias("lever"))


def health(nodes: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """One row of the five parts and the score of a code graph: nodes (id, label, is_dead, community), edges (rel, confidence,
    strength) and flow steps (id); a part without data has its default."""
    callable_ = F.col("label").isin("function", "method")
    n = nodes.agg(F.count(F.when(F.col("label").isin("function", "method", "class"), 1)).alias("symbols"), F.count(F.when(F.col("is_dead"), 1)).alias("dead"), F.countDistinct("community").alias("communities"), F.count(F.when(callable_, 1)).alias("callables"))
    e = edges.agg(F.avg(F.when(F.col("rel") == "calls", F.col("confidence"))).alias("sure"), F.count(F.when(F.col("rel") == "coupled_with", 1)).alias("coupled"), F.count(F.when((F.col("rel") == "coupled_with") & (F.col("strength") > 0.7), 1)).alias("close"))
    used = steps.select("id").distinct().join(nodes.filter(callable_).select("id"), "id", "left_semi").agg(F.count("*").alias("used"))
    one = n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(used))  # one row each
    c, within = F.col, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))
    r = lambda x: F.round(x, 1)
    parts = one.select(
        r(within(100 - c("dead") / F.greatest("symbols", F.lit(1)) * 100)).alias("dead_code"), F.when(c("coupled") == 0, 100.0).otherwise(r(within(100 - c("close") / c("coupled") * 200))).alias("coupling"),
        F.when(c("communities") == 0, 20.0).when(c("communities") <= 15, r(within(c("communities") / 15 * 100))).otherwise(r(F.greatest(100 - (c("communities") - 15) * 2.0, F.lit(50.0)))).alias("modularity"),
        r(within(F.coalesce("sure", F.lit(0.8)) * 100)).alias("confidence"), r(within(c("used") / F.greatest("callables", F.lit(1)) * 100)).alias("coverage"),
    )
    return parts.withColumn("score", r(0.25 * c("dead_code") + 0.2 * c("coupling") + 0.2 * c("modularity") + 0.2 * c("confidence") + 0.15 * c("coverage")))


def scenario(reports: DataFrame, signals: list[str]) -> DataFrame:
    """(id, passed, total) of reports (id, seeds, crossings, gaps, actions, kinds, categories): how many expected signals are there;
    an unknown signal never is."""
    some = lambda name: F.size(name) > 0
    known = {"seed": some("seeds"), "queue-boundary": some("crossings"), "gaps": some("gaps"), "actions": some("actions"), "commit": F.array_contains("kinds", "commit")}
    tests = [F.array_contains("categories", s[4:]) if s.startswith("hyp:") else known.get(s, F.lit(False)) for s in signals]
    return reports.select("id", sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0)).alias("passed"), F.lit(len(signals)).alias("total"))


def gap_actions(gaps: DataFrame) -> DataFrame:
    """(inv, place, dimension) of gaps (inv, dimension, impact, seq): the costliest first, runtime evidence last of all."""
    order = Window.partitionBy("inv").orderBy(F.col("dimension") == "runtime evidence", F.desc("impact"), "seq")
    return gaps.select("inv", F.row_number().over(order).alias("place"), "dimension")


def reranked(causes: DataFrame, score: Column) -> DataFrame:
    """(inv, id, place): causes (inv, id, seq) by a model's score; equal ones keep their order, none is added or lost."""
    order = Window.partitionBy("inv").orderBy(score.desc(), F.col("seq"))
    return causes.select("inv", "id", F.row_number().over(order).alias("place"))


def claims_like(entries: DataFrame, query: str, repo: str, limit: int = 10) -> DataFrame:
    """(id, score) of a repository's claims (id, repo, scope, claim) by shared words with the query; of equal ones the narrower
    scope, then the id. Without a repository or a word nothing is seen."""
    q = tokens(F.lit(query))
    rank = F.when(F.col("scope") == "symbol", 3).when(F.col("scope") == "file", 2).when(F.col("scope") == "area", 1).otherwise(0)
    rows = entries.filter((F.col("repo") == repo) & (F.lit(repo.strip() != ""))).select("id", jaccard(tokens(F.col("claim")), q).alias("score"), rank.alias("rank"))
    return rows.filter("score > 0").orderBy(F.desc("score"), F.desc("rank"), "id").limit(limit).select("id", "score")


def startup_recall(pool: DataFrame, asked: dict[str, str], query: list[str], now: Column, similarity: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(id, fields, relevance) of past incidents to look at first: at most `most`, one of each incident.

    pool: id, incident, claim, status, created_at, seen_at, verified_at, hints (array of term arrays) and the fields environment,
    service, fingerprint, error_code, workflow, operation of where it applies. asked has the same fields of the new incident, as
    far as known. Hidden and future ones are out, so is one whose known field says otherwise; the rest needs a field in common, or
    its hints match: by shared terms of .45, with a similarity (id, similarity) of .86 together, or by a rare code. Terms weigh by
    their rarity among all hints of the pool."""
    docs = pool.select("id", F.posexplode("hints").alias("h", "terms"))
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    wanted = sorted(set(query))
    idf = lambda many: F.log(1 + (F.col("n") - many + 0.5) / (many + 0.5))
    every = docs.select("id", "h", F.explode(F.array_distinct("terms")).alias("t")).join(df, "t").crossJoin(F.broadcast(n)).withColumn("w", idf(F.col("df")))  # n is one row
    hit = F.col("t").isin(wanted)
    rare = hit & F.col("t").startswith("#") & (F.length("t") > 6) & (F.col("df") <= 2)
    per = every.groupBy("id", "h").agg(F.sum("w").alias("own"), F.sum(F.when(hit, F.col("w")).otherwise(0.0)).alias("both"), F.count(F.when(hit, 1)).alias("k"), F.coalesce(F.bool_or(rare), F.lit(False)).alias("rare"))
    words = pool.sparkSession.createDataFrame([(t,) for t in wanted], "t string").join(df, "t", "left").crossJoin(F.broadcast(n)).agg(F.sum(idf(F.coalesce("df", F.lit(0)))).alias("total"))
    scored = per.crossJoin(F.broadcast(words))  # one row
    f1 = F.when(F.col("k") >= 2, F.try_divide(2 * F.col("both"), F.col("own") + F.col("total")))
    best = scored.groupBy("id").agg(F.coalesce(F.max(f1), F.lit(0.0)).alias("keyword"), F.bool_or("rare").alias("rare"))
    rows = pool.join(best, "id", "left")
    rows = rows.join(similarity, "id", "left") if similarity is not None else rows.withColumn("similarity", F.lit(None).cast("double"))
    keyword = F.coalesce("keyword", F.lit(0.0))
    score = F.when(F.col("similarity").isNull(), keyword).otherwise(F.col("similarity") + 0.4 * keyword)
    matched = F.coalesce("rare", F.lit(False)) | (score >= F.when(F.col("similarity").isNull(), 0.45).otherwise(0.86))
    differs = lambda f: (F.coalesce(F.col(f), F.lit("")) != "") & (F.col(f) != asked[f]) if asked.get(f) else F.lit(False)
    same = F.filter(F.array(*[F.when(F.col(f) == asked[f], F.lit(f)) if asked.get(f) else F.lit(None).cast("string") for f in ("fingerprint", "error_code", "workflow", "operation")]), lambda x: x.isNotNull())
    late = lambda c: F.coalesce(F.col(c) > now, F.lit(False))
    fit = ~F.col("status").isin(HIDDEN) & ~late("created_at") & ~late("seen_at") & ~late("verified_at")
    for f in ("environment", "service", "fingerprint", "error_code", "workflow", "operation"):
        fit = fit & ~differs(f)
    found = rows.filter(fit).select("id", F.coalesce("incident", F.lower("claim")).alias("key"), same.alias("fields"), score.alias("hint"), matched.alias("matched"))
    found = found.filter((F.size("fields") > 0) | F.col("matched")).select("id", "key", "fields", F.round(F.size("fields") + F.col("hint"), 9).alias("relevance"))  # sums of one set of terms are ties, whatever their order
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("relevance"), "id"))
    return found.withColumn("r", first).filter("r = 1").orderBy(F.desc("relevance"), "id").limit(most).select("id", "fields", "relevance")
