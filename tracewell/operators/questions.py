"""Follow-up questions answered from saved reports: what contradicts an explanation, what evidence is missing, what limits the confidence.

hypotheses has report, id, category, verdict and contradicts (ids); evidence report and id; gaps report, dimension and impact;
totals report, confidence and ceiling, one row a report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wording of the three kinds of questions, in the order in which they are tried.
KINDS = {
    "confidence": r"(?i)\b(?:confidence|confident|certainty|sure|why\s+(?:is\s+)?(?:it\s+)?not\s+higher)\b",
    "contradicts": r"(?i)\b(?:contradict|contradicts|argues?\s+against|evidence\s+against|rule\s+out|disprove|refute|weaken)\b",
    "missing-evidence": r"(?i)\b(?:missing|absent|gaps?|don'?t\s+have|do\s+not\s+have|lack(?:ing)?|what\s+else)\b",
}
#: Topics with their words and the category of explanations that they mean, in the order in which they are tried.
TOPICS = {
    "queue": ("queue backlog enqueue drain", "queue-backlog"),
    "worker": ("worker processor slowdown stall consume", "worker-slowdown"),
    "deployment": ("deploy deployment change commit regression shipped release", "deployment-regression"),
    "api": ("api external upstream latency", "external-api-latency"),
    "retry": ("retry storm", "retry-storm"),
    "infra": ("infra infrastructure redis database network", "infrastructure"),
}


#: Fixed value: the end of a word of ASCII letters, as the patterns' \b means it; that of Java takes other letters and marks for parts of words too.
_EDGE = r"(?:(?<=[a-zA-Z0-9_])(?![a-zA-Z0-9_])|(?<![a-zA-Z0-9_])(?=[a-zA-Z0-9_]))"


def _found(text: Column, pattern: str) -> Column:
    return text.rlike(pattern.replace(r"\b", _EDGE))


def question_kind(text: Column) -> Column:
    """contradicts, missing-evidence or confidence; null for any other text."""
    return F.coalesce(*[F.when(_found(text, p), F.lit(k)) for k, p in KINDS.items()])


def question_topic(text: Column) -> Column:
    """The topic that a question names, by its own name alone or by any of its words."""
    named = lambda name, words: (F.trim(F.lower(text)) == name) | _found(text, rf"(?i)\b(?:{words.replace(' ', '|')})\b")
    return F.coalesce(*[F.when(named(t, words), F.lit(t)) for t, (words, _) in TOPICS.items()])


def answers(questions: DataFrame, hypotheses: DataFrame, evidence: DataFrame, gaps: DataFrame, totals: DataFrame) -> DataFrame:
    """(question, report, kind, topic, answer, n, items, verdicts, confidence, ceiling) of questions (question, report, text) that are of a kind.

    contradicts: items are the evidence against the topic's explanations, or against all where no topic is named (`contradicted`,
    `uncontradicted`), verdicts theirs; of a topic that no explanation is about the items are the categories that
    were looked at (`not-evaluated`). missing-evidence: the dimensions without evidence (`gaps`, `no-gaps`). confidence: the
    dimensions by what they cost, the dearest first (`capped`, `uncapped`), and the categories of explanations that are
    not confirmed as verdicts. Lists are made once a report, however many questions it gets; ids that are no evidence are dropped."""
    c, text = F.col, F.col("text")
    category = F.coalesce(*[F.when(c("topic") == t, F.lit(k)) for t, (_, k) in TOPICS.items()])
    asked = questions.select("question", "report", question_kind(text).alias("kind"), question_topic(text).alias("topic")).filter("kind IS NOT NULL").withColumn("category", category)
    against = hypotheses.select("report", "category", F.explode("contradicts").alias("id")).distinct().join(evidence.select("report", "id"), ["report", "id"], "left_semi")
    ids = lambda g: against.groupBy(*g).agg(F.array_sort(F.collect_set("id")).alias("against"))
    verdicts = lambda g: hypotheses.groupBy(*g).agg(F.array_sort(F.collect_set("verdict")).alias("told"))
    looked = hypotheses.groupBy("report").agg(F.array_sort(F.collect_set("category")).alias("looked"), F.array_sort(F.collect_set(F.when(c("verdict").isin("weakened", "unconfirmed"), c("category")))).alias("weak"))
    cost = gaps.groupBy("report").agg(F.transform(F.array_sort(F.collect_set(F.struct((-c("impact")).alias("less"), "dimension"))), lambda x: x["dimension"]).alias("costs"), F.array_sort(F.collect_set("dimension")).alias("lacks"))
    of_topic = verdicts(["report", "category"]).join(ids(["report", "category"]), ["report", "category"], "left").select("report", "category", c("told").alias("topic_told"), c("against").alias("topic_against"))
    rows = asked.join(of_topic, ["report", "category"], "left").join(ids(["report"]), "report", "left").join(looked, "report", "left").join(cost, "report", "left").join(totals.select("report", "confidence", "ceiling"), "report", "left")
    none = F.array().cast("array<string>")
    some = lambda name: F.coalesce(c(name), none)
    unmet = c("topic").isNotNull() & c("topic_told").isNull()
    contra = F.when(unmet, some("looked")).when(c("topic").isNotNull(), some("topic_against")).otherwise(some("against"))
    items = F.when(c("kind") == "contradicts", contra).when(c("kind") == "confidence", some("costs")).otherwise(some("lacks"))
    rows = rows.withColumn("items", items)
    met = F.size("items") > 0
    answer = F.when(c("kind") == "contradicts", F.when(unmet, "not-evaluated").when(met, "contradicted").otherwise("uncontradicted")).when(c("kind") == "confidence", F.when(met, "capped").otherwise("uncapped")).otherwise(F.when(met, "gaps").otherwise("no-gaps"))
    told = F.when(c("kind") == "contradicts", some("topic_told")).when(c("kind") == "confidence", some("weak")).otherwise(none)
    sure = lambda name: F.when(c("kind") == "confidence", c(name))
    return rows.select("question", "report", "kind", "topic", answer.alias("answer"), F.size("items").alias("n"), "items", told.alias("verdicts"), sure("confidence").alias("confidence"), sure("ceiling").alias("ceiling"))
