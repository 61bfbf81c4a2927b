"""Hypotheses, candidate causes, findings and the headline of many investigations at once.

Evidence here has inv (the investigation), id, kind, queue, signal (what a queue, metric or state item
says, or how a log was linked), direct, level, ratio, message, n and seq; an investigation's facts are one row
of inv, queues, changed, change_relevant, focus, maintenance, affected, seed and impact (evidence ids).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

#: Fixed value: retry wording of logs.
RETRY = r"(?i)\b(?:retr(?:y|ies|ied|ying)|re-?attempt|attempts?|back-?off|re-?queu|redeliver)"
#: Fixed value: wording of network and dependency failures.
NETWORK = r"(?i)\b(?:ENOTFOUND|ECONNREFUSED|ETIMEDOUT|EAI_AGAIN|ECONNRESET|getaddrinfo|socket hang up|connection (?:refused|reset|timed out)|network (?:error|timeout)|DNS)\b"
#: Fixed value: files of a change beyond which it is broad.
BROAD = 14
NONE = "array<string>"


def _ids(test: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(test, F.col("id"))))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def hypotheses(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """(inv, id, category, queue, prior, supports, contradicts, seq): the competing explanations.

    Seven templates, two of them for each queue of the investigation. Support raises the prior;
    starvation speaks against a retry storm, direct errors against benign variance, which is named only
    if something supports it or the facts say that it applies. facts also has vague and benign."""
    k, s, c = F.col("kind"), F.col("signal"), F.col
    retry = (k == "log") & (c("ratio") >= 2) & c("direct") & F.coalesce(c("message"), F.lit("")).rlike(RETRY)
    alive = (k == "state") & ~F.coalesce(s, F.lit("")).isin("stale", "legacy")
    backlog, starved = (k == "queue-state") & (s == "backlog"), (k == "queue-state") & (s == "worker-starvation")
    latency = (k == "metric") & s.isin("latency", "error-rate-change")
    loud = (k == "log") & c("direct") & c("level").isin("error", "fatal", "critical")
    seen = evidence.groupBy("inv").agg(
        _ids((k == "commit") & (F.coalesce(s, F.lit("")) != "per-commit")).alias("commits"), _ids(retry | backlog).alias("storm"), _ids(starved).alias("starved"), _ids(latency).alias("latency"),
        _ids(alive | starved | latency).alias("infra"), _ids((k == "duration") | ((k == "metric") & (s == "bimodal-population"))).alias("benign_ids"), _ids(loud).alias("loud"),
    )
    none = F.array().cast(NONE)
    rows = facts.join(seen, "inv", "left")
    of = lambda name: F.coalesce(c(name), none)
    has = lambda x: F.size(x) > 0
    relevant = has(of("commits")) & F.coalesce(c("change_relevant"), F.lit(True))
    broad = relevant & F.coalesce(c("focus") > BROAD, F.lit(False))
    vague = relevant & ~broad & F.coalesce(c("vague"), F.lit(False))
    one = lambda seq, name, prior, supports, against: F.struct(F.lit(name).alias("category"), prior.cast("double").alias("prior"), supports.alias("supports"), against.alias("contradicts"), F.lit(seq).alias("seq"))
    prior = lambda ids, yes, no: F.when(has(ids), yes).otherwise(no)
    change = F.when(broad, 0.25).when(vague, 0.3).when(relevant, 0.5).otherwise(0.15)
    benign = of("benign_ids")
    templates = F.array(
        one(0, "deployment-regression", change, F.when(relevant & ~broad & ~vague, of("commits")).otherwise(none), none),
        one(3, "external-api-latency", prior(of("latency"), 0.55, 0.2), of("latency"), none), one(4, "retry-storm", prior(of("storm"), 0.35, 0.15), of("storm"), of("starved")),
        one(5, "infrastructure", prior(of("infra"), 0.35, 0.15), of("infra"), none),
        F.when(has(benign) | F.coalesce(c("benign"), F.lit(False)), one(6, "benign-variance", F.lit(0.1), benign, of("loud"))),
    )
    fixed = rows.select("inv", F.lit(None).cast("string").alias("queue"), F.explode(F.filter(templates, lambda h: h.isNotNull())).alias("h"))
    slow = starved | ((k == "metric") & (s == "queue-growth"))
    by_queue = evidence.filter("queue IS NOT NULL").groupBy("inv", "queue").agg(_ids(backlog).alias("backlog"), _ids(slow).alias("slow"))
    each = facts.select("inv", F.explode("queues").alias("queue")).join(by_queue, ["inv", "queue"], "left")
    pair = F.array(one(1, "queue-backlog", prior(of("backlog"), 0.7, 0.35), of("backlog"), none), one(2, "worker-slowdown", prior(of("slow"), 0.55, 0.3), of("slow"), none))
    found = fixed.unionByName(each.select("inv", "queue", F.explode(pair).alias("h")))
    return found.select("inv", F.concat_ws(":", "h.category", "queue").alias("id"), "h.category", "queue", "h.prior", "h.supports", "h.contradicts", "h.seq")


def touched_score(focus: Column) -> Column:
    """The base of a regression by how few files the most focused commit on the seed's file changed."""
    return F.when(focus.isNull(), 0.18).when(focus <= 4, 0.45).when(focus <= 8, 0.38).when(focus <= 14, 0.3).otherwise(0.2)


def cause_inputs(evidence: DataFrame, queues: DataFrame, facts: DataFrame) -> DataFrame:
    """(inv, id, category, base, ids): candidate causes with their base score and evidence.

    queues (inv, queue, waiting, active) is the queues' runtime state; facts also has data_flow (a base or
    null) and source_impact (whether the question is structural, which leaves changes out)."""
    c, k, s = F.col, F.col("kind"), F.col("signal")
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    made = lambda df, id_, category, base, ids: df.select("inv", id_.alias("id"), F.lit(category).alias("category"), base.cast("double").alias("base"), F.filter(ids, lambda x: x.isNotNull()).alias("ids"))
    name = lambda prefix: F.concat(F.lit(prefix), c("queue"))
    starved = (c("waiting") >= 10) & (c("active") == 0)
    of_queue = evidence.filter("kind = 'queue-state'").groupBy("inv", "queue").agg(_ids(F.lit(True)).alias("ids"))
    none = F.array().cast(NONE)
    jammed = queues.filter(starved | (c("waiting") > 100)).join(of_queue, ["inv", "queue"], "left")
    parts = [made(jammed, name("queue-backlog:"), "queue-backlog", clamp(F.when(starved, 0.45).otherwise(0.45 + F.least(c("waiting") / 5000, F.lit(0.2)))), F.coalesce("ids", none))]
    paths = evidence.filter("kind = 'queue-edge'").groupBy("inv", "queue").agg(_ids(F.lit(True)).alias("ids")).join(facts, "inv")
    parts.append(made(paths, name("queue-path:"), "queue-path", F.lit(0.35), F.array_append("ids", c("impact"))))
    hits = evidence.filter("kind = 'queue-edge'").groupBy("inv").agg(F.countDistinct("queue").alias("hits"))
    known = facts.join(hits, "inv", "left").withColumn("bonus", F.when(F.coalesce(c("hits"), F.lit(0)) > 0, 0.05).otherwise(0.0))
    open_question = ~F.coalesce(c("source_impact"), F.lit(False))
    change = F.when(c("change_relevant"), touched_score(c("focus"))).otherwise(0.18) + c("bonus")
    parts.append(made(known.filter(c("changed").isNotNull() & open_question), F.lit("deployment-regression"), "deployment-regression", clamp(change * F.when(c("change_relevant") & c("maintenance"), 0.5).otherwise(1.0)), F.array("changed", "seed")))
    parts.append(made(known.filter((c("affected") >= 3) & c("impact").isNotNull() & c("seed").isNotNull()), F.lit("blast-radius"), "blast-radius", clamp(0.15 + c("bonus")), F.array("impact", "seed")))
    parts.append(made(known.filter(c("data_flow").isNotNull() & c("seed").isNotNull() & open_question), F.lit("seed-data-flow"), "data-flow", c("data_flow"), F.array("seed")))
    tier = rules.severity_tier(c("code"), c("level"), c("message"))
    logs = evidence.filter("kind = 'log'").withColumn("tier", tier)
    rank = F.when(c("tier") == "error", 0).when(c("tier") == "warning", 1).otherwise(2)
    volume = lambda rate: F.least(F.log10(F.greatest(c("lead.n").cast("double"), F.lit(1.0))) * rate, F.lit(0.1))
    emitted = logs.filter("signal IN ('seed', 'callee')")
    lead = F.min(F.struct((s != "seed").alias("callee"), rank.alias("rank"), (-c("n")).alias("less"), c("id"), c("tier"), c("n"))).alias("lead")
    joined = emitted.groupBy("inv").agg(lead, _ids(F.lit(True)).alias("ids")).join(facts.filter("seed IS NOT NULL"), "inv").filter("lead.tier <> 'info'")
    base = F.when(c("lead.tier") == "error", 0.6).otherwise(0.42) + volume(0.025) - F.when(c("lead.callee"), 0.18).otherwise(0.0)
    parts.append(made(joined, F.lit("seed-emitted-error"), "error-correlation", clamp(base), F.array_append("ids", c("seed"))))
    hinted = logs.filter("signal = 'hint'").groupBy("inv").agg(F.min(F.struct((-c("n")).alias("less"), c("id"), c("tier"), c("n"))).alias("lead"))
    hinted = hinted.join(emitted.select("inv").distinct(), "inv", "left_anti")
    parts.append(made(hinted, F.lit("hint-matched-signal"), "error-correlation", clamp(F.when(c("lead.tier") == "error", 0.6).otherwise(0.56) + volume(0.03)), F.array("lead.id")))
    direct = (k == "log") & c("direct")
    broken = F.coalesce(c("message"), F.lit("")).rlike(NETWORK)
    summed = evidence.groupBy("inv").agg(
        _ids(direct).alias("logs"), F.coalesce(F.bool_or(direct & broken), F.lit(False)).alias("network"), F.min(F.when((k == "queue-state") & (s == "failed-breakdown") & broken, F.struct("seq", "id", "direct"))).alias("failed"),
        _ids((k == "state") & s.isin("anomaly", "stale")).alias("data"), _ids((k == "metric") & s.isin("latency", "error-rate-change")).alias("latency"), _ids((k == "metric") & (s == "queue-growth")).alias("growth"),
    )
    three = lambda name_: F.slice(name_, 1, 3)
    some = lambda name_: F.size(name_) > 0
    parts.append(made(summed.filter(some("logs")).join(hits, "inv"), F.lit("error-correlation"), "error-correlation", F.lit(0.3), three("logs")))
    parts.append(made(summed.filter("network"), F.lit("dependency-failure"), "infrastructure", F.lit(0.5), three("logs")))
    # direct of a queue failure says that it is fresh.
    parts.append(made(summed.filter("NOT network AND failed IS NOT NULL"), F.lit("dependency-failure"), "infrastructure", F.when(c("failed.direct"), 0.5).otherwise(0.34), F.array("failed.id")))
    parts.append(made(summed.filter(some("data")), F.lit("data-state-anomaly"), "data-state-anomaly", F.lit(0.22), three("data")))
    parts.append(made(summed.filter(some("latency")), F.lit("metric-latency"), "external-api-latency", F.lit(0.45), c("latency")))
    parts.append(made(summed.filter(some("growth")), F.lit("metric-queue-growth"), "queue-backlog", F.lit(0.4), c("growth")))
    return _union(parts)


def findings(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """(inv, finding, kind, confidence, ids): what the evidence says by itself.

    facts also has seed_score (null: unknown) and low_confidence; counts of flows, commits and configuration
    files are those of the evidence."""
    c, k = F.col, F.col("kind")
    made = lambda df, what, kind, conf, ids: df.select("inv", what.alias("finding"), F.lit(kind).alias("kind"), F.round(conf, 3).alias("confidence"), ids.alias("ids"))
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    sure = F.when(c("low_confidence"), F.least(F.coalesce("seed_score", F.lit(0.3)), F.lit(0.4))).otherwise(F.least(F.greatest(F.coalesce("seed_score", F.lit(0.75)), F.lit(0.5)), F.lit(0.95)))
    parts = [made(facts.filter("seed IS NOT NULL"), F.lit("seed"), "observation", F.round(sure, 2), F.array("seed"))]
    per = evidence.groupBy("inv").agg(_ids(k == "flow").alias("flows"), _ids(k == "config-change").alias("config"), F.sum(F.when(k == "commit", c("n"))).alias("commits"), F.min(F.when(k == "commit", c("id"))).alias("commit"))
    parts.append(made(per.filter("size(flows) > 0"), F.lit("flows"), "observation", clamp(0.5 + F.size("flows") * 0.1), c("flows")))
    parts.append(made(facts.filter("affected > 0 AND impact IS NOT NULL"), F.lit("blast-radius"), "observation", clamp(0.4 + F.least("affected", F.lit(20)) / 40), F.array("impact")))
    parts.append(made(per.filter("commits IS NOT NULL"), F.lit("commits"), "observation", clamp(0.3 + F.least("commits", F.lit(10)) / 20), F.array("commit")))
    parts.append(made(per.filter("size(config) > 0"), F.lit("config-change"), "observation", clamp(0.35 + F.least(F.size("config"), F.lit(10)) / 20), c("config")))
    crossed = evidence.filter("kind = 'queue-edge'").groupBy("inv", "queue").agg(_ids(F.lit(True)).alias("ids"))
    parts.append(made(crossed, F.concat(F.lit("queue:"), c("queue")), "correlation", F.lit(0.7), c("ids")))
    return _union(parts)


def uncertainty(causes: DataFrame, found: DataFrame) -> DataFrame:
    """(inv, id, delta): what unsure findings take from causes (inv, id, ids): a tenth of what the surest
    finding on their evidence, mere observations aside, lacks to .6."""
    items = causes.select("inv", "id", F.explode("ids").alias("eid"))
    sure = found.filter("kind <> 'observation'").select("inv", "confidence", F.explode("ids").alias("eid"))
    best = items.join(sure, ["inv", "eid"]).groupBy("inv", "id").agg(F.max("confidence").alias("most"))
    return best.filter("most < 0.6").select("inv", "id", F.round(-(0.6 - F.col("most")) * 0.1, 3).alias("delta")).filter("delta <> 0")


def context(causes: DataFrame, nodes: DataFrame, service: str) -> DataFrame:
    """(inv, id, delta): causes whose evidence hangs on the implicated node of the service asked about.
    nodes (inv, node, type, implicated, ids)."""
    mine = nodes.filter((F.col("node") == f"service:{service}") & F.col("implicated")).select("inv", F.explode("ids").alias("eid"))
    items = causes.select("inv", "id", F.explode("ids").alias("eid"))
    return items.join(mine, ["inv", "eid"], "left_semi").select("inv", "id").distinct().withColumn("delta", F.lit(0.04))


def history(causes: DataFrame, nodes: DataFrame, prior: DataFrame) -> DataFrame:
    """(inv, id, delta): .04 for each code node with prior incidents (prior: node, n) on a cause's evidence, .1 at most."""
    code = nodes.filter(F.col("type").isin("symbol", "file")).join(prior.filter("n > 0"), "node").select("inv", "node", F.explode("ids").alias("eid"))
    items = causes.select("inv", "id", F.explode("ids").alias("eid"))
    met = items.join(code, ["inv", "eid"]).groupBy("inv", "id").agg(F.countDistinct("node").alias("k"))
    return met.select("inv", "id", F.round(F.least(F.col("k") * 0.04, F.lit(0.1)), 3).alias("delta"))


def headline(ranked: DataFrame, linked: DataFrame) -> DataFrame:
    """(inv, top, headline, linked): of ranked causes (inv, id, score, place, ids) the best, and the one to name:
    of those with .2 at least the best whose evidence is linked (inv, eid) to the seed, or else the best.
    Of equal scores the first place wins."""
    items = ranked.select("inv", "id", F.explode("ids").alias("eid")).join(linked, ["inv", "eid"], "left_semi").select("inv", "id").distinct().withColumn("on_seed", F.lit(True))
    rows = ranked.join(items, ["inv", "id"], "left").withColumn("on_seed", F.coalesce("on_seed", F.lit(False)))
    order = F.struct("score", -F.col("place"))
    fit = F.col("score") >= 0.2
    return rows.groupBy("inv").agg(
        F.max_by("id", order).alias("top"),
        F.max_by(F.when(fit, F.col("id")), F.when(fit, F.struct("on_seed", "score", -F.col("place")))).alias("headline"),
        F.coalesce(F.bool_or(fit & F.col("on_seed")), F.lit(False)).alias("linked"),
    )


def evidence_graph(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (inv, node, type, ids) and edges (inv, source, type, target, ids) of evidence, by rules of its kind.

    evidence has queue, producer, worker, services, collection, symbol, file, flow and steps; what is null
    gives nothing. Each item is a node itself, under which the rest hangs."""
    ev = F.concat(F.lit("ev:"), "id")
    c = F.col
    named = lambda prefix, name: F.when(name.isNotNull() & (name != ""), F.concat(F.lit(prefix + ":"), name))
    node = lambda x, kind: F.struct(x.alias("node"), F.lit(kind).alias("type"))
    edge = lambda a, kind, b: F.struct(a.alias("source"), F.lit(kind).alias("type"), b.alias("target"))
    is_kind = lambda *kinds: c("kind").isin(*kinds)
    q, producer, worker = F.when(is_kind("queue-edge", "queue-state"), named("queue", c("queue"))), F.when(is_kind("queue-edge"), named("service", c("producer"))), F.when(is_kind("queue-edge"), named("worker", c("worker")))
    box, deploy = F.when(is_kind("state"), named("collection", c("collection"))), F.when(is_kind("commit"), F.concat(F.lit("deployment:"), c("id")))
    symbol, file = F.when(is_kind("symbol"), named("symbol", c("symbol"))), F.when(is_kind("symbol") & (c("symbol") != ""), named("file", c("file")))
    flow, many = F.when(is_kind("flow"), named("flow", c("flow"))), F.when(is_kind("log", "metric"), F.transform("services", lambda x: F.concat(F.lit("service:"), x)))
    steps = F.when(is_kind("flow"), F.transform(F.filter("steps", lambda x: x != ""), lambda x: F.concat(F.lit("symbol:"), x)))
    some = lambda xs, kind: F.coalesce(F.transform(xs, lambda x: node(x, kind)), F.array().cast("array<struct<node: string, type: string>>"))
    none = "array<struct<source: string, type: string, target: string>>"
    seen = F.concat(F.array(node(ev, "evidence"), node(q, "queue"), node(producer, "service"), node(worker, "worker"), node(box, "collection"), node(deploy, "deployment"), node(symbol, "symbol"), node(file, "file"), node(flow, "flow")), some(many, "service"))
    observed = F.when(c("kind") == "metric", "metric_from").otherwise("observed_in")
    lines = F.concat(
        F.array(edge(ev, "observed_in", q), edge(producer, "emits", q), edge(q, "consumes", worker), edge(ev, "observed_in", box), edge(ev, "observed_in", deploy), edge(ev, "observed_in", symbol), edge(symbol, "in_file", file), edge(ev, "observed_in", flow)),
        F.coalesce(F.transform(many, lambda x: F.struct(ev.alias("source"), observed.alias("type"), x.alias("target"))), F.array().cast(none)),
        F.coalesce(F.transform(steps, lambda x: edge(x, "symbol_in_flow", flow)), F.array().cast(none)),
    )
    ids = F.array_sort(F.collect_set("id")).alias("ids")
    nodes = evidence.select("inv", "id", F.explode(seen).alias("n")).filter("n.node IS NOT NULL").select("inv", "id", "n.*")
    # Steps of a flow are symbols without evidence of their own.
    bare = evidence.select("inv", F.explode(steps).alias("node")).select("inv", F.lit(None).cast("string").alias("id"), "node", F.lit("symbol").alias("type"))
    edges = evidence.select("inv", "id", F.explode(lines).alias("e")).select("inv", "id", "e.*").filter("source IS NOT NULL AND target IS NOT NULL")
    return nodes.unionByName(bare).groupBy("inv", "node", "type").agg(ids), edges.groupBy("inv", "source", "type", "target").agg(ids)


#: Commits that cannot have broken anything, and commits of mere maintenance.
NOISE_AUTHOR = r"(?i)\[bot\]|\b(?:dependabot|renovate)\b"
NOISE_SUBJECT = (
    r"(?i)^bump\s|\b(?:dependabot|renovate)\b|^(?:build|chore|fix|deps)\(deps(?:-dev)?\)|^merge\b|^(?:prepare release|release|bump version|version bump|chore\(release\))|pre-commit.*autoupdate|\[pre-commit\.ci\]"
    r"|^(?:docs|style|test|ci)(?:\([^)]*\))?[:!]|\b(?:reformat|whitespace|prettier|eslint)\b|\bcode\s*(?:style|formatting)\b|\bclean\s*up\b[^.]*\bformat"
)
DOCS_SUBJECT, DOCS_CODE = r"(?i)\b(?:documentation|docs|readme)\b", r"(?i)\b(?:endpoint|api|service|handler|controller|component|module|feature|migration|schema|query|cache|queue|webhook|sdk|cli|route)\b"
CHORE_SUBJECT = r"(?i)^(?:chore|style|docs|ci|build)(?:\(|:)|\btypo\b|\bformatting\b|\blint\b"


def noise_commit(author: Column, subject: Column) -> Column:
    a, s = F.trim(author), F.trim(subject)
    return a.rlike(NOISE_AUTHOR) | s.rlike(NOISE_SUBJECT) | (s.rlike(DOCS_SUBJECT) & ~s.rlike(DOCS_CODE))


def regression_focus(commits: DataFrame, seed_file: str) -> DataFrame:
    """One row: of commits (author, subject, files) that touch the seed's file and are no noise, the smallest number
    of files, whether all are maintenance, and the base score that follows."""
    touches = F.exists("files", lambda f: (f == seed_file) | F.lit(seed_file).endswith(f) | f.endswith(seed_file))
    real = commits.filter(touches & ~noise_commit(F.col("author"), F.col("subject")))
    out = real.agg(F.min(F.size("files")).alias("focus"), F.coalesce(F.bool_and(F.trim("subject").rlike(CHORE_SUBJECT)), F.lit(False)).alias("maintenance"))
    return out.withColumn("score", touched_score(F.col("focus")))
