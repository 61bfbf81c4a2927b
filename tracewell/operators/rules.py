"""Rule-based projections and filters: classes of text, relevance, hygiene, validated reads, seeds and routes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def severity_tier(code: Column, level: Column, message: Column) -> Column:
    """error, warning or info of a seed's code: by its log level, else by the prefix convention of
    codes, else by words; what is unknown is an error, so no failure is played down."""
    low, text = F.lower(level), F.lower(F.concat_ws(" ", code, F.coalesce(message, F.lit(""))))
    prefix = F.regexp_extract(F.coalesce(code, F.lit("")), "^([A-Z])_", 1)
    return (
        F.when(low.isin("error", "fatal", "critical"), "error").when(low.isin("warn", "warning"), "warning").when(low.isin("info", "debug", "trace"), "info")
        .when(prefix == "W", "warning").when(prefix.isin("D", "I", "T"), "info").when(prefix.isin("E", "F", "C"), "error")
        .when(text.rlike(INFO_WORDS), "info").when(text.rlike(WARN_WORDS), "warning").otherwise("error")
    )


#: Where migrations are, and names of settings files.
MIGRATION_PLACE, MIGRATION_FILE = r"(?i)(?:^|/)(?:migrations?|alembic|migrate)/|(?:^|/)schema\.(?:sql|prisma|rb|graphql|gql)$", r"(?i)\.(?:migration|migrate)\.[a-z0-9]+$"
CONFIG_NAME = r"(?i)(?:^|\.)env(?:$|\.)|\.(?:config|conf)(?:$|\.)|\.(?:ya?ml|toml|ini)$"
#: Words of informative and of warning messages.
INFO_WORDS, WARN_WORDS = r"\b(?:skip|skipping|skipped|deprecat|info|debug|trace|notice)\b", r"\bwarn(?:ing)?\b"
#: What messages of failing connectors hold, by class; a status in between decides before the last three.
FAIL_TIMEOUT, FAIL_CONNECTION = r"(?i)abort|timed?\s*out|timeout|ETIMEDOUT", "(?i)ECONNREFUSED|ECONNRESET|ENOTFOUND|EAI_AGAIN|EPIPE|socket|network|fetch failed"
FAIL_STATUS = [r"->\s*(?:HTTP\s+)?(\d{3})\b", r"\bHTTP\s+(\d{3})\b"]
FAIL_AUTH, FAIL_RATE, FAIL_SERVER = "(?i)unauthoriz|forbidden|WRONGPASS|NOAUTH|authenticat|invalid[^']*(?:token|key|credential|password)", "(?i)rate.?limit|too many requests", "(?i)internal server error"


def failure_class(message: Column) -> Column:
    """Why a source failed, without its own words."""
    found = [F.regexp_extract(message, p, 1) for p in FAIL_STATUS]
    status = F.when(found[0] != "", found[0]).otherwise(found[1])
    by_status = F.when(status.isin("401", "403"), "auth failure").when(status == "429", "rate limited").when(status.startswith("5"), "server error").otherwise("request failed")
    return (
        F.when(message.rlike(FAIL_TIMEOUT), "timeout").when(message.rlike(FAIL_CONNECTION), "connection failed").when(status != "", by_status)
        .when(message.rlike(FAIL_AUTH), "auth failure").when(message.rlike(FAIL_RATE), "rate limited").when(message.rlike(FAIL_SERVER), "server error")
        .otherwise("request failed")
    )


#: What hints say, by kind.
SYMPTOM = (
    r"(?i)\b(?:fail|fails|failed|failing|failure|break|breaks|breaking|broke|broken|crash|crashes|crashing|down|outage|incident|regress(?:ion|ed)?|degrad(?:e|ed|ing)?|slow|stuck|hang|hangs|hung"
    r"|timeout|timing\s*out|latency|wrong|exception|error|errors|leak|leaking|stopped|throwing|throws|reject|rejected|denied|not\s+work|doesn'?t\s+work|isn'?t\s+work|can'?t|cannot|caus(?:e|es|ing)"
    r"|misbehav|500|5xx|oom|out\s+of\s+memory|panic|p9[59]|throttl|spike|stack\s*trace|flap)"
)
EXPLAIN_LEAD = r"(?i)^\s*(?:explain|describe|walk\s+me\s+through|tell\s+me\s+(?:about|how))\b"
REGRESSION = r"(?i)\b(?:recently\s+changed|what\s+changed|changed\s+recently|regress|regression)\b"
QUESTION = r"(?i)\b(?:how|what|why|when|where)\b.*\b(?:work|works|working|do|does|done|happen|happens|flow|flows|behave|called|invoked|triggered|used)\b"
LEADING_QUESTION = r"(?i)^\s*(?:how|what|why|when|where)\b"
SOURCE_IMPACT = (
    r"(?i)\b(?:what depends on|blast[- ]?radius|impact of (?:adding|serving|removing|changing|renaming|moving|deleting)|affected by|who (?:calls|uses|imports|consumes)"
    r"|downstream of|upstream of|ripple|if i (?:change|remove|rename|move|delete)|safe to (?:remove|delete|rename|change))\b"
)
ISOLATION = (
    r"(?i)\bverify\b.*\b(?:does ?n[o']?t|not) affect\b|\bis\b.+\bisolated\b|\bisolated\??$|\bdoes\b.+\baffect\b"
    r"|\bany (?:impact|effect) on\b|\bcontained to\b|\bbleed (?:in)?to\b|\bcoupled to\b"
)
PERFORMANCE = r"(?i)\b(?:slow|slowness|sluggish|laggy|lag|latency|perf|performance|throughput|degraded|degradation|response\s*time|p9[59])\b"
DURATION_THEME = r"(?i)\b(?:duration|took|elapsed|anomal(?:y|ies|ous)|spike|variance|regress(?:ion|ed)?|p\d{2})\b"
SUGGESTIVE = (
    r"(?i)\b(?:could indicate|may be|might be|maybe|possibly|suggest(?:s|ing|ed)?|likely (?:caused|due)|points? to|consistent with|indicat(?:es|ive)|appears? to be|seems? to be|probably)\b"
)
CAUSE_CUES = [
    ("deployment-regression", r"\b(?:deploy(?:ment|ed)?|release|rollout|regression|recent change|shipped)\b"),
    ("infrastructure", r"\b(?:database|db|infra(?:structure)?|network|cache|disk|memory|cpu|oom|out of memory|connection pool|datastore|redis|mongo|postgres)\b"),
    ("external-api-latency", r"\b(?:upstream|external api|third[- ]party|downstream|api latency|timeout|slow (?:api|service)|gateway)\b"),
    ("retry-storm", r"\b(?:retr(?:y|ies)|retry storm|thundering herd|amplif)"),
    ("queue-backlog", r"\b(?:queue|backlog|consumer lag|enqueue)\b"),
    ("worker-slowdown", r"\b(?:worker|consumer)\b"),
    ("benign-variance", r"\b(?:per[- ]segment|per[- ]region|skew(?:ed)?|variance|expected variation|noise)\b"),
]


def diffable(since: Column) -> Column:
    """Whether a since is a range or a ref, not a duration."""
    s = F.trim(F.coalesce(since, F.lit("")))
    return (s != "") & (F.contains(s, F.lit("..")) | (~s.rlike(r"(?i)^\d+[smhd]$") & s.rlike(r"^[A-Za-z0-9._/~^-]+$")))


def explanatory(hint: Column) -> Column:
    h = F.trim(F.coalesce(hint, F.lit("")))
    return (h != "") & (h.rlike(EXPLAIN_LEAD) | (~h.rlike(REGRESSION) & (h.rlike(QUESTION) | (~h.rlike(SYMPTOM) & h.rlike(LEADING_QUESTION)))))


def source_impact(hint: Column) -> Column:
    return F.coalesce(hint.rlike(SOURCE_IMPACT) | hint.rlike(ISOLATION), F.lit(False))


def intent(hint: Column, since: Column | None = None) -> Column:
    """incident, source-impact or explain; a live symptom or a range to compare always wins."""
    live = F.coalesce(hint.rlike(SYMPTOM), F.lit(False)) | (diffable(since) if since is not None else F.lit(False))
    return F.when(live, "incident").when(source_impact(hint), "source-impact").when(explanatory(hint), "explain").otherwise("incident")


def suggested_causes(hint: Column) -> Column:
    """Categories that the alert's own words merely suggest, in fixed order."""
    low = F.lower(hint)
    found = F.filter(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in CAUSE_CUES]), lambda k: k.isNotNull())
    return F.when(hint.rlike(SUGGESTIVE), found).otherwise(F.array().cast("array<string>"))


def config_class(path: Column) -> Column:
    """migration or config of a changed path, null for any other."""
    base = F.substring_index(path, "/", -1)
    migration = path.rlike(MIGRATION_PLACE) | base.rlike(MIGRATION_FILE)
    return F.when(migration, "migration").when(base.rlike(CONFIG_NAME), "config")


def since_seconds(text: Column) -> Column:
    """`30m`, `24h`, `7d`, `90s` to seconds; anything else is seven days."""
    n = F.regexp_extract(text, r"^(\d{1,9})[smhd]$", 1)
    unit = F.when(text.endswith("s"), 1).when(text.endswith("m"), 60).when(text.endswith("h"), 3600).otherwise(86400)
    return F.when(n != "", n.try_cast("long") * unit).otherwise(F.lit(7 * 86400))


#: Words that say that something is wrong, but not what.
GENERIC_TERMS = ["error", "errors", "err", "fail", "failed", "failing", "failure", "exception", "exceptions", "crash", "crashing", "issue", "problem", "slow", "timeout", "broken", "down", "production", "prod", "staging"]


def long_words(text: Column) -> Column:
    """Lower-case words of at least four characters, camelCase taken apart; repeats stay."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.transform(F.split(spaced, "[^A-Za-z0-9]+"), F.lower), lambda t: F.length(t) >= 4)


def direct(key: Column, message: Column, services: Column, seeds: list[str], service: str | None = None) -> Column:
    """Whether a log signature touches the seeds: its key shares part of a specific seed term, a service is
    one, the message holds two of them, or the configured service is in a service's name. Without a
    specific term every signature does."""
    specific = sorted({s for s in seeds if s not in GENERIC_TERMS})
    if not specific:
        return F.lit(True)
    terms = F.array(*[F.lit(s) for s in specific])
    words = lambda c: F.filter(long_words(c), lambda t: ~t.isin(GENERIC_TERMS))
    stem = lambda t: F.regexp_replace(t, "s$", "")
    same = lambda t, c: (t == c) | (stem(t) == c) | (stem(c) == t)
    of_services = F.flatten(F.transform(services, words))
    by_key = F.exists(terms, lambda t: F.exists(words(key), lambda c: F.contains(c, t) | F.contains(t, c)))
    by_service = F.exists(terms, lambda t: F.exists(of_services, lambda c: same(t, c)))
    by_words = F.size(F.filter(terms, lambda t: F.exists(words(message), lambda c: same(t, c)))) >= 2
    configured = F.exists(services, lambda s: F.contains(F.lower(s), F.lit(service.lower()))) if service else F.lit(False)
    return F.coalesce(by_key | by_service | by_words | configured, F.lit(False))


def relevance(signatures: DataFrame, seeds: list[str], service: str | None = None) -> DataFrame:
    """signatures (key, message, services, is_new, ratio) with whether they touch the seeds (direct()), and their relevance."""
    touch, up = direct(F.col("key"), F.col("message"), F.col("services"), seeds, service), F.col("ratio") >= 1.5
    score = F.when(touch, F.when(F.col("is_new"), 0.95).when(up, 0.9).otherwise(0.85)).otherwise(F.when(F.col("is_new"), 0.7).when(up, 0.55).otherwise(0.35))
    return signatures.withColumn("direct", touch).withColumn("relevance", score)


#: Words that name a queue only if a worker vouches for them.
GENERIC_QUEUES = ["name", "queue", "queues", "test", "example", "sample", "demo", "default", "data", "items", "jobs", "events", "messages", "tasks", "emails", "reports", "alpha", "beta", "seed", "seed_products"]
CONSTANT_NAME, CODE_MARKS = r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$", r"[\s<>{}()`\"';$]"
ENUM_FILE, DECLARATION_FILE = "enum|constant|attribute|telemetry", r"\.d\.[cm]?ts$|\.interfaces?\.[cm]?ts$"


def plausible_queues(edges: DataFrame) -> DataFrame:
    """Queue edges (queue, producer_symbol, producer_file, worker_symbol, worker_file) that production code can mean.

    Gone are names that cannot be a queue's, edges of files that are no product code (or of no file, if
    the name is generic), two constants of one enum file, and edges of type declarations only. A generic
    or constant-shaped name stays if some edge of it has a worker that is a named symbol in product code."""
    q, pf, wf, ws = (F.col(c) for c in ("queue", "producer_file", "worker_file", "worker_symbol"))
    base = lambda f: F.substring_index(f, "/", -1)
    files = F.filter(F.array(pf, wf), lambda f: f.isNotNull() & (f != ""))
    generic = F.lower(q).isin(GENERIC_QUEUES)
    plausible = (F.length(q) > 0) & (F.length(q) <= 100) & ~q.rlike(CODE_MARKS) & (F.length(q) - F.length(F.replace(q, F.lit("."), F.lit(""))) < 2)
    product = F.exists(files, lambda f: tx.path_class(f) == "product")
    fixture = F.when(F.size(files) > 0, ~product).otherwise(generic)
    enum = F.coalesce((pf != "") & (pf == wf) & F.lower(base(pf)).rlike(ENUM_FILE), F.lit(False))
    declared = (F.size(files) > 0) & F.forall(files, lambda f: F.lower(base(f)).rlike(DECLARATION_FILE))
    rows = edges.filter(plausible & ~fixture & ~enum & ~declared)
    stem = F.regexp_replace(base(wf), r"\.[^.]+$", "")
    in_file = (tx.path_class(wf) == "product") & (ws != base(wf)) & ~((ws == stem) & ~stem.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"))
    vouches = (ws != "") & ~ws.rlike(CONSTANT_NAME) & ~ws.rlike(r"(?i)\.[a-z]{1,4}$") & F.when(F.coalesce(wf, F.lit("")) != "", in_file).otherwise(True)
    needs = F.lower(q).isin(GENERIC_QUEUES) | q.rlike(CONSTANT_NAME)
    vouched = rows.filter(needs & F.coalesce(vouches, F.lit(False))).select("queue").distinct().withColumn("vouched", F.lit(True))
    return rows.join(vouched, "queue", "left").filter(~needs | F.col("vouched")).drop("vouched")


def focus(evidence: DataFrame, topics: list[str], ignore: list[str]) -> DataFrame:
    """Rows whose title or category holds a topic and none of the ignored words; all rows if none would stay."""
    hay = F.lower(F.concat_ws(" ", "title", "category"))
    has = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]).cast("array<string>"), lambda w: F.contains(hay, w))
    keep = (has(topics) if topics else F.lit(True)) & ~has(ignore)
    marked = evidence.withColumn("_keep", keep)
    any_kept = marked.agg(F.coalesce(F.bool_or("_keep"), F.lit(False)).alias("_any"))
    return marked.crossJoin(F.broadcast(any_kept)).filter("_keep OR NOT _any").drop("_keep", "_any")  # one row of totals


SENSITIVE = re.compile(r"(?i)passw|secret|token|api_?key|ssn|card")


def record_read(rows: DataFrame, equal: dict, fields: list[str], limit: int) -> DataFrame:
    """A bounded read: at most 8 equalities, 30 fields and 5 rows, no sensitive fields."""
    if not 1 <= len(equal) <= 8 or not 1 <= len(fields) <= 30 or not 1 <= limit <= 5:
        raise ValueError("a record read takes 1 to 8 equalities, 1 to 30 fields and 1 to 5 rows")
    for name in [*equal, *fields]:
        if SENSITIVE.search(name):
            raise ValueError(f"{name} is sensitive")
        if name not in rows.columns:
            raise ValueError(f"{name} is no column")
    for name, value in equal.items():
        rows = rows.filter(F.col(f"`{name}`") == value)
    return rows.select(*[F.col(f"`{c}`") for c in fields]).orderBy(*[F.col(f"`{c}`") for c in fields]).limit(limit)


def files_containing(files: DataFrame, words: list[str], most: int) -> DataFrame:
    """(word, path): files that hold each whole word outside comment lines, `most` a word by path.

    A file is read once; its words meet the wanted ones in the row."""
    code = F.regexp_replace("content", r"(?m)^\s*(?://|#|\*).*$", "")
    found = F.filter(F.array(*[F.when(code.rlike(rf"(?<![A-Za-z0-9_]){re.escape(w)}(?![A-Za-z0-9_])"), F.lit(w)) for w in words]), lambda w: w.isNotNull())
    rows = files.select("path", F.explode(found).alias("word"))
    return rows.groupBy("word").agg(F.slice(F.array_sort(F.collect_list("path")), 1, most).alias("p")).select("word", F.explode("p").alias("path"))


def redis_roles(prefixes: DataFrame) -> DataFrame:
    """What key prefixes (prefix, n) say a database is used for."""
    p = F.lower("prefix")
    role = F.when(p.rlike("^(?:bull|bullmq|queue|celery|rq)"), "queue").when(p.rlike("lock|mutex"), "lock").when(p.rlike("rate|throttle|limit"), "rate-limit").when(p.rlike("sess"), "session").otherwise("cache")
    return prefixes.groupBy(role.alias("role")).agg(F.sum("n").alias("n"))


#: What names and paths say about how likely a symbol is the place of a fault.
PREFER_ROLE = r"(?i)resolver|controller|\bservice\b|route|router|handler|gateway|processor|worker|consumer|repository|usecase|use-case|endpoint"
DEMOTE_ROLE = r"(?i)\butil|helper|\bscript|backfill|legacy|migration|seeder|fixture|\bmock\b|\btest\b|\bspec\b"
PRESENTATION = "^(?:build|format|render|compose|serialize)[A-Z].*(?:Message|Markup|Html|Text|Label|Summary|Notification|String)$"
PREDICATE = "^(?:is|has|can|should|was|were|are|does|did|needs|allows?|must)[A-Z]"
TYPE_LIKE = "(?:Result|Input|Response|Payload|Args|Dto|Props|Edge|Connection)$|^I[A-Z][a-z]"
CODEGEN = r"(?i)(?:^|/)(?:__generated__|generated)/|(?:(?:^|/)generated|[._-](?:generated|gen))\.[jt]sx?$|\.(?:graphql|gql)\.[jt]sx?$"
TYPE_KIND = "(?i)^(?:type_alias|typealias|type|interface|enum)$"
ARCHITECTURE_FILE = r"(?i)\.(?:resolver|controller|service)\.[jt]sx?$"
SCRIPTS_FOLDER = "(?i)(?:^|/)scripts?/"
TEST_PLACE = r"(?i)(?:^|/)(?:tests?|__tests__|spec)/|(?:\.|_)(?:test|spec)\.[jt]sx?$|(?:^|/)test_[^/]*\.py$|_test\.py$"
EXAMPLE_FOLDER = "(?i)(?:^|/)(?:examples?|samples?|demos?|fixtures?|sandbox|playground|docs|docs_src|tutorials?)(?:/|$)"
TS_DECLARATION = r"(?i)\.d\.[cm]?ts$"


def seed_points(id: Column, name: Column, path: Column, start: Column, end: Column, place: Column, rank_score: Column, changed: Column, tokens: list[str], code_hint: bool = False, named: str | None = None) -> Column:
    """How likely a symbol is where an investigation should begin. place: its position in the search;
    rank_score: the search's score; changed: whether its file changed in the window."""
    kind, hay = F.substring_index(id, ":", 1), F.lower(F.concat_ws(" ", name, path))
    plus = lambda test, n: F.when(F.coalesce(test, F.lit(False)), float(n)).otherwise(0.0)
    role = 0.0 if code_hint or named else 1.0
    hits = F.size(F.filter(F.array(*[F.lit(t) for t in tokens]).cast("array<string>"), lambda t: F.contains(hay, t)))
    return (
        plus(hay.rlike(PREFER_ROLE), 3 * role) - plus(hay.rlike(DEMOTE_ROLE), 3) - plus(name.rlike(PRESENTATION), 3) - plus(name.rlike(TYPE_LIKE), 4)
        - plus((end - start <= 3) & ~name.rlike(PREDICATE), 3) + plus(changed, 5) + plus(path.rlike(ARCHITECTURE_FILE), 2 * role)
        - plus(path.rlike(SCRIPTS_FOLDER), 2) - plus(path.rlike(TEST_PLACE), 4) - plus(path.rlike(EXAMPLE_FOLDER), 4)
        + F.greatest(5.0 - place, F.lit(0.0)) * (0.8 if code_hint else 0.1) + F.coalesce(rank_score, F.lit(0.0)) * (8.0 if code_hint else 2.0)
        - plus(name.rlike(r"(?i)\.[jt]sx?$"), 5) - plus(path.rlike(CODEGEN), 5) - plus(kind.rlike(TYPE_KIND), 6)
        + F.least(2.0 * hits, F.lit(6.0)) + plus(F.lower(name) == F.lit((named or "").lower()), 40 if named else 0)
    )


def seeds(symbols: DataFrame, tokens: list[str], changed: DataFrame, code_hint: bool = False, named: str | None = None, most: int = 10) -> DataFrame:
    """The best `most` of symbols (id, name, path, start_line, end_line, place, rank_score) with score; tests, docs,
    examples, generated code and mere types come after all others. changed: paths that changed."""
    marked = symbols.join(changed.select("path").distinct().withColumn("changed", F.lit(True)), "path", "left")
    columns = [F.col(c) for c in ("id", "name", "path", "start_line", "end_line", "place", "rank_score", "changed")]
    aside = tx.path_class(F.col("path")).isin("test", "docs", "example", "vendored") | F.col("path").rlike(CODEGEN) | F.substring_index("id", ":", 1).rlike(TYPE_KIND)
    scored = marked.select("id", "name", "path", "place", seed_points(*columns, tokens, code_hint, named).alias("score"), aside.alias("aside"))
    return scored.orderBy("aside", F.desc("score"), "place", "id").limit(most)


def exact_candidates(symbols: DataFrame, asked: str, tests_too: bool = False) -> DataFrame:
    """id, name and score of symbols (id, name, path, start_line, end_line) that have the asked name, case aside;
    the best first, ties by place in the file."""
    kind, path = F.lower(F.substring_index("id", ":", 1)), F.col("path")
    weight = F.when(kind == "class", 4.0).when(kind.isin("interface", "enum"), 3.0).when(kind == "function", 2.0).when(kind.isin("type_alias", "typealias"), 1.0).otherwise(0.0)
    aside = path.rlike(CODEGEN) | (F.lit(not tests_too) & tx.path_class(path).isin("test", "docs", "example", "vendored"))
    lines = F.coalesce("end_line", F.lit(0)) - F.coalesce("start_line", F.lit(0))
    score = (
        F.when(F.col("name") == asked, 8.0).otherwise(0.0) + weight - F.when(aside, 6.0).otherwise(0.0) - F.when(path.rlike(TS_DECLARATION), 3.0).otherwise(0.0)
        + F.when(lines > 0, F.least(F.log2(lines + 1.0), F.lit(4.0))).otherwise(0.0)
    )
    return symbols.filter(F.lower("name") == asked.lower()).select("id", "name", score.alias("score")).orderBy(F.desc("score"), "id")


#: Next steps by what an investigation found, in order.
ROUTES = [("queue", "inspect workers and backlog"), ("database", "check table state"), ("deployment", "compare the release"), ("logs", "open the signatures"), ("metrics", "open the panels")]


def routes(evidence: DataFrame) -> DataFrame:
    """(place, step): the steps of categories that have evidence above info; one fallback if none has."""
    spark = evidence.sparkSession
    rules = spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(ROUTES)], "place int, category string, step string")
    hit = rules.join(evidence.filter("priority <> 'info'").select("category").distinct(), "category", "left_semi").select("place", "step")
    other = spark.createDataFrame([(99, "widen the time range")], "place int, step string").join(hit.limit(1).select(F.lit(99).alias("place")), "place", "left_anti")
    return hit.union(other)


def missing_kinds(evidence: DataFrame, wanted: list[str]) -> DataFrame:
    w = evidence.sparkSession.createDataFrame([(k,) for k in wanted], "kind string")
    return w.join(evidence.select("kind").distinct(), "kind", "left_anti")


def chains(evidence: DataFrame) -> DataFrame:
    """Correlated evidence of a queue: strength = mean relevance + .1 a further item, 1 at most."""
    rows = evidence.filter("queue IS NOT NULL").groupBy("queue").agg(F.count("*").alias("n"), F.avg("relevance").alias("r"))
    return rows.filter("n >= 2").select("queue", "n", F.least(F.col("r") + 0.1 * (F.col("n") - 1), F.lit(1.0)).alias("strength"))
