"""Data flow, cause chains, communities, the stateful watcher, failure details and running sums against hand cases and plain Python."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import detail
from tracewell.operators import chains, communities, dataflow, evidence, graph, scan
from tracewell.streaming import watcher

PAD = "\n" + "x" * 40
SOURCES = [
    # body, name, signature, imports, callees -> pattern, matched, about
    ("setInterval(() => poll(), 5_000)", "f", "", [], [], ("fixed-cadence", "setInterval(() => poll(), 5_000)", "interval")),
    ("setTimeout(run, 99)", "f", "", [], [], None),
    ("// setInterval(run, 5000)\n/* WHERE a = $1 */", "f", "", [], [], None),
    ('cron("0 */2 * * 1-5")', "f", "", [], [], ("fixed-cadence", '"0 */2 * * 1-5"', "cron")),
    ("refetchInterval: 30", "f", "", [], [], ("fixed-cadence", "refetchInterval: 30", "cadence")),
    ("sql`SELECT * FROM t WHERE \"code\" = :code`", "f", "", [], [], ("exact-match-query", 'WHERE "code" = :code', "sql")),
    ("SELECT a FROM t WHERE LOWER(name) LIKE b AND code = $1", "f", "", [], [], None),
    ("db.users.findFirst({ email: e })", "f", "", [], [], ("exact-match-query", ".findFirst({ email:", "field")),
    ("list.find(x => x.id === id)", "f", "", [], [], None),
    ("state.total.sum = 4", "cartReducer", "", [], [], ("in-place-mutation", "state.total.sum =", "state")),
    ("state.total.sum = 4", "cart", "", [], [], None),
    ("cache.items.push(x)", "cart", "", ["node_modules/zustand"], [], ("in-place-mutation", "cache.items.push(", "cache")),
    ("state.a === 3; draft.b = 2", "storeIt", "", [], [], ("in-place-mutation", "draft.b =", "draft")),
    ("state.a = 3; return { ...state }", "storeIt", "", [], [], None),
    ("await a()\n  repo.saveOrder(o)\n", "f", "async f()", [], ["saveOrder"], ("unawaited-async-write", "repo.saveOrder(o)", "saveOrder")),
    ("await a()\n  repo.saveOrder(o)\n", "f", "async f()", [], ["other"], None),
    ("await a()\n  saveOrder(o).catch(log)\n return saveOrder(o)\n logSave(o)", "f", "async f()", [], ["saveOrder", "logSave"], None),
    ("saveOrder(o)", "f", "async f()", [], ["saveOrder"], None),
    ("await x()\nrefreshAsync(o)", "f", "", [], ["refreshAsync"], ("unawaited-async-write", "refreshAsync(o)", "refreshAsync")),
    ("if (Object.is(a, b)) return", "f", "", [], [], ("hardcoded-bound", "Object.is(", "Object.is")),
    ("if (n > 3 && retries >= 5) stop()", "f", "", [], [], ("hardcoded-bound", "retries >= 5", "retries")),
    ("if (maxIdx > 1 && limit === 0 && count < 1) stop()", "f", "", [], [], None),
    ("setInterval(run, 500); state.a = 1; retries > 4", "store", "", [], [], ("fixed-cadence", "setInterval(run, 500)", "interval")),
]


def test_data_flow_findings(spark):
    rows = [(i, b + PAD, n, "src/a.ts", s, im, ca) for i, (b, n, s, im, ca, _) in enumerate(SOURCES)]
    rows += [(90, "setInterval(run, 500)", "f", "a", "", [], []), (91, None, "f", None, None, None, None), (92, "await x()\nsaveIt(1)" + PAD, "f", None, None, None, None), (93, "store.a = 1" + PAD, "store", None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, body string, name string, file string, signature string, imports array<string>, callees array<string>")
    got = {r.i: r.f for r in df.select("i", dataflow.finding(*(F.col(c) for c in ("body", "name", "file", "signature", "imports", "callees"))).alias("f")).collect()}
    for i, (*_, want) in enumerate(SOURCES):
        assert (None if got[i] is None else (got[i].pattern, got[i].matched, got[i].about)) == want, SOURCES[i]
    assert got[90] is None and got[91] is None and got[92] is None and got[93].pattern == "in-place-mutation"


def test_nearest_context_wins(spark):
    bodies = {"a": "nothing", "b": "retries > 4", "c": "setInterval(run, 500)", "d": "isEqual(a, b)", "z": "setInterval(run, 900)"}
    symbols = spark.createDataFrame([(k, k, "f.ts", "", [], v + PAD) for k, v in bodies.items()], "id string, name string, file string, signature string, imports array<string>, body string")
    calls = spark.createDataFrame([("a", t, i) for i, t in enumerate("zdc")] + [("b", "c", 0)], "source string, target string, seq int")
    seeds = [(1, "a", 1), (1, "b", 2), (2, "a", 1), (3, "a", 1), (3, "b", 5), (3, "c", 2), (4, "gone", 1)]
    near = dataflow.contexts(spark.createDataFrame(seeds, "inv int, id string, place int"), calls, symbols)
    got = {r.inv: (r.id, r.rank, r.pattern) for r in dataflow.across(near).collect()}
    assert got == {1: ("b", 2, "hardcoded-bound"), 2: ("z", 5, "fixed-cadence"), 3: ("c", 2, "fixed-cadence")}
    assert {r.id for r in near.filter("inv = 3").collect()} == {"a", "c", "z", "d"}  # place 5 is not read
    assert dataflow.across(near.limit(0)).count() == 0


def test_cause_chains(spark):
    items = [(1, "c1", "commit", None), (1, "y1", "symbol", None), (1, "i1", "impact", None), (1, "l1", "log", None), (1, "l2", "log", None), (1, "m1", "metric", None), (1, "q1", "queue-state", True), (1, "q2", "queue-state", False), (1, "e1", "queue-edge", None), (1, "s1", "state", None), (2, "q2", "queue-state", False), (2, "l1", "log", None)]
    found = spark.createDataFrame(items, "inv int, id string, kind string, stalled boolean")
    nodes = spark.createDataFrame([(1, "service:b", "service", True), (1, "service:a", "service", False), (1, "queue:mail", "queue", False), (1, "queue:zip", "queue", True), (1, "deployment:c1", "deployment", False), (1, "worker:w", "worker", False), (1, "collection:o", "collection", True)], "inv int, node string, type string, implicated boolean")
    told = [
        (1, "deploy", "deployment-regression", None, "supported", ["c1", "i1", "l2", "y1", "m1", "gone"]), (1, "back", "queue-backlog", "mail", "weakened", ["q1", "q2"]), (1, "slow", "worker-slowdown", "mail", "supported", ["q2", "q1", "m1", "l1"]),
        (1, "api", "external-api-latency", None, "supported", ["m1"]), (1, "infra", "infrastructure", None, "supported", ["q2", "l1"]), (1, "storm", "retry-storm", None, "supported", ["l2", "l1", "q1", "m1"]), (1, "odd", "new-kind", None, "supported", ["s1", "l1"]),
        (1, "none", "retry-storm", None, "unconfirmed", []), (1, "gone", "retry-storm", None, "eliminated", ["l1"]), (2, "slow", "worker-slowdown", "mail", "supported", ["q2"]),
    ]
    explained = spark.createDataFrame([(a, b, c, q, 0.5, v, s) for a, b, c, q, v, s in told], "inv int, id string, category string, queue string, confidence double, verdict string, supports array<string>")
    got = {}
    for r in chains.cause_chains(explained, found, nodes).orderBy("inv", "id", "slot").collect():
        got.setdefault((r.inv, r.id), []).append((r.role, r.ids, r.node))
    assert got == {
        (1, "deploy"): [("trigger", ["c1"], "deployment:c1"), ("propagation", ["y1", "i1"], None), ("symptom", ["l2", "m1"], "service:b")],
        (1, "back"): [("trigger", [], "queue:mail"), ("propagation", ["q1", "q2"], "queue:mail")],
        (1, "slow"): [("trigger", ["q1", "m1"], None), ("propagation", ["q2", "q1"], "queue:mail"), ("symptom", ["l1"], "service:b")],
        (1, "api"): [("trigger", ["m1"], "service:b")],
        (1, "infra"): [("trigger", ["q2"], "collection:o"), ("propagation", ["q2"], "service:b"), ("symptom", ["l1"], "service:b")],
        (1, "storm"): [("trigger", ["l2", "l1"], "service:b"), ("propagation", ["q1"], "queue:zip"), ("symptom", ["m1"], "service:b")],
        (1, "odd"): [("trigger", ["s1", "l1"], "service:b"), ("symptom", ["l1"], "service:b")],
        (2, "slow"): [("trigger", ["q2"], None), ("propagation", ["q2"], None)],
    }
    paths = {r.id: r.path for r in chains.cause_chains(explained, found, nodes).filter("inv = 1").collect()}
    assert paths["back"] == "trigger > propagation" and paths["api"] == "trigger"
    assert chains.cause_chains(explained.limit(0), found, nodes).count() == 0


def test_overall_confidence(spark):
    rows = [(0.6, "s", False, 1.0, 0.9, 0.8), (0.6, "s", True, 1.0, 0.9, 0.45), (0.6, None, True, 1.0, 0.9, 0.3), (1.0, "s", False, 0.7, 0.9, 0.7), (1.0, "s", None, 1.0, None, 0.6), (0.1, "s", True, 1.0, 0.9, 0.2)]
    df = spark.createDataFrame(rows, "c double, s string, low boolean, gap double, best double, want double")
    for r in df.select("want", evidence.overall_confidence(*(F.col(x) for x in ("c", "s", "low", "gap", "best"))).alias("got")).collect():
        assert r.got == pytest.approx(r.want)


def best_modularity(links):
    """The optimum over all partitions."""
    nodes, m2 = sorted({x for l in links for x in l}), 2 * len(links)
    degree = {n: sum(n in l for l in links) for n in nodes}

    def grow(i, labels, groups):
        if i == len(nodes):
            return sum(2 * sum(labels[a] == labels[b] == g for a, b in links) / m2 - (sum(degree[n] for n in nodes if labels[n] == g) / m2) ** 2 for g in range(groups))
        return max(grow(i + 1, labels | {nodes[i]: g}, max(groups, g + 1)) for g in range(groups + 1))

    return grow(0, {}, 0)


def as_edges(spark, links):
    return spark.createDataFrame([(a, b, "calls") for a, b in links], "source string, target string, rel string")


def test_communities_of_a_ring_of_cliques(spark):
    cliques = [[f"{c}{i}" for i in range(4)] for c in "abc"]
    links = [p for c in cliques for p in itertools.combinations(c, 2)] + [("a0", "b0"), ("b1", "c0"), ("c1", "a1")]
    edges = as_edges(spark, links).union(as_edges(spark, [("a0", "a0"), ("lone", "lone")]))
    edges = edges.unionByName(spark.createDataFrame([("x", "a0", "imports")], "source string, target string, rel string"))
    found = communities.best_communities(edges).collect()
    assert {r.id: r.community for r in found} == {n: c[0] for c in cliques for n in c}
    links_ = communities.arcs(edges)
    got = communities.modularity(links_, spark.createDataFrame(found)).first()[0]
    assert got == pytest.approx(2 * 18 / 42 - 3 * (14 / 42) ** 2)
    assert got >= communities.modularity(links_, graph.communities(edges)).first()[0] - 1e-12


def test_communities_near_the_optimum(spark):
    r = random.Random(3)
    links = sorted({tuple(sorted(r.sample("abcdefgh", 2))) for _ in range(12)})
    edges = as_edges(spark, links)
    found = communities.best_communities(edges)
    assert communities.modularity(communities.arcs(edges), found).first()[0] >= 0.98 * best_modularity(links)
    assert communities.best_communities(edges.limit(0)).count() == 0 and communities.modularity(communities.arcs(edges.limit(0)), found).first()[0] is None


EVENT = "route string, family string, event_id long, occurred_at timestamp, source string, state string, severity string, episode string, required boolean"


def story(seed=7, n=160):
    """Polls of events of some families, some of them late."""
    r, polls = random.Random(seed), []
    for p in range(4):
        rows = []
        for i in range(n // 4):
            at = 1_700_000_000 + p * 9000 + r.randrange(-6000, 9000)
            rows.append(("r", f"f{r.randrange(6)}", p * 1000 + i, at, r.choice(["elasticsearch", "sentry"]), r.choice(["active", "active", "resolved", "done"]), r.choice(["warn", "error"]), r.choice([None, None, "e1", "e2"]), r.random() < 0.1))
        polls.append(rows)
    return polls


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT.replace("timestamp", "long")).withColumn("occurred_at", F.timestamp_seconds("occurred_at"))


def test_hand_cases_of_the_watcher(spark):
    t = 1_700_000_000
    rows = [
        ("r", "a", 1, t, "elasticsearch", "active", "warn", None, False), ("r", "a", 2, t + 3540, "elasticsearch", "active", "warn", None, False), ("r", "a", 3, t + 3540 + 3660, "elasticsearch", "active", "warn", None, False),
        ("r", "b", 1, t, "sentry", "active", "warn", "e", False), ("r", "b", 2, t + 9, "sentry", "resolved", "warn", "e", False), ("r", "b", 3, t + 10, "sentry", "active", "warn", "e", False), ("r", "b", 4, t + 20, "sentry", "resolved", "warn", "e", False), ("r", "b", 5, t + 30, "sentry", "active", "warn", None, False),
        ("r", "c", 1, t, "sentry", "active", "warn", None, False), ("r", "c", 2, t + 1, "sentry", "done", None, None, False), ("r", "c", 3, t + 2, "sentry", "active", "error", None, False), ("r", "c", 4, t + 3, "sentry", "active", "error", None, False), ("r", "c", 5, t + 4, "sentry", "active", "error", "e9", False),
        ("r", "d", 1, t, "sentry", "resolved", "warn", None, False), ("r", "d", 2, t + 1, "sentry", "resolved", "warn", None, True), ("r", "e", 1, t, "sentry", "done", None, None, False), ("r", "e", 2, t, "sentry", "resolved", "warn", None, True),
    ]
    got = {(r.family, r.event_id): (r.job, r.action, r.status) for r in watcher.watch(frame(spark, rows)).collect()}
    assert got == {
        ("a", "1"): (1, "open", "pending"), ("a", "2"): (1, "update", "pending"), ("a", "3"): (2, "open", "pending"),
        ("b", "1"): (1, "open", "pending"), ("b", "2"): (1, "resolve", "pending"), ("b", "3"): (1, "update", "pending"), ("b", "4"): (1, "resolve", "pending"), ("b", "5"): (2, "open", "pending"),
        ("c", "1"): (1, "open", "pending"), ("c", "2"): (1, "done", "done"), ("c", "3"): (1, "notify", "pending"), ("c", "4"): (1, "update", "pending"), ("c", "5"): (2, "open", "pending"),
        ("d", "1"): (1, "closed", "cancelled"), ("d", "2"): (1, "reopen", "pending"), ("e", "1"): (0, "ignored", None), ("e", "2"): (1, "open", "pending"),
    }
    assert watcher.watch(frame(spark, rows).limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    polls, source = story(), tmp_path / "in"
    for i, rows in enumerate(polls):
        frame(spark, rows).coalesce(1).write.parquet(str(source / f"p={i}"))
    whole = spark.read.parquet(str(source))
    want = sorted(map(tuple, watcher.watch(whole, "p").collect()))
    assert {"open", "closed", "late", "resolve", "update", "done"} <= {r[4] for r in want}
    live = tmp_path / "live"
    live.mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for i in range(len(polls)):
        for f in sorted(os.listdir(source / f"p={i}")):
            if f.endswith(".parquet"):
                os.link(source / f"p={i}" / f, live / f"{i}-{f}")
        stream = spark.readStream.schema(frame(spark, polls[0]).schema).parquet(str(live))
        run = watcher.watch_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want


def test_details(spark):
    rows = [('{"error": {"message": "m"}}', "error.message", "m"), ('{"error": {"message": "said"}}', None, None), ('{"context": {"text": "x", "errors": {"text": "y"}}}', "context.errors.text", "y"), ('{"error": {"b": "2", "a": "1"}, "err": {"c": "3"}}', "error.a", "1"), ('["error"]', None, None), (None, None, None), ("{", None, None), ("", None, None), ('{"error": {"message": "' + "z" * 400 + '"}}', "error.message", "z" * 300), ('{"error": {"x": {"message": "far"}, "y": "near"}}', "error.x.message", "far"), ('{"err": {"list": ["a"], "ok": true}}', None, None)]
    df = spark.createDataFrame([(i, b, "extra") for i, (b, _, _) in enumerate(rows)], "i int, body string, detail_x string")
    got = {r.i: (r.detail_path, r.detail) for r in detail.with_detail(df, "body", F.lit("said")).collect()}
    assert [got[i] for i in range(len(rows))] == [(p, t) for _, p, t in rows]


def test_running_sum(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(-5, 9)) for i in range(500)]
    df = spark.createDataFrame(r.sample(rows, 500), "i int, v int").repartition(7)
    got = {x.i: x.s for x in scan.running_sum(df, "i", F.col("v"), "s").collect()}
    assert [got[i] for i in range(500)] == list(itertools.accumulate(v for _, v in rows))
    assert scan.running_sum(df.limit(0), "i", F.col("v"), "s").count() == 0
