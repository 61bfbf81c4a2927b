"""Hand cases of operators that the driver tables do not exercise."""

import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import evaluation, graph, logs, metrics, state
from tracewell.streaming import episodes


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def edges(spark, *pairs):
    return frame(spark, [(a, b, "calls", 1.0) for a, b in pairs], "source string, target string, rel string, confidence double")


def ids(spark, *names):
    return frame(spark, [(n,) for n in names], "id string")


def test_traverse_chain_and_cycle(spark):
    chain = edges(spark, ("a", "b"), ("b", "c"))
    assert sorted(map(tuple, graph.traverse(chain, ids(spark, "a"), 3).collect())) == [("b", 1), ("c", 2)]
    assert [tuple(r) for r in graph.traverse(chain, ids(spark, "a"), 1).collect()] == [("b", 1)]
    assert graph.traverse(chain, ids(spark, "a"), 0).count() == 0
    assert [tuple(r) for r in graph.traverse(edges(spark, ("a", "b"), ("b", "a")), ids(spark, "a"), 5).collect()] == [("b", 1)]


def test_strong_components(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"))
    got = {}
    for r in graph.components(e).collect():
        got.setdefault(r.component, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == [["a", "b", "c"], ["d", "e"]]


def test_communities_of_two_cliques(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(4) for j in range(i + 1, 4)]
    got = {r.id: r.community for r in graph.communities(edges(spark, *clique("a"), *clique("b"), ("a0", "b0"))).collect()}
    assert len({got[f"a{i}"] for i in range(4)}) == 1 and len({got[f"b{i}"] for i in range(4)}) == 1 and got["a1"] != got["b1"]


def test_shortest_path(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"))
    assert [r.id for r in graph.shortest_path(e, "a", "d").orderBy("step").collect()] == ["a", "b", "c", "d"]
    assert graph.shortest_path(e, "d", "a", directed=True).count() == 0


def test_cochange(spark):
    commits = [(f"c{i}", f) for i in range(3) for f in ("auth", "models")] + [("d", "views"), ("d", "utils")]
    rows = frame(spark, commits, "commit string, file string")
    got = {(r.file, r.other): (r.co, r.strength) for r in graph.cochange(rows, 1, 0.0).collect()}
    assert got == {("auth", "models"): (3, 1.0), ("utils", "views"): (1, 1.0)}
    assert graph.cochange(rows, 3).count() == 1


def test_durations(spark):
    rows = frame(spark, [(t,) for t in ("2m10s", "~19ms", "5 markets", "250", "1h2m3s", "1.5s", "500us", None, "")], "t string")
    assert [r[0] for r in rows.select(logs.duration_ms(F.col("t"))).collect()] == [130000.0, 19.0, None, 250.0, 3723000.0, 1500.0, 0.5, None, None]


def test_new_signature_and_spike(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [("new", "error", "m", "s", at(10), 1), ("", "error", "m", "s", at(11), 2)] + [("up", "error", "m", "s", at(10), i) for i in range(3, 6)] + [("up", "error", "m", "s", at(5), i) for i in (7, 8)]
    df = frame(spark, rows, "code string, level string, message string, service string, ts timestamp_ntz, seq long")
    got = {r.key: r for r in logs.analyze_errors(df, F.expr("TIMESTAMP_NTZ '2024-01-08'"), F.expr("TIMESTAMP_NTZ '2024-01-15'")).collect()}
    assert got["new"].is_new and got["new"].ratio is None and got["(no code)"].n == 1
    assert got["up"].ratio == 1.5 and got["up"].tag == "spike"


def test_metric_edges(spark):
    series = lambda *v: frame(spark, [("s", i, float(x)) for i, x in enumerate(v)], "series string, t long, v double")
    assert metrics.spikes(series(1, 1, 1)).count() == 0 and metrics.spikes(series(5)).count() == 0
    r = metrics.summary(series("nan", 2, 4)).first()
    assert (r.min_v, r.max_v, r.last_v, r.n) == (2.0, 4.0, 4.0, 2)
    assert [b.n for b in metrics.histogram(series(3, 3), "v").collect()] == [2]
    assert metrics.histogram(series(0, 10), "v").orderBy("bin").collect()[9].n == 1
    ratios = lambda *v: frame(spark, [(float(x),) for x in v], "ratio double")
    assert not metrics.bimodal(ratios(3, 0.5)).first().bimodal
    assert metrics.bimodal(ratios(3, 3, 0.5, 0.5)).first().bimodal
    assert metrics.bimodal(ratios(3, 3, "inf", 0)).first().degenerate_n == 2


def test_queue_states(spark):
    q = frame(spark, [("emails", 12, 0, 0, 0, 7.2e6, None, 0.0, None)], "queue string, waiting long, active long, failed long, delayed long, oldest_waiting_ms double, newest_failed_age_ms double, top_share double, top_age_ms double")
    assert {r.kind: r.relevance for r in state.queue_signals(q).collect()} == {"worker-starvation": 0.7, "oldest-job": 0.85, "summary": 0.4}


def test_lag_is_null_when_unknown(spark):
    ends = frame(spark, [("a", 10), ("b", 5), ("c", 3)], "part string, end_offset long")
    got = state.lag(ends, frame(spark, [("a", 4), ("b", 9)], "part string, committed long"), ["part"]).collect()
    assert {r.part: r.lag for r in got} == {"a": 6, "b": None, "c": None}


def test_fnv1a(spark):
    def plain(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h

    assert [r[0] for r in frame(spark, [("abc",), ("",), ("42",)], "t string").select(text.fnv1a(F.col("t"))).collect()] == [plain("abc"), plain(""), plain("42")]


def test_read_only_guard():
    assert text.is_read_only("SELECT 1") and text.is_read_only("with a as (select 1) select * from a;")
    assert not text.is_read_only("delete from nodes") and not text.is_read_only("select 1; drop table x") and text.is_read_only("select 'drop table'")


def test_logistic_equals_numpy(spark):
    r = np.random.default_rng(0)
    x = r.integers(0, 4, (60, 2)).astype(float)
    y = (x[:, 0] > x[:, 1]).astype(int)
    rows = frame(spark, [(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    w, b0 = evaluation.fit_logistic(rows, ["a", "b"], "y", epochs=50)
    v, c = np.zeros(2), 0.0
    for _ in range(50):
        err = 1 / (1 + np.exp(-(x @ v + c))) - y
        v, c = v - 0.1 * (x.T @ err / 60 + 0.001 * v), c - 0.1 * err.mean()
    assert np.allclose(w, v) and np.isclose(b0, c)


def test_stream_equals_batch(spark, tmp_path):
    """Duplicates go and sessions close by the quiet gap, as in the batch form."""
    start = dt.datetime(2024, 1, 1)
    minutes = [0, 59, 119, 180, 242, 400]
    rows = [{"user": u, "id": f"{u}{m}", "ts": (start + dt.timedelta(minutes=m)).isoformat()} for u in ("a", "b") for m in minutes if not (u == "b" and m == 242)]
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(map(json.dumps, rows + rows[:3])))
    (source / "2.json").write_text(json.dumps({"user": "z", "id": "z", "ts": "2024-02-01T00:00:00"}))
    stream = spark.readStream.schema("user string, id string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))
    once = episodes.distinct_events(stream, "user", "id", "ts")
    out = episodes.stream_episodes(once, "user", "ts", late=None).writeStream.format("memory").queryName("ep").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination()
    got = sorted((r.user, r.started, r.ended, r.n) for r in spark.table("ep").collect() if r.user != "z")
    batch = frame(spark, [(r["user"], r["id"], dt.datetime.fromisoformat(r["ts"])) for r in rows], "user string, id string, ts timestamp")
    want = sorted((r.user, r.started, r.ended, r.n) for r in episodes.episodes(batch, "user", "ts", "id").collect())
    assert got == want


def test_dead_code_callers_and_exported_classes(spark):
    from tracewell.operators import flows

    rows = [
        ("helper", "function", "helper", "src/a.py", None, False),
        ("used", "function", "used", "src/a.py", None, False),
        ("far", "function", "far", "src/a.py", None, False),
        ("caller", "function", "main", "src/b.py", None, False),
        ("check", "function", "test_helper", "tests/test_a.py", None, False),
        ("shown", "class", "Shown", "src/a.py", None, True),
        ("open", "method", "open", "src/a.py", "Shown", False),
        ("shut", "method", "_shut", "src/a.py", "Shown", False),
        ("other", "method", "open", "src/c.py", "Shown", False),
    ]
    nodes = spark.createDataFrame(rows, "id string, label string, name string, path string, class_name string, exported boolean")
    edges = spark.createDataFrame([("check", "helper", "calls"), ("caller", "used", "calls"), ("unknown", "far", "calls")], "source string, target string, rel string")
    assert {r.id for r in flows.dead_code(nodes, edges).collect()} == {"helper", "shut", "other"}
