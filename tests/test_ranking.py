"""The written full-text index and the reranker against the scan and a plain fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import reranker, search
from tracewell.operators.textindex import TextIndex, postings

DOCS = [(1, "Alpha beta alphabet"), (2, "beta beta gamma-ray"), (3, None), (4, ""), (5, "ALPHA été 42 x1"), (6, "delta " * 50 + "alpha"), (7, "none of these"), (8, "gamma"), (9, "alpha beta alphabet")]


@pytest.mark.parametrize("prefix", [True, False])
def test_index_ranks_as_the_scan(spark, tmp_path, prefix):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    index = TextIndex(str(tmp_path / "index")).write(docs)
    for terms in (["alpha"], ["Alpha", "BETA", "zzz"], ["é", "4"], ["absent"]):
        want = [(r.id, pytest.approx(r.score)) for r in search.bm25(docs, terms, 5, prefix=prefix).collect()]
        assert [(r.id, r.score) for r in index.search(spark, terms, 5, prefix).collect()] == want
    assert index.search(spark, [], 5).count() == 0
    plan = index.search(spark, ["alpha"], 5, False)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,alpha)]" in plan and "text" not in plan.split("PushedFilters")[0].split("ReadSchema")[-1]


def test_postings(spark, tmp_path):
    rows = spark.createDataFrame([*DOCS[:2], (2, "beta"), (None, "beta")], "id long, text string")
    got = {(r.term, r.id, r.tf, r.len) for r in postings(rows).collect()}
    assert got == {("alpha", 1, 1, 3), ("beta", 1, 1, 3), ("alphabet", 1, 1, 3), ("beta", 2, 2, 4), ("gamma", 2, 1, 4), ("ray", 2, 1, 4), ("beta", 2, 1, 1), ("beta", None, 1, 1)}
    index = TextIndex(str(tmp_path / "none")).write(rows.limit(0))
    assert index.search(spark, ["beta"]).count() == 0


CAUSE = "inv int, id string, final_score double, confidence double, base_score double, ids array<string>, nodes array<string>, explanations array<struct<factor: string, delta: double>>"


def causes(spark):
    r = np.random.default_rng(4)
    rows = [(i % 5, f"c{i}", float(r.random()), float(r.random()), None if i % 4 == 0 else 0.3, ["e"] * (i % 3), None if i % 5 == 0 else ["n"], [(f"f{i % 3}", 0.1), ("z", -0.2), (f"f{i % 2}", 0.3), (None, 1.0)] if i % 6 else None) for i in range(60)]
    return spark.createDataFrame(rows, CAUSE), rows


def test_features_and_fit(spark):
    frame, rows = causes(spark)
    keys = [r.key for r in reranker.vocabulary(frame).orderBy("place").collect()]
    assert keys == [*reranker.SCALARS, "f:f0", "f:f1", "f:f2", "f:z"]
    want = {}
    for inv, id_, final, sure, base, ids, nodes, why in rows:
        v = [final, sure, base or 0.0, len(ids), len(nodes or []), *(sum(d for f, d in why or [] if f == k[2:]) for k in keys[5:])]
        want[inv, id_] = v
    got = {}
    found = reranker.features(frame)
    for r in found.collect():
        v = [0.0] * len(keys)
        for p, x in zip(r.places, r["values"], strict=True):
            v[p] = x
        got[r.inv, r.id] = v
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    marked = found.withColumn("y", (F.substring("id", 2, 9).cast("int") % 2).cast("double"))
    w, b = reranker.fit(marked.union(marked.limit(7)), len(keys), "y", epochs=30, parts=3)
    again = marked.union(marked.limit(7)).collect()
    x, y = np.zeros((len(again), len(keys))), np.array([r.y for r in again])
    for i, r in enumerate(again):
        x[i, r.places] = r["values"]
    wl, bl = np.zeros(len(keys)), 0.0
    for _ in range(30):
        err = 1 / (1 + np.exp(-(x @ wl + bl))) - y
        wl, bl = wl - 0.1 * (x.T @ err / len(y) + 0.001 * wl), bl - 0.1 * err.sum() / len(y)
    assert w == pytest.approx(wl.tolist(), abs=1e-9) and b == pytest.approx(bl, abs=1e-9)
    score = {r.id: r.score for r in reranker.scored(found, w, b).collect()}
    assert all(score[i] == pytest.approx(1 / (1 + np.exp(-(np.array(v) @ wl + bl)))) for (_, i), v in want.items())
    assert reranker.fit(marked.limit(0), 2, "y") == ([0.0, 0.0], 0.0)
    assert [r.key for r in reranker.vocabulary(frame.limit(0)).orderBy("place").collect()] == reranker.SCALARS


def test_questions(spark):
    from tracewell.operators import questions

    asked = [("a", 1, "what contradicts the queue?"), ("b", 1, "argues against redis"), ("c", 1, "evidence against all of it"), ("d", 2, "refute it"), ("e", 1, "What don't we have? it doesn't have gaps"), ("f", 2, "what else"), ("g", 1, "are you sure that nothing contradicts the deploy"), ("h", 2, "certainty"), ("i", 1, "hello gapsy"), ("j", 1, None), ("k", 1, "rule  out API latency of the queue"), ("l", 9, "rule out retry"), ("m", 1, "disprove the worker")]
    told = [(1, "h1", "queue-backlog", "weakened", ["e2", "e1", "gone"]), (1, "h2", "queue-backlog", "supported", ["e1"]), (1, "h3", "retry-storm", "supported", ["e3"]), (1, "h4", "worker-slowdown", "unconfirmed", []), (2, "h1", "retry-storm", "supported", None)]
    known = spark.createDataFrame([(1, "e1"), (1, "e2"), (1, "e3"), (2, "gone")], "report int, id string")
    gaps = spark.createDataFrame([(1, "logs", 0.05), (1, "state", 0.1), (1, "state", 0.1)], "report int, dimension string, impact double")
    totals = spark.createDataFrame([(1, 0.6, 0.85), (2, 0.9, 1.0)], "report int, confidence double, ceiling double")
    found = questions.answers(spark.createDataFrame(asked, "question string, report int, text string"), spark.createDataFrame(told, "report int, id string, category string, verdict string, contradicts array<string>"), known, gaps, totals)
    got = {r.question: (r.kind, r.topic, r.answer, r["items"], r.verdicts, r.confidence) for r in found.collect()}
    assert got == {
        "a": ("contradicts", "queue", "contradicted", ["e1", "e2"], ["supported", "weakened"], None),
        "b": ("contradicts", "infra", "not-evaluated", ["queue-backlog", "retry-storm", "worker-slowdown"], [], None),
        "c": ("contradicts", None, "contradicted", ["e1", "e2", "e3"], [], None), "d": ("contradicts", None, "uncontradicted", [], [], None),
        "e": ("missing-evidence", None, "gaps", ["logs", "state"], [], None), "f": ("missing-evidence", None, "no-gaps", [], [], None),
        "g": ("confidence", "deployment", "capped", ["state", "logs"], ["queue-backlog", "worker-slowdown"], 0.6), "h": ("confidence", None, "uncapped", [], [], 0.9),
        "k": ("contradicts", "queue", "contradicted", ["e1", "e2"], ["supported", "weakened"], None), "l": ("contradicts", "retry", "not-evaluated", [], [], None), "m": ("contradicts", "worker", "uncontradicted", [], ["unconfirmed"], None),
    }
    assert found.filter("n <> size(items)").count() == 0


def test_walkthroughs(spark):
    from tracewell.operators import walkthrough

    symbols = [("a", "place", "src/a.ts"), ("b", "order.save", "src/b.ts"), ("c", "getLogger", "src/c.ts"), ("d", "axios.post", "src/d.ts"), ("e", "pay", "src/pay.gateway.ts"), ("f", "Cart", "src/cart.ts"), ("g", "add", "src/cart.ts"), ("h", "total", "src/cart.ts"), ("i", "lone", "src/i.ts"), ("j", "order.save", "src/b.ts"), ("k", "keep", "src/telemetry/k.ts"), *((f"r{i}", f"r{i}", "src/repository.ts") for i in range(8))]
    flows = [("one", 0, "a"), ("one", 1, "c"), ("one", 2, "b"), ("two", 0, "d"), ("two", 1, "a"), ("two", 2, "e"), ("two", 3, "k"), ("three", 0, "i"), ("also", 0, "b"), ("also", 1, "e"), ("also", 2, "d")]
    calls = [("a", "j", 0), ("a", "b", 1), ("e", "d", 0), ("h", "g", 1), ("h", "b", 0), ("i", "c", 0), *(("g", f"r{i}", i) for i in range(8))]
    members = [("f", "g", 1), ("f", "h", 0), ("f", "c", 2)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    seeds = frame([(x,) for x in ("a", "b", "e", "f", "g", "h", "i", "gone", "a")], "id string")
    found = walkthrough.walkthroughs(seeds, frame(symbols, "id string, name string, file string"), frame(flows, "flow string, step int, id string"), frame(calls, "source string, target string, seq int"), frame(members, "id string, method string, seq int"))
    got = {r.id: (r.kind, r.flow, r.entry, r.steps, r.stores, r.calls_out) for r in found.collect()}
    assert got == {
        "a": ("flow", "two", "axios.post", ["axios.post", "place", "pay"], ["order.save"], ["axios.post", "pay"]),
        "b": ("flow", "also", "order.save", ["order.save", "pay", "axios.post"], ["order.save"], ["pay", "axios.post"]),
        "e": ("flow", "two", "axios.post", ["axios.post", "place", "pay"], [], ["axios.post", "pay"]),
        "f": ("class", None, "Cart", ["total", "add"], [], []),
        "g": ("calls", None, "add", ["add", *(f"r{i}" for i in range(8))], [f"r{i}" for i in range(6)], []),
        "h": ("calls", None, "total", ["total", "order.save", "add"], ["order.save"], []),
        "i": ("alone", None, "lone", ["lone"], [], []),
    }
    assert found.count() == 7
