"""Resolution of names that very many symbols bear: no name's uses meet all its symbols."""

from plan_rows import most_rows

from tracewell.operators import graph, resolve

MANY = 300


def _uses(spark, key):
    return spark.createDataFrame([(i, "run", f"f{i % 3}.py") for i in range(MANY)] + [(MANY, "rare", "f0.py"), (MANY + 1, "none", "f0.py")], f"{key} long, name string, file string")


def _symbols(spark):
    """run stands in f0 and f1 in great number and not in f2; rare twice in f0."""
    return spark.createDataFrame([(f"p{i:03}", "run", f"f{i % 2}.py") for i in range(5, MANY)] + [("r1", "rare", "f0.py"), ("r2", "rare", "f0.py"), ("r3", "rare", "f9.py")], "id string, name string, file string")


FIRST = {0: "p006", 1: "p005", 2: "p005"}


def test_siblings_of_a_name_of_many(spark):
    found = resolve.siblings(_uses(spark, "call"), _symbols(spark))
    assert most_rows(found) < 5 * MANY
    assert sorted(tuple(r) for r in found.collect()) == [(MANY, "r1", 0.4), (MANY, "r2", 0.4)]


def test_arguments_of_a_name_of_many(spark):
    found = resolve.arguments(_uses(spark, "call"), _symbols(spark))
    assert most_rows(found) < 5 * MANY
    assert {r.call: (r.id, r.confidence) for r in found.collect()} == {i: (FIRST[i % 3], 0.4 if i % 3 == 2 else 0.8) for i in range(MANY)} | {MANY: ("r1", 0.8)}


def test_types_of_a_name_of_many(spark):
    found = resolve.named(_uses(spark, "use"), _symbols(spark))
    assert most_rows(found) < 5 * MANY
    assert {r.use: r.id for r in found.collect()} == {i: FIRST[i % 3] for i in range(MANY)} | {MANY: "r1"}


def test_types_where_files_or_ids_are_null(spark):
    """A symbol in another file comes before one in no file, which comes before none; a null id is last in its place, not lost."""
    rows = [("p1", "part", None), ("p2", "part", "b.py"), ("p3", "part", "c.py"), ("q1", "lost", None), (None, "bare", "a.py"), ("r1", "bare", "b.py"), (None, "gone", None)]
    symbols = spark.createDataFrame(rows, "id string, name string, file string")
    uses = [(1, "part", "a.py"), (2, "part", "c.py"), (3, "part", None), (4, "lost", "a.py"), (5, "bare", "a.py"), (6, "bare", "c.py"), (7, "gone", "a.py"), (8, None, "a.py")]
    uses += [(9, "part", None), (9, "bare", "c.py")]
    found = resolve.named(spark.createDataFrame(uses, "use long, name string, file string"), symbols)
    assert {r.use: r.id for r in found.collect()} == {1: "p2", 2: "p3", 3: "p1", 4: "q1", 5: None, 6: "r1", 7: None, 9: "r1"}
    passed = spark.createDataFrame(uses[:8], "call long, name string, file string")
    assert {r.call: (r.id, r.confidence) for r in resolve.arguments(passed, symbols).collect()} == {1: ("p2", 0.4), 2: ("p3", 0.8), 3: ("p1", 0.4), 4: ("q1", 0.4), 5: (None, 0.8), 6: ("r1", 0.4), 7: (None, 0.4)}


def test_calls_of_a_name_of_many(spark):
    """Own file, imported file, and a guess for the rare name only."""
    calls = spark.createDataFrame([(i, f"a/f{i % 3}.py", "runs") for i in range(MANY)] + [(MANY, "b/z.py", "rare"), (MANY + 1, "b/z.py", "runs")], "call long, file string, name string")
    symbols = spark.createDataFrame([(f"p{i:03}", "runs", f"a/f{i % 2}.py") for i in range(5, MANY)] + [("r1", "rare", "a/f0.py"), ("r2", "rare", "b/f9.py")], "id string, name string, file string")
    found = graph.resolve_calls(calls, symbols, spark.createDataFrame([("a/f2.py", "a/f0.py"), ("a/f0.py", "a/f1.py")], "file string, target string"))
    assert most_rows(found) < 5 * MANY
    want = {i: ({0: "p006", 1: "p005", 2: "p006"}[i % 3], 1.0) for i in range(MANY)} | {MANY: ("r2", 0.5)}
    assert {r.call: (r.id, r.confidence) for r in found.collect()} == want


def test_receivers_of_a_name_of_many(spark):
    calls = _uses(spark, "call").selectExpr("call", "'C' AS receiver", "name", "IF(call = 7, 'x.go', file) AS file")
    found = resolve.receivers(calls, _symbols(spark).selectExpr("id", "name", "'C' AS class_name", "file"))
    assert most_rows(found) < 5 * MANY
    assert {r.call: r.id for r in found.collect()} == {i: FIRST[i % 3] for i in range(MANY) if i != 7} | {MANY: "r1"}
