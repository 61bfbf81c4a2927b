"""Queries on rows that the given tables do not hold, against their SQL."""

import duckdb

from tracewell.operators import questions
from tracewell.plans import registry


def test_words_end_at_letters_beyond_ascii(spark):
    """As in the reference, a word ends where ASCII letters, digits and the underscore end."""
    texts = ["queue\u00f3 stall", "\u00f1queue\u00f1 api", "queue_ stall", "no gap\u00e9 here", "what else\u00ed", "redis\u0301", "unsure", "sure\u00e1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: (r.k, r.t) for r in rows.select("id", questions.question_kind(rows.text).alias("k"), questions.question_topic(rows.text).alias("t")).collect()}
    assert got == {0: (None, "queue"), 1: (None, "queue"), 2: (None, "worker"), 3: ("missing-evidence", None), 4: ("missing-evidence", None), 5: (None, "infra"), 6: (None, None), 7: ("confidence", None)}


def test_samples_of_events_with_nulls_and_quotes(spark, tmp_path):
    events = [(7, 'a"b\\c', 1.5), (8, None, 2.5), (9, "x", None), (None, "y", 3.5), (50, "n", 1.0), (51, "i", 1.0), (10**15 + 7, "\u00c4\n", -0.0), (12, "z", 1e-300), (13, "w", float("inf"))]
    spark.createDataFrame(events, "event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = registry.QUERIES["src_prom_parse"](spark, str(tmp_path)).select("kind", "t", "v").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["src_prom_parse"]).fetchall()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want)) and len(want) == len(events)
