"""Polling by halved windows: the rule, the batch form against it, and the streaming source with a burst and a restart."""

import random

import pytest

from tracewell.streaming import polling

T = 1_700_000_000


def test_window_halves():
    rows = [T + 10] * 30 + [T + 500] * 30 + [T + 3000] * 30
    count = lambda a, b: sum(a <= x <= b for x in rows)
    assert polling.window(count, T, T + 9000, most=100) == (T - 120, T + 3600)
    assert polling.window(count, T, T + 60, most=100) == (T - 120, T + 60)
    assert polling.window(count, T, T + 9000, most=80) == (T - 120, T + 1740)
    assert polling.window(count, T, T + 9000, most=50) == (T - 120, T + 345)
    with pytest.raises(ValueError):
        polling.window(count, T, T + 9000, most=30)  # thirty rows of one second, and what lies behind the cursor cannot shrink
    with pytest.raises(ValueError):
        polling.window(lambda a, b: 5, T, T + 9000, most=5)


def test_batch_polls(spark):
    r = random.Random(6)
    rows = [(k, T + r.randrange(0, 20_000), r.randrange(1, 4)) for k in ("a", "b") for _ in range(300)] + [("a", None, 7), ("c", None, 1)]
    got = {}
    for x in polling.polls(spark.createDataFrame(rows, "route string, t long, n long"), T, T + 18_000, most=60).orderBy("route", "poll").collect():
        got.setdefault(x.route, []).append((x.start, x.end, x.n))
    for k in ("a", "b"):
        count = lambda a, b: sum(n for q, t, n in rows if q == k and t is not None and a <= t <= b)  # noqa: B023, E731
        want, cursor = [], T
        while cursor < T + 18_000:
            start, cursor = polling.window(count, cursor, T + 18_000, most=60)
            want.append((start, cursor, count(start, cursor)))
        assert got[k] == want and max(n for *_, n in want) < 60
    assert set(got) == {"a", "b"}


def test_batch_polls_get_over_what_cannot_be_halved(spark):
    """Seconds of `most` rows and more, also before the beginning: every row is in a poll, and the last poll ends now."""
    for rows in ([("a", T + 9 + 700 * i, 60) for i in range(20)], [("a", T - 5, 80), ("a", T, 80), ("a", T + 1, 1)], [("a", T + i, 3) for i in range(900)]):
        got = sorted(tuple(x)[1:] for x in polling.polls(spark.createDataFrame(rows, "route string, t long, n long"), T, T + 15_000, most=50).collect())
        assert got[-1][2] == T + 15_000 and [g[0] for g in got] == list(range(len(got)))
        assert all(b[1] == a[2] - polling.OVERLAP for a, b in zip(got, got[1:], strict=False)) and got[0][1] == T - polling.OVERLAP
        assert all(any(a <= t <= b for _, a, b, _ in got) for _, t, _ in rows)
        assert all(n == sum(k for _, t, k in rows if a <= t <= b) for _, a, b, n in got) and len(got) < 2000


def test_batch_polls_go_back_as_the_rule_does(spark):
    """A window that halves behind its cursor and gets past the spot from there ends as the rule says, without an error."""
    rows = [("a", T + t, n) for t, n in ((437, 44), (1110, 21), (1192, 9), (2159, 20), (2697, 33), (2877, 46))]
    count = lambda a, b: sum(n for _, t, n in rows if a <= t <= b)
    want, cursor = [], T
    for _ in range(200):
        if cursor >= T + 9000:
            break
        a, b = cursor - 120, min(T + 9000, cursor + 3600)
        while count(a, b) >= 50:
            b = (a + b) // 2
        want.append((a, b, count(a, b)))
        cursor = b
    got = [tuple(x)[2:] for x in polling.polls(spark.createDataFrame(rows, "route string, t long, n long"), T, T + 9000, most=50).orderBy("poll").collect()]
    assert cursor >= T + 9000 and any(b[1] <= a[1] for a, b in zip(want, want[1:], strict=False))
    assert got == want


def test_stream_of_polls(spark, tmp_path):
    """A burst shortens polls, and a query that starts again goes on at its cursor."""
    r = random.Random(9)
    events = [(i, T + r.randrange(0, 4000)) for i in range(60)] + [(100 + i, T + 5000 + i // 3) for i in range(120)] + [(900, T + 9000)]
    spark.createDataFrame(events, "event_id long, t long").repartition(3).write.parquet(str(tmp_path / "log"))
    spark.dataSource.register(polling.PolledLog)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run(now):
        stream = spark.readStream.format("polled_log").schema("event_id long, t long").options(path=str(tmp_path / "log"), begin=T, now=now, most=50, overlap=0).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        try:
            query.processAllAvailable()
            return [p for p in query.recentProgress if p.numInputRows]
        finally:
            query.stop()

    first = run(T + 5020)
    second = run(T + 10_000)
    assert first and second and all(0 < p.numInputRows < 50 for p in [*first, *second])
    found = [(x.event_id, x.t) for x in spark.read.parquet(out).collect()]
    assert set(found) == set(events)
    assert min(int(p.sources[0].startOffset.split(":")[-1].strip(" }") or 0) for p in second) >= T + 4000  # not from the beginning
