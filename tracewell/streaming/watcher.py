"""The watcher's state: incident events become jobs, an episode each, by a state machine for every family of events.

events has route, family, event_id, occurred_at (timestamp), source, state (active, resolved, or done: the word of a worker that a
job is finished), severity, episode (null where the source has none) and required (whether an investigation is asked for).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: silence in ms after which a source without resolutions begins another episode.
QUIET_MS = 3_600_000
OUT = "route string, family string, event_id string, job long, action string, status string, resolved boolean"
STATE = "job long, episode string, at long, severity string, resolved boolean, status string, tried boolean"
COLUMNS = ["route", "family", "event_id", "at", "source", "state", "severity", "episode", "required"]


@dataclass
class Job:
    """The last job of a family: its number, its first event's episode, and what the latest event in time said."""

    job: int
    episode: str | None
    at: int
    severity: str | None
    resolved: bool
    status: str
    tried: bool

    def key(self) -> tuple:
        return self.job, self.episode, self.at, self.severity, self.resolved, self.status, self.tried


def _opened(number: int, e) -> tuple[Job, str]:
    shut = e.state == "resolved"
    status = "cancelled" if shut and not e.required else "pending"
    return Job(number, e.episode, e.at, e.severity, shut, status, False), "open" if status == "pending" else "closed"


def step(last: Job | None, e) -> tuple[Job | None, str]:
    """The job after an event, and what the event did: open (a new job), closed (a new one that needs no work), late (older than what is
    known: recorded only), reopen (work after all), notify (a finished job's severity changed: told once more), resolve, update,
    done, or ignored (done without a job)."""
    if e.state == "done":
        if last is None:
            return None, "ignored"
        return Job(last.job, last.episode, last.at, last.severity, last.resolved, "done", True), "done"
    if last is None:
        return _opened(1, e)
    if e.at < last.at:
        return last, "late"
    other = e.episode != last.episode
    silent = e.source == "elasticsearch" and e.at - last.at > QUIET_MS
    if e.state == "active" and ((last.resolved and (e.episode is None or other)) or (e.episode is not None and other) or silent):
        return _opened(last.job + 1, e)
    shut = e.state == "resolved"
    idle = not last.tried and last.status in ("cancelled", "done")
    again = idle and (e.required or (not shut and last.resolved))
    tell = not again and last.status == "done" and e.severity != last.severity
    status = "pending" if again or tell else last.status
    action = "reopen" if again else "notify" if tell else "resolve" if shut else "update"
    return Job(last.job, last.episode, e.at, e.severity, shut, status, last.tried), action


def _row(e, job: Job | None, action: str) -> tuple:
    return (e.route, e.family, e.event_id, 0 if job is None else job.job, action, None if job is None else job.status, None if job is None else job.resolved)


def _plain(rows: pd.DataFrame) -> Iterator:
    """Rows as tuples with None for what is missing."""
    return rows.astype(object).where(rows.notna(), None).itertuples(index=False, name="Event")


NAMES = [x.strip().split(" ")[0] for x in OUT.split(",")]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by family and order -> what each did. Only a family's last job is held from row to row."""
    family, last = None, None
    for rows in batches:
        out = []
        for e in _plain(rows[COLUMNS]):
            if (e.route, e.family) != family:
                family, last = (e.route, e.family), None
            last, action = step(last, e)
            out.append(_row(e, last, action))
        yield pd.DataFrame(out, columns=NAMES)


def _prepared(events: DataFrame, *more: str) -> DataFrame:
    return events.select("route", "family", F.col("event_id").cast("string").alias("event_id"), F.unix_millis(F.col("occurred_at").cast("timestamp")).alias("at"), "source", "state", "severity", "episode", F.coalesce("required", F.lit(False)).alias("required"), *more)


def watch(events: DataFrame, *arrival: str) -> DataFrame:
    """(route, family, event_id, job, action, status, resolved): what each event did, in the order of the columns arrival (such as the
    number of the poll that brought it), then of time and id.

    Jobs of a family are numbered from 1; status and resolved are those after the event. Null times go first and rows that repeat
    an id count each (see distinct_events). A family is read in sequence, as its rule demands, but never held: a task keeps its
    last job only. An empty table gives an empty result."""
    order = [*arrival, "at", "event_id"]
    rows = _prepared(events, *arrival).withColumn("at", F.coalesce("at", F.lit(0)))
    dealt = rows.repartition("route", "family").sortWithinPartitions("route", "family", *order)
    return dealt.mapInPandas(_scan, OUT)


def watch_stream(events: DataFrame, late: str | None = None, forget_ms: int | None = None) -> DataFrame:
    """watch() over a stream: the events of each micro-batch in order of time after those of the batches before it.

    late: the watermark, needed with forget_ms, after which the state of a family without events is dropped (its next event opens job 1
    again); without it state is kept for good."""
    timeout = GroupStateTimeout.EventTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = Job(*state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out = []
        for e in _plain(rows[COLUMNS]):
            last, action = step(last, e)
            out.append(_row(e, last, action))
        if last is not None:
            state.update(last.key())
            if forget_ms:
                state.setTimeoutTimestamp(max(last.at, state.getCurrentWatermarkMs()) + forget_ms)
        yield pd.DataFrame(out, columns=NAMES)

    marked = events.withWatermark("occurred_at", late) if late else events
    rows = _prepared(marked, *(["occurred_at"] if late else []))
    return rows.groupBy("route", "family").applyInPandasWithState(run, OUT, STATE, "append", timeout)
