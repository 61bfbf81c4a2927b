"""A registry of queries and oracles that each plan module fills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def literal(value) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]" + ("" if value else "::VARCHAR[]")
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return add

    def cases(self, name: str, schema: str, rows: list[tuple], value: Callable[..., Column], kind: str | None = None) -> None:
        """A query that applies a column function to a case for each event, the cases in turn. The last
        entry of each row is the answer worked out by hand; the oracle knows nothing else."""

        def run(spark: SparkSession, d: str) -> DataFrame:
            inputs = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], f"nr long, {schema}")
            events = table(spark, d, "events").select("event_id", F.pmod("event_id", F.lit(len(rows))).alias("nr"))
            columns = [F.col(c) for c in inputs.columns[1:]]
            return events.join(inputs, "nr").select("event_id", value(*columns).alias("value"))

        answers = ", ".join(f"({i}, {literal(r[-1])})" for i, r in enumerate(rows))
        cast = f"CAST(c.value AS {kind})" if kind else "c.value"
        self.queries[name] = run
        self.oracles[name] = f"SELECT event_id, {cast} AS value FROM events JOIN (VALUES {answers}) c(nr, value) ON event_id % {len(rows)} = nr"
