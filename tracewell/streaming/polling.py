"""Polls by windows of time that halve until they hold few enough rows: the rule, a batch of it, and a streaming source."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

#: Seconds that a poll looks back beyond its cursor and ahead of it, rows that it must stay under.
OVERLAP, SPAN, MOST = 120, 3600, 1000


def window(count: Callable[[int, int], int], cursor: int, now: int, most: int = MOST, span: int = SPAN, overlap: int = OVERLAP) -> tuple[int, int]:
    """(start, end) of the poll after cursor, both included: from `overlap` before it to `span` after it or to now, the end halved towards
    the start while count(start, end) is `most` or more. Raises where halving reaches one second or the cursor, so that a poll
    always gets ahead: the cursor stays, and the filter must be narrowed."""
    start, end = cursor - overlap, min(now, cursor + span)
    while count(start, end) >= most:
        end = (start + end) // 2
        if end - start < 1 or end <= cursor:
            raise ValueError(f"over {most} rows in a window that cannot be halved, after {cursor}: refine the filter")
    return start, end


def _halved(count: Callable[[int, int], int], cursor: int, now: int, most: int, span: int, overlap: int) -> tuple[int, int] | None:
    """window() where it may fall behind the cursor; None where no window down to one second holds less than `most` rows."""
    start, end = cursor - overlap, min(now, cursor + span)
    while count(start, end) >= most:
        half = (start + end) // 2
        if half == end:
            return None
        end = half
    return start, end


def _ahead(cursor: int, far: int, now: int, span: int, overlap: int) -> tuple[int, int]:
    """The shortest of the halved windows after cursor that ends beyond `far`, which is before now."""
    start, end = cursor - overlap, min(now, cursor + span)
    if end <= far:
        return start, min(now, far + span)
    while (half := (start + end) // 2) > far:
        end = half
    return start, end


def polls(seconds: DataFrame, begin: int, now: int, most: int = MOST, span: int = SPAN, overlap: int = OVERLAP) -> DataFrame:
    """(route, poll, start, end, n): the polls that bring each route from begin to now. seconds has route, t and n, rows by whole second.

    A poll begins where the one before it ended, so a route is walked in sequence; what a task holds of it are counts by second, not rows.
    Halving may end a poll behind its cursor, as the specified rule does. Where that would go on for ever (a cursor comes back, or one second
    holds `most` rows), the poll is the shortest halved window that ends beyond all before it: no row is left out, and its n, which
    is `most` or more, tells that a poll of a service would be refused there.
    Null times are left out, repeated seconds add up, and a route without rows has none of its polls listed."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["t"]).groupby("t", as_index=False)["n"].sum().assign(route=rows["route"].iloc[0])
        at, upto = rows["t"].to_numpy(np.int64), np.r_[0, np.cumsum(rows["n"].to_numpy(np.int64))]
        count = lambda a, b: int(upto[np.searchsorted(at, b, "right")] - upto[np.searchsorted(at, a)]) if b >= a else 0
        out, cursor, met, far = [], begin, set(), begin
        while cursor < now:
            again = cursor in met
            met.add(cursor)
            found = None if again else _halved(count, cursor, now, most, span, overlap)
            start, cursor = found or _ahead(cursor, far, now, span, overlap)
            far = max(far, cursor)
            out.append((rows["route"].iloc[0] if len(rows) else None, len(out), start, cursor, count(start, cursor)))
        return pd.DataFrame(out, columns=["route", "poll", "start", "end", "n"])

    kind = dict(seconds.dtypes)["route"]
    return seconds.filter("t IS NOT NULL").select("route", "t", "n").groupBy("route").applyInPandas(walk, f"route {kind}, poll int, start long, end long, n long")


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.time = schema.fieldNames(), options["path"], options.get("time", "t")
        self.begin, self.now = int(options["begin"]), int(options["now"]) if "now" in options else None
        self.sizes = {k: int(options.get(k, v)) for k, v in (("most", MOST), ("span", SPAN), ("overlap", OVERLAP))}

    def _between(self, a: int, b: int):
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        at = pc.field(self.time)
        return ds.dataset(self.path, format="parquet").scanner(columns=self.names, filter=(at >= a) & (at <= b))

    def initialOffset(self) -> dict:
        return {"cursor": self.begin}

    def _rows(self, start: int, end: int) -> Iterator[tuple]:
        found = self._between(start, end).to_table().sort_by(self.time).to_pydict()
        return iter(list(zip(*(found[c] for c in self.names), strict=True)))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self.now if self.now is not None else int(time.time())
        if start["cursor"] >= now:
            return iter(()), start
        a, b = window(lambda x, y: self._between(x, y).count_rows(), start["cursor"], now, **self.sizes)
        return self._rows(a, b), {"cursor": b}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start["cursor"] - self.sizes["overlap"], end["cursor"])


class PolledLog(DataSource):
    """`polled_log`: a stream over a folder of Parquet files, a poll a batch, with the cursor as its offset in the query's checkpoint.

    Options: path, begin and now (seconds; now is the clock's unless given), time (the column of whole seconds, t), most, span and
    overlap. The stream's schema names the columns to read. A poll's rows number under `most`, so they may pass the driver as
    those of a poll of a service do; neighbouring polls overlap, so ids come twice (see distinct_events). A second with
    `most` rows or more fails the query, and its cursor stays."""

    @classmethod
    def name(cls) -> str:
        return "polled_log"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(schema, dict(self.options))
