"""URL filters by a temporal list join, in DataFrame functions only.

Dated list entries become validity intervals; an as-of join holds every capture against the entries
that were active when it was fetched, by its host's domains and its first path segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Dated entries of the production lists: list, entry (a domain, or a host and its first path
#: segment), whether it blocks or allows, whether it is added or removed, and when.
ENTRIES = [
    ("spam", "spam-farm.example.org", "block", "add", "2024-01-01"),
    ("spam", "spam-farm.example.org", "block", "remove", "2024-05-01"),
    ("spam", "spam-farm.example.org", "block", "add", "2024-08-15"),
    ("pharma", "cheap-pills.example.com", "block", "add", "2024-02-10"),
    ("pharma", "cheap-pills.example.com", "block", "remove", "2024-11-01"),
    ("networks", "example.net", "block", "add", "2024-06-01"),
    ("networks", "example.net", "block", "remove", "2024-07-01"),
    ("trusted", "blog.tionsh.example.net", "allow", "add", "2024-01-01"),
    ("sections", "therha.example.com/en", "block", "add", "2024-03-01"),
    ("sections", "therha.example.com/en", "block", "remove", "2024-09-01"),
    # Added again while active, removed twice, and back on the list: only changes of state count.
    ("spam", "spam-farm.example.org", "block", "add", "2024-09-20"),
    ("spam", "spam-farm.example.org", "block", "remove", "2024-10-10"),
    ("spam", "spam-farm.example.org", "block", "remove", "2024-10-15"),
    ("spam", "spam-farm.example.org", "block", "add", "2024-12-01"),
    # Overlaps: a whole domain for two weeks of each quarter, and an exception in some of them.
    *(("outages", "example.com", "block", action, f"2024-{month:02}-{day:02}") for month in (2, 5, 8, 11) for action, day in (("add", 3), ("remove", 17))),
    ("outages", "cheap-pills.example.com", "allow", "add", "2024-05-10"),
    ("outages", "cheap-pills.example.com", "allow", "remove", "2024-08-10"),
    *(("mirrors", "example.org", "block", action, f"2024-{month:02}-{day:02}") for month in range(1, 13) for action, day in (("add", 27), ("remove", 28))),
]


def entries(spark: SparkSession, rows: list[tuple] = ENTRIES) -> DataFrame:
    listed = spark.createDataFrame(rows, "list string, entry string, effect string, action string, day string")
    return listed.select("list", "entry", "effect", "action", F.col("day").cast("timestamp_ntz").alias("at"))


def intervals(listed: DataFrame) -> DataFrame:
    """list, entry, effect, valid_from (inclusive), valid_to (exclusive, null: still active).

    Of changes of one entry at one time, a removal comes last. Adding what is active and removing
    what is not change nothing: the interval keeps its first day. Rows with a null entry, time or
    action are left out; repeated rows count once. An empty list gives no intervals.
    """
    order = Window.partitionBy("list", "entry", "effect").orderBy("at", "removes")
    known = listed.select("list", F.lower("entry").alias("entry"), "effect", "at", (F.col("action") == "remove").alias("removes"))
    known = known.filter("entry is not null and at is not null and removes is not null").distinct()
    turns = known.withColumn("was", F.coalesce(F.lag("removes").over(order), F.lit(True))).filter("removes <> was")
    spans = turns.select("*", F.lead("at").over(order).alias("valid_to")).filter("not removes")
    spans = spans.filter("valid_to is null or valid_to > at")
    return spans.select("list", "entry", "effect", F.col("at").alias("valid_from"), "valid_to")


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def _segment(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1))


def judge(pages: DataFrame, fetched: Column, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id_col, host, fetched, kept, list, entry, valid_from.

    The longest entry active at fetch time decides; of equally long ones an allowing entry, then the
    first list by name. A page is kept unless a blocking entry decides. A url without a host, a null
    url and a null time match nothing and are kept; hosts are compared in lower case without a final
    dot. Captures are merged by host, segment and time before they meet the list, so a hot host is
    looked up once a time; no side is broadcast unless Spark measures it as small. Repeated rows and
    ids have repeated results, other columns of either table are ignored, and an empty table of pages
    gives an empty result.
    """
    url = F.col(url_col)
    seen = pages.select(
        F.col(id_col).alias(id_col), F.regexp_replace(_host(url), r"\.$", "").alias("host"), _segment(url).alias("segment"), fetched.cast("timestamp_ntz").alias("fetched")
    )
    captures = seen.select("host", "segment", "fetched").filter("host <> '' and fetched is not null").distinct()
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    names = F.when(F.col("segment") != "", F.concat(domains, F.array(F.concat_ws("/", "host", "segment")))).otherwise(domains)
    spans = intervals(listed)
    looked_up = captures.select("*", F.explode(names).alias("entry")).join(spans, "entry").filter("fetched >= valid_from and (valid_to is null or fetched < valid_to)")
    rank = F.struct(-F.length("entry"), F.when(F.col("effect") == "allow", 0).otherwise(1), "list", "entry", "valid_from", "effect")
    best = looked_up.groupBy("host", "segment", "fetched").agg(F.min(rank).alias("best"))
    decided = seen.join(best, ["host", "segment", "fetched"], "left")
    return decided.select(
        id_col,
        "host",
        "fetched",
        F.coalesce(F.col("best.effect") != "block", F.lit(True)).alias("kept"),
        F.col("best.list").alias("list"),
        F.col("best.entry").alias("entry"),
        F.col("best.valid_from").alias("valid_from"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` has no fetch time: captures are spread over the days of 2024 by page_id."""
    day = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("page_id") * 7919 % 366).cast("int"))
    return judge(table(spark, sf_dir, "pages"), day, entries(spark))


ORACLE = (
    "WITH listed(list, entry, effect, action, changed) AS (VALUES "
    + ", ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e}')" for a, b, c, d, e in ENTRIES)
    + r"""),
turns AS (
  SELECT *, lag(action, 1, 'remove') OVER (PARTITION BY list, entry, effect ORDER BY changed, action = 'remove') AS was FROM listed),
spans AS (
  SELECT list, entry, effect, action, changed AS valid_from,
         lead(changed) OVER (PARTITION BY list, entry, effect ORDER BY changed, action = 'remove') AS valid_to FROM turns WHERE action <> was),
seen AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1)) AS segment,
         TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 7919 % 366 AS INTEGER)) AS fetched
  FROM pages),
hits AS (
  SELECT s.page_id, p.*, row_number() OVER (PARTITION BY s.page_id
           ORDER BY length(p.entry) DESC, CASE WHEN effect = 'allow' THEN 0 ELSE 1 END, list, entry, valid_from) AS nth
  FROM seen s JOIN spans p ON p.action = 'add' AND s.fetched >= p.valid_from AND (p.valid_to IS NULL OR s.fetched < p.valid_to)
    AND (s.host = p.entry OR ends_with(s.host, '.' || p.entry) OR s.host || '/' || s.segment = p.entry))
SELECT s.page_id, s.host, s.fetched, coalesce(h.effect <> 'block', true) AS kept, h.list, h.entry, h.valid_from
FROM seen s LEFT JOIN hits h ON h.page_id = s.page_id AND h.nth = 1
"""
)
