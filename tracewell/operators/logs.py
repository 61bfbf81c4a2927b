"""Log analysis: levels, filters, error signatures against a preceding window, durations.

A log frame has code, level, message, service, ts (timestamp_ntz) and seq (a unique tie-breaker).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numeric levels by label.
LEVELS = {"trace": 10, "debug": 20, "info": 30, "warn": 40, "error": 50, "fatal": 60}
NO_CODE = "(no code)"
SPIKE = 1.5


def level_number(level: Column) -> Column:
    out = F.lit(LEVELS["info"])
    for name, number in LEVELS.items():
        out = F.when(F.lower(level) == name, number).otherwise(out)
    return out


def level_label(number: Column) -> Column:
    """The label of the highest level at or below a number; below all of them, trace."""
    out = F.lit("trace")
    for name, least in LEVELS.items():
        out = F.when(number >= least, name).otherwise(out)
    return F.when(number.isNull(), "info").otherwise(out)


def at_least(logs: DataFrame, level: str) -> DataFrame:
    return logs.filter(F.col("level").isin([n for n, x in LEVELS.items() if x >= LEVELS[level]]))


def where(logs: DataFrame, equal: dict) -> DataFrame:
    """All of the equalities; a field may also stand under its keyword twin, `<field>.keyword`."""
    for name, value in equal.items():
        twin = f"{name}.keyword"
        test = F.lit(False)
        for c in (name, twin):
            if c in logs.columns:
                test = test | (F.col(f"`{c}`") == value)
        logs = logs.filter(test)
    return logs


def text_match(logs: DataFrame, phrase: str, broad: bool = False) -> DataFrame:
    """Case-insensitive phrase in the message, or broadly in message, code and detail."""
    fields = [c for c in ("message", "code", "detail") if c in logs.columns] if broad else ["message"]
    return logs.filter(F.lower(F.concat_ws("\n", *fields)).contains(phrase.lower()))


def between(logs: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Both ends included."""
    return logs.filter((F.col("ts") >= start) & (F.col("ts") <= stop))


def search(logs: DataFrame, start: Column, stop: Column, level: str | None = None, limit: int = 50) -> DataFrame:
    """Newest rows of a time range first."""
    rows = between(logs, start, stop)
    rows = at_least(rows, level) if level else rows
    return rows.orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def buckets(logs: DataFrame, field: str, top: int = 20) -> DataFrame:
    """Values of a field among rows of at least error level, by count."""
    rows = at_least(logs, "error").groupBy(F.col(field).alias("key")).agg(F.count("*").alias("n"))
    return rows.filter("key IS NOT NULL").orderBy(F.desc("n"), "key").limit(top)


def signatures(logs: DataFrame, services: int = 10, top: int | None = 25) -> DataFrame:
    """Per code: n, first_seen, last_seen, the most frequent services, level and message of the latest row."""
    code = F.when(F.col("code").isNull() | (F.col("code") == ""), NO_CODE).otherwise(F.col("code")).alias("key")
    rows = logs.select(code, "level", "message", "service", "ts", "seq")
    last = F.max_by(F.struct("level", "message"), F.struct("ts", "seq"))
    heads = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), last.alias("last"))
    per = rows.filter("service IS NOT NULL").groupBy("key", "service").agg(F.count("*").alias("m"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("m"), "service"))
    named = per.withColumn("r", rank).filter(F.col("r") <= services).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "service"))).alias("s"))
    out = heads.join(named, "key", "left").select(
        "key", "n", "first_seen", "last_seen", F.coalesce(F.col("s.service"), F.array().cast("array<string>")).alias("services"), "last.level", "last.message"
    )
    return out.orderBy(F.desc("n"), "key").limit(top) if top else out


def against_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """current (key, n, ...) with baseline_n, is_new, ratio (null if new) and tag."""
    out = current.join(baseline.select("key", F.col("n").alias("baseline_n")), "key", "left").fillna(0, ["baseline_n"])
    out = out.withColumn("is_new", F.col("baseline_n") == 0).withColumn("ratio", F.try_divide("n", "baseline_n"))
    tag = F.when(F.col("is_new"), "new").when(F.col("ratio") >= SPIKE, "spike").otherwise("steady")
    return out.withColumn("tag", tag)


def analyze_errors(logs: DataFrame, start: Column, stop: Column, level: str = "error", top: int = 25) -> DataFrame:
    """Signatures of [start, stop] against the equally long window before it; a row stamped exactly
    start counts in both windows. One pass over the rows of both windows."""
    length = stop - start
    rows = at_least(between(logs, start - length, stop), level)
    current = signatures(rows.filter(F.col("ts") >= start), top=top)
    earlier = rows.filter(F.col("ts") <= start)
    counts = earlier.groupBy(F.when(F.col("code").isNull() | (F.col("code") == ""), NO_CODE).otherwise(F.col("code")).alias("key")).agg(F.count("*").alias("n"))
    return against_baseline(current, counts)


def deltas(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Full outer comparison of (key, n): missing counts as zero; largest growth first."""
    b, c = baseline.select("key", F.col("n").alias("baseline_n")), current.select("key", F.col("n").alias("current_n"))
    out = b.join(c, "key", "outer").fillna(0, ["baseline_n", "current_n"])
    return out.withColumn("delta", F.col("current_n") - F.col("baseline_n")).orderBy(F.desc("delta"), "key")


def entities(logs: DataFrame, field: str, top: int = 20) -> DataFrame:
    """Distinct values of a context field, by count; capped tells that there are more than `top`."""
    counts = logs.filter(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("entity")).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "entity").limit(top + 1)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "entity"))
    return first.withColumn("r", place).withColumn("capped", F.max("r").over(Window.partitionBy()) > top).filter(F.col("r") <= top).drop("r")


#: Milliseconds by unit of a duration text.
UNITS = {"h": 3_600_000.0, "m": 60_000.0, "s": 1000.0, "ms": 1.0, "us": 0.001, "µs": 0.001, "ns": 0.000001}


def duration_ms(text: Column) -> Column:
    """`2m10s`, `~19ms`, `1.5s`, a bare number (milliseconds) -> double; anything else null."""
    t = F.regexp_replace(F.trim(text), r"^~\s*", "")
    unit = r"([0-9]+(?:\.[0-9]+)?)\s*(h|ms|us|µs|ns|m|s)"
    parts = F.regexp_extract_all(t, F.lit(unit), F.lit(0))

    def one(p: Column) -> Column:
        number = F.regexp_extract(p, r"[0-9.]+", 0).cast("double")
        name, out = F.regexp_extract(p, "[a-zµ]+$", 0), F.lit(0.0)
        for u, ms in UNITS.items():
            out = F.when(name == u, number * ms).otherwise(out)
        return out

    whole = t.rlike(rf"^(?:{unit}\s*)+$")
    return F.when(t.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), t.try_cast("double")).when(whole, F.aggregate(parts, F.lit(0.0), lambda a, p: a + one(p)))


def durations(rows: DataFrame, dimension: str, value: str) -> DataFrame:
    """Per dimension: avg, nearest-rank p95, n, min and max of a duration in milliseconds."""
    v = F.col(value).cast("double")
    p95 = F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY CAST(`{value}` AS double))")
    rows = rows.filter(v.isNotNull() & ~F.isnan(v))
    return rows.groupBy(F.col(dimension).alias("dimension")).agg(F.avg(v).alias("avg_ms"), p95.alias("p95_ms"), F.count("*").alias("n"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"))
