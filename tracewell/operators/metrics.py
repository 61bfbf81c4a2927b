"""Metric series in long form (series key, t, v): summaries, window comparison, spikes, populations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPIKE, DROP = 1.5, 0.67
INF = float("inf")


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < INF)


def label_key(labels: Column) -> Column:
    """A join key of a label map that does not depend on the labels' order."""
    return F.to_json(F.array_sort(F.map_entries(labels)))


def summary(series: DataFrame, key: str = "series") -> DataFrame:
    """min, max, avg, the last value by t, and n of values that are not NaN; all zero for a series without any."""
    v = F.when(~F.isnan("v"), F.col("v"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return series.groupBy(key).agg(
        zero(F.min(v)).alias("min_v"), zero(F.max(v)).alias("max_v"), zero(F.avg(v)).alias("avg_v"),
        zero(F.max_by(v, F.when(v.isNotNull(), F.col("t")))).alias("last_v"), F.count(v).alias("n"),
    )


def compare(baseline: DataFrame, current: DataFrame, key: str = "series", spike: float = SPIKE) -> DataFrame:
    """current against baseline averages: delta, ratio (infinite without a baseline), is_spike."""
    b = summary(baseline, key).select(key, F.col("avg_v").alias("baseline_avg"))
    out = summary(current, key).select(key, F.col("avg_v").alias("current_avg")).join(b, key, "left").fillna(0.0, ["baseline_avg"])
    out = out.withColumn("delta", F.col("current_avg") - F.col("baseline_avg"))
    none = F.when(F.col("current_avg") > 0, F.lit(INF)).otherwise(0.0)
    out = out.withColumn("ratio", F.when(F.col("baseline_avg") == 0, none).otherwise(F.try_divide("current_avg", "baseline_avg")))
    return out.withColumn("is_spike", F.col("ratio") >= spike)


def spikes(series: DataFrame, key: str = "series", k: float = 3.0) -> DataFrame:
    """Points whose leave-one-out z-score is over k; constant and one-point series have none.

    Sums per series are joined back, so a series of any length is spread over tasks."""
    rows = series.filter(finite(F.col("v")))
    stats = rows.groupBy(key).agg(F.sum("v").alias("s"), F.count("*").alias("n"), F.avg("v").alias("mean_v"), F.stddev_pop("v").alias("std_v")).filter("n >= 2 AND std_v > 0")
    z = (F.col("v") - (F.col("s") - F.col("v")) / (F.col("n") - 1)) / F.col("std_v")
    return rows.join(stats, key).withColumn("z", z).filter(F.col("z") > k).select(key, "t", "v", "mean_v", "std_v", "z")


def quartiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Linear quartiles of finite values per key."""
    at = lambda p: F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY `{value}`)")
    return rows.filter(finite(F.col(value))).groupBy(key).agg(
        F.min(value).alias("min_v"), at(0.25).alias("q1"), at(0.5).alias("median_v"), at(0.75).alias("q3"), F.max(value).alias("max_v"), F.count("*").alias("n")
    )


def histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins with empty ones, the maximum in the last; one bin if all values are equal."""
    v = rows.filter(finite(F.col(value))).select(F.col(value).cast("double").alias("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo IS NOT NULL")
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1)))
    counts = v.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # ends is one row
    frame = ends.select("lo", "hi", F.explode(F.when(F.col("hi") == F.col("lo"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))).alias("bin"))
    out = frame.join(counts, "bin", "left").fillna(0, ["n"])
    top = F.when(F.col("hi") == F.col("lo"), F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width)
    return out.select("bin", (F.col("lo") + F.col("bin") * width).alias("lo"), top.alias("hi"), "n")


def bimodal(ratios: DataFrame, spike: float = SPIKE, drop: float = DROP) -> DataFrame:
    """One row: whether spiking series and a low or empty counter-population stand side by side."""
    r = F.col("ratio")
    ok = r.isNotNull() & ~F.isnan(r) & (r < INF)
    high, low = ok & (r >= spike), ok & (r > 0) & (r <= drop)
    degenerate = ~ok | (r == 0)
    c = lambda x: F.count(F.when(x, 1))
    out = ratios.agg(F.count("*").alias("total"), c(high).alias("high_n"), c(low).alias("low_n"), c(degenerate).alias("degenerate_n"), F.median(F.when(high, r)).alias("high_ratio"), F.median(F.when(low, r)).alias("low_ratio"))
    counter = F.col("low_n") + F.col("degenerate_n")
    out = out.withColumn("high_share", F.coalesce(F.try_divide("high_n", "total"), F.lit(0.0))).withColumn("low_share", F.coalesce(F.try_divide(counter, F.col("total")), F.lit(0.0)))
    close = (F.col("low_n") > 0) & (F.try_divide("high_ratio", "low_ratio") < 2.0)
    yes = (F.col("total") >= 3) & (F.col("high_n") >= 1) & (counter >= 2) & (F.col("low_share") >= 0.2) & ((F.col("high_n") >= 2) | (F.col("high_share") >= 0.2))
    return out.withColumn("bimodal", yes & ~F.coalesce(close, F.lit(False)))


def anomaly(kind: Column, spike: float = SPIKE, drop: float = DROP) -> Column:
    """The kind of change that compare()'s columns show for a metric kind (latency, queue, throughput, error-rate, ...)."""
    b, c, r, d = (F.col(x) for x in ("baseline_avg", "current_avg", "ratio", "delta"))
    floor = F.when(kind == "queue", 1.0).when(kind == "latency", 0.05).when(kind == "error-rate", 0.005).otherwise(0.0)
    down = (r > 0) & (r <= drop)
    return (
        F.when((b <= 1e-9) & (c > 0) & (c < floor), "none")
        .when((kind == "latency") & (r >= spike), "latency-spike")
        .when((kind == "queue") & ((r >= spike) | (c > b)) & (d > 0), "queue-growth")
        .when((kind == "throughput") & down, "throughput-drop")
        .when((kind == "error-rate") & (r >= spike), "error-rate-change")
        .when((r >= spike) | down, "change")
        .otherwise("none")
    )


#: Words of a panel's title or queries, and units, by metric kind; the first kind wins.
PANELS = [
    ("queue", "queue|bullmq|backlog|depth|jobs", None),
    ("error-rate", "error|5xx|fail", None),
    ("latency", r"latency|duration|p9\d|histogram_quantile", "s"),
    ("throughput", r"rate\(|throughput|requests_total|operations_total|reqps", "reqps"),
    ("saturation", "cpu|memory|disk|saturation", "percent"),
]


def panel_kind(title: Column, unit: Column, exprs: Column) -> Column:
    """The metric kind of a panel with an array of queries."""
    queries = F.lower(F.array_join(exprs, " "))
    hay, out = F.concat_ws(" ", F.lower(title), queries), F.lit("other")
    for kind, words, its_unit in reversed(PANELS):
        test = hay.rlike(words)
        if kind == "error-rate":
            test = test | F.contains(queries, F.lit('status_code=~"5'))
        out = F.when(test | (unit == its_unit) if its_unit else test, kind).otherwise(out)
    return out


_TARGETS = "ARRAY<STRUCT<expr: STRING>>"
_PANEL = "STRUCT<id: STRING, type: STRING, title: STRING, datasource: STRING, fieldConfig: STRUCT<defaults: STRUCT<unit: STRING>>, targets: " + _TARGETS + ", panels: STRING>"


def panels(dashboards: DataFrame, depth: int = 8) -> DataFrame:
    """(uid, id, title, type, unit, datasource, exprs, kind) of the leaf panels of dashboards (uid, json).

    Rows hold panels, at most `depth` levels of them; a row itself is no panel. Queries that are empty are left out."""
    level = dashboards.select("uid", F.get_json_object("json", "$.panels").alias("nested"))
    leaves = []
    for _ in range(depth):
        rows = level.select("uid", F.explode(F.from_json("nested", f"ARRAY<{_PANEL}>")).alias("p"))
        leaves.append(rows.filter("coalesce(p.type, '') <> 'row'").select("uid", "p"))
        level = rows.filter("p.type = 'row' AND p.panels IS NOT NULL").select("uid", F.col("p.panels").alias("nested"))
    found = leaves[0]
    for part in leaves[1:]:
        found = found.union(part)
    source = F.when(F.col("p.datasource").startswith("{"), F.get_json_object("p.datasource", "$.uid")).otherwise(F.col("p.datasource"))
    exprs = F.filter(F.transform(F.coalesce("p.targets", F.array().cast(_TARGETS)), lambda t: t["expr"]), lambda e: e.isNotNull() & (e != ""))
    rows = found.select(
        "uid", F.coalesce(F.col("p.id").try_cast("long"), F.lit(0)).alias("id"), F.coalesce("p.title", F.lit("")).alias("title"), F.coalesce("p.type", F.lit("")).alias("type"),
        F.coalesce("p.fieldConfig.defaults.unit", F.lit("none")).alias("unit"), F.coalesce(source, F.lit("")).alias("datasource"), exprs.alias("exprs"),
    )
    return rows.withColumn("kind", panel_kind(F.col("title"), F.col("unit"), F.col("exprs")))


def query_text(expr: Column) -> Column:
    """A panel's query with interval macros filled in; null if another variable is left."""
    filled = F.replace(F.replace(expr, F.lit("$__rate_interval"), F.lit("5m")), F.lit("$__interval"), F.lit("5m"))
    return F.when(~F.contains(filled, F.lit("$")), filled)


def hint_tokens(hint: str) -> list[str]:
    """Words of at least three characters of a hint, camelCase and acronyms taken apart."""
    spaced = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z])([A-Z])", r"\1 \2", hint))
    return [t for t in re.split("[^a-z0-9]+", spaced.lower()) if len(t) >= 3]


def match_source(title: Column, exprs: Column, labels: Column, hint: str) -> Column:
    """Where a hint meets a panel: panel-title, query-text or series-labels (an array of label values); null where it does not."""
    words = hint_tokens(hint)
    if not words:
        return F.lit(None).cast("string")
    some = lambda hay: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(hay, w))
    by_query = F.exists(exprs, lambda e: some(F.lower(e)))
    return F.when(some(F.lower(title)), "panel-title").when(by_query, "query-text").when(some(F.lower(F.array_join(labels, " "))), "series-labels")


def bucketed(rows: DataFrame, key: str, ts: str, seconds: int, value: Column) -> DataFrame:
    """(series, t, v): value per key and time bucket of the given width."""
    t = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)) * seconds
    return rows.groupBy(F.col(key).alias("series"), t.alias("t")).agg(value.cast("double").alias("v"))
