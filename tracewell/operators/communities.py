"""Communities of a graph by modularity, level by level: nodes move to the neighbouring community that gains most, communities that
fell apart are split, each becomes a node of a smaller graph, and the same again; at the end the nodes of the first graph move once more.

Arcs (source, target, w) hold each link in both directions, a link of a node with itself once, with both of its ends counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Weights of links by type.
WEIGHTS = {"calls": 1.0, "extends": 0.5, "implements": 0.5}
#: Least gain of a level, turns of a level without one, turns and levels at most.
GAIN, PATIENCE, TURNS, LEVELS = 1e-4, 3, 12, 6


def arcs(edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Arcs of edges (source, target, rel); types without a weight, null ends and links of a node with itself are left out."""
    w = F.lit(None).cast("double")
    for rel, value in (WEIGHTS if weights is None else weights).items():
        w = F.when(F.col("rel") == rel, F.lit(float(value))).otherwise(w)
    e = edges.select("source", "target", w.alias("w")).filter("w IS NOT NULL AND source <> target")
    return e.union(e.select("target", "source", "w")).groupBy("source", "target").agg(F.sum("w").alias("w"))


def modularity(links: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of labels (id, community) over arcs; a node without a label is a community of its own,
    and a graph without arcs has none (null)."""
    name = lambda end: F.coalesce("community", F.concat(F.lit("\x00"), F.col(end)))
    a = links.join(labels.withColumnRenamed("id", "source"), "source", "left").select("source", "target", "w", name("source").alias("own"))
    b = a.join(labels.withColumnRenamed("id", "target"), "target", "left").select("own", name("target").alias("other"), "w")
    sums = b.groupBy("own").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("own") == F.col("other"), F.col("w")).otherwise(0.0)).alias("inner"))
    all_ = F.sum("total")
    return sums.agg((F.sum("inner") / all_ - F.sum(F.col("total") * F.col("total")) / (all_ * all_)).alias("modularity"))


def _moved(links: DataFrame, state: DataFrame, twice: float, inner: float, level: int) -> tuple[DataFrame, float]:
    """state (id, label, k) after its turns, and its modularity. In each turn a hash lets about half of the nodes move, so that
    neighbours seldom change places; the best state of all turns counts."""
    best, most, still = state, float("-inf"), 0
    for turn in range(TURNS):
        tot = state.groupBy(F.col("label").alias("to")).agg(F.sum("k").alias("tot"), F.count("*").alias("n"))
        own_tot = tot.select(F.col("to").alias("label"), F.col("tot").alias("own_tot"), F.col("n").alias("own_n"))
        there = state.select(F.col("id").alias("target"), F.col("label").alias("to"))
        votes = links.filter("source <> target").join(there, "target").groupBy(F.col("source").alias("id"), "to").agg(F.sum("w").alias("w"))
        pull = F.col("w") - F.col("k") * F.col("tot") / twice
        other = F.when(F.col("to") != F.col("label"), F.struct((-pull).alias("less"), "to", "n"))
        chosen = state.join(votes, "id").join(tot, "to").groupBy("id", "label", "k").agg(F.min(other).alias("best"), F.coalesce(F.max(F.when(F.col("to") == F.col("label"), F.col("w"))), F.lit(0.0)).alias("held"))
        chosen = chosen.join(own_tot, "label")
        gain = -F.col("best.less") - (F.col("held") - F.col("k") * (F.col("own_tot") - F.col("k")) / twice)
        swaps = (F.col("own_n") == 1) & (F.col("best.n") == 1) & (F.col("best.to") > F.col("label"))
        turns = F.crc32(F.concat_ws("|", F.col("id"), F.lit(f"{level}.{turn}"))) % 2 == 0
        goes = F.coalesce((gain > 1e-12) & ~swaps, F.lit(False))
        after = chosen.select("id", F.when(goes & turns, F.col("best.to")).otherwise(F.col("label")).alias("label"), "k", "held", goes.alias("goes"))
        alone = state.join(votes.select("id").distinct(), "id", "left_anti").select("id", "label", "k", F.lit(0.0).alias("held"), F.lit(False).alias("goes"))
        after = cut_lineage(after.unionByName(alone))
        held, willing = after.agg(F.sum("held"), F.count(F.when(F.col("goes"), 1))).first()
        squares = tot.agg(F.sum(F.col("tot") * F.col("tot"))).first()[0]
        now = ((held or 0.0) + inner) / twice - squares / twice**2
        still = 0 if now > most + GAIN else still + 1
        if now > most:
            best, most = state, now
        if not willing or still > PATIENCE:
            break
        state = after.select("id", "label", "k")
    return best, most


def _joined(links: DataFrame, state: DataFrame) -> DataFrame:
    """(id, label): the connected parts of each community, by their smallest node."""
    ends = state.select("id", "label")
    inner = links.join(ends.withColumnRenamed("id", "source"), "source").join(ends.select(F.col("id").alias("target"), F.col("label").alias("other")), "target")
    inner = cut_lineage(inner.filter("label = other").select("source", "target"))
    parts = cut_lineage(state.select("id", F.col("id").alias("part")))
    while True:
        near = inner.join(parts.withColumnRenamed("id", "target"), "target").groupBy(F.col("source").alias("id")).agg(F.min("part").alias("near"))
        step = parts.join(near, "id", "left").select("id", F.least("part", F.coalesce("near", "part")).alias("part"))
        jump = step.select(F.col("id").alias("part"), F.col("part").alias("root"))
        new = cut_lineage(step.join(jump, "part").select("id", F.least("part", "root").alias("part")))
        if new.join(parts.withColumnRenamed("part", "old"), "id").filter("part <> old").isEmpty():
            return new.withColumnRenamed("part", "label")
        parts = new


def best_communities(edges: DataFrame, weights: dict[str, float] | None = None, least: int = 2) -> DataFrame:
    """(id, community): communities of edges (source, target, rel) of high modularity, each named by its smallest node; those of
    fewer than `least` nodes are left out. The same edges give the same result, in whatever order and partitions.

    Each turn of moves is a few shuffled aggregations by node and by community; a hot node or community is pre-aggregated
    before its shuffle, and each turn is written to the shared folder. Graphs shrink from level to level."""
    first = cut_lineage(arcs(edges, weights))
    twice = first.agg(F.sum("w")).first()[0]
    if not twice:
        return first.select(F.col("source").alias("id"), F.col("source").alias("community"))
    links, names, most = first, None, float("-inf")
    degrees = lambda e: e.groupBy(F.col("source").alias("id")).agg(F.sum("w").alias("k"))
    for level in range(LEVELS):
        inner = links.filter("source = target").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        state = cut_lineage(degrees(links).select("id", F.col("id").alias("label"), "k"))
        state, now = _moved(links, state, twice, inner, level)
        parts = _joined(links, state)
        names = parts if names is None else cut_lineage(names.join(parts.select(F.col("id").alias("label"), F.col("label").alias("up")), "label").select("id", F.col("up").alias("label")))
        if now <= most + GAIN:
            break
        most = now
        ends = parts.select(F.col("id").alias("source"), F.col("label").alias("a"))
        links = links.join(ends, "source").join(parts.select(F.col("id").alias("target"), F.col("label").alias("b")), "target")
        links = cut_lineage(links.groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(F.sum("w").alias("w")))
    state = cut_lineage(degrees(first).join(names, "id").select("id", "label", "k"))
    state, _ = _moved(first, state, twice, 0.0, LEVELS)
    parts = _joined(first, state)
    big = parts.groupBy(F.col("label").alias("community")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return parts.withColumnRenamed("label", "community").join(big, "community", "left_semi").select("id", "community")
