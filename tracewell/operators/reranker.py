"""Features of candidate causes for the reranker, over a vocabulary that the candidates make, and their logistic fit.

candidates has inv, id, final_score, confidence, base_score, ids and nodes (arrays) and explanations (array of factor, delta).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Features that every candidate has, in order; factors follow by name.
SCALARS = ["finalScore", "confidence", "baseScore", "evidenceCount", "affectedCount"]


def vocabulary(candidates: DataFrame) -> DataFrame:
    """(place, key): the scalar features, then `f:` and each factor in the order of their names. Factors name rules, so they are few."""
    factors = candidates.select(F.explode("explanations.factor").alias("factor")).filter("factor IS NOT NULL").distinct()
    known = F.transform(F.array_sort(F.collect_set("factor")), lambda f: F.concat(F.lit("f:"), f))
    return factors.agg(F.concat(F.array(*map(F.lit, SCALARS)), known).alias("keys")).select(F.posexplode("keys").alias("place", "key"))


def features(candidates: DataFrame) -> DataFrame:
    """(inv, id, places, values): each candidate's features that are not 0 by their place in vocabulary(); deltas of one factor add up.
    A null score or list counts as 0. Candidates with one inv and id are one if they are equal, else each is its own."""
    c, none = F.col, F.lit(0.0)
    number = lambda x: F.coalesce(x.cast("double"), none)
    size = lambda x: F.when(x.isNull(), 0).otherwise(F.size(x)).cast("double")
    scalars = [number(c("final_score")), number(c("confidence")), number(c("base_score")), size(c("ids")), size(c("nodes"))]
    pairs = F.concat(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in zip(SCALARS, scalars, strict=True)]),
        F.coalesce(F.transform(F.filter("explanations", lambda e: e["factor"].isNotNull()), lambda e: F.struct(F.concat(F.lit("f:"), e["factor"]).alias("key"), number(e["delta"]).alias("value"))), F.array().cast("array<struct<key: string, value: double>>")))
    rows = candidates.withColumn("row", F.xxhash64("final_score", "confidence", "base_score", "ids", "nodes", "explanations")).select("inv", "id", "row", F.inline(pairs))
    sums = rows.groupBy("inv", "id", "row", "key").agg(F.sum("value").alias("value"))
    placed = sums.join(vocabulary(candidates), "key").groupBy("inv", "id", "row")
    held = F.array_sort(F.collect_list(F.when(F.col("value") != 0, F.struct("place", "value"))))
    return placed.agg(held.alias("f")).select("inv", "id", F.transform("f", lambda x: x["place"]).alias("places"), F.transform("f", lambda x: x["value"]).alias("values"))


def _blocks(size: int):
    """Rows (places, values, target, weight) -> a task's rows as arrays: dense features, targets and weights."""

    def run(rows: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        x, y, n = [], [], []
        for places, values, target, weight in rows:
            v = np.zeros(size)
            v[places] = values
            x.append(v), y.append(float(target)), n.append(float(weight))
        if x:
            yield np.stack(x), np.array(y), np.array(n)

    return run


def fit(rows: DataFrame, size: int, target: str, epochs: int = 400, rate: float = 0.1, l2: float = 0.001, parts: int | None = None) -> tuple[list[float], float]:
    """Weights and bias of a logistic model over sparse rows (places, values, target), by full-batch gradient descent from zero.

    Equal rows are counted first. The rest stays on the executors as arrays; in each epoch they hand up sums of `size` numbers,
    merged in a tree, so the driver holds the weights only. An empty table gives zeros."""
    counted = cut_lineage(rows.groupBy("places", "values", F.col(target).alias("target")).agg(F.count("*").alias("weight")))
    dealt = counted if parts is None else counted.repartition(parts)
    blocks = dealt.rdd.mapPartitions(_blocks(size)).persist()
    total = blocks.map(lambda b: float(b[2].sum())).fold(0.0, lambda a, b: a + b)
    w, b = np.zeros(size), 0.0

    def add(sums: np.ndarray, block) -> np.ndarray:
        x, y, n = block
        err = (1 / (1 + np.exp(-(x @ w + b))) - y) * n
        return sums + np.r_[x.T @ err, err.sum()]

    for _ in range(epochs if total else 0):
        g = blocks.treeAggregate(np.zeros(size + 1), add, lambda p, q: p + q)
        w, b = w - rate * (g[:-1] / total + l2 * w), b - rate * g[-1] / total
    blocks.unpersist()
    return w.tolist(), float(b)


def scored(rows: DataFrame, weights: list[float], bias: float) -> DataFrame:
    """rows (places, values, ...) with score."""
    w = F.array(*[F.lit(x) for x in weights])
    z = F.aggregate(F.zip_with("places", "values", lambda p, v: F.get(w, p) * v), F.lit(bias), lambda a, x: a + x)
    return rows.withColumn("score", 1 / (1 + F.exp(-z)))
