"""Outcomes and learning: current verdicts, accuracy, factor separation, a small logistic reranker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import reranker


def current_verdicts(labels: DataFrame) -> DataFrame:
    """The latest row (at, id) of each investigation; rows without one stand alone."""
    key = F.coalesce(F.col("investigation").cast("string"), F.concat(F.lit("row:"), F.col("id").cast("string")))
    last = Window.partitionBy(key).orderBy(F.desc("at"), F.desc("id"))
    return labels.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def accuracy(labels: DataFrame, *by: str) -> DataFrame:
    """evaluated, yes, partly, no, accuracy and weighted (partly counts half) of current verdicts."""
    n = lambda v: F.count(F.when(F.col("resolved") == v, 1))
    out = current_verdicts(labels).groupBy(*by).agg(F.count("*").alias("evaluated"), n("yes").alias("yes"), n("partly").alias("partly"), n("no").alias("no"))
    rate = lambda x: F.coalesce(F.try_divide(x, F.col("evaluated").cast("double")), F.lit(0.0))
    return out.withColumn("accuracy", rate(F.col("yes"))).withColumn("weighted", rate(F.col("yes") + 0.5 * F.col("partly")))


def separation(rows: DataFrame, factors: list[str]) -> DataFrame:
    """Per factor: means and population variances of yes and no rows, separation, effect size, CV; a
    factor that a row lacks counts as zero."""
    long = rows.filter(F.col("target").isin("yes", "no")).select("target", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("v")) for f in factors])).alias("x")).select("target", "x.factor", "x.v")
    yes, no, v = F.col("target") == "yes", F.col("target") == "no", F.col("v")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = long.groupBy("factor").agg(
        zero(F.avg(F.when(yes, v))).alias("mean_yes"), zero(F.avg(F.when(no, v))).alias("mean_no"), zero(F.var_pop(F.when(yes, v))).alias("var_yes"), zero(F.var_pop(F.when(no, v))).alias("var_no"),
        F.stddev_pop(v).alias("_std"), F.avg(v).alias("_mean"),
    )
    out = out.withColumn("separation", F.col("mean_yes") - F.col("mean_no"))
    out = out.withColumn("effect_size", zero(F.try_divide("separation", "_std"))).withColumn("cv", zero(F.try_divide(F.col("_std"), F.abs("_mean"))))
    return out.drop("_std", "_mean")


def standardised(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features less their mean over their population deviation (0 counts as 1)."""
    stats = rows.agg(*[x for f in features for x in (F.avg(f).alias(f"_m_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))])
    scaled = [((F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") == 0, 1.0).otherwise(F.col(f"_s_{f}"))).alias(f) for f in features]
    rest = [c for c in rows.columns if c not in features]
    return rows.crossJoin(F.broadcast(stats)).select(*rest, *scaled)  # stats is one row


def fit_logistic(rows: DataFrame, features: list[str], target: str, epochs: int = 400, rate: float = 0.1, l2: float = 0.001) -> tuple[list[float], float]:
    """Weights and bias by full-batch gradient descent from zero, summed up by the executors in each epoch (see reranker.fit)."""
    places = F.array(*[F.lit(i) for i in range(len(features))])
    values = F.array(*[F.col(f).cast("double") for f in features])
    return reranker.fit(rows.select(places.alias("places"), values.alias("values"), F.col(target).alias("_y")), len(features), "_y", epochs, rate, l2)


def logistic_score(weights: list[float], bias: float, features: list[str]) -> Column:
    z = F.lit(bias) + sum((F.lit(w) * F.col(f) for w, f in zip(weights, features, strict=True)), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def top1_hit_rate(rows: DataFrame, group: str, score: str, target: str, tie: str) -> DataFrame:
    """One row: groups and the share of them whose best row by score (then tie) has target 1."""
    best = rows.groupBy(group).agg(F.max_by(target, F.struct(F.col(score), -F.col(tie))).alias("hit"))
    return best.agg(F.count("*").alias("groups"), F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"))
