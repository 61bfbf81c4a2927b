"""Helpers of the training-data operators: reading, materialising, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset the
    context's checkpoint folder. Where that is unset too, a session in one process (tests) gets a
    temporary folder, and a cluster an error: its machines do not share one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isEmpty():
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
            set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = set_dir.get()
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the shared folder's own clean-up applies then
        pass


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The files go at release(), or when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame) -> None:
    """Remove the files of a materialised df that nothing reads any more."""
    _remove(df.sparkSession, df._written)


def _low(e: DataFrame, own: bool = False) -> DataFrame:
    """(u, m): the smallest neighbour of each node (or itself). The key is an expression, so a join deals
    both sides anew instead of keeping the aggregate's order, and AQE may split a hot node's links."""
    m = F.least("u", F.min("v")) if own else F.min("v")
    return e.groupBy("u").agg(m.alias("m")).select((F.col("u") + F.lit(0)).alias("u"), "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (id, component): the smallest id reachable, for each id that has a link.

    Alternating large-star and small-star rounds: every node hands its larger (then its smaller)
    neighbours to its smallest neighbour until nothing moves; rounds grow with the logarithm of the
    number of nodes. Minima are pre-aggregated, joins are ordinary shuffled joins whose hot keys AQE
    may split, and each round is written to the shared folder in place of the one before it.
    Self-links and repeated links are
    allowed, null ends are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = materialise(e.filter("u is not null and v is not null and u <> v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _low(both, own=True)
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = e
        e = large.filter("u <> v").distinct()
        low = _low(e)
        small = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        release(kept)
        if now == before:
            break
        before = now
    low = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return low.select(F.col("u").alias("id"), "component").union(roots)


def among_lowest(h: Column, n: Column, most: int) -> Column:
    """Whether a 64-bit hash can be one of the `most` lowest of n distinct ones: some four times as many pass, so what
    is then sorted in one task does not grow with n. That fewer than `most` pass has no measurable probability."""
    return (h / F.lit(2.0**64) + 0.5) * n <= 4 * most + 100


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
