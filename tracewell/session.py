"""Session settings shared by the entry point, the benchmark and the tests."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with AQE on and UTC time; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tracewell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TRACEWELL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path stays a URI so any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share: the cluster's spark.checkpoint.dir, or what the context has. Where
    neither is set, a session in one process (tests) gets a temporary folder, and a cluster an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="tracewell-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the shared folder's own clean-up applies then
        pass


def new_folder(spark: SparkSession) -> str:
    """A name for a new folder under the shared one; what is written there goes when the driver process ends."""
    path = f"{shared_folder(spark)}/tracewell-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that loops keep short plans and lost executors cost no recomputation.

    Not checkpoint(): what that returns keeps the size that Spark had estimated for its plan, and in a loop of joins
    these estimates multiply until planning takes longer than the work. Files are removed when the driver process ends."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
