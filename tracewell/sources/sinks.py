"""Sinks: key upserts, deletes by file, flags, byte-stable JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with changes in place of rows of the same key; changes carry `seq`, the last one wins."""
    last = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    new = changes.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "seq")
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def without_files(nodes: DataFrame, edges: DataFrame, files: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes outside the files, and the edges that do not begin in them: those that come in from other files wait
    there until the files' nodes are written again."""
    gone = nodes.filter(F.col("file").isin(files)).select("id")
    edges = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti")
    return nodes.filter(~F.col("file").isin(files)), edges


def flagged(nodes: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """nodes with the flag set for the ids, and cleared for the others."""
    return nodes.drop(flag).join(ids.select("id").distinct().withColumn(flag, F.lit(True)), "id", "left").fillna(False, [flag])


def json_lines(rows: DataFrame, key: str) -> DataFrame:
    """One JSON text a row in key order, fields in name order: the same bytes for the same rows."""
    return rows.orderBy(key).select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def save_report(rows: DataFrame, path: str) -> None:
    """Writes rows by investigation (inv): those of the rows' investigations replace older ones, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("inv").parquet(path)


def replace_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
