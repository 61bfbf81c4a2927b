"""Running sums over a whole table without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def running_sum(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """rows with `name`, the sum of value over all rows up to each in `order` (unique; nulls first).

    Ranges of the order are dealt to partitions, which sum their own rows; each gets what those before it hold as an
    offset. Only those totals, one row a partition, meet in one task."""
    mark = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in rows.columns))
    part, own, before = f"{mark}part", f"{mark}value", f"{mark}before"
    dealt = rows.withColumn(own, value).repartitionByRange(order).withColumn(part, F.spark_partition_id())
    dealt = cut_lineage(dealt)  # the ranges are drawn from a sample: written once, so that both passes see the same
    totals = dealt.groupBy(part).agg(F.sum(own).alias(before))
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, F.coalesce(F.sum(before).over(upto), F.lit(0)).alias(before))
    inside = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), part).withColumn(name, F.coalesce(F.sum(own).over(inside), F.lit(0)) + F.col(before))
    return out.drop(part, own, before)
