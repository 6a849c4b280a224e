"""Exact order statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def medians(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, name, n): the exact median of `value` in each group, and how many values aren't null.

    Values are put in order over the cluster by key and value, so a group may lie in many
    tasks; counts of groups by task say where its middle is, and only the rows there are
    read again.  No task holds a group.  Groups without values are left out.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value"), F.monotonically_increasing_id().alias("_tie"))
    # the last key lets equal values be dealt to several tasks
    ordered = known.repartitionByRange(*keys, "_value", "_tie").sortWithinPartitions(*keys, "_value")
    placed = written(ordered.select(*keys, "_value", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_at")), "ordered")
    group = Window.partitionBy(*keys)
    before = group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*keys, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    parts = parts.select(*keys, "_n", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(group).alias("n"))
    middle = F.explode(F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))))
    wanted = parts.withColumn("_k", middle).where((F.col("_k") >= F.col("_base")) & (F.col("_k") < F.col("_base") + F.col("_n")))
    found = wanted.select(*keys, "n", (F.col("_first") + F.col("_k") - F.col("_base")).alias("_at")).join(placed.select("_at", "_value"), "_at")
    return found.groupBy(*keys, "n").agg(F.avg("_value").alias(name)).select(*keys, name, "n")
