"""Numbers for rows in order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlink.plans.stages import materialize


def ranked(df: DataFrame, group: str, order: list[str | Column], label: str) -> DataFrame:
    """``df`` with ``idx``, the place of each row (from 0) within its ``group`` by ``order``, and ``total``, the
    rows of the group; written once.

    Rows are dealt by ranges of (group, order), so a group of any size spreads over tasks, as do rows that are equal
    throughout; a table with one row for each task and group has the offsets.  ``group`` must not be null.
    """
    dealt = df.withColumn("_row", F.monotonically_increasing_id())
    keys = [group, *order, "_row"]
    # the id after the sort holds the partition above bit 33 and the place in it below; it is read from the written table
    placed = materialize(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("total")), f"{label}-runs")
    return placed.join(runs, [group, "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
