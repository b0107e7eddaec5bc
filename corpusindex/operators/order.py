"""Places of rows in an order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusindex.sources.store import stored


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`rows` with `idx`, the place from 0 within their `group` by the columns `order`, and `n`, the group's size.

    Rows are dealt by range and numbered where they lie; only a count for each range and group is added up. Rows equal in all
    columns are told apart by where they were read. Nulls come first. The columns tie, at, slice, first and before are not
    for `rows` to have.
    """
    held = stored(rows).withColumn("tie", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.repartitionByRange(parts, group, *order, "tie").sortWithinPartitions(group, *order, "tie").drop("tie")
    placed = stored(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("slice", F.shiftright("at", 33)))
    slices = placed.groupBy(group, "slice").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    whole = Window.partitionBy(group)
    before = F.sum("rows").over(whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    slices = stored(slices.select(group, "slice", "first", before.alias("before"), F.sum("rows").over(whole).alias("n")))
    found = placed.join(slices, [group, "slice"]).withColumn("idx", F.col("before") + F.col("at") - F.col("first"))
    return found.drop("slice", "at", "first", "before")
