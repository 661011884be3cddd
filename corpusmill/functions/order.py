"""Global orders without a single-partition window over the rows.

Rows are dealt to partitions by ranges of the order, sampled by Spark, and written so. Only the partitions' totals, one
row each, pass through a window without partitions; within a range a partitioned window adds the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import written


def running_total(rows: DataFrame, block: Column, order: list[Column], amount: Column, name: str) -> DataFrame:
    """rows with `name`: the sum of amount over all rows before, in the order of (block, *order)."""
    keyed = rows.withColumns({"_first": block, "_amount": amount.cast("long")})
    ranged = written(keyed.repartitionByRange(F.col("_first"), *order).withColumn("_block", F.spark_partition_id()))
    sums = ranged.groupBy("_block").agg(F.sum("_amount").alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy("_first", *order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("_amount").over(inside), F.lit(0))
    # as many rows as there are shuffle partitions
    return ranged.join(F.broadcast(bases), "_block").withColumn(name, F.col("_base") + local).drop("_block", "_first", "_amount", "_base")


def global_rank(rows: DataFrame, block: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with `name`: the position from 0 in the order of (block, *order)."""
    return running_total(rows, block, order, F.lit(1), name)


def following(rows: DataFrame, block: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with `name`: the next row's value in the order of (block, *order); the first row follows the last.

    Neighbours on both sides of a range's end meet through the ranges' first rows, one for each partition.
    """
    keyed = rows.withColumns({"_first": block, "_value": value})
    ranged = written(keyed.repartitionByRange(F.col("_first"), *order).withColumn("_block", F.spark_partition_id()))
    heads = ranged.groupBy("_block").agg(F.min_by("_value", F.struct("_first", *order)).alias("_head"))
    ring = Window.orderBy("_block")
    entries = heads.select("_block", F.coalesce(F.lead("_head").over(ring), F.first("_head").over(ring)).alias("_entry"))
    inside = Window.partitionBy("_block").orderBy("_first", *order)
    ends = F.lead(F.lit(True)).over(inside).isNull()
    # as many rows as there are shuffle partitions
    joined = ranged.join(F.broadcast(entries), "_block")
    return joined.withColumn(name, F.when(ends, F.col("_entry")).otherwise(F.lead("_value").over(inside))).drop("_block", "_first", "_value", "_entry")


def hash32(*parts: Column) -> Column:
    """The first eight hexadecimal digits of the MD5 of the parts joined by a colon, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A fixed pseudo-random number above 0 and below 1."""
    return (hash32(*parts) + 0.5) / float(1 << 32)


def seeded_rank(rows: DataFrame, key: Column, seed: int, name: str = "rank") -> DataFrame:
    """rows with their position in a fixed shuffled order."""
    h = hash32(key, F.lit(seed))
    return global_rank(rows, h, [key], name)
