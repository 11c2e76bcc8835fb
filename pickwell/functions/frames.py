"""Whole-frame helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pickwell.session import use_checkpoints


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, matched by column name.

    Spark 4.1 may take a union of equally partitioned inputs for partitioned
    by that key even where a reused exchange has placed their rows
    differently, and a grouping or join on the key then splits its groups.
    The setting turns that shortcut off; such a grouping shuffles instead.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionByName, frames)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(rows: DataFrame, path: str) -> None:
    """Write a Parquet folder and leave no shuffle of it behind.

    Else shuffles stay on disk until the driver collects its garbage, which says nothing of how full the disks are.
    """
    conf = rows.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def numbered(rows: DataFrame, order: str | Sequence[str | Column], out: str) -> DataFrame:
    """Adds ``out``: 1, 2, ... in the order of ``order`` (one or more columns), without one task that sees all rows.

    Rows are dealt by ranges and kept (the numbers depend on the ranges); rows of earlier ranges are counted.
    """
    use_checkpoints(rows.sparkSession)
    order = [order] if isinstance(order, str) else list(order)
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range: as few as a shuffle has partitions.
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    placed = dealt.withColumn("_place", place).join(F.broadcast(shift), "_part")
    return placed.withColumn(out, F.col("_shift") + F.col("_place")).drop("_part", "_place", "_shift")
