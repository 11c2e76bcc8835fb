"""Running totals per key that hold for a key with a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_total_before(df: DataFrame, key: str, seq: str, value: str, out: str, ranges: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over earlier rows (by ``seq``) of the key.

    ``seq`` is cut between its least and greatest value into ``ranges`` of equal width, by default as many as a shuffle has
    partitions; nothing is counted before the frame is used. Totals per (key, range) are summed before
    the shuffle and carried forward; one task sorts at most one range of a key, so a key's rows are spread as far as
    their numbers are. Null keys are a key of their own, and a null ``seq`` comes before all others.
    """
    spark = df.sparkSession
    ranges = max(1, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    low, high = (df.agg(f(seq).cast("double")).scalar() for f in (F.min, F.max))
    at = F.floor((F.col(seq).cast("double") - low) * ranges / F.greatest(high - low, F.lit(1.0)))
    placed = df.withColumn("_range", F.when(F.col(seq).isNull(), -1).otherwise(F.least(at, F.lit(ranges - 1))))
    totals = placed.groupBy(key, "_range").agg(F.sum(value).alias("_total"))
    earlier = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        F.col(key).alias("_key"), F.col("_range").alias("_in"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carried")
    )
    within = W.partitionBy(key, "_range").orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = local.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_in")))
    return joined.withColumn(out, (F.col("_carried") + F.col("_local")).cast("bigint")).drop(
        "_range", "_local", "_carried", "_key", "_in"
    )
