"""Keyed tables in Spark's catalog, bucketed by key so that joins on the key need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def create_bucketed(spark: SparkSession, name: str, schema: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """An empty table of rows in ``buckets`` by a hash of ``keys``, unless there is one of this name."""
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def drop_table(spark: SparkSession, name: str) -> bool:
    """Drop a table with its rows; False if there was none."""
    found = table_exists(spark, name)
    spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")
    return found


def append_rows(rows: DataFrame, name: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Append rows, matched by column name. A task writes whole buckets, so a bucket gets one file from each call."""
    columns = rows.sparkSession.table(name).columns
    rows.select(columns).repartition(buckets, *keys).write.insertInto(name)


def stored_by(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The rows as a new table in as many buckets by ``keys`` as a shuffle has partitions, so rows that a shuffle by ``keys`` has dealt are written
    where they are. Windows, groups and joins by ``keys`` over the table need no exchange."""
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").bucketBy(buckets, *keys).saveAsTable(name)
    return rows.sparkSession.table(name)


def read_rows(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
