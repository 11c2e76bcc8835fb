"""Model versions on storage and the registry that announces them."""

from __future__ import annotations

from datetime import datetime
from time import time_ns
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwell.model import FactorModel
from pickwell.operators.factors import as_factors
from pickwell.sources.files import children, exists, remove

class Saved(Protocol):
    """A model of the caller's own that writes itself to a folder."""

    def save(self, path: str) -> None: ...


VERSIONS = "path string, published_at timestamp"


def save_model(model: FactorModel, root: str, at: datetime) -> str:
    """Write the two factor tables under ``root/yyyyMMdd/HH-mm-ss_Model``.

    The rank is written last; a folder without it is an unfinished save.
    """
    path = f"{root}/{at:%Y%m%d}/{at:%H-%M-%S}_Model"
    as_factors(model.users).write.mode("overwrite").parquet(f"{path}/users")
    as_factors(model.items).write.mode("overwrite").parquet(f"{path}/items")
    spark = model.users.sparkSession
    spark.range(1).select(F.lit(model.rank).alias("rank")).write.mode("overwrite").json(f"{path}/rank")
    return path


def load_model(spark: SparkSession, path: str) -> FactorModel:
    rank = spark.read.schema("rank int").json(f"{path}/rank").first().rank
    return FactorModel(rank, spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items"))


def load_or_keep(spark: SparkSession, path: str | None, current: FactorModel | None) -> FactorModel | None:
    """The model at ``path``, or ``current`` when it cannot be read."""
    if path is None or not exists(spark, f"{path}/rank/_SUCCESS"):
        return current
    return load_model(spark, path)


def latest_model(spark: SparkSession, root: str) -> str | None:
    """Path of the newest complete model: last day, last save; None without one."""
    for day in reversed(children(spark, root)):
        for save in reversed(children(spark, day.path)):
            if exists(spark, f"{save.path}/rank/_SUCCESS"):
                return save.path
    return None


def save_version(model: FactorModel | Saved, spark: SparkSession, root: str, number: int) -> str:
    """Write a model as version ``number`` under ``root``; a version written again comes after what it repeats.

    The mark that it is complete is written last, so a save that broke off is not found.
    """
    path = f"{root}/version-{number:012d}-{time_ns():020d}"
    if isinstance(model, FactorModel):
        as_factors(model.users).write.parquet(f"{path}/model/users")
        as_factors(model.items).write.parquet(f"{path}/model/items")
        spark.range(1).select(F.lit(model.rank).alias("rank")).write.json(f"{path}/model/rank")
    else:
        model.save(f"{path}/model")
    spark.range(1).select(F.lit(number).alias("number")).write.json(f"{path}/complete")
    return path


def newest_saved(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest complete version, None without one."""
    for entry in reversed(children(spark, root)):
        if entry.name.startswith("version-") and exists(spark, f"{entry.path}/complete/_SUCCESS"):
            return entry.path
    return None


def drop_versions(spark: SparkSession, root: str, keep: int) -> None:
    """Remove all but the newest ``keep`` versions and what broke off before them."""
    for entry in [e for e in children(spark, root) if e.name.startswith("version-")][:-keep]:
        remove(spark, entry.path)


def publish_model(spark: SparkSession, registry: str, path: str, at: datetime) -> None:
    """Append a version event."""
    row = spark.createDataFrame([(path, at)], VERSIONS)
    row.coalesce(1).write.mode("append").parquet(registry)


def model_versions(spark: SparkSession, registry: str, *, stream: bool = False) -> DataFrame:
    """Version events, as a table or as a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(VERSIONS).parquet(registry)


def newest_version(versions: DataFrame) -> DataFrame:
    """One row: the path published last."""
    newest = versions.agg(F.max_by("path", F.struct("published_at", "path")).alias("path"))
    return newest.where(F.col("path").isNotNull())
