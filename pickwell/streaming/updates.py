"""Streams of single factor changes: ``(seq, tbl, option, id, feature)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pickwell.functions.frames import union_all
from pickwell.model import FactorModel
from pickwell.operators.factors import as_factors
from pickwell.sources.files import exists
from pickwell.sources.tables import read_table, upsert

# Fixed values of the event fields.
USER, ITEM = "User", "Item"
UPDATE, REMOVE = "Update", "Remove"

SIDES = {USER: "users", ITEM: "items"}


def first_rank(updates: DataFrame) -> int | None:
    """Vector length of the first Update of a known table, which fixes an empty model's rank."""
    row = updates.where(F.col("tbl").isin(USER, ITEM) & (F.col("option") == UPDATE)).agg(F.min_by(F.size("feature"), "seq").alias("rank")).first()
    return row.rank


def accepted_updates(updates: DataFrame, rank: int) -> DataFrame:
    """Known tables and options only, Updates only with ``rank`` elements."""
    sided = F.col("tbl").isin(USER, ITEM)
    fits = (F.col("option") == REMOVE) | ((F.col("option") == UPDATE) & (F.size("feature") == rank))
    return updates.where(sided & fits)


def last_updates(updates: DataFrame, rank: int) -> DataFrame:
    """The change that counts for each (tbl, id): ``(tbl, id, seq, features, deleted)``.

    A maximum per key, taken in part before the shuffle, so an id that gets
    a third of all changes is no hot group.
    """
    newest = accepted_updates(updates, rank).groupBy("tbl", "id").agg(
        F.max_by(F.struct("option", "feature"), "seq").alias("e"), F.max("seq").alias("seq")
    )
    removed = F.col("e.option") == REMOVE
    features = F.when(~removed, F.col("e.feature").cast("array<double>"))
    return newest.select("tbl", "id", "seq", features.alias("features"), removed.alias("deleted"))


def apply_factor_updates(model: FactorModel | None, updates: DataFrame) -> FactorModel | None:
    """The model after all changes, in order of ``seq``.

    Without a model the first Update fixes the rank; if there is none, there
    is still no model.
    """
    rank = model.rank if model is not None else first_rank(updates)
    if rank is None:
        return model
    last = last_updates(updates, rank)
    sides = []
    for tbl, side in SIDES.items():
        mine = last.where(F.col("tbl") == tbl)
        put = mine.where(~F.col("deleted")).select("id", "features")
        if model is not None:
            kept = as_factors(getattr(model, side)).join(mine.select("id"), "id", "left_anti")
            put = union_all(kept, put)
        sides.append(put)
    return FactorModel(rank, *sides)


def stream_rank(batch: DataFrame, number: int, record: str) -> int | None:
    """The rank that the first Update of a stream fixes, None while there was none.

    The batch that brings it writes it to ``record`` before anything else, so the batch repeated, and every later one, reads the same.
    """
    spark = batch.sparkSession
    if exists(spark, f"{record}/_SUCCESS"):
        return spark.read.schema("batch bigint, rank int").json(record).first().rank
    rank = first_rank(batch)
    if rank is not None:
        spark.createDataFrame([(number, rank)], "batch bigint, rank int").write.mode("overwrite").json(record)
    return rank


def run_factor_updates(
    updates: DataFrame, users_path: str, items_path: str, checkpoint: str, rank: int | None = None, **trigger
) -> StreamingQuery:
    """Keep two keyed factor tables up to date from a stream of changes.

    Tables keep the ``seq`` of each id's last change, removals too; read with ``order='seq'``
    (:func:`updated_model`) they hold what the changes leave in order of ``seq``, in whatever order they
    arrived. Without ``rank`` the model is empty and the first Update fixes it.
    """
    paths = {USER: users_path, ITEM: items_path}

    def handle(batch: DataFrame, number: int) -> None:
        fixed = stream_rank(batch, number, f"{checkpoint}/rank") if rank is None else rank
        last = last_updates(batch, fixed).persist() if fixed is not None else None
        for tbl, path in paths.items() if last is not None else ():
            mine = last.where(F.col("tbl") == tbl).select("id", "seq", "features", "deleted")
            upsert(mine, path, ["id"], order="seq", writer=f"{checkpoint}#{number}", deleted="deleted")
        if last is not None:
            last.unpersist()

    writer = updates.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def updated_model(spark: SparkSession, users_path: str, items_path: str, checkpoint: str, rank: int | None = None) -> FactorModel | None:
    """The model that :func:`run_factor_updates` keeps; None before the first Update."""
    if rank is None:
        record = f"{checkpoint}/rank"
        if not exists(spark, f"{record}/_SUCCESS"):
            return None
        rank = spark.read.schema("batch bigint, rank int").json(record).first().rank
    return FactorModel(rank, *(read_table(spark, p, ["id"], order="seq").drop("seq") for p in (users_path, items_path)))
