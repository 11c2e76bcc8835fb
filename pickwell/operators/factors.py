"""Factor tables: lookups, guards, fallback, pruning and merging.

Lookups are plain equi-joins on ``id``. The factor side holds one row per id,
so a hot id on the other side is a skew that adaptive execution splits; small
id sets become broadcasts at run time, by measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwell.functions.columns import blend
from pickwell.functions.frames import union_all
from pickwell.model import FactorModel

def as_factors(df: DataFrame) -> DataFrame:
    """Any ``(id, features)`` frame in the standard types, null rows dropped."""
    typed = df.select(F.col("id").cast("int").alias("id"), F.col("features").cast("array<double>").alias("features"))
    return drop_null(typed)


def drop_null(df: DataFrame) -> DataFrame:
    """Rows with no null in any column."""
    return df.dropna("any")


def as_speed_model(model: FactorModel) -> FactorModel:
    """The model with double features; nothing is collected."""
    return FactorModel(model.rank, as_factors(model.users), as_factors(model.items))


def user_ids(model: FactorModel) -> DataFrame:
    return drop_null(model.users.select("id"))


def item_ids(model: FactorModel) -> DataFrame:
    return drop_null(model.items.select("id"))


def has_ids(factors: DataFrame, ids: DataFrame) -> DataFrame:
    """Each ``id`` with a ``known`` flag."""
    marked = factors.select("id", F.lit(True).alias("hit"))
    return ids.join(marked, "id", "left").select("id", F.col("hit").isNotNull().alias("known"))


def has_users(model: FactorModel, ids: DataFrame) -> DataFrame:
    return has_ids(model.users, ids)


def has_items(model: FactorModel, ids: DataFrame) -> DataFrame:
    return has_ids(model.items, ids)


def lookup(factors: DataFrame, ids: DataFrame) -> DataFrame:
    """Each ``id`` with its features, an empty array when unknown."""
    none = F.array().cast("array<double>")
    return ids.join(factors, "id", "left").select("id", F.coalesce("features", none).alias("features"))


def user_factors(model: FactorModel, ids: DataFrame) -> DataFrame:
    return lookup(model.users, ids)


def item_factors(model: FactorModel, ids: DataFrame) -> DataFrame:
    return lookup(model.items, ids)


def model_summary(models: dict[str, FactorModel]) -> DataFrame:
    """Rows ``(model, side, n)``."""
    return union_all(*[
        getattr(model, side).agg(F.count("id").alias("n")).select(F.lit(name).alias("model"), F.lit(side).alias("side"), "n")
        for name, model in models.items()
        for side in ("users", "items")
    ])


def check_rank(a: FactorModel, b: FactorModel) -> None:
    if a.rank != b.rank:
        raise ValueError(f"models of rank {a.rank} and {b.rank} cannot be combined")


def valid_features(df: DataFrame, rank: int) -> DataFrame:
    """Adds ``valid``: the vector has exactly ``rank`` elements."""
    return df.withColumn("valid", F.coalesce(F.size("features") == rank, F.lit(False)))


def resolve_factors(ids: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Features from ``first`` if the id is there, else from ``second``.

    ``ids`` may repeat and may contain unknown ids; the result has one row per
    known distinct id.
    """
    one = first.select("id", F.col("features").alias("one"))
    two = second.select("id", F.col("features").alias("two"))
    found = ids.select("id").distinct().join(one, "id", "left").join(two, "id", "left")
    return drop_null(found.select("id", F.coalesce("one", "two").alias("features")))


def prune_speed(speed: FactorModel, batch: FactorModel) -> FactorModel:
    """Speed rows whose id the newly installed batch model does not cover."""
    return FactorModel(
        speed.rank,
        speed.users.join(batch.users.select("id"), "id", "left_anti"),
        speed.items.join(batch.items.select("id"), "id", "left_anti"),
    )


def merge_factors(old: DataFrame, new: DataFrame, weight: float) -> DataFrame:
    """Full outer blend; ``is_new`` marks ids only the new side has."""
    pairs = old.select("id", F.col("features").alias("was")).join(
        new.select("id", F.col("features").alias("now")), "id", "full_outer"
    )
    both = F.col("was").isNotNull() & F.col("now").isNotNull()
    merged = F.when(both, blend(F.col("now"), F.col("was"), weight)).otherwise(F.coalesce("now", "was"))
    return pairs.select("id", merged.alias("features"), F.col("was").isNull().alias("is_new"))


def merge_models(old: FactorModel, new: FactorModel, weight: float = 0.5) -> FactorModel:
    """Blend ``new`` into ``old``; both sides carry ``is_new``."""
    check_rank(old, new)
    return FactorModel(
        old.rank, merge_factors(old.users, new.users, weight), merge_factors(old.items, new.items, weight)
    )


def recent_new(merged: FactorModel) -> DataFrame:
    """Rows ``(side, id)`` the last merge added."""
    parts = [
        getattr(merged, side).where("is_new").select(F.lit(side).alias("side"), "id") for side in ("users", "items")
    ]
    return union_all(*parts)
