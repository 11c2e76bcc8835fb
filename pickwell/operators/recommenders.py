"""What serving and the micro-batch layer ask of a model, so that a caller's own can stand in for a factor model.

A recommender answers whole tables of ids or vectors with nested lists ``(id int, matches array<struct<id:int,
score:double>>)``, best first; ids it does not know have no list. A :class:`~pickwell.model.FactorModel` is one by
way of :mod:`pickwell.operators.scoring`; any object with the methods of :class:`Recommender` is another.
"""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwell.functions.kernel import MATCHES_DDL
from pickwell.model import FactorModel
from pickwell.operators import scoring
from pickwell.operators.factors import user_ids


@runtime_checkable
class ItemRecommender(Protocol):
    """Items for users, by id or by whatever vector describes a user to this recommender."""

    def items_for_users(self, ids: DataFrame, k: int) -> DataFrame: ...

    def items_for_features(self, vectors: DataFrame, k: int) -> DataFrame: ...


@runtime_checkable
class UserRecommender(Protocol):
    """Users for items, by id or by vector."""

    def users_for_items(self, ids: DataFrame, k: int) -> DataFrame: ...

    def users_for_features(self, vectors: DataFrame, k: int) -> DataFrame: ...


@runtime_checkable
class Recommender(ItemRecommender, UserRecommender, Protocol):
    """Both directions, and the users it knows as ``id``."""

    def user_ids(self) -> DataFrame: ...


Model = FactorModel | Recommender


def _lists(lists: DataFrame, k: int) -> DataFrame:
    """A recommender's answer in the standard types, no list longer than asked for, no empty or null one."""
    typed = lists.select(F.col("id").cast("int").alias("id"), F.slice(F.col("matches").cast(MATCHES_DDL), 1, k).alias("matches"))
    return typed.where(F.col("id").isNotNull() & (F.size("matches") > 0))


def _asked(ids: DataFrame) -> DataFrame:
    """The ids, once each. They are narrow but grow into lists, so they are dealt to a given number of tasks and not by bytes."""
    typed = ids.select(F.col("id").cast("int").alias("id")).where("id IS NOT NULL")
    return typed.repartition(scoring.tasks(ids.sparkSession), "id").distinct()


def known_users(model: Model) -> DataFrame:
    """Every user a model knows, once, as ``id``."""
    return user_ids(model) if isinstance(model, FactorModel) else _asked(model.user_ids())


def items_for(model: Model, ids: DataFrame, k: int) -> DataFrame:
    """Nested lists of items for the users in ``ids``."""
    if isinstance(model, FactorModel):
        return scoring.items_for_users_subset(ids, model, k)
    return _lists(model.items_for_users(_asked(ids), k), k)


def users_for(model: Model, ids: DataFrame, k: int) -> DataFrame:
    """Nested lists of users for the items in ``ids``."""
    if isinstance(model, FactorModel):
        return scoring.users_for_items_subset(ids, model, k)
    return _lists(model.users_for_items(_asked(ids), k), k)


def items_by_features(model: Model, vectors: DataFrame, k: int) -> DataFrame:
    """Nested lists of items for ``(id, features)`` rows; empty vectors have none."""
    if isinstance(model, FactorModel):
        return scoring.items_for_features(vectors, model, k)
    return _lists(model.items_for_features(vectors.where(F.size("features") > 0), k), k)


def users_by_features(model: Model, vectors: DataFrame, k: int) -> DataFrame:
    """Nested lists of users for ``(id, features)`` rows; empty vectors have none."""
    if isinstance(model, FactorModel):
        return scoring.users_for_features(vectors, model, k)
    return _lists(model.users_for_features(vectors.where(F.size("features") > 0), k), k)
