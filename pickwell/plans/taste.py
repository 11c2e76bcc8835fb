"""A recommender without factors, as a caller would write one: groups of users by how highly they rate.

It shows what :class:`pickwell.operators.recommenders.Recommender` asks for, and is what the queries run through the
serving and micro-batch layers in place of a factor model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 4
"""Users whose mean rating falls into the same stretch of this width are a group."""
BROADCAST_ENTRIES = 1 << 20
"""Entries of all groups' lists up to which the lists are broadcast (16 MB)."""


def _nested(rows: DataFrame, key: str, other: str, k: int) -> DataFrame:
    """``(id, matches)`` of the best ``k`` of ``(key, other, score)`` rows: score desc, id asc."""
    order = W.partitionBy(key).orderBy(F.desc("score"), other)
    best = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    entries = F.array_sort(F.collect_list(F.struct("place", F.col(other).alias("id"), "score")))
    match = lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))
    return best.groupBy(F.col(key).alias("id")).agg(entries.alias("e")).select("id", F.transform("e", match).alias("matches"))


def _group(mean: Column) -> Column:
    return F.floor(mean / WIDTH).cast("int")


@dataclass(frozen=True)
class TasteGroups:
    """``members`` are ``(user, grp)``, one row per user; ``scores`` are ``(grp, item, score)``, what a group gave an item in all."""

    members: DataFrame
    scores: DataFrame

    @classmethod
    def train(cls, ratings: DataFrame) -> TasteGroups:
        members = ratings.groupBy("user").agg(_group(F.avg("rating")).alias("grp"))
        given = ratings.groupBy("user", "item").agg(F.sum("rating").alias("given")).join(members, "user")
        return cls(members, given.groupBy("grp", "item").agg(F.sum("given").alias("score")))

    def save(self, path: str) -> None:
        self.members.write.parquet(f"{path}/members")
        self.scores.write.parquet(f"{path}/scores")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TasteGroups:
        return cls(spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/scores"))

    def _lists(self, k: int) -> DataFrame:
        """The list of each group. Most users are in a few groups, so few lists go to the users and not users to a list."""
        lists = _nested(self.scores, "grp", "item", k).withColumnRenamed("id", "grp")
        few = self.scores.select("grp").distinct().count() * k <= BROADCAST_ENTRIES
        return F.broadcast(lists) if few else lists

    def user_ids(self) -> DataFrame:
        return self.members.select(F.col("user").alias("id"))

    def items_for_users(self, ids: DataFrame, k: int) -> DataFrame:
        return ids.join(self.members, F.col("id") == F.col("user")).join(self._lists(k), "grp").select("id", "matches")

    def items_for_features(self, vectors: DataFrame, k: int) -> DataFrame:
        """A user's vector holds their mean rating."""
        return vectors.select("id", _group(F.col("features")[0]).alias("grp")).join(self._lists(k), "grp").select("id", "matches")

    def _first_members(self, k: int) -> DataFrame:
        """Members of a group score alike, so no list needs more than its first ``k``."""
        place = F.row_number().over(W.partitionBy("grp").orderBy("user"))
        return self.members.withColumn("place", place).where(F.col("place") <= k).drop("place")

    def users_for_items(self, ids: DataFrame, k: int) -> DataFrame:
        wanted = self.scores.join(ids, F.col("item") == F.col("id"), "left_semi")
        return _nested(wanted.join(self._first_members(k), "grp"), "item", "user", k)

    def users_for_features(self, vectors: DataFrame, k: int) -> DataFrame:
        """An item's vector holds a score per group."""
        wanted = vectors.select("id", F.posexplode("features").alias("grp", "score"))
        return _nested(wanted.join(self._first_members(k), "grp").withColumnRenamed("id", "item"), "item", "user", k)
