"""Candidate sources: registry, per-user quotas and pulls."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwell.functions.columns import next_offset, rank_key
from pickwell.functions.frames import numbered, union_all

PULL_SIZE = 2000

REGISTRY = "name string, candidate_list_type string, store_type string, url string, algo string"
PARAMS = "user int, cid int, weight double, offset string"

# The (type, store, algo) combinations that can be pulled from;
# None stands for any algo.
SUPPORTED = [("mode", "hbase", "als"), ("list", "hbase", None)]

Loader = Callable[[SparkSession, str, str], DataFrame]
"""``(spark, url, name)`` to the candidate's table."""


@dataclass(frozen=True)
class Source:
    """An opened candidate: per-user lists (``mode``) or one top list (``list``)."""

    cid: int
    kind: str
    table: DataFrame


def resolve_candidates(registry: DataFrame, supported: list[tuple] = SUPPORTED) -> DataFrame:
    """Adds ``accepted`` to registry rows."""
    accepted = F.lit(False)
    for kind, store, algo in supported:
        match = (F.col("candidate_list_type") == kind) & (F.col("store_type") == store)
        if algo is not None:
            match = match & (F.col("algo") == algo)
        accepted = accepted | F.coalesce(match, F.lit(False))
    return registry.withColumn("accepted", accepted)


def open_sources(registry: DataFrame, loaders: dict[tuple[str, str], Loader]) -> list[Source]:
    """Open accepted sources through a loader per (type, store).

    Registry rows name tables, so they are read on the driver like any list of
    input paths.
    """
    supported = [(kind, store, None) for kind, store in loaders if (kind, store, "als") not in SUPPORTED]
    rows = resolve_candidates(registry, SUPPORTED + supported).where("accepted").orderBy("cid")
    opened = []
    for row in rows.toLocalIterator():
        loader = loaders.get((row.candidate_list_type, row.store_type))
        if loader is not None:
            opened.append(Source(row.cid, row.candidate_list_type, loader(registry.sparkSession, row.url, row.name)))
    return opened


def add_candidates(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Register sources whose name is not there yet, each under an unused id, by name."""
    last = F.coalesce(registry.agg(F.max("cid")).scalar(), F.lit(0))
    fresh = new.dropDuplicates(["name"]).join(registry.select("name"), "name", "left_anti")
    placed = numbered(fresh, "name", "_nth")
    return union_all(registry, placed.withColumn("cid", (last + F.col("_nth")).cast("int")).drop("_nth"))


def remove_candidates(registry: DataFrame, cids: DataFrame) -> DataFrame:
    return registry.join(cids.select("cid"), "cid", "left_anti")


def candidate_params(users: DataFrame, cids: DataFrame, params: DataFrame) -> DataFrame:
    """Every user with every candidate and what is stored for the pair.

    The ids of the registry reach each user row as one array value, so users
    are expanded where they are; only stored parameters are joined.
    """
    every = cids.agg(F.sort_array(F.collect_list("cid")).alias("cids")).scalar()
    grid = users.select("user").distinct().withColumn("cids", every).select("user", F.explode("cids").alias("cid"))
    return grid.join(params.select("user", "cid", "weight", "offset"), ["user", "cid"], "left")


def quotas(users: DataFrame, cids: DataFrame, params: DataFrame, num: int = PULL_SIZE) -> DataFrame:
    """Rows ``(user, cid, num, offset)``: how much each candidate gives.

    ``trunc(num * weight)`` where a weight is stored, else
    ``trunc((1.0 / candidates) * num)`` from offset 0.
    """
    share = (F.lit(1.0) / cids.agg(F.count("cid")).scalar()) * num
    stored = F.col("weight").isNotNull()
    return candidate_params(users, cids, params).select(
        "user",
        "cid",
        F.when(stored, (F.lit(num) * F.col("weight")).cast("int")).otherwise(share.cast("int")).alias("num"),
        F.when(stored, F.col("offset")).otherwise("0").alias("offset"),
    )


def pull_model_lists(lists: DataFrame, quota: DataFrame) -> DataFrame:
    """First ``num`` ids of each user's stored list as ``(user, cid, items)``.

    ``lists`` is ``(user, items)``; a user without a list has no row and the
    stored offset is not used.
    """
    joined = quota.where(F.col("num") > 0).join(lists.select("user", "items"), "user")
    return joined.select("user", "cid", F.slice("items", 1, F.col("num")).cast("array<int>").alias("items"))


def pull_top_lists(top_list: DataFrame, quota: DataFrame) -> DataFrame:
    """Top-list rows with ``offset <= rank_key < offset + num`` as ``(user, cid, items)``.

    Users with the same quota get the same rows, so the list is cut once per
    distinct ``(num, offset)`` and the cut, one array of at most ``num`` ids,
    is joined back to the users.
    """
    wanted = quota.where(F.col("num") > 0)
    cuts = wanted.select("num", "offset").distinct()
    start = F.col("offset").cast("int")
    keys = cuts.select("num", "offset", F.explode(F.sequence(start, start + F.col("num") - 1)).alias("n"))
    keys = keys.select("num", "offset", rank_key(F.col("n")).alias("rank_key"))
    rows = keys.join(top_list.select("rank_key", F.col("item").cast("int").alias("item")), "rank_key")
    entries = F.sort_array(F.collect_list(F.struct("rank_key", "item")))
    cut = rows.groupBy("num", "offset").agg(entries.alias("entries"))
    joined = wanted.join(cut, ["num", "offset"])
    return joined.select("user", "cid", F.col("entries.item").alias("items"))


def units(pulled: DataFrame) -> DataFrame:
    """Pulled lists as units ``(user, item, cid, pos)``."""
    return pulled.select("user", "cid", F.posexplode("items").alias("pos", "item")).select("user", "item", "cid", "pos")


def pull_model(lists: DataFrame, quota: DataFrame) -> DataFrame:
    """Units from the users' stored lists."""
    return units(pull_model_lists(lists, quota))


def pull_top(top_list: DataFrame, quota: DataFrame) -> DataFrame:
    """Units from a top list."""
    return units(pull_top_lists(top_list, quota))


def pull_lists(quota: DataFrame, sources: list[Source]) -> DataFrame:
    """Pulled lists ``(user, cid, items)`` from every source."""
    pullers = {"mode": pull_model_lists, "list": pull_top_lists}
    parts = [pullers[s.kind](s.table, quota.where(F.col("cid") == s.cid)) for s in sources]
    if not parts:
        raise ValueError("no candidate source is open")
    return union_all(*parts)


def pull_all(quota: DataFrame, sources: list[Source]) -> DataFrame:
    """Units from every source.

    The lists move to their user as arrays and are opened there, so fusing,
    ranking and listing the units shuffles nothing more.
    """
    return units(pull_lists(quota, sources).repartition("user"))


def next_offsets(quota: DataFrame) -> DataFrame:
    """Quota rows with the offset after the rows they take."""
    return quota.withColumn("next", next_offset(F.col("num"), F.col("offset")))


def saved_params(quota: DataFrame, params: DataFrame, sources: list[Source]) -> DataFrame:
    """Parameters to store after a pull, for pairs that had a stored weight.

    The weight is kept; the offset advances for top lists and stays for
    per-user lists, which are always read from the start.
    """
    had = params.select("user", "cid", "weight")
    moving = F.col("cid").isin([s.cid for s in sources if s.kind == "list"])
    moved = next_offsets(quota).join(had, ["user", "cid"])
    return moved.select("user", "cid", "weight", F.when(moving, F.col("next")).otherwise(F.col("offset")).alias("offset"))
