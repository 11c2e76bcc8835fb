"""Cached lists as a table ``(user, begin_time, items, offset)``: evict and admit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwell.functions.frames import numbered, union_all

CAPACITY = 1_000_000
TTL_MS = 1_200_000
HEADROOM = 0.1


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in order, wherever they are: places come from counts of ranges, so no task gathers them."""
    return numbered(rows, order, "_nth").where(F.col("_nth") <= n).drop("_nth")


def evict(
    cache: DataFrame, now: int, capacity: int = CAPACITY, ttl_ms: int = TTL_MS, headroom: float = HEADROOM
) -> DataFrame:
    """Entries to keep.

    Entries older than ``ttl_ms`` go. If less than ``headroom`` of the capacity
    is then free, the longest-staying ``headroom * capacity`` go as well.
    """
    alive = cache.where(F.lit(now) - F.col("begin_time") <= ttl_ms)
    spare = int(capacity * headroom)
    if capacity - alive.count() >= capacity * headroom:
        return alive
    oldest = first_rows(alive.select("begin_time", "user"), ["begin_time", "user"], spare)
    return alive.join(oldest.select("user"), "user", "left_anti").select(cache.columns)


def admit(cache: DataFrame, incoming: DataFrame, now: int, capacity: int = CAPACITY) -> DataFrame:
    """The cache after ``incoming`` rows ``(user, items, arrival)``.

    A known user's list is always replaced. New users are let in by arrival
    while there is room. Several lists of a user: the first decides the place,
    the last is kept. New entries start at offset 0. Places are decided on
    narrow rows; lists stay where they are.
    """
    latest = incoming.groupBy("user").agg(
        F.max_by("items", "arrival").alias("items"), F.min("arrival").alias("arrival")
    )
    entry = [F.lit(now).cast("bigint").alias("begin_time"), "items", F.lit(0).alias("offset")]
    known = latest.join(cache.select("user"), "user", "left_semi")
    room = max(capacity - cache.count(), 0)
    firsts = incoming.groupBy("user").agg(F.min("arrival").alias("arrival"))
    let_in = first_rows(firsts.join(cache.select("user"), "user", "left_anti"), ["arrival", "user"], room)
    newcomers = latest.join(let_in.select("user"), "user", "left_semi")
    kept = cache.join(latest.select("user"), "user", "left_anti")
    fresh = union_all(known, newcomers).select("user", *entry)
    return union_all(kept.select("user", "begin_time", "items", "offset"), fresh)


def remove(cache: DataFrame, users: DataFrame) -> DataFrame:
    return cache.join(users.select("user"), "user", "left_anti")
