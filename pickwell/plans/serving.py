"""Refreshing serving lists and answering a table of requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwell.functions.frames import union_all
from pickwell.operators.candidates import PULL_SIZE, Source, pull_all, pull_lists, quotas, saved_params
from pickwell.operators.fusion import fuse, fused_lists, history_of, listed, rank_fused
from pickwell.operators.paging import (
    CACHED_REFILL,
    STORED_REFILL,
    advance_stored,
    normalise_requests,
    page_cached,
    page_stored,
    stored_lists,
    touch_cached,
    with_ids_before,
)
from pickwell.session import fresh_path
from pickwell.sources.tables import upsert

RETURN_DIRECT, RETURN_TO_DATABASE = "ReturnDirect", "ReturnToDataBase"


@dataclass(frozen=True)
class Refresh:
    """Fused lists to store, history to append, parameters with moved offsets, and lists to hand back (if asked for)."""

    stored: DataFrame
    history: DataFrame
    params: DataFrame
    returned: DataFrame | None


def refresh_lists(
    users: DataFrame,
    sources: list[Source],
    cids: DataFrame,
    params: DataFrame,
    now: int,
    num: int = PULL_SIZE,
    mode: str = RETURN_DIRECT,
    seed: int = 0,
    order: list[Column] | None = None,
) -> Refresh:
    """Pull, fuse and rank candidates for ``users``, once: the result is a table in the shared folder.

    Both modes give lists, history and parameters to store (:func:`store_refresh`); only ``ReturnDirect``
    also hands the lists back. ``order`` replaces the ranking by the caller's own sort columns.
    """
    if mode not in (RETURN_DIRECT, RETURN_TO_DATABASE):
        raise ValueError(f"unknown mode {mode}")
    quota = quotas(users, cids, params, num)
    if order is None:
        fused = fused_lists(pull_lists(quota, sources), seed)
    else:
        ranked = rank_fused(fuse(pull_all(quota, sources), [s.cid for s in sources]), seed, order)
        entries = F.sort_array(F.collect_list(F.struct("rank", "item", "cids")))
        fused = ranked.groupBy("user").agg(entries.alias("e")).select("user", F.col("e.item").alias("items"), F.col("e.cids").alias("cids"))
    spark = users.sparkSession
    path = fresh_path(spark, "refresh")
    fused.write.parquet(path)
    fused = spark.read.parquet(path)
    stored = listed(fused, now)
    returned = stored.select("user", "items") if mode == RETURN_DIRECT else None
    return Refresh(stored, history_of(fused), saved_params(quota, params, sources), returned)


def store_refresh(done: Refresh, lists: str, history: str, params: str, run: int) -> None:
    """Store a refresh: lists and parameters by key, the history appended under the number of its ``run``."""
    upsert(done.stored, lists, ["user"], writer=f"refresh#{run}")
    upsert(done.params, params, ["user", "cid"], writer=f"refresh#{run}")
    done.history.write.mode("overwrite").parquet(f"{history}/run={run}")


@dataclass(frozen=True)
class Answer:
    """Responses and the state after them."""

    responses: DataFrame
    refill: DataFrame
    cache: DataFrame
    stored: DataFrame


def answer(
    requests: DataFrame,
    cache: DataFrame,
    stored: DataFrame,
    fresh: DataFrame,
    now: int,
    stored_refill: int = STORED_REFILL,
    cached_refill: int = CACHED_REFILL,
) -> Answer:
    """Answer a batch of requests against the state at its start.

    ``requests`` is ``(seq, user, page, per_page)``, ``cache`` is ``(user,
    begin_time, items, offset)``, ``stored`` is ``(user, items, offset)`` and
    ``fresh`` holds lists ``(user, items)`` pulled and fused for users in
    neither. A user with a cache entry is served from it, else from the stored
    list, else from the fresh one, else gets an empty page with status Error; empty
    lists count as none.
    A stored list's offset moves only when the stored list answered; its full
    list is then cached behind the pages given, unless it ran low. Fresh lists
    are cached and stored. ``refill`` names users whose list ran low.
    """
    asked = normalise_requests(requests)
    valid = with_ids_before(asked.where("valid"))
    filled = F.size("items") > 0
    in_cache = cache.where(filled).select("user", F.lit(True).alias("in_cache"))
    in_stored = stored.where(filled).select("user", F.lit(True).alias("in_stored"))
    origin = F.when(F.col("in_cache"), "cache").when(F.col("in_stored"), "stored").otherwise("fresh")
    routed = valid.join(in_cache, "user", "left").join(in_stored, "user", "left").withColumn("origin", origin)
    # Every branch below reads the routed requests: they are worked out once.
    path = fresh_path(requests.sparkSession, "routed")
    routed.write.parquet(path)
    routed = requests.sparkSession.read.parquet(path)

    from_cache = routed.where(F.col("origin") == "cache")
    from_stored = routed.where(F.col("origin") == "stored")
    from_fresh = routed.where(F.col("origin") == "fresh")

    wanted = fresh.where(filled).join(from_fresh.select("user").distinct(), "user", "left_semi")
    new = wanted.select("user", "items", F.lit(0).alias("offset"))

    cache_pages = page_cached(from_cache, cache, cached_refill).drop("new_offset")
    stored_pages = page_stored(from_stored, stored, stored_refill).drop("new_offset")
    fresh_pages = page_cached(from_fresh, new, 0).drop("new_offset")
    failed = F.when(F.col("status") == "CacheFindFail", "Error").otherwise("ReturnList")
    fresh_pages = fresh_pages.withColumn("status", failed)
    no_id = asked.where(~F.col("valid")).select(
        "seq", "user", F.array().cast("array<int>").alias("page_items"), F.lit("Error").alias("status")
    )
    pages = union_all(cache_pages, stored_pages, fresh_pages, no_id)
    low_cached = cache_pages.where(F.col("status") == "UpdateCache").select("user", "status").distinct()
    low_stored = stored_pages.where(F.col("status") == "UpdateDatabase").select("user", "status").distinct()

    stored_after = advance_stored(from_stored, stored)
    began = F.lit(now).cast("bigint").alias("begin_time")
    into_cache = ["user", began, "items", "offset"]
    calm = from_stored.join(low_stored.select("user"), "user", "left_anti")
    served = touch_cached(calm, stored_lists(calm, stored).select(*into_cache), now)
    new_served = touch_cached(from_fresh, new.select(*into_cache), now)
    # What was just cached or stored takes the place of an empty list.
    fresh_users = new.select("user")
    cached = touch_cached(from_cache, cache, now).where(filled)
    cache_after = union_all(cached, served, new_served)
    stored_after = union_all(stored_after.join(fresh_users, "user", "left_anti"), new.select(stored_after.columns))
    return Answer(pages, union_all(low_cached, low_stored), cache_after, stored_after)
