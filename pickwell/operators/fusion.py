"""Fusing pulled units into one serving list per user."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# Fixed values of the jitter: a Mersenne prime and odd multipliers.
PRIME, BY_USER, BY_ITEM, BY_SEED, BY_SQUARE = 2147483647, 73856093, 19349663, 83492791, 48271


def fuse(units: DataFrame, cids: list[int] | None = None) -> DataFrame:
    """One row per (user, item) with the candidates that gave it.

    Repeats count. A group holds at most one entry per pulled unit of one
    user and item, that is about one per candidate. Where the open candidates
    are known, ``cids`` turns collecting into counting per candidate; only units of
    other candidates are collected.
    """
    groups = units.groupBy("user", "item")
    n_sources = F.count(F.lit(1)).cast("int").alias("n_sources")
    if cids is None:
        return groups.agg(F.sort_array(F.collect_list("cid")).alias("cids"), n_sources)
    # Counting stays a hash aggregate; what other candidates gave, if anything, is collected apart.
    counted = groups.agg(n_sources, *[F.count_if(F.col("cid") == c).cast("int").alias(f"_{c}") for c in cids])
    known = F.coalesce(F.col("cid").isin(cids), F.lit(False))
    others = units.where(~known).groupBy(F.col("user").alias("_user"), F.col("item").alias("_item")).agg(F.collect_list("cid").alias("_others"))
    same = F.col("user").eqNullSafe(F.col("_user")) & F.col("item").eqNullSafe(F.col("_item"))
    given = [F.array_repeat(F.lit(c), F.col(f"_{c}")) for c in sorted(cids)]
    known_cids = F.flatten(F.array(*given)) if given else F.array().cast("array<int>")
    all_cids = F.when(F.col("_others").isNull(), known_cids).otherwise(F.array_sort(F.concat(known_cids, "_others")))
    return counted.join(others, same, "left").select("user", "item", all_cids.alias("cids"), "n_sources")


def jitter(seed: int) -> Column:
    """A fixed pseudo-random number per (user, item): reruns give the same list."""
    x = F.pmod(
        F.col("user").cast("bigint") * BY_USER + F.col("item").cast("bigint") * BY_ITEM + F.lit(seed * BY_SEED), F.lit(PRIME)
    )
    return ((x * x) % PRIME * BY_SQUARE + x) % PRIME


def rank_fused(fused: DataFrame, seed: int = 0, order: list[Column] | None = None) -> DataFrame:
    """Adds ``rank``: more sources first, random among equals.

    ``order`` replaces the ranking by the caller's own sort columns.
    """
    order = order or [F.col("n_sources").desc(), jitter(seed), F.col("item")]
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("user").orderBy(*order)))


def _jitter(user: np.ndarray, item: np.ndarray, seed: int) -> np.ndarray:
    """:func:`jitter` for whole numbers in numpy; no product leaves 64 bits."""
    x = (user * BY_USER + item * BY_ITEM + seed * BY_SEED) % PRIME
    return ((x * x) % PRIME * BY_SQUARE + x) % PRIME


STEP_IDS, STEP_USERS = 1 << 21, 1 << 14
"""Ids and users that are fused in one pass."""


def _grouped(owner: np.ndarray, item: np.ndarray, known: np.ndarray, cid: np.ndarray) -> tuple[np.ndarray, ...]:
    """The four columns ordered by owner, item (unknown ones first) and candidate.

    Where they fit, all go into one whole number, which sorts several times as fast as columns do.
    """
    names, place = np.unique(cid, return_inverse=True)
    if len(names) >= 1 << 16:
        order = np.lexsort((cid, item, known, owner))
        return owner[order], item[order], known[order], cid[order]
    key = np.sort((((owner << 32) + (item + (1 << 31)) << 1) + known << 16) + place) if known.all() else None
    if key is None:
        order = np.lexsort((place, item, known, owner))
        return owner[order], item[order], known[order], cid[order]
    return key >> 49, (key >> 17 & 0xFFFFFFFF) - (1 << 31), np.ones(len(key), bool), names[key & 0xFFFF]


def _by_rank(owner: np.ndarray, n: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Order by owner, more sources first, then ``draw``; rows that tie stay as they are."""
    most = int(n.max(initial=0))
    if most >= 1 << 17:
        return np.lexsort((draw, -n, owner))
    key = ((owner << 17) + (most - n) << 32) + (draw + 1)
    order = np.argsort(key)
    same = np.flatnonzero(np.diff(key[order]) == 0)
    if len(same):
        return np.argsort(key, kind="stable")
    return order


def fused_lists(pulled: DataFrame, seed: int = 0) -> DataFrame:
    """``(user, items, cids)``: the fused list of each user, best first, and the candidates that gave each item.

    The same as :func:`fuse`, :func:`rank_fused` and collecting the ranked rows, but from pulled lists ``(user, cid,
    items)`` that stay nested: a user's lists meet in one row and some users at a time are
    fused and ranked as arrays. Users without an item have no row. A null user is one of their own, and a null item one more
    item; where either is null there is no draw, so such items come before others with as many sources, by id.
    """

    def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pc.list_flatten(batch.column("lists"))
            of_list = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("lists")).to_numpy())
            ids = np.bincount(of_list, pc.list_value_length(pc.struct_field(parts, "items")).to_numpy(), batch.num_rows).astype(np.int64)
            step = np.cumsum(ids) // STEP_IDS + np.arange(batch.num_rows) // STEP_USERS
            edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:]):
                if high > low:
                    yield some(batch.slice(low, high - low))

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        users, lists = batch.column("user"), batch.column("lists")
        named = pc.is_valid(users).to_numpy(zero_copy_only=False)
        user = pc.fill_null(users, 0).to_numpy().astype(np.int64)
        parts = pc.list_flatten(lists)
        of_list = np.repeat(np.arange(len(user)), pc.list_value_length(lists).to_numpy())
        items = pc.struct_field(parts, "items")
        sizes = pc.list_value_length(items).to_numpy()
        values = pc.list_flatten(items)
        owner, cid = np.repeat(of_list, sizes), np.repeat(pc.struct_field(parts, "cid").to_numpy(), sizes)
        known = pc.is_valid(values).to_numpy(zero_copy_only=False)
        owner, item, known, cid = _grouped(owner, pc.fill_null(values, -(1 << 31)).to_numpy().astype(np.int64), known, cid)
        new = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (known[1:] != known[:-1])
        start = np.flatnonzero(np.r_[True, new][: len(item)])
        n = np.diff(np.r_[start, len(item)])
        owner, item, known = owner[start], item[start], known[start]
        draw = np.where(known & named[owner], _jitter(user[owner], item, seed), -1)
        rank = _by_rank(owner, n, draw)
        sizes, begin = n[rank], start[rank]
        inner = np.r_[0, np.cumsum(sizes)]
        given = cid[np.repeat(begin - inner[:-1], sizes) + np.arange(inner[-1])]
        outer = pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=len(user)))], pa.int32())
        cids = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(given, pa.int32()))
        best = pa.array(item[rank].astype(np.int32), pa.int32(), mask=~known[rank])
        return pa.RecordBatch.from_arrays(
            [users, pa.ListArray.from_arrays(outer, best), pa.ListArray.from_arrays(outer, cids)], ["user", "items", "cids"]
        )

    met = pulled.where(F.size("items") > 0).groupBy("user").agg(F.collect_list(F.struct("cid", "items")).alias("lists"))
    return met.mapInArrow(fused, "user int, items array<int>, cids array<array<int>>")


def fused_rows(pulled: DataFrame, seed: int = 0) -> DataFrame:
    """Rows ``(user, item, cids, n_sources, rank)`` as :func:`fuse` and :func:`rank_fused` give them, opened from :func:`fused_lists`."""
    opened = fused_lists(pulled, seed).select("user", F.posexplode(F.arrays_zip("items", "cids")).alias("pos", "x"))
    return opened.select(
        "user", F.col("x.items").alias("item"), F.col("x.cids").alias("cids"), F.size("x.cids").alias("n_sources"), (F.col("pos") + 1).alias("rank")
    )


def listed(fused: DataFrame, now: int) -> DataFrame:
    """Fused lists as serving lists, see :func:`serving_lists`."""
    return fused.select("user", "items", F.lit(now).cast("bigint").alias("update_time"), F.lit(0).alias("offset"))


def history_of(fused: DataFrame) -> DataFrame:
    """Fused lists as history rows, see :func:`history_rows`."""
    opened = fused.select("user", F.posexplode(F.arrays_zip("items", "cids")).alias("pos", "x"))
    return opened.select("user", F.explode("x.cids").alias("cid"), (F.col("pos") + 1).alias("seq"), F.col("x.items").alias("item"))


def history_rows(ranked: DataFrame) -> DataFrame:
    """Rows ``(user, cid, seq, item)`` to append to the history."""
    return ranked.select("user", F.explode("cids").alias("cid"), F.col("rank").alias("seq"), "item")


def history_lists(history: DataFrame) -> DataFrame:
    """Numbered history ``(user, cid, pos, item)``, oldest first.

    ``history`` is the appended rows with the number of their ``run``. Rows
    are numbered within a run, which is at most one pull long, and shifted by
    the counts of earlier runs, so a long history is never sorted as a whole.
    """
    runs = history.groupBy("user", "cid", "run").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("user", "cid").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    shift = runs.select("user", "cid", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    place = F.row_number().over(W.partitionBy("user", "cid", "run").orderBy("seq", "item"))
    placed = history.withColumn("place", place).join(shift, ["user", "cid", "run"])
    return placed.select("user", "cid", (F.col("shift") + F.col("place")).cast("int").alias("pos"), "item")


def serving_lists(ranked: DataFrame, now: int) -> DataFrame:
    """Rows ``(user, items, update_time, offset)``, ids in rank order.

    ``now`` is epoch milliseconds. A list is no longer than one pull.
    """
    entries = F.sort_array(F.collect_list(F.struct("rank", "item")))
    return ranked.groupBy("user").agg(entries.alias("e")).select(
        "user",
        F.col("e.item").alias("items"),
        F.lit(now).cast("bigint").alias("update_time"),
        F.lit(0).alias("offset"),
    )
