"""Lists merged from a batch and a stream (speed) model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwell.functions.frames import union_all
from pickwell.model import FactorModel
from pickwell.operators.factors import as_factors, check_rank, resolve_factors
from pickwell.operators.recommenders import Model, items_for, known_users, users_for
from pickwell.operators.scoring import items_for_all_users, merge_two, top_k

LIST_LENGTH = 5000
SERVE_LENGTH = 1000


def _one_of(batch: Model | None, stream: Model | None) -> None:
    if batch is None and stream is None:
        raise ValueError("no model is loaded")
    if isinstance(batch, FactorModel) and isinstance(stream, FactorModel):
        check_rank(batch, stream)


def _distinct(dedupe: str) -> bool:
    if dedupe not in ("none", "max"):
        raise ValueError("dedupe is 'none' or 'max'")
    return dedupe == "max"


def merged_topn_bulk(
    batch: Model | None,
    stream: Model | None,
    n: int = LIST_LENGTH,
    vector_source: str = "stream",
    dedupe: str = "none",
    **how,
) -> DataFrame:
    """Nested lists for every user of the stream model.

    The list of a user is the best ``n`` of their batch-item scores and their
    stream-item scores together. Both come from one user vector, and the best
    ``n`` of two best-``n`` lists is the best ``n`` of the joint catalogue, so
    the item tables are united first and each user is scored once; no list is
    shuffled. Users are scored with their stream vector, or with their batch
    vector where known (``vector_source='batch'``); vectors of two models
    trained apart are not aligned, which the caller accepts by asking for a
    merge. Without a stream model there is nothing to do. Recommenders that are no factor models
    answer for themselves, each user of the stream's one by both.
    """
    _one_of(batch, stream)
    distinct = _distinct(dedupe)
    if stream is None:
        raise ValueError("the bulk merge needs a stream model")
    if batch is None and isinstance(stream, FactorModel):
        return items_for_all_users(stream, n, **how)
    if not (isinstance(batch, FactorModel) and isinstance(stream, FactorModel)):
        return merged_topn_users(known_users(stream), batch, stream, n, dedupe)
    users = as_factors(stream.users)
    if vector_source == "batch":
        known = as_factors(batch.users).select("id", F.col("features").alias("known"))
        users = users.join(known, "id", "left").select("id", F.coalesce("known", "features").alias("features"))
    elif vector_source != "stream":
        raise ValueError("vector_source is 'stream' or 'batch'")
    how = {"n_targets": batch.size("items") + stream.size("items"), **how} if "n_targets" not in how else how
    items = union_all(as_factors(batch.items), as_factors(stream.items))
    return top_k(users, items, stream.rank, n, distinct=distinct, **how)


def _merged(lists: list[DataFrame], k: int | None, distinct: bool = False) -> DataFrame:
    return lists[0] if len(lists) == 1 else merge_two(*lists, k, distinct)


def merged_topn_users(
    ids: DataFrame,
    batch: Model | None,
    stream: Model | None,
    n: int = LIST_LENGTH,
    dedupe: str = "none",
) -> DataFrame:
    """Nested lists for the users in ``ids``.

    Each model scores with its own user vector; whichever models are loaded
    take part. The two sorted lists of a user meet in one join and are merged as they are.
    """
    _one_of(batch, stream)
    return _merged([items_for(m, ids, n) for m in (batch, stream) if m is not None], n, _distinct(dedupe))


def serve_items(
    users: DataFrame,
    batch: Model | None,
    speed: Model | None,
    k: int = SERVE_LENGTH,
    limit: int | None = None,
) -> DataFrame:
    """Nested lists of items for the ids in ``users``, ``k`` per model.

    With two factor models the user's batch vector is used, else the speed vector,
    against the items of each; with one model its own vectors are used, and recommenders that are no factor
    models always answer by id.
    """
    return _served(users, batch, speed, k, limit, "users", "items", items_for)


def serve_users(
    items: DataFrame,
    batch: Model | None,
    speed: Model | None,
    k: int = SERVE_LENGTH,
    limit: int | None = None,
) -> DataFrame:
    """Nested lists of users for the ids in ``items``; the mirror of ``serve_items``."""
    return _served(items, batch, speed, k, limit, "items", "users", users_for)


def _served(ids, batch, speed, k: int, limit: int | None, own: str, other: str, by_id) -> DataFrame:
    _one_of(batch, speed)
    if isinstance(batch, FactorModel) and isinstance(speed, FactorModel):
        vectors = resolve_factors(ids, getattr(batch, own), getattr(speed, own))
        lists = [top_k(vectors, getattr(m, other), m.rank, k, n_targets=m.size(other)) for m in (speed, batch)]
    else:
        lists = [by_id(m, ids, k) for m in (speed, batch) if m is not None]
    if len(lists) == 1 and limit is not None:
        return lists[0].select("id", F.slice("matches", 1, limit).alias("matches"))
    return _merged(lists, limit)
