"""Pages of stored and cached lists for a table of requests.

Requests are ``(seq, user, per_page)`` with ``seq`` unique; several requests of
a user continue one another. Lists are ``(user, items array<int>, offset)``,
one row per user. Running totals are taken over the narrow request rows first;
the lists are joined once, afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwell.functions.columns import circular_slice, encode_ids
from pickwell.operators.running import with_total_before

STORED_REFILL = 50
CACHED_REFILL = 200

# Request defaults when page or per_page is missing, and the texts of responses.
DEFAULT_PAGE, DEFAULT_PER_PAGE = 1, 10
NO_ID, NOT_IN_MODEL = "ID is null", "This id is not in model"


def normalise_requests(requests: DataFrame, *carry: str) -> DataFrame:
    """Adds ``valid`` (the id is there) and fills page and per_page together; a negative per_page is 0. Columns to ``carry`` follow."""
    partial = F.col("page").isNull() | F.col("per_page").isNull()
    return requests.select(
        "seq",
        "user",
        F.when(partial, DEFAULT_PAGE).otherwise(F.col("page")).alias("page"),
        F.when(partial, DEFAULT_PER_PAGE).otherwise(F.greatest(F.col("per_page"), F.lit(0))).alias("per_page"),
        F.col("user").isNotNull().alias("valid"),
        *carry,
    )


def _length(items: str = "items") -> Column:
    return F.coalesce(F.size(items), F.lit(0))


def with_ids_before(requests: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(seq, user, per_page, before)``: how many ids the user's earlier requests ask for."""
    return with_total_before(requests.select("seq", "user", "per_page"), "user", "seq", "per_page", "before", ranges)


def _joined(requests: DataFrame, lists: DataFrame, ranges: int | None) -> DataFrame:
    running = requests if "before" in requests.columns else with_ids_before(requests, ranges)
    return running.join(lists.select("user", "items", "offset"), "user", "left")


def _page(rows: DataFrame, found: Column, start: Column, next_offset: Column, status: Column) -> DataFrame:
    return rows.select(
        "seq",
        "user",
        F.when(found, circular_slice(F.col("items"), start, F.col("per_page")))
        .otherwise(F.array().cast("array<int>"))
        .alias("page_items"),
        F.when(found, next_offset).cast("int").alias("new_offset"),
        status.alias("status"),
    )


def page_stored(
    requests: DataFrame, lists: DataFrame, refill: int = STORED_REFILL, ranges: int | None = None
) -> DataFrame:
    """Circular pages of stored lists: ``(seq, user, page_items, new_offset, status)``.

    Requests may already hold ``before`` (see :func:`with_ids_before`).

    ``UpdateDatabase`` when fewer than ``refill`` items would be left,
    ``WriterToCache`` otherwise, ``DatabaseFindFail`` without a list.
    """
    rows = _joined(requests, lists, ranges)
    length = _length()
    found = length > 0
    rows = rows.withColumn("start", F.when(found, F.pmod(F.col("offset") + F.col("before"), length)))
    end = F.col("start") + F.col("per_page")
    status = (
        F.when(~found, "DatabaseFindFail").when(length - end < refill, "UpdateDatabase").otherwise("WriterToCache")
    )
    return _page(rows, found, F.col("start"), end % length, status)


def page_cached(
    requests: DataFrame, cache: DataFrame, refill: int = CACHED_REFILL, ranges: int | None = None
) -> DataFrame:
    """Circular pages of cached lists; the offset stops at the list's end.

    ``UpdateCache`` when fewer than ``refill`` items would be left,
    ``ReturnList`` otherwise, ``CacheFindFail`` without an entry.
    """
    rows = _joined(requests, cache, ranges)
    length = _length()
    found = length > 0
    rows = rows.withColumn("start", F.when(found, F.least(F.col("offset") + F.col("before"), length)))
    end = F.col("start") + F.col("per_page")
    status = F.when(~found, "CacheFindFail").when(length - end < refill, "UpdateCache").otherwise("ReturnList")
    return _page(rows, found, F.col("start"), F.least(end, length), status)


def _asked(requests: DataFrame) -> DataFrame:
    """Ids asked for per user, summed before the shuffle."""
    return requests.groupBy("user").agg(F.sum("per_page").alias("asked"))


def advance_stored(requests: DataFrame, lists: DataFrame) -> DataFrame:
    """The stored lists with their offsets after all requests."""
    joined = lists.join(_asked(requests), "user", "left")
    moved = F.pmod(F.col("offset") + F.coalesce("asked", F.lit(0)), F.greatest(_length(), F.lit(1)))
    return joined.withColumn("offset", moved.cast("int")).select(lists.columns)


def touch_cached(requests: DataFrame, cache: DataFrame, now: int) -> DataFrame:
    """The cache after all requests: offsets moved, begin time of read entries renewed."""
    joined = cache.join(_asked(requests), "user", "left")
    moved = F.least(F.col("offset") + F.coalesce("asked", F.lit(0)), _length())
    begin = F.when(F.col("asked").isNotNull(), F.lit(now).cast("bigint")).otherwise(F.col("begin_time"))
    return joined.withColumn("offset", moved.cast("int")).withColumn("begin_time", begin).select(cache.columns)


def stored_lists(users: DataFrame, lists: DataFrame) -> DataFrame:
    """Full stored lists of the given users, offset 0, to refill the cache."""
    chosen = lists.join(users.select("user").distinct(), "user", "left_semi")
    return chosen.select("user", "items", F.lit(0).alias("offset"))


def first_page(lists: DataFrame, n: int | Column) -> DataFrame:
    """The first ids of each list, and the whole list to cache behind that page."""
    size = F.least(n if isinstance(n, Column) else F.lit(n), _length()).cast("int")
    return lists.select("user", F.slice("items", 1, size).alias("page_items"), "items", size.alias("offset"))


def visible(responses: DataFrame) -> DataFrame:
    """What a caller sees by the literal status rule: other statuses pass no list."""
    passes = F.col("status").isin("Error", "ReturnList", "UpdateCache")
    shown = F.when(passes, F.col("page_items")).otherwise(F.array().cast("array<int>"))
    return responses.withColumn("page_items", shown)


def format_responses(responses: DataFrame) -> DataFrame:
    """Response records from ``(seq, user, page_items)``, and the record as JSON."""
    no_id, empty = F.col("user").isNull(), F.coalesce(F.size("page_items"), F.lit(0)) <= 0
    record = responses.select(
        "seq",
        F.when(no_id, "null").otherwise(F.col("user").cast("string")).alias("user_id"),
        F.when(no_id | empty, "null").otherwise(encode_ids(F.col("page_items"))).alias("video_ids"),
        F.when(no_id | empty, 1).otherwise(0).alias("error_code"),
        F.when(no_id, NO_ID).when(empty, NOT_IN_MODEL).otherwise("").alias("error_reason"),
    )
    return record.withColumn("json", F.to_json(F.struct("user_id", "video_ids", "error_code", "error_reason")))
