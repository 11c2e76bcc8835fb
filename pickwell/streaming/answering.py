"""A stream of requests answered from state that each user keeps: a list, a place in it, and when it was last read."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pickwell.functions.frames import union_all
from pickwell.operators.cache import TTL_MS
from pickwell.operators.paging import CACHED_REFILL, STORED_REFILL, normalise_requests

CACHE, STORED, FRESH = "cache", "stored", "fresh"
RESPONSES = "seq bigint, user int, page_items array<int>, status string"

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Answers(StatefulProcessor):
    """The list of a user is written to the state once, its place at every micro-batch that reads it.

    An entry that nobody reads for ``ttl_ms`` is gone: a request that comes later finds nothing, and a timer
    clears the state of users who do not come back.
    """

    def __init__(self, ttl_ms: int, stored_refill: int, cached_refill: int) -> None:
        self.ttl_ms, self.refill = ttl_ms, {STORED: stored_refill, CACHE: cached_refill, FRESH: 0}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.list = handle.getValueState("list", "origin string, items array<int>")
        self.place = handle.getValueState("place", "at bigint, touched bigint")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        touched = initialState["begin_time"]
        self.list.update((initialState["origin"], initialState["items"]))
        self.place.update((initialState["offset"], touched))
        if touched is not None:
            self.handle.registerTimer(touched + self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        origin, items = self.list.get() or (None, [])
        at, touched = self.place.get() or (0, None)
        before = touched
        for row in sorted(rows, key=lambda r: (r["seq"] is None, r["seq"])):
            when = row["at_ms"]
            if origin is not None and None not in (touched, when) and when - touched > self.ttl_ms:
                origin, items = None, []
            if origin is None:
                yield Row(seq=row["seq"], user=key[0], page_items=[], status="Error")
                continue
            at, page, status = self.page(origin, items, at, row["per_page"])
            touched = max(x for x in (touched, when) if x is not None) if when is not None else touched
            yield Row(seq=row["seq"], user=key[0], page_items=page, status=status)
        self.keep(origin, at, before, touched)

    def page(self, origin: str, items: list[int], at: int, n: int) -> tuple[int, list[int], str]:
        """New place, page and status: circular, but for a stored list the place wraps and for others it stops at the end."""
        size = len(items)
        start = at % size if origin == STORED else min(at, size)
        page = [items[(start + i) % size] for i in range(n)]
        low = size - (start + n) < self.refill[origin]
        if origin == STORED:
            return (start + n) % size, page, "UpdateDatabase" if low else "WriterToCache"
        return min(start + n, size), page, "UpdateCache" if low and origin == CACHE else "ReturnList"

    def keep(self, origin: str | None, at: int, before: int | None, touched: int | None) -> None:
        if origin is None:
            self.list.clear()
            self.place.clear()
        elif touched is not None:
            self.place.update((at, touched))
            if before is None:
                self.handle.registerTimer(touched + self.ttl_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """A user has one timer, which is set again here if they were read since, and not by every micro-batch."""
        _, touched = self.place.get() or (0, None)
        if touched is not None and touched + self.ttl_ms > expiredTimerInfo.getExpiryTimeInMs() and not self.over(touched, timerValues):
            self.handle.registerTimer(touched + self.ttl_ms)
        else:
            self.list.clear()
            self.place.clear()
        yield from ()

    def over(self, touched: int, timerValues: Any) -> bool:
        return touched + self.ttl_ms < timerValues.getCurrentWatermarkInMs()

    def close(self) -> None:
        pass


def first_entries(cache: DataFrame, stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """One entry per user to start from: the cached list, else the stored one, else the fresh one; empty lists count as none."""
    never = F.lit(None).cast("bigint")
    filled = F.size("items") > 0
    entries = union_all(
        cache.where(filled).select("user", F.lit(0).alias("choice"), F.lit(CACHE).alias("origin"), "items", "offset", "begin_time"),
        stored.where(filled).select("user", F.lit(1).alias("choice"), F.lit(STORED).alias("origin"), "items", "offset", never.alias("begin_time")),
        fresh.where(filled).select("user", F.lit(2).alias("choice"), F.lit(FRESH).alias("origin"), "items", F.lit(0).alias("offset"), never.alias("begin_time")),
    )
    entry = F.struct("origin", "items", "offset", "begin_time")
    return entries.where(F.col("user").isNotNull()).groupBy("user").agg(F.min_by(entry, "choice").alias("e")).select("user", "e.*")


def answer_stream(
    requests: DataFrame,
    entries: DataFrame,
    ttl_ms: int = TTL_MS,
    stored_refill: int = STORED_REFILL,
    cached_refill: int = CACHED_REFILL,
    late: str = "1 minute",
) -> DataFrame:
    """Responses ``(seq, user, page_items, status)`` to a stream ``(seq, user, page, per_page, at timestamp)``.

    A user's requests go on from one another in order of ``seq``, over all micro-batches, as in
    :func:`pickwell.plans.serving.answer` for one batch. ``entries`` (:func:`first_entries`) are the state of the first
    micro-batch. Requests without a user get an error and touch no state. A user's requests of a micro-batch meet in one task.
    """
    timed = requests.withWatermark("at", late)
    asked = normalise_requests(timed, "at")
    rows = asked.where("valid").select("seq", "user", "per_page", F.unix_millis("at").alias("at_ms"), "at")
    found = rows.groupBy("user").transformWithState(
        statefulProcessor=Answers(ttl_ms, stored_refill, cached_refill), outputStructType=RESPONSES, outputMode="Append",
        timeMode="eventTime", initialState=entries.groupBy("user"),
    )
    none = F.array().cast("array<int>").alias("page_items")
    return found.union(asked.where(~F.col("valid")).select("seq", "user", none, F.lit("Error").alias("status")))


@contextmanager
def _settings(spark: SparkSession, **wanted: str | None) -> Iterator[None]:
    """Settings for queries started inside; the session's own stay as they were."""
    names = {"store": _STORE, "partitions": "spark.sql.shuffle.partitions"}
    before = {names[k]: spark.conf.get(names[k], None) for k, v in wanted.items() if v is not None}
    for key, value in wanted.items():
        if value is not None:
            spark.conf.set(names[key], value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_answers(responses: DataFrame, path: str, checkpoint: str, partitions: int | None = None, **trigger) -> StreamingQuery:
    """Append the responses of :func:`answer_stream` to a folder.

    The state is kept in ``partitions`` parts (as many as a shuffle has, if not given), which a checkpoint fixes for good.
    """
    writer = responses.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    with _settings(responses.sparkSession, store=_ROCKS, partitions=None if partitions is None else str(partitions)):
        return writer.outputMode("append").trigger(**(trigger or {"processingTime": "1 second"})).start()
