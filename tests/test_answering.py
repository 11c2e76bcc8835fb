"""Requests answered from state per user: as the batch does over all files, and not from entries that were left too long."""

import random
from datetime import datetime, timedelta

import pytest

from pickwell.plans import serving
from pickwell.session import fresh_path
from pickwell.streaming import answering

START = datetime(2024, 1, 1)
LISTS = "user int, items array<int>, offset int"


def tables(spark, rng):
    def some(users, offsets=True):
        return [(u, rng.sample(range(1000), rng.randrange(0, 9)), rng.randrange(3) if offsets else 0) for u in users]

    held = [(u, items, min(o, len(items))) for u, items, o in some(range(0, 6))]
    cache = spark.createDataFrame([(u, 0, items, o) for u, items, o in held], "user int, begin_time long, items array<int>, offset int")
    stored = spark.createDataFrame(some(range(4, 12)), LISTS)
    fresh = spark.createDataFrame([(u, items) for u, items, _ in some(range(10, 16), False)], "user int, items array<int>")
    return cache, stored, fresh


def asked(rng, n):
    pick = [None, *range(18)]
    return [
        (i, rng.choice(pick), rng.choice([1, None]), rng.choice([0, 1, 3, 20, -2, None]), START + timedelta(minutes=i))
        for i in range(n)
    ]


def answers(spark, requests, parts, entries, **settings):
    """``(page, status)`` by number, from requests that arrive in ``parts`` files."""
    root = fresh_path(spark, "answers")
    frame = spark.createDataFrame(requests, "seq long, user int, page int, per_page int, at timestamp")
    for part in range(parts):
        low, high = len(requests) * part // parts, len(requests) * (part + 1) // parts
        frame.where((frame.seq >= low) & (frame.seq < high)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    found = answering.answer_stream(stream, entries, **settings)
    answering.run_answers(found, f"{root}/out", f"{root}/log", partitions=3, availableNow=True).awaitTermination()
    return frame, {r.seq: (r.page_items, r.status) for r in spark.read.schema(answering.RESPONSES).parquet(f"{root}/out").collect()}


@pytest.mark.parametrize("parts", [1, 3])
def test_files_of_requests_give_the_pages_of_the_batch(spark, parts):
    rng = random.Random(parts)
    cache, stored, fresh = tables(spark, rng)
    before = spark.conf.get(answering._STORE, None)
    entries = answering.first_entries(cache, stored, fresh)
    frame, got = answers(spark, asked(rng, 150), parts, entries, ttl_ms=10**13, stored_refill=3, cached_refill=4)
    want = serving.answer(frame.drop("at"), cache, stored, fresh, 9, stored_refill=3, cached_refill=4).responses
    assert got == {r.seq: (r.page_items, r.status) for r in want.collect()} and len(got) == 150
    assert spark.conf.get(answering._STORE, None) == before and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_entries_that_are_left_too_long_are_gone(spark):
    cache = spark.createDataFrame([(1, int(START.timestamp() * 1000), [1, 2, 3], 0), (2, 0, [4, 5], 0)], "user int, begin_time long, items array<int>, offset int")
    stored = spark.createDataFrame([(3, [6, 7, 8], 1)], LISTS)
    entries = answering.first_entries(cache, stored, stored.select("user", "items").limit(0))
    minutes = [(1, 5), (2, 6), (3, 50), (1, 14), (1, 30), (3, 58), (9, 59), (1, 60), (3, 61), (3, 90)]
    requests = [(i, user, 1, 1, START + timedelta(minutes=at)) for i, (user, at) in enumerate(minutes)]
    _, got = answers(spark, requests, 5, entries, ttl_ms=600_000, stored_refill=0, cached_refill=0, late="1 hour")
    assert {i: page for i, (page, _) in got.items()} == {0: [1], 1: [], 2: [7], 3: [2], 4: [], 5: [8], 6: [], 7: [], 8: [6], 9: []}
    assert [got[i][1] for i in (0, 1, 2, 9)] == ["ReturnList", "Error", "WriterToCache", "Error"]


def test_the_first_list_of_a_user_counts(spark):
    cache = spark.createDataFrame([(1, 5, [], 0), (2, 5, [9], 1), (None, 5, [1], 0)], "user int, begin_time long, items array<int>, offset int")
    stored = spark.createDataFrame([(1, [], 0), (2, [8], 0), (3, [7], 4)], LISTS)
    fresh = spark.createDataFrame([(1, [6]), (3, [5]), (4, [])], "user int, items array<int>")
    got = {r.user: (r.origin, r["items"], r.offset, r.begin_time) for r in answering.first_entries(cache, stored, fresh).collect()}
    assert got == {1: ("fresh", [6], 0, None), 2: ("cache", [9], 1, 5), 3: ("stored", [7], 4, None)}
