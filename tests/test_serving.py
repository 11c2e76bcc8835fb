"""Candidates, fusion, paging, cache and the answer cascade on small hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from pickwell.operators import cache as C
from pickwell.operators import candidates as K
from pickwell.operators import fusion, paging
from pickwell.operators.running import with_total_before
from pickwell.plans import serving

LISTS = "user int, items array<int>, offset int"


def test_running_total_with_one_hot_user(spark):
    """A third of the rows are one user's; ranges are far smaller than that."""
    rng = random.Random(1)
    rows = [(i * 3, 7 if rng.random() < 0.34 else rng.randrange(200), rng.randrange(5)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "seq bigint, user int, n int")
    want, sums = {}, {}
    for seq, user, n in sorted(rows):
        want[seq] = sums.get(user, 0)
        sums[user] = sums.get(user, 0) + n
    for chunk in (10, 100, 5000):
        got = with_total_before(df, "user", "seq", "n", "before", chunk).collect()
        assert {r.seq: r.before for r in got} == want and len(got) == 3000


def test_a_page_wraps_and_chained_requests_go_on(spark):
    lists = spark.createDataFrame([(1, list(range(10)), 8), (2, [5], 0), (3, [], 0)], LISTS)
    asked = spark.createDataFrame([(1, 1, 3), (2, 1, 4), (3, 2, 3), (4, 3, 2), (5, 9, 2)], "seq int, user int, per_page int")
    got = {r.seq: (r.page_items, r.new_offset, r.status) for r in paging.page_stored(asked, lists, refill=3).collect()}
    assert got == {
        1: ([8, 9, 0], 1, "UpdateDatabase"),
        2: ([1, 2, 3, 4], 5, "WriterToCache"),
        3: ([5, 5, 5], 0, "UpdateDatabase"),
        4: ([], None, "DatabaseFindFail"),
        5: ([], None, "DatabaseFindFail"),
    }
    after = {r.user: r.offset for r in paging.advance_stored(asked, lists).collect()}
    assert after == {1: 5, 2: 0, 3: 0}


def test_a_cached_offset_stops_at_the_end(spark):
    lists = spark.createDataFrame([(1, list(range(10)), 5)], LISTS)
    asked = spark.createDataFrame([(1, 1, 2), (2, 1, 6), (3, 1, 2)], "seq int, user int, per_page int")
    got = {r.seq: (r.page_items, r.new_offset, r.status) for r in paging.page_cached(asked, lists, refill=3).collect()}
    assert got == {
        1: ([5, 6], 7, "ReturnList"),
        2: ([7, 8, 9, 0, 1, 2], 10, "UpdateCache"),
        3: ([0, 1], 10, "UpdateCache"),
    }


def test_request_defaults_and_records(spark):
    asked = spark.createDataFrame(
        [(1, None, 1, 2), (2, 5, None, 4), (3, 5, 2, None), (4, 5, 2, 3)], "seq int, user int, page int, per_page int"
    )
    got = [(r.page, r.per_page, r.valid) for r in paging.normalise_requests(asked).orderBy("seq").collect()]
    assert got == [(1, 2, False), (1, 10, True), (1, 10, True), (2, 3, True)]
    pages = spark.createDataFrame([(1, None, []), (2, 5, []), (3, 5, [1, 2])], "seq int, user int, page_items array<int>")
    records = [tuple(r)[1:5] for r in paging.format_responses(pages).orderBy("seq").collect()]
    assert records == [
        ("null", "null", 1, "ID is null"), ("5", "null", 1, "This id is not in model"), ("5", "1,2", 0, ""),
    ]
    json = paging.format_responses(pages).orderBy("seq").collect()[2].json
    assert json == '{"user_id":"5","video_ids":"1,2","error_code":0,"error_reason":""}'


def test_offsets_of_a_top_list_are_padded_and_advance(spark):
    top = spark.createDataFrame([(f"{i:05d}", 100 + i) for i in range(30)], "rank_key string, item int")
    quota = spark.createDataFrame([(1, 2, 4, "5"), (2, 2, 4, "00005"), (3, 2, 9, "28"), (4, 2, 0, "0")],
                                  "user int, cid int, num int, offset string")
    got = sorted((r.user, r.pos, r.item) for r in K.pull_top(top, quota).collect())
    four = [(0, 105), (1, 106), (2, 107), (3, 108)]
    assert got == [(1, *x) for x in four] + [(2, *x) for x in four] + [(3, 0, 128), (3, 1, 129)]
    params = quota.select("user", "cid", F.lit(0.5).alias("weight"), "offset")
    saved = K.saved_params(quota, params, [K.Source(2, "list", top)]).orderBy("user").collect()
    assert [r.offset for r in saved] == ["00009", "00009", "00037", "00000"]


def test_a_user_without_a_list_gives_no_units(spark):
    lists = spark.createDataFrame([(1, [9, 8, 7])], "user int, items array<int>")
    quota = spark.createDataFrame([(1, 1, 2, "1"), (2, 1, 2, "0")], "user int, cid int, num int, offset string")
    assert [(r.user, r.pos, r.item) for r in K.pull_model(lists, quota).collect()] == [(1, 0, 9), (1, 1, 8)]


def test_candidate_ids_are_unique_and_unsupported_sources_not_opened(spark):
    schema = "cid int, " + K.REGISTRY
    registry = spark.createDataFrame([(4, "als", "mode", "hbase", "u", "als")], schema)
    new = spark.createDataFrame(
        [("als", "mode", "hbase", "u", "als"), ("top", "list", "hbase", "u", ""), ("k", "mode", "hbase", "u", "kmean"),
         ("x", "list", "jdbc", "u", "")], K.REGISTRY)
    all_of_them = K.add_candidates(registry, new)
    assert sorted((r.name, r.cid) for r in all_of_them.collect()) == [("als", 4), ("k", 5), ("top", 6), ("x", 7)]
    table = spark.createDataFrame([(1, [1])], "user int, items array<int>")
    loaders = {("mode", "hbase"): lambda s, url, name: table, ("list", "hbase"): lambda s, url, name: table}
    assert [(s.cid, s.kind) for s in K.open_sources(all_of_them, loaders)] == [(4, "mode"), (6, "list")]
    loaders["list", "jdbc"] = lambda s, url, name: table
    assert [s.cid for s in K.open_sources(all_of_them, loaders)] == [4, 6, 7]


def test_quota_truncates(spark):
    users = spark.createDataFrame([(1,), (2,), (2,)], "user int")
    cids = spark.createDataFrame([(1,), (2,), (3,)], "cid int")
    params = spark.createDataFrame([(1, 2, 0.3, "7")], "user int, cid int, weight double, offset string")
    got = sorted(tuple(r) for r in K.quotas(users, cids, params, 10).collect())
    assert got == [(1, 1, 3, "0"), (1, 2, 3, "7"), (1, 3, 3, "0"), (2, 1, 3, "0"), (2, 2, 3, "0"), (2, 3, 3, "0")]


def test_fused_items_rank_by_sources_and_repeat_runs_agree(spark):
    rows = [(u, i, c, 0) for u in range(3) for i in range(40) for c in ((1, 2) if i % 3 else (2, 2, 1))]
    units = spark.createDataFrame(rows, "user int, item int, cid int, pos int")
    for cids in (None, [2, 1]):
        fused = fusion.fuse(units, cids)
        assert {tuple(r.cids) for r in fused.collect()} == {(1, 2), (1, 2, 2)}
        ranked = fusion.rank_fused(fused, seed=3).orderBy("user", "rank").collect()
        assert [r.n_sources for r in ranked if r.user == 1] == [3] * 14 + [2] * 26
        again = fusion.rank_fused(fused.repartition(7), seed=3).orderBy("user", "rank").collect()
        assert [r.item for r in ranked] == [r.item for r in again]
        other = fusion.rank_fused(fused, seed=4).orderBy("user", "rank").collect()
        assert [r.item for r in ranked] != [r.item for r in other]


def test_return_modes(spark):
    users = spark.createDataFrame([(1,)], "user int")
    lists = spark.createDataFrame([(1, [9, 8, 7])], "user int, items array<int>")
    cids = spark.createDataFrame([(1,)], "cid int")
    params = spark.createDataFrame([], K.PARAMS)
    for mode in (serving.RETURN_DIRECT, serving.RETURN_TO_DATABASE):
        done = serving.refresh_lists(users, [K.Source(1, "mode", lists)], cids, params, 5, 2, mode)
        assert (done.returned is not None) == (mode == serving.RETURN_DIRECT)
        assert done.stored.first().update_time == 5 and done.history.count() == 2
    with pytest.raises(ValueError):
        serving.refresh_lists(users, [], cids, params, 5, 2, "ReturnNothing")


CACHE = "user int, begin_time bigint, items array<int>, offset int"


def test_evict_drops_the_oldest_when_room_is_short(spark):
    cache = spark.createDataFrame([(u, 1000 + u % 5, [u], 0) for u in range(95)] + [(99, 1, [1], 0)], CACHE)
    kept = {r.user for r in C.evict(cache, 2000, capacity=100, ttl_ms=1000).collect()}
    gone = sorted(set(range(95)) - kept)
    assert 99 not in kept and gone == [0, 5, 10, 15, 20, 25, 30, 35, 40, 45]
    assert C.evict(cache, 2000, capacity=1000, ttl_ms=1000).count() == 95


def test_admit(spark):
    cache = spark.createDataFrame([(1, 10, [1], 3), (2, 10, [2], 3)], CACHE)
    new = spark.createDataFrame([(1, [7], 5), (5, [5], 2), (4, [4], 1), (6, [6], 3), (4, [44], 9)],
                                "user int, items array<int>, arrival int")
    after = sorted(tuple(r) for r in C.admit(cache, new, 50, capacity=4).collect())
    assert after == [(1, 50, [7], 0), (2, 10, [2], 3), (4, 50, [44], 0), (5, 50, [5], 0)]
    assert {r.user for r in C.admit(cache, new, 50, capacity=1).collect()} == {1, 2}


def test_answer_uses_cache_then_stored_then_fresh(spark):
    cache = spark.createDataFrame([(1, 10, list(range(100, 400)), 0)], CACHE)
    stored = spark.createDataFrame([(1, list(range(300)), 4), (2, list(range(300)), 4), (5, list(range(20)), 0)], LISTS)
    fresh = spark.createDataFrame([(3, [31, 32, 33]), (2, [1])], "user int, items array<int>")
    asked = spark.createDataFrame(
        [(1, 1, 1, 2), (2, 2, 1, 2), (3, 3, 1, 2), (4, 4, 1, 2), (5, None, 1, 2), (6, 3, 1, 1), (7, 5, 1, 3)],
        "seq int, user int, page int, per_page int")
    got = serving.answer(asked, cache, stored, fresh, now=99)
    pages = {r.seq: (r.page_items, r.status) for r in got.responses.collect()}
    assert pages == {
        1: ([100, 101], "ReturnList"), 2: ([4, 5], "WriterToCache"), 3: ([31, 32], "ReturnList"), 4: ([], "Error"),
        5: ([], "Error"), 6: ([33], "ReturnList"), 7: ([0, 1, 2], "UpdateDatabase"),
    }
    assert [tuple(r) for r in got.refill.collect()] == [(5, "UpdateDatabase")]
    cached = {r.user: (len(r["items"]), r.offset, r.begin_time) for r in got.cache.collect()}
    assert cached == {1: (300, 2, 99), 2: (300, 2, 99), 3: (3, 3, 99)}
    left = {r.user: r.offset for r in got.stored.collect()}
    assert left == {1: 4, 2: 6, 3: 0, 5: 3}
