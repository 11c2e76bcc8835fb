"""Answers that small or orderly fixtures do not show."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pickwell.functions.frames import numbered
from pickwell.functions.kernel import to_matrix
from pickwell.model import FactorModel
from pickwell.operators import candidates as K
from pickwell.operators import fusion, paging
from pickwell.operators.running import with_total_before
from pickwell.plans import serving
from pickwell.session import fresh_path
from pickwell.sources import tables
from pickwell.streaming import speed

LISTS = "user int, items array<int>, offset int"


@pytest.mark.parametrize("ranges", [None, 1, 2, 50])
def test_running_totals_keep_null_keys_and_places(spark, ranges):
    rows = [(i, (None if i % 3 == 0 else i % 2), 1 + i % 4) for i in range(40)] + [(None, 1, 7), (None, None, 5)]
    got = with_total_before(spark.createDataFrame(rows, "seq long, user int, n int"), "user", "seq", "n", "before", ranges)
    want = {
        (s, u): sum(m for t, v, m in rows if v == u and (t is None or (s is not None and t < s)) and not (t is None and s is None))
        for s, u, _ in rows
    }
    assert {(r.seq, r.user): r.before for r in got.collect()} == want
    assert got.count() == len(rows)
    assert with_total_before(got.limit(0).drop("before"), "user", "seq", "n", "before", ranges).count() == 0


def test_requests_without_an_id_get_a_record(spark):
    asked = spark.createDataFrame([(1, None, 1, 5), (2, 4, 1, 2), (3, None, 1, 5), (4, 4, 1, 2)], "seq int, user int, page int, per_page int")
    lists = spark.createDataFrame([(4, [1, 2, 3], 0)], LISTS)
    for ranges in (1, 3):
        pages = paging.page_stored(paging.normalise_requests(asked), lists, 0, ranges)
        records = {r.seq: (r.video_ids, r.error_reason) for r in paging.format_responses(pages).collect()}
        assert records == {1: ("null", paging.NO_ID), 2: ("1,2", ""), 3: ("null", paging.NO_ID), 4: ("3,1", "")}


@pytest.mark.parametrize("lists", [[[1.0] * 5, [1.0] * 5, [1.0] * 4], [[1.0] * 4, [1.0] * 6], [[1.0] * 5, None], [[1.0] * 4 + [None]]])
def test_vectors_of_another_length_are_refused(lists):
    good = pa.record_batch({"id": pa.array([7], pa.int32()), "features": pa.array([[1.0] * 5])})
    assert to_matrix(good, 5)[1].shape == (1, 5) and to_matrix(good.slice(0, 0), 5)[1].shape == (0, 5)
    batch = pa.record_batch({"id": pa.array(range(len(lists)), pa.int32()), "features": pa.array(lists, pa.list_(pa.float64()))})
    if any(x != [1.0] * 5 for x in lists):
        with pytest.raises(ValueError):
            to_matrix(batch, 5)


def test_empty_lists_do_not_stop_the_cascade(spark):
    asked = spark.createDataFrame([(i, i, 1, 2) for i in (1, 2, 3, 4)], "seq int, user int, page int, per_page int")
    cache = spark.createDataFrame([(1, 0, [], 0), (2, 0, [], 0)], "user int, begin_time long, items array<int>, offset int")
    stored = spark.createDataFrame([(1, [11, 12, 13], 0), (2, [], 0), (3, [], 0)], LISTS)
    fresh = spark.createDataFrame([(2, [21, 22]), (3, [31, 32, 33]), (4, [])], "user int, items array<int>")
    got = serving.answer(asked, cache, stored, fresh, 9, 0, 0)
    pages = {r.user: (r.page_items, r.status) for r in got.responses.collect()}
    assert pages == {1: ([11, 12], "WriterToCache"), 2: ([21, 22], "ReturnList"), 3: ([31, 32], "ReturnList"), 4: ([], "Error")}
    kept = sorted((r.user, r.items) for r in got.stored.collect())
    assert kept == [(1, [11, 12, 13]), (2, [21, 22]), (3, [31, 32, 33])]
    cached = [r.user for r in got.cache.collect()]
    assert sorted(cached) == sorted(set(cached)) == [1, 2, 3]


def test_units_of_unlisted_candidates_stay(spark):
    units = spark.createDataFrame([(1, 5, 2, 0), (1, 5, 1, 0), (1, 5, 9, 0), (2, 5, 9, 1)], "user int, item int, cid int, pos int")
    for cids in (None, [1], [1, 2], []):
        got = {(r.user, r.item): (r.cids, r.n_sources) for r in fusion.fuse(units, cids).collect()}
        assert got == {(1, 5): ([1, 2, 9], 3), (2, 5): ([9], 1)}


def test_a_batch_of_malformed_lines_gives_nothing(spark):
    lines = spark.createDataFrame([("not a rating",)] * 150, "value string")
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id int, features array<double>")
    store = speed.ModelStore(batch=FactorModel(2, one, one))
    assert speed.speed_batch(lines, store, speed.SpeedSettings(rank=2)) is None


def test_numbering_over_ranges(spark):
    names = spark.range(300).select(F.concat(F.lit("n"), F.lpad("id", 4, "0")).alias("name"))
    got = numbered(names.repartition(5), "name", "nth")
    assert [(r.name, r.nth) for r in got.orderBy("nth").collect()] == [(f"n{i:04d}", i + 1) for i in range(300)]
    assert numbered(names.limit(0), "name", "nth").count() == 0


def test_nested_fusing_equals_the_rows(spark):
    pulled = spark.createDataFrame(
        [(1, 1, [5, 6, 5]), (1, 2, [6, 7]), (2, 2, []), (3, 9, [8]), (1, 9, [6]), (-4, 1, list(range(50)))], "user int, cid int, items array<int>"
    ).repartition(3)
    rows = fusion.rank_fused(fusion.fuse(K.units(pulled)), seed=3)
    nested = fusion.fused_lists(pulled, seed=3)
    want = sorted(map(tuple, fusion.serving_lists(rows, 9).collect()))
    assert sorted(map(tuple, fusion.listed(nested, 9).collect())) == want
    assert sorted(map(tuple, fusion.history_of(nested).collect())) == sorted(map(tuple, fusion.history_rows(rows).collect()))
    assert fusion.fused_lists(pulled.limit(0)).count() == 0
    opened = fusion.fused_rows(pulled, seed=3).select(rows.columns)
    assert sorted(map(tuple, opened.collect())) == sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("ids", [1, 1 << 21])
def test_nested_fusing_with_nulls_extremes_and_many_candidates(spark, monkeypatch, ids):
    """A few ids a pass, and all; null users and items, ids at the ends of their type, more candidates than a key has bits for."""
    monkeypatch.setattr(fusion, "STEP_IDS", ids)
    low, high = -(1 << 31), (1 << 31) - 1
    schema = "user int, cid int, items array<int>"
    some = [(None, 1, [5, None, -7, 5]), (None, 2, [None, low]), (1, 1, [None, 0, low, high]), (1, 2, [0, None, high]), (2, 1, None), (3, 3, [low])]
    many = [(4, c, [c % 7, None]) for c in range(70_000)]
    for rows in (some, many):
        pulled = spark.createDataFrame(rows, schema)
        want = fusion.rank_fused(fusion.fuse(K.units(pulled)), seed=2)
        for given in (want, fusion.rank_fused(fusion.fuse(K.units(pulled), [1, 2]), seed=2)):
            got = fusion.fused_rows(pulled, seed=2).select(given.columns)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, given.collect()))


def test_fusing_counts_in_a_hash_aggregate(spark):
    units = spark.createDataFrame([(1, 5, 1)], "user int, item int, cid int")
    plan = fusion.fuse(units, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") - plan.count("ObjectHashAggregate") >= 2


@pytest.mark.parametrize("by_item", [False, True])
def test_two_refreshes_in_a_row(spark, by_item):
    order = [F.col("item")] if by_item else None
    users = spark.createDataFrame([(1,), (2,)], "user int")
    cids = spark.createDataFrame([(1,), (2,)], "cid int")
    params = spark.createDataFrame([(1, 1, 0.5, "0"), (1, 2, 0.5, "00000")], "user int, cid int, weight double, offset string")
    bought = spark.createDataFrame([(1, [101, 102, 103])], "user int, items array<int>")
    best = spark.createDataFrame([(f"{i:05d}", 10 + i) for i in range(9)], "rank_key string, item int")
    sources = [K.Source(1, "mode", bought), K.Source(2, "list", best)]
    paths = [fresh_path(spark, n) for n in ("lists", "history", "params")]
    seen = []
    for run in (1, 2):
        done = serving.refresh_lists(users, sources, cids, params, run, num=4, order=order)
        serving.store_refresh(done, *paths, run)
        params = tables.read_table(spark, paths[2], ["user", "cid"])
        lists = {r.user: (sorted(r["items"]), r.update_time) for r in tables.read_table(spark, paths[0], ["user"]).collect()}
        seen.append(lists)
        assert done.returned.count() == 2
    assert seen == [{1: ([10, 11, 101, 102], 1), 2: ([10, 11], 1)}, {1: ([12, 13, 101, 102], 2), 2: ([10, 11], 2)}]
    history = fusion.history_lists(spark.read.parquet(paths[1]))
    assert sorted(r.item for r in history.where("user = 1 and cid = 2").collect()) == [10, 11, 12, 13]
