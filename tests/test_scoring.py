"""Lists against brute force, for every way the two sides can meet."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pickwell.functions import kernel
from pickwell.model import FactorModel
from pickwell.operators import merging, scoring

RANK = 3
WAYS = {
    "targets broadcast": {},
    "sources broadcast": {"n_targets": 10**9},
    "grid": {"broadcast_bytes": 0, "cell_rows": 17},
    "grid, one group": {"broadcast_bytes": 0, "cell_rows": 1000},
}


def vectors(n, seed):
    """Whole numbers, so equal scores are common; a third of the rows are the same vector."""
    found = np.random.default_rng(seed).integers(-3, 4, (n, RANK)).astype(float)
    found[: n // 3] = found[0]
    return found


def frame(spark, ids, values):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, values)], "id int, features array<double>")


def brute(source, target_ids, target, k, distinct=False):
    out = {}
    for i, row in enumerate(source):
        scores = (target * row).sum(axis=1)
        pairs = sorted(zip(-scores, target_ids))
        if distinct:
            seen, kept = set(), []
            for pair in pairs:
                if pair[1] not in seen:
                    seen.add(pair[1])
                    kept.append(pair)
            pairs = kept
        out[i] = [(int(j), float(-s)) for s, j in pairs[:k]]
    return out


def as_dict(df):
    return {r.id: [(m.id, m.score) for m in r.matches] for r in df.collect()}


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("k", [1, 7, 60, 500])
def test_all_pairs(spark, way, k):
    users, items = vectors(60, 1), vectors(90, 2)
    model = FactorModel(RANK, frame(spark, range(60), users), frame(spark, range(90), items))
    got = as_dict(scoring.items_for_all_users(model, k, **WAYS[way]))
    assert got == brute(users, range(90), items, k)


@pytest.mark.parametrize("way", ["targets broadcast", "grid", "grid, one group"])
@pytest.mark.parametrize("k", [3, 40, 200])
def test_merged_lists_keep_the_best_of_two_scores(spark, way, k):
    users, old, new = vectors(40, 1), vectors(50, 2), vectors(50, 3)
    batch = FactorModel(RANK, frame(spark, range(40), users), frame(spark, range(50), old))
    stream = FactorModel(RANK, frame(spark, range(40), users), frame(spark, range(25, 75), new))
    ids, both = [*range(50), *range(25, 75)], np.concatenate((old, new))
    for dedupe in ("max", "none"):
        got = as_dict(merging.merged_topn_bulk(batch, stream, k, dedupe=dedupe, **WAYS[way]))
        assert got == brute(users, ids, both, k, distinct=dedupe == "max")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 30), st.integers(1, 200), st.integers(1, 50), st.integers(0, 10**6), st.booleans())
def test_kernel(n, m, k, seed, fine):
    """Small blocks force merging and early stops."""
    rng = np.random.default_rng(seed)
    draw = rng.standard_normal if fine else (lambda shape: rng.integers(-2, 3, shape).astype(float))
    source, target = draw((n, RANK)), draw((m, RANK)) * rng.integers(1, 20, (m, 1))
    ids = rng.permutation(m).astype(np.int32)
    old = kernel.BLOCK, kernel.CELLS
    kernel.BLOCK, kernel.CELLS = 5, 40
    try:
        batches = list(kernel.top_lists(np.arange(n, dtype=np.int32), source, kernel.Targets(ids, target), k))
    finally:
        kernel.BLOCK, kernel.CELLS = old
    got = {r["id"]: [(x["id"], x["score"]) for x in r["matches"]] for b in batches for r in b.to_pylist()}
    for i in range(n):
        scores = np.zeros(m)
        for j in range(RANK):
            scores += source[i, j] * target[:, j]
        want = sorted(zip(-scores, ids))[:k]
        assert got[i] == [(int(t), float(-s)) for s, t in want]


def test_unknown_ids_and_empty_vectors_have_no_list(spark):
    users, items = vectors(5, 1), vectors(9, 2)
    model = FactorModel(RANK, frame(spark, range(5), users), frame(spark, range(9), items))
    ids = spark.createDataFrame([(1,), (1,), (77,)], "id int")
    assert set(as_dict(scoring.items_for_users_subset(ids, model, 3))) == {1}
    empty = spark.createDataFrame([(1, [])], "id int, features array<double>")
    assert as_dict(scoring.items_for_features(empty, model, 3)) == {}
    wrong = spark.createDataFrame([(1, [1.0])], "id int, features array<double>")
    with pytest.raises(Exception):
        as_dict(scoring.items_for_features(wrong, model, 3))


def test_no_targets(spark):
    users = frame(spark, range(5), vectors(5, 1))
    model = FactorModel(RANK, users, users.where("id < 0"))
    assert as_dict(scoring.items_for_all_users(model, 3)) == {}
    assert as_dict(scoring.items_for_all_users(model, 3, broadcast_bytes=-1, n_sources=5)) == {}


def test_each_side_is_scored_with_its_own_table(spark):
    """Users for items come from the users, in batch and speed models alike."""
    model = FactorModel(RANK, frame(spark, range(100, 105), vectors(5, 1)), frame(spark, range(9), vectors(9, 2)))
    ids = spark.createDataFrame([(2,)], "id int")
    found = scoring.ranked(scoring.users_for_items_subset(ids, model, 50), "item", "user")
    assert {r.user for r in found.collect()} == set(range(100, 105))


def test_served_lists_join_both_models(spark):
    """Also with both models' lists partitioned alike by user."""
    old = FactorModel(RANK, frame(spark, range(5), vectors(5, 1)), frame(spark, range(9), vectors(9, 2)))
    new = FactorModel(RANK, frame(spark, range(3, 8), vectors(5, 3)), frame(spark, range(20, 29), vectors(9, 4)))
    ids = spark.createDataFrame([(i,) for i in range(10)], "id int")
    rows = scoring.ranked(merging.serve_items(ids, old, new, k=4)).collect()
    assert {r.user for r in rows} == set(range(8))
    assert all(len([r for r in rows if r.user == u]) == 8 for u in range(8))
    only = scoring.ranked(merging.serve_items(ids, None, new, k=4)).collect()
    assert {r.user for r in only} == set(range(3, 8)) and max(r.rank for r in only) == 4
    assert {r.id for r in merging.merged_topn_users(ids, old, None, 2).collect()} == set(range(5))
    assert all(len(r.matches) == 3 for r in merging.serve_items(ids, old, new, k=4, limit=3).collect())
    assert all(len(r.matches) == 3 for r in merging.serve_items(ids, old, None, k=4, limit=3).collect())
    with pytest.raises(ValueError):
        merging.serve_items(ids, None, None)
    with pytest.raises(ValueError):
        merging.merged_topn_bulk(FactorModel(2, old.users, old.items), new)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_lists_stay_nested(spark):
    old = FactorModel(RANK, frame(spark, range(5), vectors(5, 1)), frame(spark, range(9), vectors(9, 2)))
    new = FactorModel(RANK, frame(spark, range(3, 8), vectors(5, 3)), frame(spark, range(20, 29), vectors(9, 4)))
    ids = spark.createDataFrame([(i,) for i in range(10)], "id int")
    partial = spark.createDataFrame([], scoring.PART_DDL)
    for df in (
        merging.serve_items(ids, old, new, k=4), merging.serve_users(ids, old, new, k=4), scoring.merge_lists(partial, 3, 99),
        merging.merged_topn_users(ids, old, new, 3, dedupe="max"),
    ):
        assert "Window" not in plan_of(df) and "Generate" not in plan_of(df)


@pytest.mark.parametrize("distinct", [False, True])
@pytest.mark.parametrize("k", [1, 4, 50])
def test_partial_lists_merge_level_by_level(spark, k, distinct):
    rng = np.random.default_rng(k)
    rows, want = [], {}
    for id_ in range(6):
        for part in rng.permutation(30)[: rng.integers(1, 30)]:
            own = sorted({int(t): float(rng.integers(-3, 4)) for t in rng.integers(0, 40, rng.integers(1, 6))}.items(), key=lambda m: (-m[1], m[0]))
            rows.append((int(part), id_, own))
            want.setdefault(id_, []).extend(own)
    partial = spark.createDataFrame(rows, scoring.PART_DDL)
    got = {r.id: [tuple(m) for m in r.matches] for r in scoring.merge_lists(partial, k, 30, fan_in=3, distinct=distinct).collect()}
    for id_, pairs in want.items():
        if distinct:
            pairs = {t: max(s for u, s in pairs if u == t) for t, _ in pairs}.items()
        assert got[id_] == sorted(pairs, key=lambda m: (-m[1], m[0]))[:k]


def test_the_grid_leaves_out_what_the_longest_targets_rule_out(spark):
    rng = np.random.default_rng(3)
    users, items = vectors(80, 5), vectors(400, 6) * np.exp(rng.uniform(-6, 3, 400))[:, None]
    model = FactorModel(RANK, frame(spark, range(80), users), frame(spark, range(400), items))
    for k in (1, 8, 60, 500):
        grid = scoring.plan_grid(model.users, model.items, RANK, k, False, 40, 10)
        needing = grid.sources.count()
        # A first group of fewer than k targets sets no bound.
        assert grid.groups == 10 and (needing == 80 if k > 40 else needing < 60)
        assert grid.cells.count() == grid.cells.distinct().count() <= 16 * 9
        got = as_dict(scoring.items_for_all_users(model, k, broadcast_bytes=0, cell_rows=40))
        assert got == brute(users, range(400), items, k)


def test_levels_share_shards_and_cells_leave_out_what_is_too_low(spark):
    """Sources that each need another number of groups: before, every one had a shard of its own."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 2)) * np.linspace(1, 9, 300)[:, None]
    targets = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id int, features array<double>")
    angles = np.linspace(0, 3, 120)
    sources = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)], "id int, features array<double>")
    grid = scoring.plan_grid(sources, targets, 2, 3, False, 10, 1000)
    needing = grid.sources.count()
    wide = 2 * spark.sparkContext.defaultParallelism
    levels = grid.cells.groupBy("shard").agg(F.max("grp").alias("last")).collect()
    assert needing and len(levels) <= 2 * wide and grid.sources.where("floor is not null").count() == needing
    cell = grid.targets.where("grp = 1").select("id", "features", "grp").toArrow()
    asked = grid.sources.select("id", "features", "floor").toArrow()
    found = scoring._score_cell(2, 3, False)(asked, cell).to_pylist()
    floor = dict(zip(asked["id"].to_pylist(), asked["floor"].to_pylist()))
    assert all(m["score"] >= floor[row["id"]] - 1e-9 for row in found for m in row["matches"])
    got = {(r.user, r.rank): r.item for r in scoring.ranked(scoring.top_k(sources, targets, 2, 3, broadcast_bytes=0, cell_rows=10)).collect()}
    scores = np.c_[np.cos(angles), np.sin(angles)] @ vectors.T
    assert got == {(u, r + 1): int(i) for u in range(120) for r, i in enumerate(np.argsort(-scores[u])[:3])}


def test_the_longest_targets_are_broadcast_if_they_are_few(spark, monkeypatch):
    users, items = vectors(80, 5), vectors(400, 6)
    model = FactorModel(RANK, frame(spark, range(80), users), frame(spark, range(400), items))
    held, real = [], scoring._score_sources
    monkeypatch.setattr(scoring, "_score_sources", lambda h, *how: (held.append(len(h.value[0])), real(h, *how))[1])
    limit = 40 * (8 * RANK + 4)
    got = as_dict(scoring.items_for_all_users(model, 8, broadcast_bytes=limit, cell_rows=40))
    assert held == [40] and got == brute(users, range(400), items, 8)


def test_a_source_meets_only_the_groups_that_may_hold_its_best(spark):
    """The longest targets are copies of one vector and say little to most sources; before, these met nearly all groups."""
    rng = np.random.default_rng(4)
    angle = rng.uniform(0, 2 * np.pi, 1600)
    items = np.concatenate((np.tile([30.0, 0, 0], (50, 1)), np.c_[np.cos(angle), np.sin(angle), np.zeros(1600)] * rng.uniform(8, 9, (1600, 1))))
    users = rng.normal(size=(60, 3))
    users[:, 0] = -np.abs(users[:, 0])
    model = FactorModel(RANK, frame(spark, range(60), users), frame(spark, range(1650), items))
    grid = scoring.plan_grid(model.users, model.items, RANK, 5, False, 50, 20)
    asked = grid.sources.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("need")).alias("cells")).first()
    assert grid.groups == 33 and asked.n == 60 and asked.cells < 60 * 32 / 4
    sizes = grid.targets.groupBy("grp").count().collect()
    assert len(sizes) == 33 and all(r["count"] == 50 for r in sizes)
    got = as_dict(scoring.items_for_all_users(model, 5, broadcast_bytes=0, cell_rows=50))
    want = brute(users, range(1650), items, 5)
    assert {u: [i for i, _ in m] for u, m in got.items()} == {u: [i for i, _ in m] for u, m in want.items()}


def test_boxes_rule_out_nothing_that_reaches_the_floor():
    rng = np.random.default_rng(5)
    targets, sources = rng.normal(size=(3000, 4)), rng.normal(size=(50, 4))
    tree = kernel.Tree(targets[:500], 6)
    targets = targets[np.argsort(tree.leaves(targets), kind="stable")]
    targets[7, 2] = np.nan
    cuts = np.arange(0, 3000, 10)
    boxes = kernel.Boxes(*(f.reduceat(targets, cuts) for f in (np.minimum, np.maximum)), np.maximum.reduceat(np.sqrt((targets**2).sum(axis=1)), cuts))
    scores = sources @ targets.T
    floor = np.nanmax(scores, axis=1) - rng.uniform(0, 1, 50)
    floor[:3] = np.nan
    at, group = boxes.needed(sources, floor)
    found = set(zip(at.tolist(), group.tolist()))
    assert len(found) == len(at) < 0.5 * 50 * 300 and (np.diff(at) >= 0).all()
    assert {(i, g) for i in range(50) for g in range(300) if not (np.nanmax(scores[i, 10 * g : 10 * g + 10]) < floor[i])} <= found
    assert {(i, 0) for i in range(50)} <= found and all((i, g) in found for i in range(3) for g in range(300))
    clean = np.flatnonzero(~np.isnan(boxes.groups[1]).any(axis=1))
    sub = kernel.Boxes(*(s[clean] for s in boxes.groups))
    best, most = sub.best(sources)
    assert (most >= scores[np.arange(50)[:, None], 10 * clean[best][:, None] + np.arange(10)].max(axis=1) - 1e-9).all()


@pytest.mark.parametrize("k, distinct, fine", [(1, False, True), (3, False, False), (3, True, True), (2, True, False)])
def test_leaves_give_the_same_lists_from_few_targets(monkeypatch, k, distinct, fine):
    """Very many targets are looked up by leaves; before, all that are long enough were scored, whatever their direction."""
    rng = np.random.default_rng(k)
    draw = rng.standard_normal if fine else (lambda shape: rng.integers(-3, 4, shape).astype(float))
    target, source = draw((4000, RANK)) * rng.integers(5, 9, (4000, 1)), draw((70, RANK))
    ids = np.r_[np.arange(2500), np.arange(1500)].astype(np.int32) if distinct else rng.permutation(4000).astype(np.int32)
    scored, real = [], kernel._offer
    monkeypatch.setattr(kernel, "_offer", lambda best, sources, rows, block, *rest: (scored.append(rows.size * len(block)), real(best, sources, rows, block, *rest)))

    def lists():
        scored.clear()
        batches = kernel.top_lists(np.arange(70, dtype=np.int32), source, kernel.Targets(ids, target), k, distinct)
        return {r["id"]: [(x["id"], x["score"]) for x in r["matches"]] for b in batches for r in b.to_pylist()}

    by_length, all_scored = lists(), sum(scored)
    monkeypatch.setattr(kernel, "LEAVES_FROM", 1000)
    monkeypatch.setattr(kernel, "LEAF", 32)
    assert lists() == by_length and sum(scored) < all_scored / 2
    monkeypatch.setattr(kernel, "AT_ONCE", 9)
    assert lists() == by_length
