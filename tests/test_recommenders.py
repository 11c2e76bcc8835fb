"""Recommenders of a caller's own in place of factor models, and models found again after a restart."""

from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pickwell.model import FactorModel
from pickwell.operators import merging, recommenders
from pickwell.operators.ratings import parse_ratings
from pickwell.plans.taste import WIDTH, TasteGroups
from pickwell.plans.views import model, view
from pickwell.session import fresh_path
from pickwell.sources import files, messages, models, tables
from pickwell.streaming import speed

SF = "/root/testdata/sf0.001"
RATINGS = [(1, 10, 8.0), (1, 11, 1.0), (2, 10, 5.0), (3, 12, 9.0), (4, 12, 9.0), (4, 10, 9.0), (5, 11, 0.0), (1, 10, 2.0)]


def taste(spark):
    return TasteGroups.train(spark.createDataFrame(RATINGS, "user int, item int, rating double"))


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id int")


def lists(df):
    return {r.id: [tuple(m) for m in r.matches] for r in df.collect()}


def brute():
    """Group of each user, and what each group gave each item."""
    of = defaultdict(list)
    for user, _, rating in RATINGS:
        of[user].append(rating)
    group = {u: int(sum(r) / len(r) // WIDTH) for u, r in of.items()}
    given = defaultdict(float)
    for user, item, rating in RATINGS:
        given[group[user], item] += rating
    return group, given


def best(pairs, k):
    return sorted(pairs, key=lambda m: (-m[1], m[0]))[:k]


def test_both_directions_and_features(spark):
    own, (group, given) = taste(spark), brute()
    assert isinstance(own, recommenders.Recommender) and not isinstance(object(), recommenders.ItemRecommender)
    want = {u: best([(i, s) for (g, i), s in given.items() if g == group[u]], 2) for u in group}
    assert lists(recommenders.items_for(own, ids(spark, 1, 1, 2, 3, 4, 5, 99, None), 2)) == want
    users = {i: best([(u, given[g, i]) for u, g in group.items() if (g, i) in given], 2) for i in (10, 11, 12)}
    assert lists(recommenders.users_for(own, ids(spark, 10, 11, 12, 77), 2)) == users
    vectors = spark.createDataFrame([(7, [sum([8.0, 1.0, 2.0]) / 3]), (8, [])], "id int, features array<double>")
    assert lists(recommenders.items_by_features(own, vectors, 2)) == {7: want[1]}
    most = max(group.values())
    scores = spark.createDataFrame([(12, [float(given.get((g, 12), -1.0)) for g in range(most + 1)])], "id int, features array<double>")
    assert [u for u, s in lists(recommenders.users_by_features(own, scores, 2))[12] if s > 0] == [u for u, _ in users[12]]


def test_answers_are_brought_to_the_standard(spark):
    class Odd:
        def items_for_users(self, ids, k):
            every = F.array(*[F.struct(F.lit(i).cast("long").alias("item"), F.lit(9 - i).alias("s")) for i in range(5)])
            rows = ids.select(F.col("id").cast("long").alias("id"), every.alias("matches"))
            return rows.unionAll(rows.select(F.lit(None).cast("long"), "matches")).unionAll(rows.select(F.col("id") + 100, F.slice("matches", 1, 0)))

    got = recommenders.items_for(Odd(), ids(spark, 1, None), 3)
    assert lists(got) == {1: [(0, 9.0), (1, 8.0), (2, 7.0)]}
    assert got.dtypes == [("id", "int"), ("matches", "array<struct<id:int,score:double>>")]


def test_served_with_a_factor_model_or_alone(spark):
    own, factors = taste(spark), model(spark, SF, "batch")
    asked = ids(spark, 1, 2, 3, 4, 5)
    mine, theirs = lists(recommenders.items_for(own, asked, 4)), lists(recommenders.items_for(factors, asked, 4))
    both = lists(merging.serve_items(asked, factors, own, k=4))
    assert both == {u: best(mine.get(u, []) + theirs.get(u, []), 8) for u in {*mine, *theirs}}
    assert lists(merging.serve_items(asked, own, None, k=4, limit=1)) == {u: m[:1] for u, m in mine.items()}
    assert lists(merging.merged_topn_bulk(factors, own, 4)) == {u: best(mine[u] + theirs.get(u, []), 4) for u in mine}
    assert set(lists(merging.merged_topn_bulk(own, factors, 4))) == {r.id for r in factors.users.select("id").collect()}


def run(spark, root, store, n, train=TasteGroups.train):
    stream = messages.read_messages(spark, "text", path=f"{root}/in", maxFilesPerTrigger="1")
    settings = speed.SpeedSettings(rank=5, iterations=2, n=n, train=train)
    speed.run_speed_layer(
        stream, store, f"{root}/lists", f"{root}/log", settings, stop_on_error=True, availableNow=True
    ).awaitTermination()
    return {r.user: r.ids.split(",") for r in tables.read_table(spark, f"{root}/lists", ["user"]).collect()}


def put(spark, root, lines):
    lines.select("value").coalesce(1).write.mode("append").text(f"{root}/in")


@pytest.mark.parametrize("train, read", [(TasteGroups.train, TasteGroups.load), (None, models.load_model)])
def test_a_restart_goes_on_from_the_saved_model(spark, train, read):
    root = fresh_path(spark, "again")
    lines = view(spark, SF, "raw_lines")
    users = sorted(r.user for r in parse_ratings(lines).select("user").distinct().collect())
    small = lambda some: spark.createDataFrame([(f"{u},1,1",) for u in some], "value string")
    put(spark, root, lines)
    first = run(spark, root, speed.ModelStore(versions=f"{root}/models", read=read), 12, train)
    assert set(first) == set(users)
    put(spark, root, small([*users[:3], 10**6]))
    second = run(spark, root, speed.ModelStore(versions=f"{root}/models", read=read), 5, train)
    assert second == {u: ids_[:5] if u in users[:3] else ids_ for u, ids_ in first.items()}
    put(spark, root, small(users[3:5]))
    forgetful = run(spark, root, speed.ModelStore(read=read), 3, train)
    assert forgetful == second


def test_versions_that_broke_off_are_not_found(spark):
    root = fresh_path(spark, "versions")
    one = model(spark, SF, "batch")
    assert models.newest_saved(spark, root) is None
    store = speed.ModelStore(versions=root)
    assert not store.recover(spark)
    saved = models.save_version(one, spark, root, 3)
    spark.range(1).write.parquet(f"{root}/version-{9:012d}-{1:020d}/model/users")
    assert models.newest_saved(spark, root).endswith(saved.rpartition("/")[2]) and store.recover(spark)
    assert store.stream.rank == one.rank and store.stream.users.count() == one.users.count()
    again = models.save_version(FactorModel(one.rank, one.users.limit(1), one.items), spark, root, 3)
    assert models.newest_saved(spark, root).endswith(again.rpartition("/")[2])
    store.install_stream(spark, one, 11)
    assert len(files.children(spark, root)) == speed.KEPT_VERSIONS and store.stream.users.count() == one.users.count()


def test_installed_stream_models_without_a_folder_are_cached(spark):
    store = speed.ModelStore()
    store.install_stream(spark, model(spark, SF, "batch"), 0)
    assert store.stream.users.is_cached
    store.install_stream(spark, taste(spark), 1)
    assert isinstance(store.stream, TasteGroups)
    assert store.load_latest(spark, fresh_path(spark, "none")) is False and models.save_model(
        model(spark, SF, "batch"), fresh_path(spark, "m"), datetime(2024, 1, 1)
    )
