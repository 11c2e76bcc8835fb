import time

import numpy as np
import pytest
from datetime import datetime
from pyspark.sql import functions as F

from pickwell.operators.ratings import parse_ratings
from pickwell.plans import training
from pickwell.plans.views import view
from pickwell.session import fresh_path
from pickwell.sources import models

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ratings(spark):
    return parse_ratings(view(spark, SF, "raw_lines")).persist()


def test_half_step_solves_the_normal_equations(spark):
    rng = np.random.default_rng(0)
    rows = [(int(u), int(i), float(r)) for u, i, r in zip(rng.integers(0, 9, 300), rng.integers(0, 7, 300), rng.normal(size=300))]
    rows += [(3, 4, 5.0)] * 150
    fixed = rng.normal(size=(7, 2))
    pairs = spark.createDataFrame(rows, "user int, item int, rating double").groupBy("user", "item").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("s"))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(fixed)], "id int, features array<double>")
    got = {r.id: r.features for r in training._half_step(pairs, "user", "item", table, 2, 0.1).collect()}
    for user in range(9):
        mine = [(fixed[i], r) for u, i, r in rows if u == user]
        a = sum(np.outer(v, v) for v, _ in mine) + 0.1 * len(mine) * np.eye(2)
        b = sum(v * r for v, r in mine)
        assert np.allclose(got[user], np.linalg.solve(a, b))


def test_both_solvers_reach_about_the_same_error(ratings):
    errors = {
        s: training.rmse(training.train_als(ratings, 5, 8, solver=s), ratings).first().rmse for s in ("blocks", "sums")
    }
    spread = ratings.agg(F.stddev_pop("rating")).first()[0]
    assert max(errors.values()) < spread and abs(errors["blocks"] - errors["sums"]) < 0.15 * spread


def test_unknown_solver(ratings):
    with pytest.raises(ValueError):
        training.train_als(ratings, 2, 1, solver="auto")


@pytest.mark.parametrize("cells", [1, 40, 1 << 22])
def test_half_step_solves_the_normal_equations(spark, monkeypatch, cells):
    monkeypatch.setattr(training, "TERM_CELLS", cells * 9)
    r = np.random.default_rng(1)
    rows = [(int(u), int(i), 1 + int(u) % 2, float(r.normal())) for u in range(7) for i in range(5) if r.random() < 0.8 or u == 3]
    given = {i: r.normal(size=3) for i in range(5)}
    pairs = spark.createDataFrame(rows, "user int, item int, n long, s double").repartition(3)
    fixed = spark.createDataFrame([(i, v.tolist()) for i, v in given.items()], "id int, features array<double>")
    got = {x.id: x.features for x in training._half_step(pairs, "user", "item", fixed, 3, 0.1).collect()}
    for user in {u for u, *_ in rows}:
        mine = [x for x in rows if x[0] == user]
        a = sum(n * np.outer(given[i], given[i]) for _, i, n, _ in mine) + 0.1 * sum(x[2] for x in mine) * np.eye(3)
        assert np.allclose(got.pop(user), np.linalg.solve(a, sum(s * given[i] for _, i, _, s in mine)))
    assert not got


def test_same_seed_same_factors(ratings):
    one, two = (training.train_als(ratings, 3, 2, seed=5).users.orderBy("id").collect() for _ in range(2))
    assert one == two and all(len(r.features) == 3 for r in one)


def test_versions_on_storage(spark, ratings):
    root = fresh_path(spark, "models")
    assert models.latest_model(spark, root) is None
    model = training.train_als(ratings, 2, 1)
    first = models.save_model(model, root, datetime(2024, 12, 31, 10))
    last = models.save_model(model, root, datetime(2025, 1, 1, 9))
    unfinished = f"{root}/20250102/08-00-00_Model"
    model.users.write.parquet(f"{unfinished}/users")
    assert first.endswith("20241231/10-00-00_Model")
    assert models.latest_model(spark, root).endswith(last.split("/", 1)[1].split("/")[-1])
    assert models.load_model(spark, last).rank == 2
    assert models.load_or_keep(spark, unfinished, model) is model
    assert models.load_or_keep(spark, f"{root}/nothing", model) is model


def test_nothing_to_train_on(spark):
    root = fresh_path(spark, "empty")
    done = training.run_batch_training(spark, f"{root}/data", f"{root}/models", f"{root}/versions", datetime(2024, 1, 1))
    assert done is None


def test_the_error_and_the_rest_share_their_shuffles(spark):
    """Ratings go to one side's ids and then to the other's, once for both figures, and are summed where they are."""
    def table(name, rows):
        path = fresh_path(spark, name)
        rows.write.parquet(path)
        return spark.read.parquet(path)

    ids = spark.range(40).selectExpr("cast(id as int) id", "array(1d, cast(id as double)) features")
    model = training.FactorModel(2, table("users", ids.where("id < 30")), table("items", ids))
    ratings = table("ratings", spark.range(900).selectExpr("cast(id % 31 as int) user", "cast(id % 37 as int) item", "cast(id % 7 as double) rating"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for side, n in (("users", 30), ("items", 37)):
            error = training.rmse(model, ratings, side).select("rmse").scalar()
            both = training.rest(model, ratings, side).withColumn("rmse", error)
            assert len(both.collect()) == n
            final = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            # The ratings twice, either side's factors once, and the one row of the error.
            assert final.count("Exchange hashpartitioning") - final.count("ReusedExchange") <= 4 + 4 and "ReusedExchange" in final
            assert training.rest(model, ratings, side)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("cells", [40, 1 << 22])
def test_a_large_fixed_side_goes_to_the_pairs_in_pieces(spark, monkeypatch, cells):
    """Before, pairs were shuffled by it, and then about a row of sums per pair."""
    monkeypatch.setattr(training, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(training, "TERM_CELLS", cells)
    r = np.random.default_rng(1)
    rows = [(int(u), int(i), 1 + int(u) % 2, float(r.normal())) for u in range(9) for i in range(40) if r.random() < 0.8 or u == 3]
    given = {i: r.normal(size=3) for i in range(38)}
    path = fresh_path(spark, "rows")
    spark.createDataFrame(rows, "user int, item int, n long, s double").repartition(3).write.parquet(f"{path}/pairs")
    spark.createDataFrame([(i, v.tolist()) for i, v in given.items()], "id int, features array<double>").write.parquet(f"{path}/fixed")
    pairs, fixed = spark.read.parquet(f"{path}/pairs"), spark.read.parquet(f"{path}/fixed")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = training._half_step(pairs, "user", "item", fixed, 3, 0.1)
        plan = step._jdf.queryExecution().executedPlan().toString()
        got = {x.id: x.features for x in step.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "Join" not in plan
    for user in {u for u, *_ in rows}:
        mine = [x for x in rows if x[0] == user and x[1] in given]
        a = sum(n * np.outer(given[i], given[i]) for _, i, n, _ in mine) + 0.1 * sum(x[2] for x in mine) * np.eye(3)
        assert np.allclose(got.pop(user), np.linalg.solve(a, sum(s * given[i] for _, i, _, s in mine)))
    assert not got


def test_pieces_do_not_change_the_fit(ratings, monkeypatch):
    whole = {r.id: r.features for r in training.train_als(ratings, 3, 2, solver="sums").items.collect()}
    monkeypatch.setattr(training, "BROADCAST_BYTES", 1000)
    pieces = {r.id: r.features for r in training.train_als(ratings, 3, 2, solver="sums").items.collect()}
    assert whole.keys() == pieces.keys() and all(np.allclose(whole[i], pieces[i]) for i in whole)


def test_sums_leave_no_shuffle_behind(spark, ratings):
    """Before, all shuffles of all half steps lay on disk until the driver collected its garbage."""
    ratings.count()

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while found.hasNext():
            names.add(found.next().getName())
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    before = files()
    training.train_als(ratings, 3, 2, solver="sums")
    for _ in range(50):  # removed in the background
        left = files() - before
        if len(left) <= 4:
            break
        time.sleep(0.2)
    # What remains is of the count of ids, four tasks with a few bytes each.
    assert len(left) <= 4
