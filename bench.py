"""Times the headline queries; prints one JSON line.

Inputs are materialised once (models, lists) as they would be in use; each
query is run once to warm up, then three times, and the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from pyspark.sql import functions as F

from pickwell.operators import candidates as K
from pickwell.operators import factors as X
from pickwell.operators import fusion, merging, paging, ratings, scoring
from pickwell.plans import serving, training
from pickwell.plans.views import RANK, as_lists, view
from pickwell.model import FactorModel
from pickwell.session import fresh_path, local_session
from pickwell.sources import tables
from pickwell.streaming import speed

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def stored(spark, df, name):
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, "bench")
    sides = {n: stored(spark, view(spark, SF, n), n) for n in ("batch_users", "batch_items", "speed_users", "speed_items")}
    batch = FactorModel(RANK, sides["batch_users"], sides["batch_items"])
    fast = FactorModel(RANK, sides["speed_users"], sides["speed_items"])
    lines = stored(spark, view(spark, SF, "raw_lines").select("value"), "lines")
    parsed = ratings.parse_ratings(lines).persist()
    parsed.count()
    trained = training.train_als(parsed, rank=5, iterations=10)
    trained = FactorModel(5, stored(spark, trained.users, "users"), stored(spark, trained.items, "items"))
    bought = stored(spark, as_lists(view(spark, SF, "bought")), "bought")
    top_list = stored(spark, view(spark, SF, "top_list"), "top")
    listed = stored(spark, as_lists(view(spark, SF, "stored"), "offset"), "stored")
    asked = stored(spark, paging.normalise_requests(view(spark, SF, "requests")).where("valid"), "requests")
    users = stored(spark, view(spark, SF, "user_ids").withColumnRenamed("id", "user"), "ids")
    cids, params = view(spark, SF, "cids").persist(), stored(spark, view(spark, SF, "params"), "params")
    pairs = stored(spark, view(spark, SF, "pairs"), "pairs")
    sources = [K.Source(1, "mode", bought), K.Source(2, "list", top_list)]
    small, large = lines.limit(100), lines.limit(10_000)
    small, large = stored(spark, small, "small"), stored(spark, large, "large")
    settings = speed.SpeedSettings(rank=RANK, iterations=10, n=1000)

    def micro_batch(batch_lines):
        store = speed.ModelStore(batch=batch, stream=None)
        tables.write_lists(speed.speed_batch(batch_lines, store, settings), fresh_path(spark, "out"))

    def units():
        return K.pull_all(K.quotas(users, cids, params, 2000), sources)

    def pulled():
        return K.pull_lists(K.quotas(users, cids, params, 2000), sources)

    grid = {"broadcast_bytes": 0, "cell_rows": 2_048}
    cached = stored(spark, as_lists(view(spark, SF, "cached"), "offset", "begin_time"), "cached")

    def answered():
        done = serving.answer(view(spark, SF, "requests"), cached, listed, bought, 0)
        for part in (done.responses, done.cache, done.stored):
            run(part)

    queries = {
        "parse_ratings": lambda: run(ratings.parse_ratings(lines)),
        "train_als": lambda: run(training.train_als(parsed, rank=5, iterations=10).users),
        "predict_pairs": lambda: run(scoring.predict(batch, pairs)),
        "merge_models": lambda: run(X.merge_models(batch, fast).users),
        "items_for_all_users_10": lambda: run(scoring.items_for_all_users(batch, 10)),
        "items_for_all_users_als_10": lambda: run(scoring.items_for_all_users(trained, 10)),
        "items_for_all_users_1000": lambda: run(scoring.items_for_all_users(batch, 1000)),
        "items_for_all_users_5000": lambda: run(scoring.items_for_all_users(batch, 5000)),
        "items_for_all_users_grid_1000": lambda: run(scoring.items_for_all_users(batch, 1000, **grid)),
        "serve_items_1000": lambda: run(merging.serve_items(users.withColumnRenamed("user", "id"), batch, fast, 1000)),
        "merged_topn_bulk_1000": lambda: run(merging.merged_topn_bulk(batch, fast, 1000, dedupe="max")),
        "fuse_rank": lambda: run(fusion.fused_rows(pulled())),
        "fuse_rank_rows": lambda: run(fusion.rank_fused(fusion.fuse(units(), [1, 2]))),
        "serving_list": lambda: run(fusion.listed(fusion.fused_lists(pulled()), 0)),
        "page_stored_many": lambda: run(paging.page_stored(asked, listed)),
        "answer": answered,
        "speed_batch_100": lambda: micro_batch(small),
        "speed_batch_10000": lambda: micro_batch(large),
    }
    only = os.environ.get("BENCH_ONLY")
    times = {}
    for name, query in queries.items():
        if only and name not in only.split(","):
            continue
        taken = []
        for i in range(RUNS + 1):
            start = time.perf_counter()
            query()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(SF).name.removeprefix("sf"), "cpus": CPUS,
    }))


if __name__ == "__main__":
    main()
