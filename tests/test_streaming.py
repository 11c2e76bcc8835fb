from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pickwell.model import FactorModel
from pickwell.operators.ratings import parse_ratings
from pickwell.plans.views import model, view
from pickwell.session import fresh_path, shared_dir
from pickwell.sources import catalog, files, messages, models, tables
from pickwell.streaming import speed, updates

SF = "/root/testdata/sf0.001"
SETTINGS = speed.SpeedSettings(rank=5, iterations=2, n=12)


def texts(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_gate(spark):
    assert not speed.is_large(spark.range(100), 100)
    assert speed.is_large(spark.range(101), 100)
    assert speed.speed_batch(texts(spark), speed.ModelStore()) is None
    assert speed.speed_batch(texts(spark, "1,2,3"), speed.ModelStore()) is None


def test_small_batches_look_up_and_large_ones_train(spark):
    root = fresh_path(spark, "speed")
    lines = view(spark, SF, "raw_lines").select("value")
    users = [r.user for r in model(spark, SF, "batch").users.select(F.col("id").alias("user")).limit(5).collect()]
    small = texts(spark, *[f"{u},1,2" for u in users], "99999,1,2", "broken")
    small.coalesce(1).write.text(f"{root}/in")
    store = speed.ModelStore()
    store.swap(batch=model(spark, SF, "batch"))

    def go():
        stream = messages.read_messages(spark, "text", path=f"{root}/in", maxFilesPerTrigger="1")
        speed.run_speed_layer(
            stream, store, f"{root}/lists", f"{root}/log", SETTINGS, stop_on_error=True, availableNow=True
        ).awaitTermination()
        return {r.user: r.ids for r in tables.read_table(spark, f"{root}/lists", ["user"]).collect()}

    first = go()
    assert set(first) == set(users) and store.stream is None
    lines.coalesce(1).write.mode("append").text(f"{root}/in")
    second = go()
    trained = {r.user for r in parse_ratings(lines).select("user").distinct().collect()}
    assert set(second) == trained | set(users) and store.stream is not None
    assert all(len(ids.split(",")) == 12 for ids in second.values())
    assert go() == second


def test_a_failing_batch_does_not_end_the_stream(spark):
    root = fresh_path(spark, "fails")
    texts(spark, "1,2,3").write.text(f"{root}/in")

    def fail():
        raise RuntimeError("no model today")

    stream = messages.read_messages(spark, "text", path=f"{root}/in")
    run = speed.run_speed_layer(
        stream, speed.ModelStore(), f"{root}/lists", f"{root}/log", SETTINGS, before_batch=fail, availableNow=True
    )
    run.awaitTermination()
    assert run.exception() is None and not tables.table_exists(spark, f"{root}/lists")


def test_model_versions_are_followed_and_bad_paths_ignored(spark):
    root = fresh_path(spark, "follow")
    saved = models.save_model(model(spark, SF, "batch"), f"{root}/models", datetime(2024, 1, 1))
    store = speed.ModelStore()
    assert store.load_latest(spark, f"{root}/models") and store.batch.rank == 5
    before = store.batch
    models.publish_model(spark, f"{root}/versions", f"{root}/gone", datetime(2024, 1, 2))

    def go():
        stream = models.model_versions(spark, f"{root}/versions", stream=True)
        speed.follow_models(stream, store, f"{root}/log", availableNow=True).awaitTermination()

    go()
    assert store.batch is before
    newer = models.save_model(model(spark, SF, "speed"), f"{root}/models", datetime(2024, 1, 3))
    models.publish_model(spark, f"{root}/versions", newer, datetime(2024, 1, 3))
    go()
    assert store.batch is not before and store.batch_path == newer != saved


def follow_updates(spark, root, changes, rank=None):
    """Run the stream over what lies under ``root``, tables created where missing."""
    for side in ("users", "items"):
        tables.create_table(spark, f"{root}/{side}", "id int, seq bigint, features array<double>")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    paths = f"{root}/users", f"{root}/items"
    updates.run_factor_updates(stream, *paths, f"{root}/log", rank, availableNow=True).awaitTermination()
    return updates.updated_model(spark, *paths, f"{root}/log", rank)


def sides(found):
    return [sorted((r.id, r.features) for r in getattr(found, side).collect()) for side in ("users", "items")]


@pytest.mark.parametrize("backwards", [False, True])
def test_updates_arriving_in_many_batches(spark, backwards):
    """Also the newest first: what came before does not undo it."""
    root = fresh_path(spark, "updates")
    changes = view(spark, SF, "updates").persist()
    lows = range(0, 1000, 250)
    for low in reversed(lows) if backwards else lows:
        part = changes.where((F.col("seq") >= low) & (F.col("seq") < low + 250))
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        found = follow_updates(spark, root, changes, 5)
        if low == 500:
            for side in ("users", "items"):
                tables.compact(spark, f"{root}/{side}", ["id"], order="seq")
    want = updates.apply_factor_updates(None, changes.where(F.size("feature") == 5))
    assert want.rank == found.rank == 5 and sides(found) == sides(want)


def test_a_stream_without_a_rank_takes_that_of_its_first_update(spark):
    root = fresh_path(spark, "first")
    schema = "seq int, tbl string, option string, id int, feature array<double>"
    batches = [
        [(1, "User", "Remove", 9, None), (2, "Shop", "Update", 1, [1.0])],
        [(3, "User", "Update", 1, [1.0, 2.0]), (4, "User", "Update", 2, [5.0])],
        [(5, "User", "Update", 1, [9.0]), (6, "Item", "Update", 7, [3.0, 4.0]), (7, "User", "Remove", 3, None)],
        [(0, "Item", "Update", 7, [0.0, 0.0]), (8, "Item", "Drop", 7, None), (6, "User", "Update", 3, [1.0, 1.0])],
    ]
    rows, found = [], []
    for batch in batches:
        rows += batch
        changes = spark.createDataFrame(batch, schema)
        changes.coalesce(1).write.mode("append").parquet(f"{root}/in")
        found.append(follow_updates(spark, root, changes))
    assert found[0] is None and [m.rank for m in found[1:]] == [2, 2, 2]
    want = updates.apply_factor_updates(FactorModel(2, *(spark.createDataFrame([], "id int, features array<double>"),) * 2), spark.createDataFrame(rows, schema))
    assert sides(found[-1]) == sides(want) == [[(1, [1.0, 2.0])], [(7, [3.0, 4.0])]]


def test_first_update_fixes_the_rank(spark):
    schema = "seq int, tbl string, option string, id int, feature array<double>"
    rows = [(1, "User", "Remove", 9, None), (2, "User", "Update", 1, [1.0, 2.0]), (3, "User", "Update", 1, [5.0]),
            (4, "Item", "Update", 1, [3.0, 4.0]), (5, "Shop", "Update", 2, [3.0, 4.0]), (6, "Item", "Drop", 1, None)]
    found = updates.apply_factor_updates(None, spark.createDataFrame(rows, schema))
    assert found.rank == 2
    assert [tuple(r) for r in found.users.collect()] == [(1, [1.0, 2.0])]
    assert [tuple(r) for r in found.items.collect()] == [(1, [3.0, 4.0])]
    assert updates.apply_factor_updates(None, spark.createDataFrame(rows[:1], schema)) is None


def land(spark, root, rows):
    schema = "value string, day string, hour string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    messages.land_stream(stream, f"{root}/out", f"{root}/log", availableNow=True).awaitTermination()


def test_landing_twice_and_reading_the_newest_days(spark):
    root = fresh_path(spark, "land")
    for day in ("20231231", "20240101", "20240102"):
        land(spark, root, [(f"{day}-{i}", day, f"{i:02d}") for i in range(3)])
    got = sorted(r.value for r in messages.read_latest(spark, f"{root}/out", 2).collect())
    assert got == [f"{d}-{i}" for d in ("20240101", "20240102") for i in range(3)]
    assert len(messages.latest_dirs(spark, f"{root}/out", 9, by="mtime")) == 3
    assert all("/day=20240102/" in f for f in messages.read_latest(spark, f"{root}/out", 1).inputFiles())
    assert messages.read_latest(spark, f"{root}/nothing", 2).count() == 0


def test_closed_hours_are_folded_once_and_lose_nothing(spark):
    root = fresh_path(spark, "fold")
    out = f"{root}/out"
    lines = lambda: sorted(r.value for r in messages.read_latest(spark, out, 9).collect())
    folders = lambda hour: [e.name for e in files.children(spark, f"{out}/day=20240101/hour={hour}")]
    want = []
    for batch in range(4):
        rows = [(f"{batch}-{i}", "20240101", f"{i % 3:02d}") for i in range(60)]
        want += [r[0] for r in rows]
        land(spark, root, rows)
    assert len(folders("00")) == 4 and lines() == sorted(want)
    assert messages.fold_hours(spark, out, before="2024010102", files=2) == 2
    assert folders("00") == folders("01") == [f"batch={3:012d}", f"batch=f{2:012d}"] and len(folders("02")) == 4
    parts = [e for e in files.children(spark, f"{out}/day=20240101/hour=00/batch=f{2:012d}") if e.name.endswith(".txt")]
    assert len(parts) <= 2 and lines() == sorted(want)
    assert messages.fold_hours(spark, out, before="2024010102", files=2) == 0
    land(spark, root, [("late", "20240101", "00")])
    want.append("late")
    kept = spark.read.text(f"{out}/day=20240101/hour=00/batch={3:012d}").collect()
    assert messages.fold_hours(spark, out, running=False) == 3 and lines() == sorted(want)
    assert folders("00") == [f"batch=f{4:012d}"] and folders("01") == [f"batch=f{4:012d}"]
    # What a fold that broke off before the end would leave: readers and the next fold take no line twice.
    spark.createDataFrame(kept, "value string").write.text(f"{out}/day=20240101/hour=00/batch={3:012d}")
    assert lines() == sorted(want) and messages.fold_hours(spark, out, running=False) == 0
    assert folders("00") == [f"batch=f{4:012d}"] and lines() == sorted(want)


def test_a_fold_gives_every_file_a_task(spark, monkeypatch):
    root = fresh_path(spark, "spread")
    rows = [(f"line {i}", "20240101", f"{i % 4:02d}") for i in range(2000)]
    land(spark, root, rows)
    tasks, write = [], messages._write_folders
    with_task = lambda df: df.select("day", "hour", F.spark_partition_id().alias("task"))
    monkeypatch.setattr(messages, "_write_folders", lambda df, at: (tasks.extend(with_task(df).distinct().collect()), write(df, at)))
    assert messages.fold_hours(spark, f"{root}/out", files=3, running=False) == 4
    assert len({t.task for t in tasks}) == len(tasks) == 12
    assert sorted(r.value for r in messages.read_latest(spark, f"{root}/out", 1).collect()) == sorted(r[0] for r in rows)


def test_a_repeated_batch_replaces_its_folders(spark):
    out = fresh_path(spark, "twice")
    rows = spark.createDataFrame([("a", "20240101", "00", "000000000000"), ("b", "20240101", "01", "000000000000")], "value string, day string, hour string, batch string")
    for _ in range(2):
        messages._write_folders(rows, out)
    assert sorted(r.value for r in messages.read_latest(spark, out, 1).collect()) == ["a", "b"]


def test_newest_days_among_other_folders(spark):
    root = fresh_path(spark, "days")
    for name in ("20240101", "day=20240102", "20240103/05", "tmp", "zz"):
        spark.createDataFrame([(name,)], "value string").write.text(f"{root}/{name}")
    read = lambda n: sorted(r.value for r in messages.read_latest(spark, root, n).collect())
    assert read(2) == ["20240103/05", "day=20240102"]
    assert read(9) == ["20240101", "20240103/05", "day=20240102"]
    with pytest.raises(ValueError):
        messages.read_latest(spark, f"{root}/20240103", 1)


def test_arrival_uses_the_calendar_year(spark):
    df = spark.sql("SELECT 'x' AS value, TIMESTAMP '2024-12-31 23:10:00' AS at")
    row = messages.with_arrival(df, F.col("at")).first()
    assert (row.day, row.hour) == ("20241231", "23")


def test_keyed_table(spark):
    path = fresh_path(spark, "table")
    tables.create_table(spark, path, "k int, v string")
    tables.create_table(spark, path, "k int, v string")
    put = lambda batch, **rows: tables.upsert(
        spark.createDataFrame([(int(k[1:]), v, v == "") for k, v in rows.items()], "k int, v string, gone boolean"),
        path, ["k"], writer=str(batch), deleted="gone")
    read = lambda: dict(tuple(r) for r in tables.read_table(spark, path, ["k"]).collect())
    assert read() == {}
    put(1, k1="a", k2="b")
    put(2, k2="c", k3="d")
    put(2, k2="c", k3="d")
    put(3, k1="")
    assert read() == {2: "c", 3: "d"}
    tables.compact(spark, path, ["k"])
    assert read() == {2: "c", 3: "d"}
    put(4, k1="again")
    tables.compact(spark, path, ["k"])
    assert read() == {1: "again", 2: "c", 3: "d"}
    assert len(files.children(spark, path)) == 1
    spark.createDataFrame([(9, "half", False, 1)], "k int, v string, deleted boolean, version bigint").write.parquet(f"{path}/part-{1:020d}-x/broken")
    assert 9 not in read()
    put(1, k2="a batch number of a stream that starts anew comes last")
    assert read()[2].startswith("a batch number")
    double = spark.createDataFrame([(7, "x", 1), (7, "z", 2), (7, "y", 3), (8, "v", 1)], "k int, v string, at int")
    tables.upsert(double.select("k", "v"), path, ["k"])
    assert {k: v for k, v in read().items() if k > 6} == {7: "z", 8: "v"}
    other = fresh_path(spark, "ordered")
    tables.upsert(double, other, ["k"], order="at")
    assert {r.k: r.v for r in tables.read_table(spark, other, ["k"]).collect()} == {7: "y", 8: "v"}
    late = fresh_path(spark, "late")
    for at, v in ((5, "new"), (3, "old")):
        row = spark.createDataFrame([(1, at, v), (2, at, v)], "k int, at int, v string")
        tables.upsert(row.withColumn("gone", F.col("k") + F.col("at") == 7), late, ["k"], order="at", deleted="gone")
    assert [tuple(r) for r in tables.read_table(spark, late, ["k"], order="at").collect()] == [(1, 5, "new")]
    assert sorted(r.v for r in tables.read_table(spark, late, ["k"]).collect()) == ["old", "old"]
    assert tables.drop_table(spark, path) and not tables.table_exists(spark, path)


def test_bucketed_tables_join_without_an_exchange(spark):
    name = f"bucketed_{fresh_path(spark, '').rpartition('-')[2]}"
    assert not catalog.table_exists(spark, name) and not catalog.drop_table(spark, name)
    catalog.create_bucketed(spark, name, "k int, v string", ["k"], 4)
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "k int, v string")
    catalog.append_rows(rows.select("v", "k").limit(60), name, ["k"], 4)
    catalog.create_bucketed(spark, name, "k int, v string", ["k"], 4)
    catalog.append_rows(rows.subtract(rows.limit(60)), name, ["k"], 4)
    mine = catalog.read_rows(spark, name)
    joined = mine.hint("merge").join(mine.withColumnRenamed("v", "w"), "k")
    grouped = mine.groupBy("k").count()
    for df in (joined, grouped):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 100
    assert catalog.drop_table(spark, name) and not catalog.table_exists(spark, name)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_swap_releases_the_old_model(spark):
    one, two = (FactorModel(5, view(spark, SF, "batch_users").limit(n), view(spark, SF, "batch_items").limit(n)) for n in (3, 4))
    store = speed.ModelStore()
    store.swap(stream=one)
    assert store.stream.users.is_cached
    store.swap(stream=two)
    assert store.stream is two and not one.users.is_cached


@pytest.mark.parametrize("bad", ["batch", "best"])
def test_merge_options_are_checked(spark, bad):
    from pickwell.operators.merging import merged_topn_bulk

    both = model(spark, SF, "batch"), model(spark, SF, "speed")
    with pytest.raises(ValueError):
        merged_topn_bulk(*both, n=2, vector_source=bad if bad == "best" else "stream", dedupe="none" if bad == "best" else bad)
