"""One query per operator, each over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwell.functions.columns import decode_ids, encode_ids, next_offset
from pickwell.functions.frames import union_all
from pickwell.model import FactorModel
from pickwell.operators import cache as C
from pickwell.operators import candidates as K
from pickwell.operators import factors as X
from pickwell.operators import fusion, merging, paging, ratings, recommenders, scoring
from pickwell.plans import serving, training
from pickwell.plans.taste import TasteGroups
from pickwell.plans.views import DAY_MS, FIRST_DAY, NOW, RANK, as_lists, model, model_lines, view
from pickwell.plans.views import models as models_of
from pickwell.plans.views import stored as _held
from pickwell.session import fresh_path
from pickwell.sources import catalog, messages, models, tables
from pickwell.streaming import answering, speed, updates

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _both(spark: SparkSession, sf: str) -> tuple[FactorModel, FactorModel]:
    batch, fast = models_of(spark, sf, "batch", "speed")
    return batch, fast


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    """Factor rows as one row per element."""
    return df.select(*keys, F.posexplode("features").alias("pos", "value"))


def _two_sides(users: DataFrame, items: DataFrame) -> DataFrame:
    return union_all(users.select(F.lit("users").alias("side"), "*"), items.select(F.lit("items").alias("side"), "*"))


# Parsing and codecs


@query
def parse_ratings_drop(spark, sf):
    return ratings.parse_ratings(view(spark, sf, "raw_lines"))


@query
def parse_ratings_default(spark, sf):
    return ratings.parse_ratings(view(spark, sf, "raw_lines"), on_malformed="default")


@query
def custom_parser(spark, sf):
    def halves(lines: DataFrame) -> DataFrame:
        return ratings.parse_ratings(lines).withColumn("rating", F.col("rating") / 2)

    return ratings.apply_parser(view(spark, sf, "raw_lines"), halves)


@query
def triples_to_ratings(spark, sf):
    return ratings.triples_to_ratings(view(spark, sf, "triples"))


@query
def id_list_codec(spark, sf):
    texts = as_lists(view(spark, sf, "bought")).select("user", encode_ids(F.col("items")).alias("ids"))
    back = decode_ids(F.col("ids"))
    total = F.aggregate(back, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return texts.select("user", "ids", F.size(back).alias("n"), total.alias("total"))


# Factor tables


@query
def valid_features(spark, sf):
    checked = X.valid_features(view(spark, sf, "updates").withColumnRenamed("feature", "features"), RANK)
    return checked.select("seq", "valid")


@query
def factor_lookup(spark, sf):
    found = X.user_factors(model(spark, sf, "batch"), view(spark, sf, "user_ids"))
    return found.select("id", F.posexplode_outer("features").alias("pos", "value"))


@query
def item_factor_lookup(spark, sf):
    found = X.item_factors(model(spark, sf, "speed"), view(spark, sf, "item_ids"))
    return found.select("id", F.posexplode_outer("features").alias("pos", "value"))


@query
def has_users(spark, sf):
    return X.has_users(model(spark, sf, "batch"), view(spark, sf, "user_ids"))


@query
def has_items(spark, sf):
    return X.has_items(model(spark, sf, "speed"), view(spark, sf, "item_ids"))


@query
def user_ids(spark, sf):
    return X.user_ids(model(spark, sf, "whole"))


@query
def item_ids(spark, sf):
    return X.item_ids(model(spark, sf, "whole"))


@query
def drop_null(spark, sf):
    return X.drop_null(view(spark, sf, "requests"))


@query
def model_summary(spark, sf):
    batch, fast = _both(spark, sf)
    return X.model_summary({"batch": batch, "speed": fast})


@query
def resolve_factors(spark, sf):
    batch, fast = _both(spark, sf)
    return _flat(X.resolve_factors(view(spark, sf, "user_ids"), batch.users, fast.users), "id")


@query
def prune_speed(spark, sf):
    batch, fast = _both(spark, sf)
    left = X.prune_speed(fast, batch)
    return _flat(_two_sides(left.users, left.items), "side", "id")


@query
def merge_models(spark, sf):
    batch, fast = _both(spark, sf)
    merged = X.merge_models(batch, fast, weight=0.8)
    return _flat(_two_sides(merged.users, merged.items), "side", "id", "is_new")


@query
def recent_new(spark, sf):
    return X.recent_new(X.merge_models(*_both(spark, sf)))


@query
def as_speed_model(spark, sf):
    return _flat(X.as_speed_model(model(spark, sf, "whole")).items, "id")


# Scoring


@query
def predict_pairs(spark, sf):
    return scoring.predict(model(spark, sf, "batch"), view(spark, sf, "pairs"))


@query
def items_for_features(spark, sf):
    return scoring.ranked(scoring.items_for_features(view(spark, sf, "vectors"), model(spark, sf, "whole"), 20))


@query
def users_for_features(spark, sf):
    found = scoring.users_for_features(view(spark, sf, "vectors"), model(spark, sf, "whole"), 20)
    return scoring.ranked(found, "item", "user")


@query
def items_for_users_subset(spark, sf):
    found = scoring.items_for_users_subset(view(spark, sf, "event_users"), model(spark, sf, "batch"), 50)
    return scoring.ranked(found)


@query
def users_for_items_subset(spark, sf):
    found = scoring.users_for_items_subset(view(spark, sf, "item_ids"), model(spark, sf, "batch"), 10)
    return scoring.ranked(found, "item", "user")


@query
def items_for_all_users(spark, sf):
    return scoring.ranked(scoring.items_for_all_users(model(spark, sf, "whole"), 10))


@query
def items_for_all_users_grid(spark, sf):
    """The same with neither side broadcast."""
    found = scoring.items_for_all_users(model(spark, sf, "whole"), 10, broadcast_bytes=0, cell_rows=500)
    return scoring.ranked(found)


@query
def users_for_all_items(spark, sf):
    return scoring.ranked(scoring.users_for_all_items(model(spark, sf, "whole"), 10), "item", "user")


@query
def items_for_factor_table(spark, sf):
    batch, fast = _both(spark, sf)
    return scoring.ranked(scoring.items_for_factor_table(fast.users, batch, 10))


@query
def speed_items_for_users(spark, sf):
    found = scoring.items_for_users_subset(view(spark, sf, "user_ids"), model(spark, sf, "speed"), 10)
    return scoring.ranked(found)


@query
def speed_users_for_items(spark, sf):
    found = scoring.users_for_items_subset(view(spark, sf, "item_ids"), model(spark, sf, "speed"), 10)
    return scoring.ranked(found, "item", "user")


@query
def speed_users_for_features(spark, sf):
    found = scoring.users_for_features(view(spark, sf, "vectors"), model(spark, sf, "speed"), 20)
    return scoring.ranked(found, "item", "user")


@query
def speed_items_for_features(spark, sf):
    return scoring.ranked(scoring.items_for_features(view(spark, sf, "vectors"), model(spark, sf, "speed"), 20))


@query
def merged_topn_bulk(spark, sf):
    return scoring.ranked(merging.merged_topn_bulk(*_both(spark, sf), n=25))


@query
def merged_topn_bulk_best(spark, sf):
    found = merging.merged_topn_bulk(*_both(spark, sf), n=25, vector_source="batch", dedupe="max")
    return scoring.ranked(found)


@query
def merged_topn_users(spark, sf):
    return scoring.ranked(merging.merged_topn_users(view(spark, sf, "event_users"), *_both(spark, sf), n=100))


@query
def serve_items(spark, sf):
    return scoring.ranked(merging.serve_items(view(spark, sf, "user_ids"), *_both(spark, sf), k=15))


@query
def serve_users(spark, sf):
    return scoring.ranked(merging.serve_users(view(spark, sf, "item_ids"), *_both(spark, sf), k=10), "item", "user")


# Recommenders of the caller's own


def _texts(spark: SparkSession, sf: str, lines: DataFrame) -> DataFrame:
    """The text lines of the lines that models are made of, which have no date."""
    return view(spark, sf, "raw_lines", lines.withColumn("ordered", F.lit(None).cast("timestamp"))).drop("ordered")


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """The text lines, joined once and stored."""
    return _held(view(spark, sf, "raw_lines").select("cust", "n", "value"), "raw-lines")


def _taste(lines: DataFrame, where: str) -> TasteGroups:
    """Groups by taste from some of the lines, stored."""
    trained = TasteGroups.train(_held(ratings.parse_ratings(lines.where(where)), "ratings"))
    return TasteGroups(_held(trained.members, "members"), _held(trained.scores, "scores"))


@query
def serve_own_items(spark, sf):
    """Two recommenders without factors behind the same serving call."""
    lines = _raw(spark, sf)
    found = merging.serve_items(view(spark, sf, "user_ids"), _taste(lines, "n <= 4"), _taste(lines, "n >= 4"), k=15)
    return scoring.ranked(found)


@query
def serve_own_users(spark, sf):
    lines = _raw(spark, sf)
    found = merging.serve_users(view(spark, sf, "item_ids"), _taste(lines, "n <= 4"), _taste(lines, "n >= 4"), k=10)
    return scoring.ranked(found, "item", "user")


@query
def serve_mixed_items(spark, sf):
    """A factor model and a recommender without factors, each answering for itself."""
    lines = model_lines(spark, sf)
    (batch,) = models_of(spark, sf, "batch", lines=lines)
    found = merging.serve_items(view(spark, sf, "user_ids"), batch, _taste(_texts(spark, sf, lines), "n >= 4"), k=15)
    return scoring.ranked(found)


@query
def own_items_for_features(spark, sf):
    """Users of the later lines, described to the other recommender by their mean rating."""
    lines = _raw(spark, sf)
    later = ratings.parse_ratings(lines.where("n >= 4"))
    vectors = later.groupBy(F.col("user").alias("id")).agg(F.array(F.avg("rating")).alias("features"))
    return scoring.ranked(recommenders.items_by_features(_taste(lines, "n <= 4"), vectors, 8))


@query
def speed_layer_own(spark, sf):
    """Three batches of messages train a recommender each; lists of all their users, merged with the batch recommender's."""
    root = fresh_path(spark, "speed")
    lines = _raw(spark, sf)
    store = speed.ModelStore(batch=_taste(lines, "n <= 4"))
    # The stream goes on after each batch has landed, so that a batch may be many files.
    for part in range(3):
        lines.where(F.col("cust") % 3 == part).select("value").write.mode("append").text(f"{root}/in")
        speed.run_speed_layer(
            messages.read_messages(spark, "text", path=f"{root}/in"), store, f"{root}/lists", f"{root}/log",
            speed.SpeedSettings(n=12, train=TasteGroups.train), stop_on_error=True, availableNow=True,
        ).awaitTermination()
    return tables.read_table(spark, f"{root}/lists", ["user"])


@query
def speed_restart(spark, sf):
    """A large batch trains and saves a model; a new process finds it again and serves a small batch of at most 100 lines from it."""
    root = fresh_path(spark, "restart")
    lines = view(spark, sf, "raw_lines")

    def go(n: int) -> None:
        store = speed.ModelStore(versions=f"{root}/models", read=TasteGroups.load)
        stream = messages.read_messages(spark, "text", path=f"{root}/in")
        settings = speed.SpeedSettings(n=n, train=TasteGroups.train)
        speed.run_speed_layer(
            stream, store, f"{root}/lists", f"{root}/log", settings, stop_on_error=True, availableNow=True
        ).awaitTermination()

    lines.select("value").write.text(f"{root}/in")
    go(12)
    asked = view(spark, sf, "user_ids").where("id < 60").select(F.format_string("%d,1,1", "id").alias("value"))
    asked.coalesce(1).write.mode("append").text(f"{root}/in")
    go(7)
    return tables.read_table(spark, f"{root}/lists", ["user"])


# Training and model versions


@query
def als_factor_ids(spark, sf):
    parsed = ratings.parse_ratings(view(spark, sf, "raw_lines"))
    trained = training.train_als(parsed, rank=5, iterations=3)
    return _two_sides(X.user_ids(trained), X.item_ids(trained))


def _fitted(trained: FactorModel, parsed: DataFrame, side: str) -> DataFrame:
    """Whether the side solved last is at rest, per id, and whether the fit beats always predicting the mean."""
    spread = parsed.agg(F.stddev_pop("rating")).scalar()
    learned = training.rmse(trained, parsed, side).select(F.col("rmse") < spread).scalar()
    return training.rest(trained, parsed, side).select("id", "n", (F.col("gradient") < 1e-4).alias("at_rest"), learned.alias("learned"))


@query
def train_als(spark, sf):
    parsed = _held(ratings.parse_ratings(view(spark, sf, "raw_lines")), "ratings")
    trained = training.train_als(parsed, rank=5, iterations=10)
    held = FactorModel(5, _held(trained.users, "users"), _held(trained.items, "items"))
    return _fitted(held, parsed, "users")


@query
def train_als_by_sums(spark, sf):
    """The same with the solver for hot ids, which solves items last."""
    parsed = _held(ratings.parse_ratings(view(spark, sf, "raw_lines")), "ratings")
    return _fitted(training.train_als(parsed, rank=5, iterations=4, solver="sums"), parsed, "items")


@query
def run_batch_training(spark, sf):
    """Land, train on the newest folders, save, announce, load what was announced."""
    root = fresh_path(spark, "train")
    _land(view(spark, sf, "raw_lines"), f"{root}/data")
    training.run_batch_training(
        spark, f"{root}/data", f"{root}/models", f"{root}/versions", datetime(2001, 9, 1), days=10, rank=5, iterations=3
    )
    path = models.newest_version(models.model_versions(spark, f"{root}/versions")).first().path
    loaded = models.load_model(spark, path)
    return _two_sides(X.user_ids(loaded), X.item_ids(loaded))


@query
def save_load_model(spark, sf):
    root = fresh_path(spark, "models")
    for one, day in zip(models_of(spark, sf, "speed", "whole"), (1, 2)):
        models.save_model(one, root, datetime(2024, 1, day))
    loaded = models.load_model(spark, models.latest_model(spark, root))
    return _flat(_two_sides(loaded.users, loaded.items), "side", "id")


@query
def follow_models(spark, sf):
    """Two models announced one after the other; the one installed last."""
    root = fresh_path(spark, "follow")
    for one, day in zip(models_of(spark, sf, "speed", "whole"), (1, 2)):
        path = models.save_model(one, f"{root}/models", datetime(2024, 1, day))
        models.publish_model(spark, f"{root}/versions", path, datetime(2024, 1, day))
    store = speed.ModelStore()
    versions = models.model_versions(spark, f"{root}/versions", stream=True)
    speed.follow_models(versions, store, f"{root}/log", availableNow=True).awaitTermination()
    return _flat(_two_sides(store.batch.users, store.batch.items), "side", "id")


@query
def persist_model(spark, sf):
    """Whether a model's tables are cached as it is held, swapped out for another, and released, and what they hold."""
    store, (one, other) = speed.ModelStore(), models_of(spark, sf, "whole", "batch")
    seen = [("new", one.users.is_cached, one.items.is_cached)]
    store.swap(batch=one)
    seen.append(("held", one.users.is_cached, one.items.is_cached))
    rows = X.model_summary({"whole": store.batch}).collect()
    store.swap(batch=other)
    seen.append(("swapped", one.users.is_cached, other.items.is_cached))
    other.unpersist()
    seen.append(("released", other.users.is_cached, other.items.is_cached))
    steps = spark.createDataFrame([(*s, None) for s in seen], "step string, users boolean, items boolean, n bigint")
    counts = spark.createDataFrame([(r.side, None, None, r.n) for r in rows], steps.schema)
    return union_all(steps, counts)


@query
def latest_model(spark, sf):
    """The newest of one announced version per order day."""
    path = fresh_path(spark, "versions")
    days = view(spark, sf, "lines").select(
        F.date_format("ordered", "yyyyMMdd").alias("path"), F.col("ordered").cast("timestamp").alias("published_at")
    )
    days.distinct().write.parquet(path)
    return models.newest_version(models.model_versions(spark, path))


# Landing and reading lines


def _land(lines: DataFrame, path: str) -> None:
    dated = messages.with_arrival(lines, F.date_trunc("month", F.col("ordered").cast("timestamp")))
    dated.select("value", "day", "hour").repartition("day").write.partitionBy("day", "hour").text(path)


@query
def read_latest(spark, sf):
    path = fresh_path(spark, "landed")
    _land(view(spark, sf, "raw_lines"), path)
    lines = messages.read_latest(spark, path, 10)
    return lines.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query
def land_stream(spark, sf):
    root = fresh_path(spark, "stream")
    dated = messages.with_arrival(
        view(spark, sf, "raw_lines"), F.date_trunc("year", F.col("ordered").cast("timestamp"))
    )
    dated.select("value", "day", "hour").write.parquet(f"{root}/in")
    stream = spark.readStream.schema("value string, day string, hour string").parquet(f"{root}/in")
    messages.land_stream(stream, f"{root}/out", f"{root}/log", availableNow=True).awaitTermination()
    landed = spark.read.schema("value string, day string, hour string").text(f"{root}/out")
    return landed.groupBy("day", "hour", "value").agg(F.count(F.lit(1)).alias("n"))


@query
def folded_hours(spark, sf):
    """Five batches of lines, then their hours folded to at most ten files; whether they are that few, and all lines once."""
    root = fresh_path(spark, "folded")
    dated = messages.with_arrival(
        view(spark, sf, "raw_lines"), F.date_trunc("year", F.col("ordered").cast("timestamp"))
    )
    held = _held(dated.select("value", "day", "hour", "cust"), "lines")
    # The stream goes on after each batch has landed, so that a batch may be many files.
    for part in range(5):
        held.where(F.col("cust") % 5 == part).drop("cust").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("value string, day string, hour string").parquet(f"{root}/in")
        messages.land_stream(stream, f"{root}/out", f"{root}/log", availableNow=True).awaitTermination()
    messages.fold_hours(spark, f"{root}/out", running=False)
    landed = spark.read.schema("value string, day string, hour string").text(f"{root}/out")
    files = landed.groupBy("day", "hour").agg(
        (F.count_distinct(F.col("_metadata.file_path")) <= messages.FILES_PER_HOUR).alias("few_files"),
        F.count_distinct("batch").alias("n_folders"),
    )
    counts = landed.groupBy("day", "hour", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(files, ["day", "hour"])


@query
def read_messages(spark, sf):
    """The source as a stream and as a batch read give the same lines."""
    root = fresh_path(spark, "messages")
    view(spark, sf, "raw_lines").select("value").write.text(f"{root}/in")
    stream = messages.read_messages(spark, "text", path=f"{root}/in")
    writer = stream.writeStream.format("parquet").option("path", f"{root}/out")
    writer.option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    streamed = spark.read.parquet(f"{root}/out").select("value", F.lit(1).alias("s"), F.lit(0).alias("b"))
    batch = messages.read_messages(spark, "text", stream=False, path=f"{root}/in")
    both = union_all(streamed, batch.select("value", F.lit(0).alias("s"), F.lit(1).alias("b")))
    return both.groupBy("value").agg(F.sum("s").alias("n_stream"), F.sum("b").alias("n_batch"))


# Keyed tables


@query
def upsert(spark, sf):
    """Orders per customer, written status by status; the last status wins, cheap ones are removed."""
    path = fresh_path(spark, "table")
    lines = view(spark, sf, "lines")
    tables.create_table(spark, path, "user int, status string, total bigint")
    for status in ("F", "O", "P"):
        rows = lines.where(F.col("order_status") == status).groupBy(F.col("cust").cast("int").alias("user")).agg(
            F.lit(status).alias("status"), F.sum("q").alias("total")
        )
        tables.upsert(rows.withColumn("gone", F.col("total") < 150), path, ["user"], deleted="gone")
        if status == "O":
            tables.compact(spark, path, ["user"])
    return tables.read_table(spark, path, ["user"])


@query
def upsert_duplicates(spark, sf):
    """All order lines written at once, keyed by customer; of a customer's the last by part, quantity and line counts."""
    path = fresh_path(spark, "doubled")
    lines = view(spark, sf, "lines")
    at = F.col("part") * 10_000 + F.col("q") * 100 + F.col("n")
    tables.upsert(lines.select(F.col("cust").cast("int").alias("user"), at.cast("bigint").alias("at")), path, ["user"], order="at")
    return tables.read_table(spark, path, ["user"])


@query
def upsert_restart(spark, sf):
    """A bulk load, a stream's batch, a repeat of it, a compaction, and batch 0 of a stream that starts anew."""
    path = fresh_path(spark, "restarted")
    lines = view(spark, sf, "lines")

    def put(status: str, writer: str | None = None) -> None:
        rows = lines.where(F.col("order_status") == status).select(F.col("cust").cast("int").alias("user")).distinct()
        tables.upsert(rows.withColumn("status", F.lit(status)), path, ["user"], writer=writer)

    put("F")
    put("O", "first log#0")
    put("O", "first log#0")
    tables.compact(spark, path, ["user"])
    put("P", "second log#0")
    return tables.read_table(spark, path, ["user"])


@query
def write_lists(spark, sf):
    """Lists of the speed model replaced by the batch model's where it has the user."""
    path = fresh_path(spark, "lists")
    batch, fast = _both(spark, sf)
    for m in (fast, batch):
        tables.write_lists(scoring.id_lists(scoring.items_for_all_users(m, 10)), path)
    return tables.read_table(spark, path, ["user"])


@query
def register_candidate(spark, sf):
    path = fresh_path(spark, "registry")
    registry = view(spark, sf, "registry").drop("cid")
    tables.register_candidates(spark, path, registry.where("candidate_list_type = 'list'"))
    tables.register_candidates(spark, path, registry.withColumn("url", F.lit("again")))
    return tables.read_candidates(spark, path).select("name", "url")


@query
def catalog_tables(spark, sf):
    """A bucketed table is created twice, filled, joined on its key and dropped; whether it was there, and the joined rows."""
    name = f"pickwell_{uuid4().hex}"
    seen = [("before", catalog.table_exists(spark, name))]
    for _ in range(2):
        catalog.create_bucketed(spark, name, "user int, total bigint", ["user"], 8)
    seen.append(("created", catalog.table_exists(spark, name)))
    lines = view(spark, sf, "lines").groupBy(F.col("cust").cast("int").alias("user")).agg(F.sum("q").alias("total"))
    catalog.append_rows(lines, name, ["user"], 8)
    rows = catalog.read_rows(spark, name)
    joined = _held(rows.join(rows.select("user", F.col("total").alias("again")), "user"), "joined")
    seen += [("dropped", catalog.drop_table(spark, name)), ("after", catalog.table_exists(spark, name)), ("again", catalog.drop_table(spark, name))]
    steps = spark.createDataFrame(seen, "step string, found boolean")
    none = F.lit(None).cast("bigint")
    return union_all(
        joined.select(F.lit("row").alias("step"), F.lit(True).alias("found"), "user", (F.col("total") + F.col("again")).alias("twice")),
        steps.select("step", "found", F.lit(None).cast("int").alias("user"), none.alias("twice")),
    )


# Candidates


def _bought_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, joined once and stored, with what lists are made of."""
    return _held(view(spark, sf, "lines").select("cust", "part", "q"), "lines")


def _lists(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    return as_lists(view(spark, sf, "bought", lines))


def _sources(spark: SparkSession, sf: str) -> list[K.Source]:
    return [K.Source(1, "mode", _lists(spark, sf)), K.Source(2, "list", view(spark, sf, "top_list"))]


def _stored_sources(spark: SparkSession, sf: str) -> list[K.Source]:
    """The same, stored for queries that pull several times."""
    lines = _bought_lines(spark, sf)
    return [K.Source(1, "mode", _held(_lists(spark, sf, lines), "lists")), K.Source(2, "list", _held(view(spark, sf, "top_list", lines), "top-list"))]


def _users(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "user_ids").withColumnRenamed("id", "user")


def _quotas(spark: SparkSession, sf: str, num: int) -> DataFrame:
    return K.quotas(_users(spark, sf), view(spark, sf, "cids"), view(spark, sf, "params"), num)


PULL = 80


@query
def resolve_candidate(spark, sf):
    return K.resolve_candidates(view(spark, sf, "registry")).select("cid", "name", "accepted")


@query
def add_candidate(spark, sf):
    registry = view(spark, sf, "registry")
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.col("s_name").alias("name"), F.lit("list").alias("candidate_list_type"), F.lit("hbase").alias("store_type"),
        F.lit("tables").alias("url"), F.lit("als").alias("algo"),
    )
    again = union_all(registry.drop("cid"), suppliers)
    return K.add_candidates(registry, again).select("cid", "name")


@query
def remove_candidate(spark, sf):
    registry = view(spark, sf, "registry")
    return K.remove_candidates(registry, registry.where("store_type = 'jdbc'")).select("cid", "name")


@query
def candidate_params(spark, sf):
    return K.candidate_params(_users(spark, sf), view(spark, sf, "cids"), view(spark, sf, "params"))


@query
def quotas(spark, sf):
    return _quotas(spark, sf, 2000)


@query
def pull_model(spark, sf):
    return K.pull_model(_lists(spark, sf), _quotas(spark, sf, PULL).where("cid = 1"))


@query
def pull_top(spark, sf):
    return K.pull_top(view(spark, sf, "top_list"), _quotas(spark, sf, PULL).where("cid = 2"))


@query
def pull_all(spark, sf):
    return K.pull_all(_quotas(spark, sf, PULL), _sources(spark, sf))


@query
def rank_keys(spark, sf):
    """Key after each customer's share of the list, at and beyond five digits."""
    lines = view(spark, sf, "lines").groupBy(F.col("cust").cast("int").alias("user")).agg(
        F.sum("q").cast("int").alias("num")
    )
    return lines.select(
        "user",
        next_offset(F.col("num"), F.lit("00012")).alias("near"),
        next_offset(F.col("num"), F.lit("99999")).alias("far"),
    )


@query
def open_sources(spark, sf):
    """What loaders open for the accepted rows of a registry, pulled by quota; a row without a loader is left out."""
    rows = [(1, "bought", "mode", "hbase", "als"), (2, "top_list", "list", "hbase", "any"), (3, "bought", "mode", "hbase", "kmean"), (4, "bought", "other", "hbase", "als")]
    registry = spark.createDataFrame(rows, "cid int, name string, candidate_list_type string, store_type string, algo string")
    registry = registry.withColumn("url", F.lit(sf))
    loaders = {
        ("mode", "hbase"): lambda session, url, name: as_lists(view(session, url, name)),
        ("list", "hbase"): lambda session, url, name: view(session, url, name),
    }
    return K.pull_all(_quotas(spark, sf, PULL), K.open_sources(registry, loaders))


@query
def save_params(spark, sf):
    return K.saved_params(_quotas(spark, sf, PULL), view(spark, sf, "params"), _sources(spark, sf))


# Fusion


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(K.pull_all(_quotas(spark, sf, PULL), _sources(spark, sf)), [1, 2])


@query
def fuse(spark, sf):
    fused = fusion.fuse(K.pull_all(_quotas(spark, sf, PULL), _sources(spark, sf)))
    return fused.select("user", "item", encode_ids(F.col("cids")).alias("cids"), "n_sources")


@query
def fuse_known(spark, sf):
    """The same, counting per known candidate."""
    return _fused(spark, sf).select("user", "item", encode_ids(F.col("cids")).alias("cids"), "n_sources")


@query
def rank_fused(spark, sf):
    return fusion.rank_fused(_fused(spark, sf), seed=7).select("user", "item", "n_sources", "rank")


@query
def rank_fused_custom(spark, sf):
    """The caller's own order: by item id."""
    return fusion.rank_fused(_fused(spark, sf), order=[F.col("item")]).select("user", "item", "rank")


@query
def append_history(spark, sf):
    path = fresh_path(spark, "history")
    pulled = K.pull_all(_quotas(spark, sf, PULL), _stored_sources(spark, sf))
    # Both runs rank the rows by user, where the table has them.
    name = f"fused_{uuid4().hex}"
    fused = catalog.stored_by(fusion.fuse(pulled, [1, 2]), name, ["user"])
    try:
        for seed in (7, 8):
            ranked = fusion.rank_fused(fused, seed=seed)
            rows = fusion.history_rows(ranked).withColumn("run", F.lit(seed))
            rows.write.mode("append").parquet(path)
    finally:
        catalog.drop_table(spark, name)
    return fusion.history_lists(spark.read.parquet(path))


@query
def serving_list(spark, sf):
    pulled = K.pull_lists(_quotas(spark, sf, PULL), _sources(spark, sf))
    lists = fusion.listed(fusion.fused_lists(pulled, seed=7), NOW)
    return lists.select("user", encode_ids(F.col("items")).alias("ids"), "update_time", "offset")


def _refreshed(spark: SparkSession, sf: str, seed: int, sources: list[K.Source] | None = None) -> serving.Refresh:
    return serving.refresh_lists(
        _users(spark, sf), sources or _sources(spark, sf), view(spark, sf, "cids"), view(spark, sf, "params"), NOW, PULL, seed=seed
    )


def _refresh_rows(lists: DataFrame, history: DataFrame, params: DataFrame) -> DataFrame:
    """Lists, history and parameters one under the other."""
    null = lambda kind: F.lit(None).cast(kind)
    return union_all(
        lists.select(F.lit("list").alias("part"), "user", null("int").alias("cid"), null("int").alias("pos"), null("int").alias("item"),
                     encode_ids(F.col("items")).alias("text"), null("double").alias("weight")),
        history.select(F.lit("history").alias("part"), "user", "cid", "pos", "item", null("string").alias("text"), null("double").alias("weight")),
        params.select(F.lit("params").alias("part"), "user", "cid", null("int").alias("pos"), null("int").alias("item"),
                      F.col("offset").alias("text"), "weight"),
    )


@query
def refresh_lists(spark, sf):
    """The lists handed back, the history to append and the parameters with moved offsets."""
    done = _refreshed(spark, sf, 7)
    return _refresh_rows(done.returned, done.history.withColumnRenamed("seq", "pos"), done.params)


@query
def store_refresh(spark, sf):
    """Two refreshes stored, the first of them twice; what the tables hold after them."""
    root = fresh_path(spark, "refreshed")
    paths = f"{root}/lists", f"{root}/history", f"{root}/params"
    sources = _stored_sources(spark, sf)
    first = _refreshed(spark, sf, 7, sources)
    for done, run in ((first, 1), (first, 1), (_refreshed(spark, sf, 8, sources), 2)):
        serving.store_refresh(done, *paths, run)
    lists, params = tables.read_table(spark, paths[0], ["user"]), tables.read_table(spark, paths[2], ["user", "cid"])
    return _refresh_rows(lists, fusion.history_lists(spark.read.parquet(paths[1])), params)


# Paging and cache


def _stored(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    return as_lists(view(spark, sf, "stored", lines), "offset")


def _cached(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    return as_lists(view(spark, sf, "cached", lines), "offset", "begin_time")


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return paging.normalise_requests(view(spark, sf, "requests")).where("valid")


def _shown(pages: DataFrame) -> DataFrame:
    return pages.withColumn("page_items", encode_ids(F.col("page_items")))


@query
def normalise_requests(spark, sf):
    return paging.normalise_requests(view(spark, sf, "requests"))


@query
def page_stored(spark, sf):
    """Every customer asks once."""
    once = _users(spark, sf).select(F.col("user").cast("bigint").alias("seq"), "user", F.lit(10).alias("per_page"))
    return _shown(paging.page_stored(once, _stored(spark, sf), refill=20))


@query
def page_stored_many(spark, sf):
    return _shown(paging.page_stored(_valid(spark, sf), _stored(spark, sf), refill=20, ranges=16))


@query
def page_cached(spark, sf):
    return _shown(paging.page_cached(_valid(spark, sf), _cached(spark, sf), refill=20))


@query
def advance_stored(spark, sf):
    return paging.advance_stored(_valid(spark, sf), _stored(spark, sf)).select("user", "offset")


@query
def touch_cached(spark, sf):
    return paging.touch_cached(_valid(spark, sf), _cached(spark, sf), NOW).select("user", "offset", "begin_time")


@query
def stored_lists(spark, sf):
    found = paging.stored_lists(_valid(spark, sf), _stored(spark, sf))
    return found.select("user", encode_ids(F.col("items")).alias("ids"), "offset")


@query
def first_page(spark, sf):
    page = paging.first_page(_stored(spark, sf), 10)
    return _shown(page).select("user", "page_items", F.size("items").alias("n_items"), "offset")


@query
def evict(spark, sf):
    kept = C.evict(_cached(spark, sf), NOW, capacity=300, ttl_ms=400 * DAY_MS)
    return kept.select("user", "begin_time")


@query
def admit(spark, sf):
    """Stored lists arrive by order of list length, then again cut to one item."""
    lines = _bought_lines(spark, sf)
    stored, cached = _held(_stored(spark, sf, lines), "stored"), _held(_cached(spark, sf, lines), "cached")
    arriving = stored.select("user", "items", (F.size("items") * 100000 + F.col("user")).alias("arrival"))
    later = stored.select("user", F.slice("items", 1, 1).alias("items"), (F.col("user") + 100000000).alias("arrival"))
    after = C.admit(cached, union_all(arriving, later), NOW, capacity=1000)
    return after.select("user", "begin_time", encode_ids(F.col("items")).alias("ids"), "offset")


@query
def visible(spark, sf):
    pages = paging.page_stored(_valid(spark, sf), _stored(spark, sf), refill=20)
    more = paging.page_cached(_valid(spark, sf), _cached(spark, sf), refill=20)
    return _shown(paging.visible(union_all(pages, more))).select("seq", "user", "status", "page_items")


@query
def format_responses(spark, sf):
    asked = paging.normalise_requests(view(spark, sf, "requests"))
    return paging.format_responses(paging.page_stored(asked, _stored(spark, sf), refill=20))


def _answer(spark: SparkSession, sf: str) -> serving.Answer:
    cached, stored, fresh = (_held(t, "lists") for t in (_cached(spark, sf), _stored(spark, sf), _lists(spark, sf)))
    return serving.answer(
        view(spark, sf, "requests"), cached, stored, fresh, NOW, stored_refill=20, cached_refill=20
    )


@query
def answer(spark, sf):
    return _shown(_answer(spark, sf).responses)


@query
def answer_refill(spark, sf):
    return _answer(spark, sf).refill


@query
def answer_state(spark, sf):
    """Cached and stored lists and their offsets after the requests."""
    after = _answer(spark, sf)
    ids = encode_ids(F.col("items")).alias("ids")
    cached = after.cache.select(F.lit("cache").alias("place"), "user", ids, "offset", "begin_time")
    stored = after.stored.select(F.lit("stored").alias("place"), "user", ids, "offset", F.lit(None).cast("bigint").alias("begin_time"))
    return union_all(cached, stored)


def _answer_stream(spark: SparkSession, sf: str, ttl_ms: int) -> DataFrame:
    """Requests arrive as three files; cached lists were last read on one of the first ten days of the requests."""
    root = fresh_path(spark, "answers")
    asked = view(spark, sf, "timed_requests").withColumn("at", F.col("at").cast("timestamp"))
    parts = asked.agg(F.max("seq") + 1).scalar()
    asked = _held(asked.withColumn("part", F.floor(F.col("seq") * 3 / parts).cast("int")), "requests")
    for part in range(3):
        asked.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(asked.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    lines = _bought_lines(spark, sf)
    cached = _cached(spark, sf, lines).withColumn("begin_time", (F.lit(FIRST_DAY) + F.col("user") % 10 * DAY_MS).cast("bigint"))
    entries = answering.first_entries(cached, _stored(spark, sf, lines), _lists(spark, sf, lines))
    responses = answering.answer_stream(stream, entries, ttl_ms, stored_refill=20, cached_refill=20)
    answering.run_answers(responses, f"{root}/out", f"{root}/log", partitions=8, availableNow=True).awaitTermination()
    return _shown(spark.read.schema(answering.RESPONSES).parquet(f"{root}/out"))


@query
def answer_stream(spark, sf):
    """No entry expires, so the pages are those of the batch."""
    return _answer_stream(spark, sf, 10_000 * DAY_MS)


@query
def answer_stream_expired(spark, sf):
    """Entries that nobody reads for three days are gone."""
    return _answer_stream(spark, sf, 3 * DAY_MS)


# Streams


@query
def batch_users(spark, sf):
    return speed.batch_users(ratings.parse_ratings(view(spark, sf, "raw_lines")))


@query
def apply_factor_updates(spark, sf):
    after = updates.apply_factor_updates(model(spark, sf, "whole"), view(spark, sf, "updates"))
    return _flat(_two_sides(after.users, after.items), "side", "id")


@query
def stream_factor_updates(spark, sf):
    """The changes as a stream into an empty model, whose rank the first Update fixes; later changes arrive before earlier ones."""
    root = fresh_path(spark, "updates")
    changes = view(spark, sf, "updates")
    first = F.when(F.col("tbl").isin(updates.USER, updates.ITEM) & (F.col("option") == updates.UPDATE), F.col("seq"))
    bounds = changes.agg(F.min(first).alias("first"), F.max("seq").alias("last")).first()
    held = _held(changes, "changes")
    # The file with the first Update, then the others from the last to the first.
    cuts = [bounds.first + 1 + (bounds.last - bounds.first) * i // 4 for i in range(5)]
    held.where(F.col("seq") < cuts[0]).coalesce(1).write.parquet(f"{root}/in")
    for low, high in reversed(list(zip(cuts, cuts[1:]))):
        held.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    held.where(F.col("seq") >= cuts[-1]).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    paths = f"{root}/users", f"{root}/items"
    for path in paths:
        tables.create_table(spark, path, "id int, seq bigint, features array<double>")
    updates.run_factor_updates(stream, *paths, f"{root}/log", availableNow=True).awaitTermination()
    after = updates.updated_model(spark, *paths, f"{root}/log")
    return _flat(_two_sides(after.users, after.items), "side", "id")


@query
def speed_layer(spark, sf):
    """Messages arrive as three files; the lists of all their users."""
    root = fresh_path(spark, "speed")
    lines = model_lines(spark, sf)
    _texts(spark, sf, lines).select("value").repartition(3).write.text(f"{root}/in")
    stream = messages.read_messages(spark, "text", path=f"{root}/in", maxFilesPerTrigger="1")
    settings = speed.SpeedSettings(rank=RANK, iterations=3, n=20)
    (batch,) = models_of(spark, sf, "batch", lines=lines)
    store = speed.ModelStore(batch=batch)
    speed.run_speed_layer(
        stream, store, f"{root}/lists", f"{root}/log", settings, stop_on_error=True, availableNow=True
    ).awaitTermination()
    lists = tables.read_table(spark, f"{root}/lists", ["user"])
    return lists.select("user", F.size(decode_ids(F.col("ids"))).alias("n"))
