"""Inputs that a query reads several times are worked out once."""

from collections import Counter
from datetime import datetime
from uuid import uuid4

from pyspark.sql import functions as F

from pickwell.functions.kernel import MATCHES_DDL
from pickwell.operators import factors, fusion, recommenders, scoring
from pickwell.operators.ratings import parse_ratings
from pickwell.plans import views
from pickwell.plans.queries import QUERIES
from pickwell.plans.taste import TasteGroups
from pickwell.plans.views import models, stored, view
from pickwell.sources import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_models_read_no_source_table_again(spark):
    for one, name in zip(models(spark, SF, "batch", "speed"), ("batch", "speed")):
        for side in ("users", "items"):
            found, want = getattr(one, side), view(spark, SF, f"{name}_{side}")
            assert "Join" not in plan(found) and "Join" in plan(want)
            assert sorted(found.collect()) == sorted(want.collect())


def test_lists_from_stored_lines_are_those_of_the_tables(spark):
    lines = stored(view(spark, SF, "lines").select("cust", "part", "q"), "lines")
    for name in ("bought", "stored", "cached", "top_list"):
        assert sorted(view(spark, SF, name, lines).collect()) == sorted(view(spark, SF, name).collect())


def test_a_few_groups_send_their_lists_to_the_users(spark):
    ratings = spark.createDataFrame([(u, i, float(i)) for u in range(30) for i in range(3)], "user int, item int, rating double")
    lists = TasteGroups.train(ratings).items_for_users(spark.range(40).select(F.col("id").cast("int")), 2)
    assert "strategy=broadcast" in plan(lists)
    assert {(r.id, tuple(m["id"] for m in r.matches)) for r in lists.collect()} == {(u, (2, 1)) for u in range(30)}


def test_a_line_is_split_once(spark):
    lines = spark.createDataFrame([("1,2,3",), ("x,2,3",)], "value string")
    for how in ("drop", "default"):
        assert plan(parse_ratings(lines, on_malformed=how).where("user > 0").groupBy("user").count()).count("split(") == 1


def busy(df):
    """Tasks that have rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_vectors_found_by_a_join_are_spread_for_scoring(spark):
    one = spark.range(400).select(F.col("id").cast("int"), F.array(F.lit(1.0)).alias("features"))
    # As many partitions as scoring asks for, and a join by shuffle.
    with_joins = {"spark.sql.shuffle.partitions": str(scoring.tasks(spark)), "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in with_joins}
    try:
        for k, v in with_joins.items():
            spark.conf.set(k, v)
        assert busy(scoring._evenly(factors.resolve_factors(one.select("id"), one, one))) >= 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_narrow_ids_are_spread_before_they_grow_into_lists(spark):
    class Same:
        def items_for_users(self, ids, k):
            return ids.select("id", F.array(F.struct(F.lit(1).alias("id"), F.lit(1.0).alias("score"))).cast(MATCHES_DDL).alias("matches"))

    twice = spark.range(400).select((F.col("id") % 200).cast("int").alias("id"))
    lists = recommenders.items_for(Same(), twice, 3)
    assert busy(lists) >= 8 and lists.count() == 200


def test_lines_are_joined_once_for_a_model_and_texts(spark, monkeypatch):
    joined, real = [], views._over_tables
    monkeypatch.setattr(views, "_over_tables", lambda *at: (joined.append("JOIN part" in at[2]), real(*at))[1])
    QUERIES["serve_mixed_items"](spark, SF)
    assert sum(joined) == 1


def test_lines_are_those_of_the_view(spark, tmp_path):
    """Keys that repeat, are null or have no match."""
    day = datetime(2024, 1, 1)
    tables = {
        "lineitem": ([(o, p, 1, n, 7.0, 0.05, "R", "O") for n, (o, p) in enumerate([(1, 1), (1, 2), (2, 1), (3, 1), (None, 1), (1, None), (9, 1)])],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"),
        "orders": ([(1, 1, "P", day), (1, 2, "F", day), (2, None, "P", day), (3, 8, "P", day), (None, 1, "P", day)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"),
        "customer": ([(1, "BUILDING"), (1, None), (2, "MACHINERY"), (None, "BUILDING")], "c_custkey long, c_mktsegment string"),
        "part": ([(1, "PROMO"), (2, None), (2, "SMALL"), (None, "PROMO")], "p_partkey long, p_type string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found, want = view(spark, str(tmp_path), "lines"), views._over_tables(spark, str(tmp_path), views.VIEWS["lines"])
    assert found.columns == want.columns and found.count() == 9
    assert Counter(found.collect()) == Counter(want.collect())


def odd_tables(spark, path):
    """Keys, segments and values that repeat, are null or have no match."""
    day = datetime(2024, 1, 1)
    pairs = [(1, 1), (1, 2), (2, 1), (3, 1), (4, 2), (4, 2), (5, 1), (5, 3), (None, 1), (1, None), (9, 1)]
    values = [(7.0, 0.05, "R", "O"), (-3.0, 0.0, "A", "F"), (None, None, None, None), (30.0, 0.1, "N", "O")]
    tables = {
        "lineitem": ([(o, p, 1, n % 9 or None, *values[n % 4]) for n, (o, p) in enumerate(pairs * 3)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"),
        "orders": ([(1, 1, "P", day), (1, 2, "F", day), (2, None, "P", day), (3, 8, "P", day), (4, 3, None, day), (4, 3, "P", None), (5, 2, "F", day)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"),
        "customer": ([(1, "BUILDING", 1, 5.0), (1, None, 2, 5.0), (2, "MACHINERY", 3, 1.0), (2, "HOUSEHOLD", None, 2.0), (3, "HOUSEHOLD", 4, None), (None, "BUILDING", 1, 5.0)],
                     "c_custkey long, c_mktsegment string, c_nationkey int, c_acctbal double"),
        "part": ([(1, "PROMO"), (1, "SMALL"), (2, None), (2, "SMALL"), (3, "LARGE"), (None, "PROMO")], "p_partkey long, p_type string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_bought_lists_are_those_of_the_views(spark, tmp_path):
    path = odd_tables(spark, tmp_path)
    for name in ("bought", "stored", "cached"):
        got, want = view(spark, path, name), views._over_tables(spark, path, views.with_views([name], "spark") + f" SELECT * FROM {name}")
        assert got.dtypes == want.dtypes and got.count() > 4
        assert Counter(map(str, got.collect())) == Counter(map(str, want.collect()))


def test_bought_lists_shuffle_the_lines_once(spark):
    lines = stored(view(spark, SF, "lines").select("cust", "part", "q"), "lines")
    lists = views.as_lists(view(spark, SF, "bought", lines))
    assert lists._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_rows_stored_by_user_are_ranked_where_they_are(spark):
    name = f"fused_{uuid4().hex}"
    rows = spark.range(300).selectExpr("cast(nullif(id % 17, 3) as int) user", "cast(id as int) item", "1 n_sources")
    ranked = fusion.rank_fused(catalog.stored_by(rows, name, ["user"]), 7)
    try:
        assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()
        assert Counter(ranked.collect()) == Counter(fusion.rank_fused(rows, 7).collect())
    finally:
        assert catalog.drop_table(spark, name)
