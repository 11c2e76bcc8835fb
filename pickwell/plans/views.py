"""Input views over the given tables, in SQL both Spark and DuckDB run.

They only shape inputs (ratings lines, factor tables, lists, requests); the
operators under test are not in here. Factor vectors hold whole numbers, so
inner products are exact and equal scores are equal in every engine.

``@ARRAY(`` and ``@DAYS(column)`` stand for the two constructs the dialects
spell differently.
"""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pickwell.functions.columns import rank_key
from pickwell.functions.frames import numbered, write_once
from pickwell.model import FactorModel
from pickwell.session import fresh_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

RANK = 5
NOW = 996624000000
DAY_MS = 86400000
FIRST_DAY = 1704067200000
"""The day of the first event, 2024-01-01."""

MODEL_COLUMNS = "cust part segment ptype order_status q n flag line_status d".split()
"""What factors are sums of, and what picks a model's lines."""

_FEATURES = """@ARRAY(
    CAST(sum(q - 25) AS DOUBLE), CAST(sum(n - 4) AS DOUBLE),
    CAST(sum(CASE flag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END) AS DOUBLE),
    CAST(sum(CASE line_status WHEN 'O' THEN 1 ELSE -1 END) AS DOUBLE),
    CAST(sum(d - 5) AS DOUBLE)) AS features"""


def _factors(key: str, where: str) -> str:
    return f"SELECT CAST({key} AS INT) AS id, {_FEATURES} FROM lines WHERE {where} GROUP BY {key}"


VIEWS: dict[str, str] = {
    # Order lines with their customer and part.
    "lines": """SELECT o_custkey AS cust, l_partkey AS part, l_suppkey AS supp, c_mktsegment AS segment,
        p_type AS ptype, o_orderstatus AS order_status, o_orderdate AS ordered, CAST(l_quantity AS INT) AS q,
        l_linenumber AS n, l_returnflag AS flag, l_linestatus AS line_status,
        CAST(round(l_discount * 100) AS INT) AS d
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
    # Message texts; some quantities stand for each odd form of a line.
    "raw_lines": """SELECT ordered, cust, part, q, n, CASE q
        WHEN 1 THEN concat(CAST(cust AS STRING), ',text,', CAST(q AS STRING))
        WHEN 2 THEN concat(CAST(cust AS STRING), ',', CAST(part AS STRING))
        WHEN 3 THEN concat(CAST(cust AS STRING), ',,', CAST(q AS STRING), ',', CAST(n AS STRING))
        WHEN 4 THEN concat(CAST(cust AS STRING), ',', CAST(part AS STRING), ',', CAST(q AS STRING), ',',
            CAST(n AS STRING), ',,')
        WHEN 5 THEN concat(CAST(cust AS STRING), ',', CAST(part AS STRING), ',', CAST(q AS STRING), ',',
            CAST(n AS STRING), ',', CAST(d AS STRING))
        WHEN 6 THEN concat(CAST(cust AS STRING), '.9,', CAST(part AS STRING), ',', CAST(q AS STRING), ',',
            CAST(n AS STRING))
        ELSE concat(CAST(cust AS STRING), ',', CAST(part AS STRING), ',', CAST(q AS STRING), ',',
            CAST(n AS STRING)) END AS value FROM lines""",
    "triples": """SELECT CAST(cust AS STRING) AS u, CAST(part AS STRING) AS i, CAST(q AS STRING) AS r FROM lines""",
    # The whole model saw all orders. Where two models must overlap, the batch model saw finished orders
    # and not yet one segment and type; the speed model saw pending orders.
    "whole_users": _factors("cust", "q > 0"),
    "whole_items": _factors("part", "q > 0"),
    "batch_users": _factors("cust", "order_status <> 'P' AND segment <> 'MACHINERY'"),
    "batch_items": _factors("part", "order_status <> 'P' AND ptype <> 'PROMO'"),
    "speed_users": _factors("cust", "order_status = 'P' AND segment <> 'BUILDING'"),
    "speed_items": _factors("part", "order_status = 'P' AND ptype <> 'SMALL'"),
    "vectors": _factors("supp", "q > 0"),
    "pairs": "SELECT DISTINCT CAST(cust AS INT) AS \"user\", CAST(part AS INT) AS item FROM lines",
    "user_ids": "SELECT CAST(c_custkey AS INT) AS id FROM customer",
    "item_ids": "SELECT CAST(p_partkey AS INT) AS id FROM part",
    "event_users": "SELECT CAST(user_id AS INT) AS id FROM events",
    # The items each customer bought, most first; see _bought().
    "bought": """SELECT "user", item, pos FROM (SELECT CAST(cust AS INT) AS "user", CAST(part AS INT) AS item,
        CAST(row_number() OVER (PARTITION BY cust ORDER BY total DESC, part) AS INT) AS pos
        FROM (SELECT cust, part, sum(q) AS total FROM lines GROUP BY cust, part) t) r""",
    # All parts, most bought first; Spark counts places over ranges, see view().
    "part_totals": "SELECT part, sum(q) AS total FROM lines GROUP BY part",
    "top_list": """SELECT CASE WHEN place <= 100000 THEN lpad(CAST(place - 1 AS STRING), 5, '0')
        ELSE CAST(place - 1 AS STRING) END AS rank_key, item FROM (SELECT CAST(part AS INT) AS item,
        row_number() OVER (ORDER BY total DESC, part) AS place FROM part_totals) r""",
    "cids": "SELECT CAST(r_regionkey AS INT) + 1 AS cid FROM region",
    "params": """SELECT CAST(c_custkey AS INT) AS "user", CAST(1 AS INT) AS cid, CAST(0.7 AS DOUBLE) AS weight,
        lpad(CAST(c_nationkey AS STRING), 5, '0') AS "offset" FROM customer WHERE c_mktsegment = 'BUILDING'
        UNION ALL SELECT CAST(c_custkey AS INT), CAST(2 AS INT), CASE c_mktsegment WHEN 'BUILDING'
        THEN CAST(0.3 AS DOUBLE) ELSE (c_nationkey + 1) / CAST(50 AS DOUBLE) END,
        lpad(CAST(c_nationkey AS STRING), 5, '0') FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')""",
    "registry": """SELECT CAST(p_partkey AS INT) + 1 AS cid, concat(p_name, '_', CAST(p_partkey AS STRING)) AS name,
        CASE WHEN p_size <= 20 THEN 'mode' WHEN p_size <= 40 THEN 'list' ELSE 'other' END AS candidate_list_type,
        CASE p_type WHEN 'PROMO' THEN 'jdbc' WHEN 'SMALL' THEN 'file' ELSE 'hbase' END AS store_type,
        'tables' AS url, CASE p_brand WHEN 'Brand#1' THEN 'kmean' ELSE 'als' END AS algo FROM part""",
    # Stored lists of customers in credit, cached lists of two segments.
    "stored": """SELECT b."user", b.item, b.pos, c.c_nationkey AS "offset" FROM bought b
        JOIN customer c ON b."user" = c.c_custkey WHERE c.c_acctbal > 0""",
    "cached": """SELECT b."user", b.item, b.pos, least(c.c_nationkey, b.len) AS "offset", b.begin_time FROM (
        SELECT "user", item, pos, max(pos) OVER (PARTITION BY "user") AS len,
        CAST(days AS BIGINT) * 86400000 AS begin_time FROM bought JOIN (
        SELECT o_custkey, max(@DAYS(o_orderdate)) AS days FROM orders GROUP BY o_custkey) d
        ON "user" = o_custkey) b
        JOIN customer c ON b."user" = c.c_custkey WHERE c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')""",
    "requests": """SELECT event_id AS seq, CASE WHEN event_type <> 'error' THEN CAST(user_id AS INT) END AS "user",
        1 AS page, CASE WHEN event_type <> 'signup' THEN CAST(least(floor(value / 5) + 1, 20) AS INT) END AS per_page
        FROM events""",
    "timed_requests": """SELECT r.*, e.ts AS at FROM requests r JOIN events e ON r.seq = e.event_id""",
    "updates": """SELECT event_id AS seq, CASE WHEN value < 20 THEN 'User' WHEN value < 90 THEN 'Item'
        ELSE 'Shop' END AS tbl,
        CASE event_type WHEN 'error' THEN 'Remove' WHEN 'signup' THEN 'Unknown' ELSE 'Update' END AS "option",
        CAST(user_id AS INT) AS id, CASE WHEN event_type = 'view' AND value > 15
        THEN @ARRAY(value, CAST(event_id AS DOUBLE))
        ELSE @ARRAY(value, CAST(event_id AS DOUBLE), value * 2, CAST(user_id AS DOUBLE), CAST(1 AS DOUBLE)) END
        AS feature FROM events""",
}


LINES_IN_SPARK = """SELECT cust, l_partkey AS part, l_suppkey AS supp, segment, p_type AS ptype, order_status, ordered,
    CAST(l_quantity AS INT) AS q, l_linenumber AS n, l_returnflag AS flag, l_linestatus AS line_status,
    CAST(round(l_discount * 100) AS INT) AS d FROM lineitem
    JOIN (SELECT o_orderkey, o_custkey AS cust, c_mktsegment AS segment, o_orderstatus AS order_status,
    o_orderdate AS ordered FROM orders JOIN customer ON o_custkey = c_custkey) ON l_orderkey = o_orderkey
    JOIN part ON l_partkey = p_partkey"""
"""The rows of the view ``lines``; customers too many to be broadcast join orders, not the lines of all orders."""


def _needs(name: str, found: list[str]) -> None:
    for other in VIEWS:
        if other != name and other not in found and re.search(rf"\b{other}\b", _no_text(VIEWS[name])):
            _needs(other, found)
    if name not in found:
        found.append(name)


def _no_text(sql: str) -> str:
    return re.sub(r"'[^']*'", "''", sql)


def _render(sql: str, dialect: str) -> str:
    if dialect == "duckdb":
        return re.sub(r"@DAYS\(([^)]*)\)", r"date_diff('day', DATE '1970-01-01', \1)", sql).replace(
            "@ARRAY(", "list_value("
        )
    spark = re.sub(r"@DAYS\(([^)]*)\)", r"datediff(\1, DATE '1970-01-01')", sql).replace("@ARRAY(", "array(")
    return spark.replace('"', "`")


def with_views(names: list[str], dialect: str = "duckdb", given: dict[str, str] | None = None) -> str:
    """``WITH`` clause (no closing select) for the named views and what they use; tables ``given`` by name stand for a view's SQL."""
    found: list[str] = list(given or {})
    for name in names:
        _needs(name, found)
    tables = {n: f"SELECT * FROM {t}" for n, t in (given or {}).items()}
    return "WITH " + ",\n".join(f"{n} AS ({tables.get(n) or _render(VIEWS[n], dialect)})" for n in found)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, read as often as needed."""
    path = fresh_path(df.sparkSession, name)
    write_once(df, path)
    return df.sparkSession.read.parquet(path)


def _over_tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for table in TABLES:
        if re.search(rf"\b(FROM|JOIN) {table}\b", sql):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)


def _bought(lines: DataFrame) -> DataFrame:
    """The rows of the view ``bought``. Lines are dealt by user before they are summed, and sums, places and a user's list need no
    further shuffle; summed by user and item first, about as many rows would be shuffled twice."""
    dealt = lines.select(F.col("cust").cast("int").alias("user"), F.col("part").cast("int").alias("item"), "q").repartition("user")
    totals = dealt.groupBy("user", "item").agg(F.sum("q").alias("total"))
    place = F.row_number().over(W.partitionBy("user").orderBy(F.desc("total"), "item"))
    return totals.select("user", "item", place.cast("int").alias("pos"))


def view(spark: SparkSession, sf_dir: str, name: str, lines: DataFrame | None = None) -> DataFrame:
    """A view by name; ``lines``, if given, are taken for the view of that name instead of joining the tables again."""
    if name == "top_list":
        placed = numbered(view(spark, sf_dir, "part_totals", lines), [F.desc("total"), "part"], "place")
        return placed.select(rank_key(F.col("place") - 1).alias("rank_key"), F.col("part").cast("int").alias("item"))
    needed: list[str] = []
    _needs(name, needed)
    given = {}
    if "lines" in needed:
        if lines is None:
            lines = _over_tables(spark, sf_dir, LINES_IN_SPARK)
        frames = {"lines": lines}
        if "bought" in needed:
            frames["bought"] = _bought(lines)
        if name in frames:
            return frames[name]
        given = {found: f"{found}_{uuid4().hex}" for found in frames}
        for found, table in given.items():
            frames[found].createOrReplaceTempView(table)
    found = _over_tables(spark, sf_dir, f"{with_views([name], 'spark', given)} SELECT * FROM {name}")
    for table in given.values():
        spark.catalog.dropTempView(table)
    return found


def model_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with what models are made of, joined once and stored."""
    return stored(view(spark, sf_dir, "lines").select(*MODEL_COLUMNS), "lines")


def models(spark: SparkSession, sf_dir: str, *names: str, lines: DataFrame | None = None) -> list[FactorModel]:
    """The named models. Lines are joined once for all of them, unless :func:`model_lines` are given, and factors summed
    once, whatever a query reads of them."""
    lines = model_lines(spark, sf_dir) if lines is None else lines
    sides = ("users", "items")
    return [
        FactorModel(RANK, *(stored(view(spark, sf_dir, f"{name}_{side}", lines), f"{name}-{side}") for side in sides)) for name in names
    ]


def model(spark: SparkSession, sf_dir: str, name: str) -> FactorModel:
    """The ``batch``, ``speed`` or ``whole`` model."""
    return models(spark, sf_dir, name)[0]


def as_lists(rows: DataFrame, *carry: str) -> DataFrame:
    """Rows ``(user, item, pos)`` to one array per user."""
    entries = F.sort_array(F.collect_list(F.struct("pos", "item")))
    return rows.groupBy("user", *carry).agg(entries.alias("e")).select("user", F.col("e.item").alias("items"), *carry)
