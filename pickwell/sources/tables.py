"""Keyed tables on plain parquet: last write wins.

A table is a folder of committed parts, each what one ``upsert`` appended: one row per key with the part's ``version`` and
whether it removes its key, so writing a micro-batch does not rewrite the table. Reading keeps the newest row per key with one
aggregation that the next join on the key can reuse. A batch that a writer repeats replaces its own part.
"""

from __future__ import annotations

import hashlib
import uuid
from time import time_ns

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pickwell.functions.columns import encode_ids
from pickwell.sources.files import children, exists, remove


def _parts(spark: SparkSession, path: str) -> list[str]:
    """Committed parts, oldest first."""
    found = [e.path for e in children(spark, path) if e.name.startswith("part-")]
    return [p for p in found if exists(spark, f"{p}/_SUCCESS")]


def _version(part: str) -> int:
    return int(part.rpartition("/")[2].split("-")[1])


def table_exists(spark: SparkSession, path: str) -> bool:
    return bool(_parts(spark, path))


def create_table(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table, unless there is one."""
    if not table_exists(spark, path):
        rows = spark.createDataFrame([], StructType.fromDDL(schema))
        rows.withColumns({"deleted": F.lit(False), "version": F.lit(0).cast("bigint")}).write.parquet(f"{path}/part-{0:020d}-empty")


def drop_table(spark: SparkSession, path: str) -> bool:
    return remove(spark, path)


def upsert(
    rows: DataFrame, path: str, keys: list[str], order: str | None = None, writer: str | None = None, deleted: str | None = None
) -> int:
    """Append ``rows`` as one version, a time in nanoseconds, and return it.

    Of several rows of a key the one with the largest ``order`` counts, without
    ``order`` the largest row. ``writer`` names this batch of a stream: given again, it
    replaces what it wrote before, in its place. ``deleted`` names a boolean column whose
    true rows remove their key.
    """
    spark = rows.sparkSession
    tag = uuid.uuid4().hex if writer is None else hashlib.sha256(writer.encode()).hexdigest()[:32]
    mine = [p for p in _parts(spark, path) if p.endswith(f"-{tag}")]
    part = mine[0] if mine else f"{path}/part-{time_ns():020d}-{tag}"
    flag = F.lit(False) if deleted is None else F.col(deleted)
    one = last_per_key(rows, keys, [order] if order else []).withColumn("deleted", flag)
    one = one.drop(deleted) if deleted and deleted != "deleted" else one
    one.withColumn("version", F.lit(_version(part)).cast("bigint")).write.mode("overwrite").parquet(part)
    return _version(part)


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; partial maxima are taken before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.dropDuplicates(keys)
    row = F.struct(*order, *[c for c in rest if c not in order])
    newest = rows.groupBy(*keys).agg(F.max(row).alias("r"))
    return newest.select(*keys, "r.*").select(rows.columns)


def _newest(spark: SparkSession, parts: list[str], keys: list[str], order: str | None) -> DataFrame:
    rows = spark.read.parquet(*parts)
    return rows if len(parts) == 1 else last_per_key(rows, keys, [order, "version"] if order else ["version"])


def read_table(spark: SparkSession, path: str, keys: list[str], order: str | None = None) -> DataFrame:
    """The newest row of every key; with ``order``, a column of the table, the one with the largest, whenever it came."""
    parts = _parts(spark, path)
    if not parts:
        raise FileNotFoundError(f"no table at {path}")
    return _newest(spark, parts, keys, order).where(~F.col("deleted")).drop("deleted", "version")


def compact(spark: SparkSession, path: str, keys: list[str], order: str | None = None) -> None:
    """Fold all parts into one and remove them, while nobody else reads or writes.

    Rows that remove their key stay, so a change that comes late still finds them. If this breaks off, what is left
    reads the same. The part of a batch that may be repeated should not be folded yet.
    """
    parts = _parts(spark, path)
    if len(parts) > 1:
        _newest(spark, parts, keys, order).write.parquet(f"{path}/part-{_version(parts[-1]):020d}-{uuid.uuid4().hex}")
        for old in parts:
            remove(spark, old)


LISTS = "user int, items array<int>"
LIST_ROWS = "user int, ids string"


def write_lists(lists: DataFrame, path: str, writer: str | None = None) -> int:
    """Store ``(user, items)`` as ``(user, ids)`` text, one row per user; empty lists are skipped."""
    rows = lists.where(F.size("items") > 0).select("user", encode_ids(F.col("items")).alias("ids"))
    return upsert(rows, path, ["user"], writer=writer)


def register_candidates(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Store candidate sources whose name is not in the registry yet."""
    create_table(spark, path, rows.schema.simpleString()[7:-1])
    fresh = rows.join(read_table(spark, path, ["name"]).select("name"), "name", "left_anti")
    upsert(fresh.select(rows.columns), path, ["name"])


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """The registry: name, type, store, url, algo and, if assigned, the id."""
    return read_table(spark, path, ["name"])
