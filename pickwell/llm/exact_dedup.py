"""Exact deduplication by a 128-bit content hash, checked byte by byte."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwell.functions.frames import union_all
from pickwell.llm.common import small, stored, texts_of


def content_hash(text: Column) -> Column:
    """The 128 bits of MD5 over the UTF-8 bytes."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are grouped by ``digest``. Inside a hash, texts are grouped by their bytes
    (``groupBy(key, text)``, summed before the shuffle, so a text costs one row per map
    task however often it is copied). A hash with one text is then proven free of
    collisions and its rows join by the hash alone; rows of a hash with several texts join
    by hash and text.

    Null texts count as empty. ``keep`` is ``min`` or ``max`` of the ids, null ids last; a group of
    null ids only has a null ``keep_id`` and keeps its rows. The id is taken for a key: a row
    repeated with its id counts in ``group_size`` and shares the fate of its twin. An empty
    table gives an empty result.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    pick = F.max if keep == "max" else F.min
    rows = texts_of(docs, id_col, text_col).withColumn("key", digest(F.col("text")))
    texts = rows.groupBy("key", "text").agg(
        pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    classes = stored(
        texts.select("key", "keep_id", "group_size", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")),
        "text-classes",
    )
    shared = classes.groupBy("key").count().where("count > 1").select("key")
    members = rows.select("doc_id", "key")
    if shared.isEmpty():
        found = members.join(classes, "key")
    else:
        shared = stored(shared, "colliding-hashes")
        alone = members.join(classes.join(shared, "key", "left_anti"), "key")
        mixed = rows.join(shared, "key", "left_semi")
        own = mixed.groupBy("key", "text").agg(
            pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        ).withColumn("text_sha256", F.sha2(F.encode("text", "UTF-8"), 256))
        names = ["doc_id", "keep_id", "group_size", "text_sha256"]
        found = union_all(alone.select(*names), mixed.join(own, ["key", "text"]).select(*names))
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, keep: str = "min") -> DataFrame:
    """Rows of ``docs`` whose text stays, all columns as they are."""
    dropped = stored(
        exact_groups(docs, keep=keep).where("not kept").select(
            F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha256")
        ).distinct(), "dropped-copies",
    )
    own = F.unhex(F.sha2(F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8"), 256))
    gone = docs["doc_id"].eqNullSafe(dropped["_id"]) & (own == dropped["_sha256"])
    return docs.join(small(dropped), gone, "left_anti")
