"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwell.session import fresh_path

CHUNK_CHARS = 1 << 18
"""Characters handled in one numpy pass, for some 30 MB of arrays; a longer text makes a pass of its own."""


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, ``doc_id`` and ``text``; a null text counts as empty. Other columns are left out,
    so their names cannot clash with an operator's own."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, its lineage cut,
    safe against lost executors. The folder is left to whoever owns ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SMALL_ROWS = 1_000_000


def small(rows: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Narrow stored rows, marked for a broadcast if a count finds no more than ``limit``; a join
    with more is left to a shuffle."""
    return rows if rows.count() > limit else F.broadcast(rows)


def chunk_bounds(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows so that a part has few characters or one row; every row is in one part."""
    return runs(np.cumsum(sizes) // limit)


def over_texts(
    rows: DataFrame, function: Callable[[list[str]], dict[str, Any]], fields: dict[str, pa.DataType], limit: int = CHUNK_CHARS
) -> DataFrame:
    """Apply ``function`` to the texts of ``doc_id, text`` rows, some at a time, in Arrow batches.

    It returns a column per field, a value per text; or a value per output row, with the
    text's number as ``owner``. Ids of any type are passed through as they are, null and repeated ones too.
    """
    kind = rows.schema["doc_id"].dataType
    ddl = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}
    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{name} {ddl[t]}" for name, t in fields.items())

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            for start, stop in chunk_bounds(sizes, limit):
                columns = function(texts.slice(start, stop - start).to_pylist())
                own = ids.slice(start, stop - start)
                if "owner" in columns:
                    own = own.take(pa.array(columns["owner"], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [own, *(pa.array(columns[name], t) for name, t in fields.items())], ["doc_id", *fields]
                )

    return rows.mapInArrow(mapped, schema)


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal neighbours."""
    if len(values):
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        edges = [0, *cuts.tolist(), len(values)]
        yield from zip(edges[:-1], edges[1:])


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus, F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
