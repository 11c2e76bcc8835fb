"""Token ids of documents in files: segments of rANS blocks, written and read in parallel.

A file is a Parquet file whose rows are segments of whole documents in ascending ``doc_id`` order: the ids and lengths of
the documents, a frequency table (:mod:`pickwell.llm.rans`) and the blocks it is shared by, each with its checksum.
Blocks hold a fixed number of tokens, so their places in the array are checkpoints: any range of
tokens is decoded from the blocks that it meets. Spark commits the files, so a task that is lost and run again leaves no
part of a segment behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from pickwell.llm import rans
from pickwell.llm.common import chunk_bounds, texts_of
from pickwell.llm.token_ids import TokenIds, with_end

SEGMENT_TOKENS = 1 << 20
"""A segment is closed by the document that fills it, so a longer document has one of its own."""
END = 0
"""The id that ends each document."""


def _schema(kind: DataType) -> str:
    return (
        f"part int, segment int, first long, n_tokens long, doc_ids array<{kind.simpleString()}>, doc_tokens array<long>, "
        "table binary, blocks array<binary>"
    )


def write(
    docs: DataFrame, tokenizer_json: str, path: str, end: int = END, segment_tokens: int = SEGMENT_TOKENS,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Write the ids of all documents, each ended by ``end``, to a new folder.

    A null text counts as empty: its end id alone. Null ids come first; rows that share an id are all kept and follow each other
    by a hash of their texts, so a very frequent id is spread over tasks. An empty table gives a folder without rows.
    """
    kind = docs.schema[id_col].dataType
    rows = texts_of(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    of_texts = TokenIds(tokenizer_json)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first = TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Array] = []
        tokens: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def closed(upto: int) -> pa.RecordBatch:
            """The first ``upto`` of the documents held."""
            nonlocal number, first, ids, tokens, counts
            own, flat, sizes = pa.concat_arrays(ids), np.concatenate(tokens), np.concatenate(counts)
            cut = int(sizes[:upto].sum())
            out, rest = flat[:cut], flat[cut:]
            table = rans.table_of(out)
            row = {
                "part": [part], "segment": [number], "first": [first], "n_tokens": [cut], "doc_tokens": [sizes[:upto].tolist()],
                "table": [rans.pack_table(table)], "blocks": [rans.encode(out, table)],
            }
            kinds = {"part": pa.int32(), "segment": pa.int32(), "table": pa.binary(), "blocks": pa.list_(pa.binary()), "doc_tokens": pa.list_(pa.int64())}
            columns = {name: pa.array(values, kinds.get(name, pa.int64())) for name, values in row.items()}
            columns["doc_ids"] = pa.ListArray.from_arrays(pa.array([0, upto], pa.int32()), own.slice(0, upto))
            ids, tokens, counts = [own.slice(upto)], [rest], [sizes[upto:]]
            number, first = number + 1, first + cut
            order = ["part", "segment", "first", "n_tokens", "doc_ids", "doc_tokens", "table", "blocks"]
            return pa.RecordBatch.from_arrays([columns[name] for name in order], order)

        for batch in batches:
            own, texts = batch.column(0), batch.column(1)
            for start, stop in chunk_bounds(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1 << 19):
                found, bounds = with_end(*of_texts(texts.slice(start, stop - start).to_pylist()), end)
                ids.append(own.slice(start, stop - start))
                tokens.append(found)
                counts.append(np.diff(bounds))
                while True:
                    sizes = np.cumsum(np.concatenate(counts))
                    if not len(sizes) or sizes[-1] < segment_tokens:
                        break
                    yield closed(int(np.searchsorted(sizes, segment_tokens)) + 1)
        if sum(map(len, ids)):
            yield closed(sum(map(len, ids)))

    dealt.mapInArrow(segments, _schema(kind)).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a folder with ``start``, the number of ids before each."""
    rows = spark.read.parquet(path)
    # One row per task that wrote: as few as a shuffle has partitions.
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    shift = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    return rows.join(F.broadcast(shift), "part").withColumn("start", F.col("shift") + F.col("first")).drop("shift", "first")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from its decoded ids; a damaged block fails."""
    rows = read(spark, path).select("doc_ids", "doc_tokens", "start", "table", "blocks")
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, sizes, start, table, blocks = (c[i] for c in batch.columns)
                ids = np.concatenate(rans.decode(blocks.as_py(), rans.unpack_table(table.as_py())))
                counts = sizes.values.to_numpy()
                at = np.r_[0, np.cumsum(counts)]
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]
                columns = [own.values, pa.array(at[:-1] + start.as_py()), pa.array(counts), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(decoded, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """``start, ids`` of the tokens from ``start`` up to ``stop``, a row per segment, decoding only the blocks they are in."""
    size = rans.BLOCK_TOKENS
    low = F.greatest(F.lit(0), F.lit(start) - F.col("start"))
    high = F.least(F.col("n_tokens"), F.lit(stop) - F.col("start"))
    rows = read(spark, path).withColumn("low", low).withColumn("high", high).where("low < high")
    skipped = F.floor(F.col("low") / size)
    met = F.slice("blocks", (skipped + 1).cast("int"), (F.ceil(F.col("high") / size) - skipped).cast("int"))
    wanted = rows.select((F.col("start") + F.col("low")).alias("start"), (F.col("low") - skipped * size).alias("skip"),
                         (F.col("high") - F.col("low")).alias("count"), "table", met.alias("blocks"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, skip, count, table, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.concatenate(rans.decode(blocks, rans.unpack_table(table)))[skip : skip + count]
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], ["start", "ids"])

    return wanted.mapInArrow(decoded, "start long, ids array<int>")
