"""Packing documents into sequences: first-fit decreasing with a tournament tree of free space.

Documents are tokenised and cut into pieces of at most a sequence. Pieces are dealt at random into groups of
bounded size, and each group is packed on its own.
"""

from __future__ import annotations

import zlib
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwell.llm.common import over_texts, stored, texts_of
from pickwell.llm.token_ids import TokenIds, ragged, with_end

CAPACITY = 1_024
GROUP_PIECES = 16_384
"""Pieces of a group, on average: enough for a tight packing, few enough for a task."""
END = 0
"""The id that ends each document."""

FIELDS = {"start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()}


class FreeSpace:
    """A tournament tree: every node holds the most free space of the bins below it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Place into the first bin that has room; its number and the space that was free."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        free = most[node]
        bin_, left = node - self.leaves, free - size
        most[node] = left
        while node > 1:
            node //= 2
            left = max(most[2 * node], most[2 * node + 1])
            if most[node] == left:
                break
            most[node] = left
        return bin_, free


def first_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, taken in the order given; none is over the capacity."""
    space = FreeSpace(len(sizes), capacity)
    placed = [space.put(size) for size in sizes]
    return [b for b, _ in placed], [capacity - free for _, free in placed]


def cut(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` per piece: a document's ids with the end id, cut at
    multiples of the capacity. An empty or null text is one piece, the end id."""
    of_texts = TokenIds(tokenizer_json)

    def pieces(texts: list[str]) -> dict[str, Any]:
        ids, bounds = with_end(*of_texts(texts), END)
        tokens = np.diff(bounds)
        count = -(-tokens // capacity)
        owner = np.repeat(np.arange(len(texts)), count)
        start = ragged(np.zeros(len(texts), np.int64), count) * capacity
        length = np.minimum(tokens[owner] - start, capacity)
        at = bounds[owner] + start
        sums = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
        return {"owner": owner, "start": start, "length": length, "ids_crc32": sums, "doc_tokens": tokens[owner]}

    return over_texts(texts_of(docs, id_col, text_col), pieces, FIELDS, limit=1 << 19)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Rows of :func:`cut` with ``sequence_id`` and ``offset``.

    Groups are drawn at random per row, so neither a long document nor a repeated id makes a large one; pieces and
    draws are stored first, so that a task run again sees the same. A sequence id is its group's
    number and its place in the group. Ties in length go by id, start and checksum.
    """
    held = stored(pieces.withColumn("draw", F.rand(17)), "pieces")
    groups = max(1, -(-held.count() // group_pieces))
    dealt = held.withColumn("group", F.floor(F.col("draw") * groups)).drop("draw")

    def packed(table: pa.Table) -> pa.Table:
        by = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        table = table.take(pc.sort_indices(table, by))
        bins, offsets = first_fit(table["length"].to_pylist(), capacity)
        sequence = np.array(bins, np.int64) + (table["group"].to_numpy() << 32)
        return table.drop_columns("group").append_column("sequence_id", pa.array(sequence)).append_column(
            "offset", pa.array(offsets, pa.int64())
        )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{name} long" for name in [*FIELDS, "sequence_id", "offset"])
    return dealt.groupBy("group").applyInArrow(packed, f"doc_id {kind}, {columns}")
