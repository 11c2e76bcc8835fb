"""Ranked lexical search by pipelined term partitioning.

Terms belong to owners, rare ones to the first and frequent ones to the last. Items travel in bundles: for each block of documents
a bundle carries sparse integer scores from owner to owner, and each owner adds what its terms contribute
(a cogroup of carried scores with the owner's postings by bundle and block). Between owners, a score that cannot reach
the item's k-th best even with all that later owners may add is left behind; nothing that can be among the best is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pickwell.functions.frames import numbered
from pickwell.llm.common import chunk_bounds, small, stored, texts_of
from pickwell.llm.token_ids import _Numbers

BLOCK_DOCS = 4_096
BLOCK_CHARS = 1 << 24
BUNDLE_ITEMS = 256
OWNED_SHARES = (256, 32, 8)
"""An owner takes terms that at most one document in so many holds; the last takes the others."""
SPLIT_BYTES = 1 << 20
WANTED_TERMS = 100_000
"""So many terms of items are sent to the tasks that read documents."""
UNIT = 1_000_000_000

#: Bytes of terms: digits, letters (capitals as small ones) and all bytes of other characters; the rest are gaps.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded size; a null byte is a gap like others."""
    data = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + SPLIT_BYTES) if at + SPLIT_BYTES < len(data) else -1
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def counted(text: str, wanted: set[bytes] | None) -> tuple[int, Counter[bytes]]:
    """How many terms a text has, and how often it has each wanted one (each one where ``wanted`` is None)."""
    total, found = 0, Counter()
    for terms in terms_of(text):
        total += len(terms)
        found.update(terms if wanted is None else filter(wanted.__contains__, terms))
    return total, found


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, term, repeats``; rows that share an id are one item, with the terms of all of them."""
    rows = texts_of(items, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, text in zip(batch.column(0), batch.column(1).to_pylist()):
                found = counted(text, None)[1]
                ids = pa.array([own.as_py()] * len(found), batch.schema.field(0).type)
                columns = [ids, pa.array([t.decode("utf-8", "surrogatepass") for t in found], pa.string()), pa.array(found.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "term", "repeats"])

    found = rows.mapInArrow(counts, f"item_id {kind}, term string, repeats long")
    return found.groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"))


def index(docs: DataFrame, wanted: set[bytes] | None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Stored rows per block of documents: one with ``ids`` and ``lengths`` (``term`` is null), and one per term with its postings,
    ``places`` in the block and ``counts``. ``docs`` and ``most`` are the documents with a term and all terms, or
    the documents with this term and its greatest count. Places follow the ids, so ties by place are ties by id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for low, high in chunk_bounds(sizes, BLOCK_CHARS):
                for start in range(low, high, block_docs):
                    yield block(name, batch.slice(start, min(block_docs, high - start)))
                    name += 1

    def block(name: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        rows = rows.take(pc.sort_indices(rows.column(0), null_placement="at_start"))
        number, lengths, terms, counts = _Numbers(), [], [], []
        for text in rows.column(1).to_pylist():
            total, found = counted(text, wanted)
            lengths.append(total)
            terms.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
            counts.append(np.fromiter(found.values(), np.uint32, len(found)))
        place = np.repeat(np.arange(len(terms), dtype=np.uint16), [len(t) for t in terms])
        term, count = np.concatenate(terms), np.concatenate(counts)
        order = np.argsort(term, kind="stable")
        place, count = place[order], count[order]
        ends = np.cumsum(np.bincount(term, minlength=len(number))).tolist()
        cuts = list(zip([0, *ends], ends))
        once = lambda value, kind: pa.array([value] + [None] * len(cuts), kind)
        columns = {
            "block": pa.array([name] * (1 + len(cuts)), pa.int64()),
            "term": pa.array([None, *(t.decode("utf-8", "surrogatepass") for t in number)], pa.string()),
            "docs": pa.array([int(np.count_nonzero(lengths)), *(b - a for a, b in cuts)], pa.int64()),
            "most": pa.array([sum(lengths), *(int(count[a:b].max()) for a, b in cuts)], pa.int64()),
            "places": pa.array([None, *(place[a:b].tobytes() for a, b in cuts)], pa.binary()),
            "counts": pa.array([None, *(count[a:b].tobytes() for a, b in cuts)], pa.binary()),
            "ids": once(rows.column(0).to_pylist(), pa.list_(rows.schema.field(0).type)),
            "lengths": once(lengths, pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    lists = f"ids array<{kind}>, lengths array<long>"
    schema = f"block long, term string, docs long, most long, places binary, counts binary, {lists}"
    return stored(docs.mapInArrow(blocks, schema), "postings")


def impact(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return UNIT * counts // (1_000 * counts + 12 * m)


CARRIED = "bundle int, block long, m array<long>, cells binary, scores binary, best array<struct<slot:int,place:int,score:long>>"


def owner_adds(k: int, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The step of an owner on one block and bundle: carried scores and postings to scores, with the best k of each item.

    Scores stand in a matrix of slots (the items of the bundle) by places (the documents of the block) that exists in the
    task alone; between owners only those travel that are above 0 and may still reach the item's bar.
    """

    def step(carried: pa.Table, postings: pa.Table) -> pa.Table:
        m = carried["m"][0].values.to_numpy()
        bars, rest = (carried[name][0].values.to_numpy() for name in ("bars", "rest"))
        scores = np.zeros((len(bars), len(m)), np.int64)
        cells = np.frombuffer(carried["cells"][0].as_py() or b"", np.int32)
        scores.ravel()[cells] = np.frombuffer(carried["scores"][0].as_py() or b"", np.int64)
        for places, counts, slots, weights in zip(*(postings[c].to_pylist() for c in ("places", "counts", "slots", "weights"))):
            places = np.frombuffer(places, np.uint16)
            gain = impact(np.frombuffer(counts, np.uint32).astype(np.int64), m[places])
            for slot, weight in zip(slots, weights):
                scores[slot, places] += weight * gain
        scores[scores + rest[:, None] < bars[:, None]] = 0
        top = min(k, len(m))
        floor = np.partition(scores, len(m) - top, axis=1)[:, len(m) - top]
        slot, place = np.nonzero((scores >= floor[:, None]) & (scores > 0))
        order = np.lexsort((place, -scores[slot, place], slot))
        slot, place = slot[order], place[order]
        chosen = np.arange(len(slot)) - np.searchsorted(slot, slot) < k
        slot, place = slot[chosen], place[chosen]
        cells = np.flatnonzero(scores).astype(np.int32) if not last else np.zeros(0, np.int32)
        best = [pa.array(slot.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(scores[slot, place])]
        return pa.table({
            "bundle": carried["bundle"],
            "block": carried["block"],
            "m": pa.array([None if last else m], pa.list_(pa.int64())),
            "cells": pa.array([cells.tobytes()], pa.binary()),
            "scores": pa.array([scores.ravel()[cells].tobytes()], pa.binary()),
            "best": pa.ListArray.from_arrays(pa.array([0, len(slot)], pa.int32()), pa.StructArray.from_arrays(best, ["slot", "place", "score"])),
        })

    return step


def by_slot(rows: DataFrame, names: list[str], size: int) -> DataFrame:
    """A row per bundle with an array per name that has a value for each slot, 0 where there is no row."""
    kept = rows.groupBy("bundle").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct(*names)))).alias("kept"))
    every = F.sequence(F.lit(0), F.lit(size - 1))
    dense = lambda name: F.transform(every, lambda i: F.coalesce(F.try_element_at("kept", i)[name], F.lit(0).cast("long")))
    return kept.select("bundle", *(dense(name).alias(name) for name in names))


def nth_best(rows: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best of each item, numbered as ``rank``."""
    order = W.partitionBy("bundle", "slot").orderBy(F.desc("score"), *ties)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, block_docs: int = BLOCK_DOCS, bundle_items: int = BUNDLE_ITEMS,
    shares: tuple[int, ...] = OWNED_SHARES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k best documents with a score above 0.

    Equal scores go by ascending id, null ids first. Every row is a document, rows that repeat an id too; rows of items that share an id
    are one item. Null and empty texts have no terms and are in no list. Scores are 64-bit integers.
    ``block_docs`` is at most 65,536. Which terms an owner has, and what is left behind between owners, changes no result.
    """
    spark = docs.sparkSession
    asked = stored(item_terms(items, item_col, text_col), "item-terms")
    terms = asked.select("term").distinct()
    # A filter that spares postings nobody asks for; beyond this bound all are written, and the joins below drop them.
    wanted = {r[0].encode("utf-8", "surrogatepass") for r in terms.collect()} if terms.count() <= WANTED_TERMS else None
    postings = index(texts_of(docs, id_col, text_col), wanted, block_docs)
    blocks, lists = postings.where("term IS NULL"), postings.where("term IS NOT NULL")
    n, total = blocks.agg(F.sum("docs"), F.sum("most")).first()
    if not total:
        kinds = {**dict(asked.dtypes), "doc_id": docs.schema[id_col].dataType.simpleString()}
        return spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")

    number = F.col("number") - 1
    numbers = stored(
        numbered(asked.select("item_id").distinct(), "item_id", "number").select(
            F.col("item_id").alias("item"), F.floor(number / bundle_items).cast("int").alias("bundle"),
            F.pmod(number, F.lit(bundle_items)).cast("int").alias("slot"),
        ),
        "items",
    )
    known = lists.groupBy("term").agg(F.sum("docs").alias("df"), F.max("most").alias("most"))
    weight = F.floor(1_000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("repeats")
    # No count is worth more than the greatest one in a document with the least m, which is 75.
    most = F.expr(f"{UNIT}L * most div (1000L * most + 900L)")
    owner = sum(((F.col("df") * share > n).cast("int") for share in shares), F.lit(0))
    lines = stored(
        asked.join(known, "term").join(small(numbers), F.col("item_id").eqNullSafe(F.col("item"))).select(
            "bundle", "slot", "term", owner.alias("owner"), weight.alias("weight"), (weight * most).alias("bound")
        ),
        "lines",
    )
    bundles = numbers.agg(F.max("bundle")).first()[0] or 0
    carried = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(bundles))).alias("bundle"), "block",
        F.expr(f"transform(lengths, x -> 75L + (25L * x * {n}L) div {total}L)").alias("m"),
        F.lit(None).cast("binary").alias("cells"), F.lit(None).cast("binary").alias("scores"),
    )
    bars = lines.select("bundle", "slot").distinct().withColumn("bars", F.lit(0).cast("long"))
    for stage in range(len(shares) + 1):
        later = F.sum(F.when(F.col("owner") > stage, F.col("bound")).otherwise(F.lit(0).cast("long"))).alias("rest")
        limits = by_slot(lines.groupBy("bundle", "slot").agg(later).join(bars, ["bundle", "slot"], "left"), ["rest", "bars"], bundle_items)
        owned = lines.where(F.col("owner") == stage).groupBy("bundle", "term").agg(
            F.collect_list(F.struct("slot", "weight")).alias("asking")
        ).select("bundle", "term", F.col("asking.slot").alias("slots"), F.col("asking.weight").alias("weights"))
        sent = lists.join(small(owned), "term").select(
            F.col("bundle").alias("to_bundle"), F.col("block").alias("to_block"), "places", "counts", "slots", "weights"
        )
        moved = carried.join(small(limits), "bundle").groupBy("bundle", "block").cogroup(sent.groupBy("to_bundle", "to_block"))
        carried = stored(moved.applyInArrow(owner_adds(k, stage == len(shares)), CARRIED), f"owner-{stage}")
        best = carried.select("bundle", F.explode("best").alias("best")).select("bundle", "best.slot", "best.score")
        bars = nth_best(best, k).groupBy("bundle", "slot").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bars"))

    found = carried.where(F.size("best") > 0).select("bundle", "block", "best").join(blocks.select("block", "ids"), "block")
    hit = lambda b: F.struct(b["slot"].alias("slot"), F.get("ids", b["place"]).alias("doc_id"), b["score"].alias("score"))
    rows = found.select("bundle", F.explode(F.transform("best", hit)).alias("hit")).select("bundle", "hit.*")
    return nth_best(rows, k, "doc_id").join(small(numbers), ["bundle", "slot"]).select(
        F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score"
    )
