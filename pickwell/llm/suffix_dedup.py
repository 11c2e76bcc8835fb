"""Suffix-array deduplication: bytes of long strings that occur elsewhere are removed.

1.  Windows of ``length`` bytes are filed by content-chosen anchors (:mod:`pickwell.llm.anchors`), in runs. Inside a task
    runs of equal bytes are put together before anything is shuffled.
2.  Runs under one key with equal bytes are copies of each other. Keys with one run are done.
3.  Only keys that hold different runs remain: their windows may agree in part. The bytes of these runs, one
    for each different run, are gathered by key and put in suffix order; from the order,
    the previous and next smaller positions give each position's longest previous factor, and, seen from the
    end, its longest next one. A window whose factor is long enough has an earlier (later) copy.
4.  Keys with very many different runs are not gathered: their windows are counted by hash instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pickwell.functions.frames import union_all
from pickwell.llm.anchors import Hashed, half_runs
from pickwell.llm.chars import mixed
from pickwell.llm.common import chunk_bounds, runs, stored, texts_of

LENGTH = 200
CHUNK_BYTES = 1 << 19
MANY_RUNS = 20_000
"""Different runs of a key up to which their bytes are gathered in one task."""
SMALL_SPANS = 1_000_000
"""Spans (16 bytes) up to this number are broadcast to the texts; more are joined by a shuffle."""
_SPAN_BITS = 20
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def packed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return first << _SPAN_BITS | (last - first)


def unpacked(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = spans >> _SPAN_BITS
    return first, first + (spans & ((1 << _SPAN_BITS) - 1))


def suffix_order(data: np.ndarray, cap: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """All suffixes in the order of their first ``cap`` bytes (equal ones by place), and their ranks by depth.

    The first ranks are those of words of eight bytes (or ``cap``); ranks of twice the depth come from
    pairs of ranks. Past the end counts as least.
    """
    n, depth = len(data), min(8, cap)
    wide = np.zeros(n + depth, np.uint64)
    wide[:n] = data.astype(np.uint64) + np.uint64(1)
    # Nine bits hold a byte and the end, so seven of them fit a word; the eighth is joined as a pair.
    word, held = np.zeros(n, np.uint64), min(7, depth)
    for k in range(held):
        word = word << np.uint64(9) | wide[k : k + n]
    rank = _ranks(word)
    levels = [(held, rank)]
    depth = held
    while depth < cap:
        step = min(depth, cap - depth)
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:]
        rank, depth = _ranks(rank * (n + 1) + after), depth + step
        levels.append((depth, rank))
    return np.argsort(rank * (n + 1) + np.arange(n)), levels


def _ranks(values: np.ndarray) -> np.ndarray:
    """Dense ranks from 1; equal values share one."""
    order = np.argsort(values)
    ahead = values[order]
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.cumsum(np.r_[True, ahead[1:] != ahead[:-1]][: len(values)])
    return ranks


def common_lengths(data: np.ndarray, order: np.ndarray, levels: list[tuple[int, np.ndarray]], cap: int) -> np.ndarray:
    """Common prefix length, up to ``cap``, of each suffix in the order with the one before it.

    Depths are tried from the longest; what is left under the least depth is compared byte by byte.
    """
    n = len(data)
    a, b = order[:-1], order[1:]
    done = np.zeros(max(0, len(order) - 1), np.int64)
    for depth, rank in reversed(levels):
        i, j = a + done, b + done
        same = np.flatnonzero((done + depth <= cap) & (np.maximum(i, j) + depth <= n))
        done[same[rank[i[same]] == rank[j[same]]]] += depth
    going = np.ones(len(done), bool)
    for _ in range(levels[0][0]):
        i, j = a + done, b + done
        going &= (done < cap) & (np.maximum(i, j) < n)
        live = np.flatnonzero(going)
        going[live] = data[i[live]] == data[j[live]]
        done += going
    return np.r_[np.zeros(min(1, len(order)), np.int64), done]


def previous_factors(order: np.ndarray, lengths: np.ndarray, size: int, least: int = 1) -> np.ndarray:
    """Longest previous factor of every position, where it is ``least`` or more, else 0.

    The longest match with an earlier position is with the previous or the next smaller position in suffix order. Both
    are found by a stack, run through each stretch of the order whose neighbours agree in ``least`` bytes;
    positions of different stretches have no match that long.
    """
    factors = np.zeros(size, np.int64)
    stretch = np.cumsum(lengths < least)
    for start, stop in runs(stretch):
        if stop - start < 2:
            continue
        stack: list[tuple[int, int]] = []  # growing places, each with its common length with the one below
        near = lengths[start:stop].tolist()
        near[0] = 0
        for place, low in zip(order[start:stop].tolist(), near):
            while stack and stack[-1][0] > place:
                bigger, own = stack.pop()
                factors[bigger] = max(own, low)
                low = min(low, own)
            stack.append((place, low))
        for bigger, own in stack:
            factors[bigger] = own
    return factors


def repeated_windows(parts: list[bytes], length: int, keep: str) -> list[np.ndarray]:
    """For each part, which windows of ``length`` have a copy elsewhere (``none``) or an earlier one (``first``)."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    # Windows across the border of two parts are none; without them the order stays one.
    edge = np.bincount(starts, minlength=len(data) + 1) - np.bincount(
        starts + np.maximum(0, sizes - length + 1), minlength=len(data) + 1
    )
    inside = np.cumsum(edge)[: len(data)] > 0
    order, levels = suffix_order(data, length)
    order = order[inside[order]]
    lengths = common_lengths(data, order, levels, length)
    hit = previous_factors(order, lengths, len(data), length) >= length
    if keep == "none":
        last = len(data) - 1
        hit |= (previous_factors(last - order, lengths, len(data), length) >= length)[::-1]
    return [hit[a : a + max(0, n - length + 1)] for a, n in zip(starts.tolist(), sizes.tolist())]


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with few bytes of text together, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)
        for start, stop in chunk_bounds(sizes, CHUNK_BYTES):
            yield batch.slice(start, stop - start)


def filed(rows: DataFrame, length: int) -> DataFrame:
    """``key, whole, row, span, weight`` of the runs of all texts.

    Of equal runs that a task sees together, the first keeps its key and has weight 2; the
    others come with a key of their own and weight 3: they are known to be copies that come later.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary())
            sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
            for start, stop in chunk_bounds(sizes, CHUNK_BYTES):
                hashed = Hashed(texts.slice(start, stop - start).to_pylist())
                half = half_runs(hashed, length)
                if not len(half.key):
                    continue
                base = hashed.starts[half.owner]
                row, first, last = ids[start:stop][half.owner], half.first - base, half.last - base
                order = np.lexsort((first, row, half.whole, half.key))
                key, whole, row, first, last = (x[order] for x in (half.key, half.whole, row, first, last))
                new = np.r_[True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])]
                count = np.diff(np.r_[np.flatnonzero(new), len(key)])
                weight = np.full(len(key), 3)
                weight[new] = np.minimum(count, 2)
                copies = np.flatnonzero(~new)
                merged = copies[np.lexsort((first[copies], row[copies]))]
                r, a, b = row[merged], first[merged], last[merged]
                joins = np.r_[False, (r[1:] == r[:-1]) & (a[1:] == b[:-1] + 1) & (a[1:] >> 16 == a[:-1] >> 16)]
                begin = np.flatnonzero(~joins[: len(r)])
                end = np.r_[begin[1:], len(r)] - 1 if len(begin) else begin
                one = np.flatnonzero(new)
                own = mixed(r[begin].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + a[begin].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.r_[key[one], own].view(np.int64)),
                    pa.array(np.r_[whole[one], own].view(np.int64)),
                    pa.array(np.r_[row[one], r[begin]]),
                    pa.array(np.r_[packed(first[one], last[one]), packed(a[begin], b[end])]),
                    pa.array(np.r_[weight[one], np.full(len(begin), 3)].astype(np.int32)),
                ], ["key", "whole", "row", "span", "weight"])

    return rows.mapInArrow(mapped, "key long, whole long, row long, span long, weight int")


def with_spans(rows: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Texts with their ``spans`` (one row per text). All spans are counted: up to :data:`SMALL_SPANS` they are
    broadcast, so texts stay where they are."""
    total = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    return rows.join(spans if total > SMALL_SPANS else F.broadcast(spans), "row", how)


def gathered(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``key, row, span, data``: the bytes of the wanted runs."""
    by_row = stored(wanted.groupBy("row").agg(F.collect_list(F.struct("key", "span")).alias("spans")), "runs-by-text")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            spans = batch.column("spans")
            owner = pc.list_parent_indices(spans)
            key, span = (pc.struct_field(pc.list_flatten(spans), name) for name in ("key", "span"))
            first, last = unpacked(span.to_numpy())
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            data = [texts[i][a : b + length] for i, a, b in zip(owner.to_pylist(), first.tolist(), last.tolist())]
            yield pa.RecordBatch.from_arrays(
                [key, batch.column("row").take(owner), span, pa.array(data, pa.binary())], ["key", "row", "span", "data"]
            )

    found = with_spans(rows.select("row", "text"), by_row, "inner")
    return found.mapInArrow(mapped, "key long, row long, span long, data binary")


def covered(spans: DataFrame, length: int) -> DataFrame:
    """``row, spans``: the maximal runs of bytes that the windows of ``row, span`` rows cover."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for some in batch.column("spans").to_pylist():
                first, last = unpacked(np.sort(np.array(some, np.int64)))
                stop = np.maximum.accumulate(last + length)
                begin = np.flatnonzero(np.r_[True, first[1:] > stop[:-1]])
                end = np.r_[begin[1:], len(first)] - 1
                merged.append([{"start": a, "stop": b} for a, b in zip(first[begin].tolist(), stop[end].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(merged, _SPANS)], ["row", "spans"])

    return spans.groupBy("row").agg(F.collect_list("span").alias("spans")).mapInArrow(
        mapped, "row long, spans array<struct<start:long,stop:long>>"
    )


def compared(parts: DataFrame, length: int, keep: str) -> DataFrame:
    """``row, span`` of the windows that :func:`repeated_windows` finds among the runs of each key.

    Parts come sorted by key, row and span; whole keys are taken together, some at a time.
    """

    def solved(table: pa.Table) -> pa.RecordBatch:
        out_row, out_span = [], []
        hits = repeated_windows(table["data"].to_pylist(), length, keep)
        for row, span, hit in zip(table["row"].to_pylist(), table["span"].to_pylist(), hits):
            for start, stop in runs(hit):
                if hit[start]:
                    out_row.append(row)
                    out_span.append(((span >> _SPAN_BITS) + start) << _SPAN_BITS | (stop - start - 1))
        return pa.RecordBatch.from_arrays([pa.array(out_row, pa.int64()), pa.array(out_span, pa.int64())], ["row", "span"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for part in (b.slice(at, 512) for b in batches for at in range(0, len(b), 512)):
            held.append(part)
            size += int(pc.sum(pc.binary_length(part.column("data"))).as_py())
            if size >= CHUNK_BYTES // 2:
                table = pa.Table.from_batches(held)
                keys = table["key"].to_numpy()
                whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if whole:
                    yield solved(table.slice(0, whole))
                    held = table.slice(whole).combine_chunks().to_batches()
                    size = sum(int(pc.sum(pc.binary_length(b.column("data"))).as_py()) for b in held)
        if held:
            yield solved(pa.Table.from_batches(held))

    dealt = parts.repartition("key").sortWithinPartitions("key", "row", "span")
    return dealt.mapInArrow(mapped, "row long, span long")


def counted(parts: DataFrame, length: int, keep: str) -> DataFrame:
    """As :func:`compared`, for keys with many different runs: windows are counted by two hashes."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("data").to_pylist()
            hashed = Hashed(data)
            at = np.concatenate([np.arange(a, max(a, b - length + 1)) for a, b in zip(hashed.starts[:-1], hashed.starts[1:])])
            owner = np.searchsorted(hashed.starts, at, side="right") - 1
            first = batch.column("span").to_numpy()[owner] >> _SPAN_BITS
            yield pa.RecordBatch.from_arrays([
                pa.array(batch.column("key").to_numpy()[owner]), pa.array(hashed.range(at, at + length).view(np.int64)),
                pa.array(batch.column("row").to_numpy()[owner]), pa.array(first + at - hashed.starts[owner]),
            ], ["key", "whole", "row", "at"])

    windows = parts.mapInArrow(mapped, "key long, whole long, row long, at long")
    place = F.struct("row", "at")
    same = windows.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("earliest")).where("n > 1")
    later = F.lit(True) if keep == "none" else place != F.col("earliest")
    return windows.join(same, ["key", "whole"]).where(later).select(
        "row", F.shiftleft("at", _SPAN_BITS).alias("span")
    )


def repeated_spans(rows: DataFrame, length: int, keep: str) -> DataFrame:
    """``row, span`` of runs of windows to remove."""
    same, in_key = Window.partitionBy("key", "whole"), Window.partitionBy("key")
    runs_ = filed(rows, length).repartition("key").select(
        "*",
        F.row_number().over(same.orderBy("row", "span")).alias("nth"),
        F.sum("weight").over(same).alias("copies"),
    ).select("*", (F.min("whole").over(in_key) != F.max("whole").over(in_key)).alias("several"))
    held = stored(runs_.where("copies > 1 or several"), "repeated-runs")
    whole = held.where("copies > 1" if keep == "none" else "nth > 1 or weight = 3").select("row", "span")
    unlike = held.where("several and nth = 1 and weight < 3").select("key", "row", "span", "copies")
    large = stored(unlike.groupBy("key").count().where(F.col("count") > MANY_RUNS).select("key"), "large-keys")
    parts = stored(gathered(rows, unlike, length), "unlike-runs")
    found = [whole, compared(parts.join(large, "key", "left_anti"), length, keep)]
    if not large.isEmpty():
        found.append(counted(parts.join(large, "key", "left_semi"), length, keep))
    return union_all(*found)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, keep: str = "first", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, kept, spans`` of every row: the UTF-8 bytes left, and what was removed.

    ``keep='first'`` removes bytes covered by a string of ``length`` bytes that starts earlier too, earlier being a smaller
    id or a smaller place; ``'none'`` removes every copy. Strings are judged on the input; they
    may overlap and lie in one document, but not cross documents. ``spans`` are the maximal removed runs,
    ends exclusive. Null texts count as empty; null and repeated ids are allowed (rows are then
    numbered as they are read, and that order counts).
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    rows = texts_of(docs, id_col, text_col)
    odd = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty() and rows.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        rows = rows.withColumn("row", F.col("doc_id").cast("long"))
    else:
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    spans = repeated_spans(rows.select("row", "text"), length, keep)
    by_row = stored(covered(spans, length), "spans-by-text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            texts = batch.column("text").cast(pa.binary())
            kept = []
            for text, removed in zip(texts.to_pylist(), batch.column("spans").to_pylist()):
                at, parts = 0, []
                for span in removed or ():
                    parts.append(text[at : span["start"]])
                    at = span["stop"]
                kept.append(b"".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(kept, pa.binary()), batch.column("spans"),
            ], ["doc_id", "n_bytes", "kept", "spans"])

    spans = F.coalesce("spans", F.array().cast("array<struct<start:long,stop:long>>")).alias("spans")
    joined = with_spans(rows, by_row, "left").select("doc_id", "text", spans)
    return joined.mapInArrow(mapped, f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>")
