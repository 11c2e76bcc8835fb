"""Exact top-k search by inner product over a pivot-distance index.

Vectors are lifted by one coordinate to a common length, so that the largest inner product is the least distance.
Each is filed under its nearest pivot (a bounded sample of the vectors) by its distance from it,
and each pivot's list, sorted by distance, is cut into annuli of bounded size. A query's k-th best score so far
bounds how far a better vector may lie; by the triangle inequality, only annuli whose distances
from the pivot are that close to the query's own can hold one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickwell.llm.common import runs, stored

PIVOTS = 64
BLOCK = 1_024
"""Vectors of an annulus, at most."""
QUERY_BLOCK = 256
FIRST_ANNULI = 2
"""Annuli of its nearest pivot that a query block searches first."""
GROUP_BLOCKS = 64
"""Query blocks that meet an annulus in one group, about."""
EXACT = float(1 << 53)


def scaled(embedding: Column, factor: int = 64) -> Column:
    """``floor(factor * x)`` of each component, taken as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def usable(vectors: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """``vec_id, v`` of the vectors that take part: id and vector not null, all components finite.
    Of rows that repeat an id, the least vector counts."""
    x = F.col("v").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min(scaled(F.col("v"), factor)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers; missing components count as 0."""
    values, offsets = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    if (offsets == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    rows = np.repeat(np.arange(len(column)), offsets)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(offsets) - offsets, offsets)] = values
    return out


class Pivots:
    """Lifted pivots; distances of vectors and queries from them."""

    def __init__(self, vectors: np.ndarray, top: float) -> None:
        self.top = top  # the largest squared length of all vectors
        self.points = self.lifted(vectors)

    def lifted(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        v = vectors.astype(float)
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, self.top - (v * v).sum(axis=1)))
        return np.c_[v, rest]

    def distances(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        x = self.lifted(vectors, query)
        squares = (x * x).sum(axis=1)[:, None] + (self.points * self.points).sum(axis=1) - 2 * x @ self.points.T
        return np.sqrt(np.maximum(0, squares))


def blocks(rows: DataFrame, pivots: Pivots, width: int, size: int, query: bool, count: int) -> DataFrame:
    """``block, pivot, low, high, ids, data``: vectors by nearest pivot and distance, in blocks of at most ``size``."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = pivots.distances(_matrix(batch.column("v"), width), query)
            pivot = away.argmin(axis=1) if len(away) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(pivot.astype(np.int32)), pa.array(away[np.arange(len(away)), pivot])],
                ["vec_id", "v", "pivot", "distance"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, away = batch.column("pivot").to_numpy(), batch.column("distance").to_numpy()
            ids, matrix = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), width)
            spans = [(a, min(a + size, stop)) for start, stop in runs(pivot) for a in range(start, stop, size)]
            yield pa.RecordBatch.from_arrays([
                pa.array([int(pivot[a]) for a, _ in spans], pa.int32()),
                pa.array([float(away[a:b].min()) for a, b in spans], pa.float64()),
                pa.array([float(away[a:b].max()) for a, b in spans], pa.float64()),
                pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([matrix[a:b].tobytes() for a, b in spans], pa.binary()),
            ], ["pivot", "low", "high", "ids", "data"])

    # Ranges by pivot and distance, so neither a crowded pivot nor equal vectors fill one task.
    tasks = max(1, -(-count // (16 * size)))
    filed = rows.mapInArrow(nearest, "vec_id long, v array<long>, pivot int, distance double")
    dealt = filed.repartitionByRange(tasks, "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    cut_rows = dealt.mapInArrow(cut, "pivot int, low double, high double, ids binary, data binary")
    return stored(cut_rows.withColumn("block", F.monotonically_increasing_id()), "query-blocks" if query else "annuli")


def best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, places and scores of the k best vectors but its own; ties to the smaller id."""
    limit = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if limit < EXACT:
        scores = (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    else:
        scores = queries @ vectors.T
    for i, row in enumerate(scores):
        other = np.flatnonzero(ids != own[i])
        row = row[other]
        if len(row) > k:
            bar = np.partition(row, len(row) - k)[len(row) - k]
            close = np.flatnonzero(row >= bar)
            other, row = other[close], row[close]
        order = np.lexsort((ids[other], -row))[:k]
        yield i, other[order], row[order]


def searched(pairs: DataFrame, query_blocks: DataFrame, annuli: DataFrame, width: int, k: int) -> DataFrame:
    """``query_id, vec_id, score``: each query's k best of each annulus it is paired with, if they reach its bar.

    Annuli are met by their query blocks in groups of about :data:`GROUP_BLOCKS`, so that no
    group grows with the number of queries.
    """
    met = pairs.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.join(met, "block").withColumn("part", F.pmod(F.xxhash64("query_block"), F.ceil(F.col("n") / GROUP_BLOCKS)).cast("int"))
    asked = dealt.select("block", "part", "query_block", "bars").join(
        query_blocks.select(F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("data").alias("query_data")),
        "query_block",
    )
    held = annuli.select(F.col("block").alias("annulus"), "ids", "data")
    parts = dealt.select(F.col("block").alias("annulus"), F.col("part").alias("slot")).distinct().join(held, "annulus")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        ids = np.frombuffer(right["ids"][0].as_py(), np.int64)
        vectors = np.frombuffer(right["data"][0].as_py(), np.int64).reshape(len(ids), width)
        for query_ids, data, bars in zip(*(left[c].to_pylist() for c in ("query_ids", "query_data", "bars"))):
            own = np.frombuffer(query_ids, np.int64)
            queries = np.frombuffer(data, np.int64).reshape(len(own), width)
            bars = np.frombuffer(bars, np.int64) if bars else np.full(len(own), np.iinfo(np.int64).min)
            for i, places, scores in best(queries, ids, vectors, own, k):
                reach = scores >= bars[i]
                out[0].append(np.full(int(reach.sum()), own[i]))
                out[1].append(ids[places[reach]])
                out[2].append(scores[reach])
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table([pa.array(x.astype(np.int64)) for x in columns], ["query_id", "vec_id", "score"])

    return asked.groupBy("block", "part").cogroup(parts.groupBy("annulus", "slot")).applyInArrow(
        scored, "query_id long, vec_id long, score long"
    )


def top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, factor: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best vectors by integer inner product, itself left out.

    ``is_query`` is a condition on ``vec_id``. Ties go to the smaller id; with fewer vectors all are returned.
    Vectors that are null or hold null or non-finite components take no part, nor do null ids; of rows
    that repeat an id, the least vector counts; missing components of a shorter vector count as 0.
    Scores are exact where they fit 64 bits.
    """
    rows = stored(usable(vectors, id_col, vector_col, factor), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    count, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(squares)).first()
    if not count:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(PIVOTS).collect()
    pivots = Pivots(_matrix(pa.array([r["v"] for r in chosen], pa.list_(pa.int64())), width), most)
    queries = rows.where(is_query)
    annuli = blocks(rows, pivots, width, BLOCK, False, count)
    asking = blocks(queries, pivots, width, QUERY_BLOCK, True, queries.count())

    # First, annuli of the nearest pivot whose distances are closest to the block's.
    near = asking.select(F.col("block").alias("query_block"), "pivot", F.col("low").alias("q_low"), F.col("high").alias("q_high"))
    gap = F.greatest(F.lit(0.0), F.col("low") - F.col("q_high"), F.col("q_low") - F.col("high"))
    nth = F.row_number().over(Window.partitionBy("query_block").orderBy("gap", "block"))
    first = near.join(annuli.select("block", "pivot", "low", "high"), "pivot").withColumn("gap", gap)
    first = stored(
        first.withColumn("nth", nth).where(F.col("nth") <= FIRST_ANNULI).select("query_block", "block", F.lit(None).cast("binary").alias("bars")),
        "first-pairs",
    )
    bars = top(searched(first, asking, annuli, width, k), k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bar")
    )
    asked = asking.withColumnRenamed("block", "query_block")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pivot, the distances at which a block's queries may still find a better vector."""
        for batch in batches:
            out: list[tuple] = []
            for block, ids, data, known in zip(*(batch.column(c).to_pylist() for c in ("query_block", "ids", "data", "known"))):
                own = np.frombuffer(ids, np.int64)
                lifted = np.frombuffer(data, np.int64).reshape(len(own), width)
                best_so_far = {x["query_id"]: x["bar"] for x in known}
                bar = np.array([best_so_far.get(q) if best_so_far.get(q) is not None else np.iinfo(np.int64).min for q in own.tolist()], np.int64)
                away = pivots.distances(lifted, True)
                square = (lifted.astype(float) ** 2).sum(axis=1) + pivots.top
                # Half a score and a little more for rounding: scores are whole numbers.
                room = np.maximum(0, square - 2 * (bar.astype(float) - 0.5))
                wide = np.sqrt(room) * (1 + 1e-9) + 1e-6 * np.sqrt(1 + square)
                low, high = (away - wide[:, None]).min(axis=0), (away + wide[:, None]).max(axis=0)
                out += [(block, p, float(low[p]), float(high[p]), bar.tobytes()) for p in range(away.shape[1])]
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["query_block", "pivot", "from_", "to_", "bars"]
            )

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x, np.int64) for x in batch.column("ids").to_pylist()]
            sizes = [len(x) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("query_block").to_numpy(), sizes)), pa.array(np.concatenate(lists) if lists else [], pa.int64())],
                ["query_block", "query_id"],
            )

    members = asked.select("query_block", "ids").mapInArrow(ids_of, "query_block long, query_id long")
    known = members.join(bars, "query_id", "left").groupBy("query_block").agg(F.collect_list(F.struct("query_id", "bar")).alias("known"))
    windows = asked.join(known, "query_block").select("query_block", "ids", "data", "known").mapInArrow(
        reach, "query_block long, pivot int, from_ double, to_ double, bars binary"
    )
    rings = annuli.select("block", "pivot", "low", "high")
    pairs = windows.join(rings, "pivot").where((F.col("high") >= F.col("from_")) & (F.col("low") <= F.col("to_")))
    pairs = stored(pairs.select("query_block", "block", "bars"), "pairs")
    return top(searched(pairs, asking, annuli, width, k), k).select("query_id", "rank", "vec_id", "score")
