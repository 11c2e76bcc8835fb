"""Scoring and top-k lists.

A score is an inner product; lists are ordered by score desc, id asc. Lists
come back nested, one row per source id::

    id int, matches array<struct<id:int, score:double>>

``ranked`` turns them into long rows. How the two sides meet depends only on
counted sizes, and every way is exact:

* target side small: it is broadcast and each list is complete at once; only
  the narrow source vectors are spread, no list is shuffled;
* source side small: the sources are broadcast, every task keeps their best k
  over its share of the targets, and the short lists are merged by key;
* both large: a grid. The longest targets are one group, the others are dealt to groups that lie near each
  other. All sources meet the longest group first, and then the group that may hold their best; the k-th score there
  rules out the groups none of whose vectors can reach it, by the bounds of their features and lengths. A source is sent
  only to the groups it still needs, in shards. Rows reach their
  cells by an equi-join key, and the lists are merged by key.

No plan holds a row per (source, target) pair outside a task's working block.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwell.functions import kernel
from pickwell.functions.columns import dot
from pickwell.functions.frames import numbered, union_all, write_once
from pickwell.model import FACTORS, FactorModel
from pickwell.operators.factors import as_factors
from pickwell.session import fresh_path

BROADCAST_BYTES = 64 << 20
CELL_ROWS, CELL_BYTES = 1 << 20, 256 << 20
"""Rows of a grid cell's side, and the bytes of its vectors and of the lists it gives, at most."""
FEW_GROUPS = 8
"""Groups beyond which it pays to look for each source's best one first."""
DEEPEST, SAMPLE_BYTES = 14, 16 << 20
"""Halvings of the targets, at most, and the bytes of the sample that tells where they are halved."""
MERGE_FAN_IN = 32
"""Partial lists of an id that meet in one row."""
PART_DDL = f"part int, {kernel.LISTS_DDL}"
ASKED_DDL = "id int, features array<double>, floor double"


def predict(model: FactorModel, pairs: DataFrame) -> DataFrame:
    """Scores of ``(user, item)`` pairs; pairs with an unknown side are dropped."""
    users = model.users.select(F.col("id").alias("user"), F.col("features").alias("u"))
    items = model.items.select(F.col("id").alias("item"), F.col("features").alias("v"))
    joined = pairs.join(users, "user").join(items, "item")
    return joined.select("user", "item", dot(F.col("u"), F.col("v")).alias("score"))


def top_k(
    sources: DataFrame,
    targets: DataFrame,
    rank: int,
    k: int,
    *,
    distinct: bool = False,
    n_sources: int | None = None,
    n_targets: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The best ``k`` targets of every source; both are ``(id, features)``.

    Source ids are unique. A target id may occur more than once; with
    ``distinct`` (ids occurring at most twice) only its best score is listed.
    Sizes not given are counted.
    """
    spark = sources.sparkSession
    sources, targets = as_factors(sources), as_factors(targets)
    row_bytes = 8 * rank + 4
    n_targets = targets.count() if n_targets is None else n_targets
    if n_targets * row_bytes <= broadcast_bytes:
        held = spark.sparkContext.broadcast(kernel.to_matrix(targets.toArrow(), rank))
        return _evenly(sources).mapInArrow(_score_sources(held, rank, k, distinct), kernel.LISTS_DDL)
    n_sources = sources.count() if n_sources is None else n_sources
    if n_sources * (row_bytes + 12 * k) <= broadcast_bytes and not distinct:
        held = spark.sparkContext.broadcast(kernel.to_matrix(sources.toArrow(), rank))
        spread = _evenly(targets)
        partial = spread.mapInArrow(_score_targets(held, rank, k), PART_DDL)
        return merge_lists(partial, k, tasks(spark))
    target_rows = max(1, min(cell_rows, CELL_BYTES // row_bytes))
    source_rows = max(1, min(cell_rows, CELL_BYTES // (row_bytes + 12 * k)))
    return _grid(sources, targets, rank, k, distinct, target_rows, source_rows, broadcast_bytes)


def _evenly(vectors: DataFrame) -> DataFrame:
    """Vectors spread over all cores by id.

    Scoring costs per row, far more than reading it, while file splits and
    adaptive partitions are sized by bytes; one shuffle of the narrow vectors
    gives every task the same work. Vectors that a join has dealt by id already would keep its partitions, which may
    be merged into one, so they are dealt by another hash.
    """
    return vectors.repartition(tasks(vectors.sparkSession), F.xxhash64("id"))


def tasks(spark: SparkSession) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _score_sources(held, rank: int, k: int, distinct: bool):
    def score(batches):
        targets = kernel.Targets(*held.value)
        at_once = kernel.AT_ONCE if targets.by_leaves(k, distinct) else 1
        for ids, vectors in _in_bulk(batches, rank, at_once):
            yield from kernel.top_lists(ids, vectors, targets, k, distinct)

    return score


def _in_bulk(batches, rank: int, rows: int):
    """Ids and vectors of the batches, put together up to about so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(kernel.to_matrix(batch, rank))
        n += batch.num_rows
        if n >= rows:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _score_targets(held, rank: int, k: int):
    def score(batches):
        ids, vectors = held.value
        step = max(1, kernel.CELLS // max(kernel.BLOCK, 2 * k))
        parts = [slice(lo, lo + step) for lo in range(0, ids.size, step)]
        best = [kernel.Best(ids[p].size, k, False) for p in parts]
        for batch in batches:
            targets = kernel.Targets(*kernel.to_matrix(batch, rank))
            for p, b in zip(parts, best):
                kernel.visit(b, vectors[p], targets)
        for p, b in zip(parts, best):
            if not b.empty:
                lists = b.lists(ids[p])
                part = pa.array([TaskContext.get().partitionId()] * lists.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([part, *lists.columns], ["part", "id", "matches"])

    return score


@dataclass(frozen=True)
class Grid:
    """Targets in groups, and which sources still need which groups after the first.

    ``first`` holds the lists of the longest group for every source. ``sources`` that need more have their ``floor``, the score that
    is still of use to them, and what they ``need``; ``cells`` are the pairs ``(shard, grp)`` to be scored, in as many shards a group
    as ``shards`` says. No source needs more than ``most`` groups.
    """

    targets: DataFrame
    first: DataFrame
    sources: DataFrame
    cells: DataFrame
    groups: int
    shards: DataFrame
    most: int


def _length() -> Column:
    return F.sqrt(dot(F.col("features"), F.col("features")))


def _score_cell(rank: int, k: int, distinct: bool):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vectors = kernel.to_matrix(left, rank)
        found = kernel.Targets(*kernel.to_matrix(right, rank))
        floor = left["floor"].to_numpy() if "floor" in left.column_names else None
        lists = pa.Table.from_batches(list(kernel.top_lists(ids, vectors, found, k, distinct, floor)), kernel.LISTS)
        if "part" in left.column_names:
            order = np.argsort(ids)
            parts = left["part"].to_numpy()[order][np.searchsorted(ids[order], lists["id"].to_numpy())]
        else:
            parts = [right["grp"][0].as_py() if right.num_rows else 0] * lists.num_rows
        return lists.add_column(0, "part", pa.array(parts, pa.int32()))

    return score


def _raise_floors(rank: int, k: int, distinct: bool):
    """The sources of a cell with the k-th score of its targets as floor, where that is higher."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vectors = kernel.to_matrix(left, rank)
        floor = left["floor"].to_numpy().copy()
        order = np.argsort(ids)
        for batch in kernel.top_lists(ids, vectors, kernel.Targets(*kernel.to_matrix(right, rank)), k, distinct, floor.copy()):
            lists = batch.column("matches")
            ends = lists.offsets.to_numpy()
            full = np.diff(ends) == k
            reached = lists.values.field("score").to_numpy()[ends[1:][full] - 1]
            rows = order[np.searchsorted(ids[order], batch.column("id").to_numpy()[full])]
            floor[rows] = np.fmax(floor[rows], reached)
        return _asked(left, floor)

    return score


def _asked(rows: pa.Table | pa.RecordBatch, floor: np.ndarray) -> pa.Table:
    return pa.table({"id": rows["id"], "features": rows["features"], "floor": pa.array(floor, pa.float64(), from_pandas=True)})


def _best_group(boxes, rank: int):
    """Adds ``grp``, the group that may hold a source's best, null if it holds nothing that the source needs."""

    def find(batches):
        for batch in batches:
            _, vectors = kernel.to_matrix(batch, rank)
            best, most = boxes.value.best(vectors)
            none = most < batch.column("floor").to_numpy(zero_copy_only=False)
            yield batch.append_column("grp", pa.array(best + 1, pa.int32(), mask=none))

    return find


def _needs(boxes, rank: int):
    """Adds ``need``, the groups after the first that a source needs; sources that need none are left out."""

    def find(batches):
        for batch in batches:
            _, vectors = kernel.to_matrix(batch, rank)
            step = max(1, kernel.CELLS // max(1, len(boxes.value)))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                at, grp = boxes.value.needed(vectors[start : start + step], part.column("floor").to_numpy(zero_copy_only=False))
                ends = np.r_[0, np.cumsum(np.bincount(at, minlength=part.num_rows))]
                need = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grp + 1, pa.int32()))
                yield part.append_column("need", need).filter(pa.array(np.diff(ends) > 0))

    return find


def _with_leaf(tree, rank: int):
    def find(batches):
        for batch in batches:
            _, vectors = kernel.to_matrix(batch, rank)
            yield batch.append_column("leaf", pa.array(tree.leaves(vectors), pa.int32()))

    return find


def _grouped(targets: DataFrame, rank: int, target_rows: int, n: int) -> DataFrame:
    """``n`` targets with ``grp``, from 1, in groups of ``target_rows`` that lie near each other.

    Where they are halved is taken from a sample; every target is in a group, whatever the sample was.
    """
    depth = min(DEEPEST, max(0, ceil(log2(max(1, 4 * n / target_rows)))))
    size = min(16 << depth, SAMPLE_BYTES // (8 * rank + 4))
    share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < F.lit(min(1.0, size / max(1, n)) * (1 << 30))
    tree = kernel.Tree(kernel.to_matrix(targets.where(share).select("id", "features").toArrow(), rank)[1], depth)
    leaves = targets.select("id", "features").mapInArrow(_with_leaf(tree, rank), f"{FACTORS}, leaf int")
    placed = numbered(leaves, ["leaf", "id"], "place")
    return placed.select("id", "features", (F.floor((F.col("place") - 1) / target_rows) + 1).cast("int").alias("grp"))


def _boxes(targets: DataFrame, rank: int) -> kernel.Boxes:
    """The bounds of the groups from 1 on: one row per group of very many targets."""
    bounds = [f(F.col("features")[j]).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(rank)]
    rows = targets.groupBy("grp").agg(*bounds, F.max(_length()).alias("length")).orderBy("grp").toArrow()
    low, high = (np.column_stack([rows[f"{name}{j}"].to_numpy() for j in range(rank)]) for name in ("low", "high"))
    return kernel.Boxes(low, high, rows["length"].to_numpy())


def _shards(counts: dict[int, int], source_rows: int, wide: int) -> list[tuple[int, int]]:
    """Shards of every group that so many sources need: enough for ``wide`` tasks, none of them much larger than ``source_rows``."""
    most = max(1, min(source_rows, ceil(sum(counts.values()) / wide)))
    return [(grp, ceil(n / most)) for grp, n in sorted(counts.items())]


def _meet(asked: DataFrame, targets: DataFrame, shards: DataFrame, found, ddl: str) -> DataFrame:
    """Sources with the ``grp`` they ask for and the group's targets in cells, one per shard of a group.

    Scoring costs per row, far more than reading it, so cells are spread over a given number of tasks and not by bytes.
    """
    n = tasks(asked.sparkSession)
    left = asked.join(F.broadcast(shards), "grp").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).drop("n")
    copies = targets.join(F.broadcast(shards), "grp").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    sides = (side.repartition(n, "shard", "grp").groupBy("shard", "grp") for side in (left, copies))
    return next(sides).cogroup(next(sides)).applyInArrow(found, ddl)


def _kept(rows: DataFrame, label: str) -> DataFrame:
    path = fresh_path(rows.sparkSession, label)
    write_once(rows, path)
    return rows.sparkSession.read.parquet(path)


def plan_grid(sources, targets, rank: int, k: int, distinct: bool, target_rows: int, source_rows: int, broadcast_bytes: int = 0) -> Grid:
    """Score everything against the longest targets, then find what each source still needs of the others.

    The longest group is broadcast if its rows may be, else it meets all sources in shards, each of which gets a copy of it. The k-th
    score there, and the one in the group that may hold a source's best, are a floor; a group is needed where its box reaches it.
    """
    spark = sources.sparkSession
    wide = 2 * spark.sparkContext.defaultParallelism
    n = targets.count()
    groups = ceil(n / target_rows)
    placed = numbered(targets.withColumn("length", _length()), [F.desc("length"), "id"], "place")
    longest = placed.where(F.col("place") <= target_rows).select("id", "features", F.lit(0).alias("grp"))
    if target_rows * (8 * rank + 4) <= broadcast_bytes:
        held = spark.sparkContext.broadcast(kernel.to_matrix(longest.select("id", "features").toArrow(), rank))
        lists = _evenly(sources).mapInArrow(_score_sources(held, rank, k, distinct), kernel.LISTS_DDL).select(F.lit(0).alias("part"), "id", "matches")
    else:
        copies = longest.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(4 * wide - 1)))).repartition(tasks(spark), "shard")
        dealt = sources.withColumn("in_shard", F.pmod(F.xxhash64("id"), F.lit(4 * wide)).cast("int")).repartition(tasks(spark), "in_shard")
        lists = dealt.groupBy("in_shard").cogroup(copies.groupBy("shard")).applyInArrow(_score_cell(rank, k, distinct), PART_DDL)
    first = _kept(lists, "longest")
    if groups <= 1:
        none = spark.createDataFrame([], f"{ASKED_DDL}, need array<int>")
        shards = spark.createDataFrame([], "grp int, n int")
        return Grid(longest, first, none, shards.select(F.lit(0).alias("shard"), "grp"), groups, shards, 0)

    others = _kept(_grouped(placed.where(F.col("place") > target_rows), rank, target_rows, n - target_rows), "groups")
    boxes = spark.sparkContext.broadcast(_boxes(others, rank))
    floor = first.select(F.col("id").alias("known"), F.when(F.size("matches") == k, F.element_at("matches", -1)["score"]).alias("floor"))
    asked = sources.join(floor, F.col("id") == F.col("known"), "left").select("id", "features", "floor")
    if groups > FEW_GROUPS and k <= target_rows:
        best = _kept(asked.mapInArrow(_best_group(boxes, rank), f"{ASKED_DDL}, grp int"), "best")
        counts = {r["grp"]: r["count"] for r in best.where("grp IS NOT NULL").groupBy("grp").count().collect()}
        shards = spark.createDataFrame(_shards(counts, source_rows, wide), "grp int, n int")
        raised = _meet(best.where("grp IS NOT NULL"), others, shards, _raise_floors(rank, k, distinct), ASKED_DDL)
        asked = union_all(best.where("grp IS NULL").select(raised.columns), raised)
    asked = _kept(asked.mapInArrow(_needs(boxes, rank), f"{ASKED_DDL}, need array<int>"), "needs")
    most = asked.agg(F.max(F.size("need"))).first()[0] or 0
    counts = {r["grp"]: r["count"] for r in asked.select(F.explode("need").alias("grp")).groupBy("grp").count().collect()}
    shards = spark.createDataFrame(_shards(counts, source_rows, wide), "grp int, n int")
    cells = shards.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("shard"), "grp")
    return Grid(union_all(longest, others), first, asked, cells, groups, shards, most)


def _grid(sources, targets, rank: int, k: int, distinct: bool, target_rows: int, source_rows: int, broadcast_bytes: int = 0) -> DataFrame:
    grid = plan_grid(sources, targets, rank, k, distinct, target_rows, source_rows, broadcast_bytes)
    if not grid.most:
        return grid.first.select("id", "matches")
    # Lists of a source are counted from the one of the longest group on.
    asked = grid.sources.select("id", "features", "floor", F.posexplode("need").alias("place", "grp"))
    asked = asked.select("id", "features", "floor", (F.col("place") + 1).alias("part"), "grp")
    lists = _meet(asked, grid.targets.where("grp > 0"), grid.shards, _score_cell(rank, k, distinct), PART_DDL)
    return merge_lists(union_all(grid.first, lists), k, grid.most + 1, distinct=distinct)


def merge_sorted(matches: Column, k: int | None, distinct: bool = False) -> Column:
    """Several sorted lists put after each other, as one: score desc, id asc, cut to ``k``.

    The sort is one that takes runs as they come, so lists that are sorted are merged. ``distinct`` keeps the better of equal ids.
    """
    if distinct:
        by_id = F.array_sort(F.transform(matches, lambda m: F.struct(m["id"].alias("id"), (-m["score"]).alias("less"))))
        before = F.concat(F.array(F.lit(None).cast("int")), F.slice(F.transform(by_id, lambda m: m["id"]), 1, F.size(by_id)))
        first = F.zip_with(by_id, before, lambda m, last: F.when(last.isNull() | (m["id"] != last), m))
        matches = F.transform(F.filter(first, lambda m: m.isNotNull()), lambda m: F.struct(m["id"].alias("id"), (-m["less"]).alias("score")))
    keyed = F.transform(matches, lambda m: F.struct((-m["score"]).alias("less"), m["id"].alias("id")))
    merged = F.sort_array(keyed) if k is None else F.slice(F.sort_array(keyed), 1, k)
    return F.transform(merged, lambda m: F.struct(m["id"].alias("id"), (-m["less"]).alias("score")))


def merge_two(one: DataFrame, other: DataFrame, k: int | None, distinct: bool = False) -> DataFrame:
    """Nested lists of two answers as one list per id; they meet in one equi-join and stay nested."""
    left = one.select("id", F.col("matches").alias("one"))
    right = other.select("id", F.col("matches").alias("other"))
    both = F.concat(*(F.coalesce(c, F.array().cast(kernel.MATCHES_DDL)) for c in ("one", "other")))
    return left.join(right, "id", "full_outer").select("id", merge_sorted(both, k, distinct).alias("matches"))


def merge_lists(partial: DataFrame, k: int, parts: int, fan_in: int = MERGE_FAN_IN, distinct: bool = False) -> DataFrame:
    """Partial lists ``(part, id, matches)`` to one list of the best ``k`` per id.

    Lists stay nested. At most ``fan_in`` of an id meet in a row, level by level, so a source whose partial lists come from
    very many tasks is never gathered in one place.
    """
    while parts > 1:
        parts = ceil(parts / fan_in)
        met = partial.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("id", "part")
        lists = met.agg(F.collect_list("matches").alias("lists"))
        partial = lists.select("part", "id", merge_sorted(F.flatten("lists"), k, distinct).alias("matches"))
    return partial.select("id", "matches")


def ranked(lists: DataFrame, source: str = "user", target: str = "item") -> DataFrame:
    """Nested lists to rows ``(source, rank, target, score)``, rank from 1."""
    rows = lists.select(F.col("id").alias(source), F.posexplode("matches").alias("pos", "m"))
    return rows.select(
        source, (F.col("pos") + 1).alias("rank"), F.col("m.id").alias(target), F.col("m.score").alias("score")
    )


def id_lists(lists: DataFrame) -> DataFrame:
    """Nested lists to ``(user, items array<int>)``, best first."""
    return lists.select(F.col("id").alias("user"), F.col("matches.id").alias("items"))


def _vectors(vectors: DataFrame, rank: int) -> DataFrame:
    """Query vectors, empty ones dropped (they have no list)."""
    return vectors.select("id", "features").where(F.size("features") > 0)


def _on(model: FactorModel, side: str, sources: DataFrame, k: int, how: dict) -> DataFrame:
    """Top-k against one side of a model, whose size is counted once per model."""
    how = {"n_targets": model.size(side), **how} if "n_targets" not in how else how
    return top_k(sources, getattr(model, side), model.rank, k, **how)


def items_for_features(vectors: DataFrame, model: FactorModel, k: int = 1000, **how) -> DataFrame:
    """Items for user vectors ``(id, features)``."""
    return _on(model, "items", _vectors(vectors, model.rank), k, how)


def users_for_features(vectors: DataFrame, model: FactorModel, k: int = 1000, **how) -> DataFrame:
    """Users for item vectors ``(id, features)``."""
    return _on(model, "users", _vectors(vectors, model.rank), k, how)


def items_for_users_subset(ids: DataFrame, model: FactorModel, k: int = 1000, **how) -> DataFrame:
    """Items for the users in ``ids``; unknown ids have no list."""
    chosen = model.users.join(ids.select("id").distinct(), "id", "left_semi")
    return _on(model, "items", chosen, k, how)


def users_for_items_subset(ids: DataFrame, model: FactorModel, k: int = 1000, **how) -> DataFrame:
    """Users for the items in ``ids``; unknown ids have no list."""
    chosen = model.items.join(ids.select("id").distinct(), "id", "left_semi")
    return _on(model, "users", chosen, k, how)


def items_for_all_users(model: FactorModel, k: int, **how) -> DataFrame:
    return _on(model, "items", model.users, k, how)


def users_for_all_items(model: FactorModel, k: int, **how) -> DataFrame:
    return _on(model, "users", model.items, k, how)


def items_for_factor_table(factors: DataFrame, model: FactorModel, k: int, **how) -> DataFrame:
    """Items for user factors of another model.

    Two models trained apart do not share a factor space; the caller decides
    whether their vectors may be compared.
    """
    return _on(model, "items", factors, k, how)
