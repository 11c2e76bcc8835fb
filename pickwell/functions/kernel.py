"""Exact top-k of inner products for one slice of vectors, in numpy.

Spark decides which source and target rows meet; this module only ranks them.
Targets are visited by falling length, so a source row can stop as soon as
|source| * |target| cannot reach its current k-th score. Candidates come from
a matrix product and are then re-scored term by term in a fixed order, which
makes scores, and therefore ties, independent of how rows were grouped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS = 1 << 21
"""Scores held at once by one task (16 MB of doubles)."""

BLOCK = 4096
"""Target rows per matrix product."""

LEAF, LEAVES_FROM, LEAVES_RANK = 256, 1 << 15, 12
"""Targets of a leaf, the number of targets from which they are looked up by leaves, and the most features they may have for it (boxes
of more rule out little)."""

AT_ONCE = 1 << 15
"""Source rows that look up leaves together."""

PACK, BEAM = 64, 8
"""Groups that are bounded together first, and packs that are looked into for a source's best group."""

SLACK = 1e-9
"""Share of a bound that rounding may have taken."""

UNUSED = np.iinfo(np.int32).min
"""Id of an empty place."""

MATCHES = pa.list_(pa.struct([("id", pa.int32()), ("score", pa.float64())]))
LISTS = pa.schema([("id", pa.int32()), ("matches", MATCHES)])
MATCHES_DDL = "array<struct<id:int,score:double>>"
LISTS_DDL = f"id int, matches {MATCHES_DDL}"


def to_matrix(batch: pa.RecordBatch | pa.Table, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a dense matrix from ``(id, features)`` Arrow data."""
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in
               (batch.column("id"), batch.column("features"))]
    ids = columns[0].to_numpy(zero_copy_only=False).astype(np.int32)
    lengths = pc.list_value_length(columns[1])
    values = columns[1].flatten()
    if values.null_count or lengths.null_count or not pc.all(pc.equal(lengths, rank), min_count=0).as_py():
        raise ValueError(f"every feature vector must have {rank} elements")
    values = values.to_numpy(zero_copy_only=False)
    return ids, values.reshape(ids.size, rank)


class Targets:
    """Target vectors ordered by falling length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        length = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.lexsort((ids, -length))
        self.ids, self.vectors, self.length = ids[order], vectors[order], length[order]
        self.boxes: Boxes | None = None

    def __len__(self) -> int:
        return self.ids.size

    def by_leaves(self, k: int, distinct: bool) -> bool:
        """Whether lists of ``k`` are found by leaves. Very many targets of few features are then put in the order of a tree, once."""
        if len(self) < LEAVES_FROM or self.vectors.shape[1] > LEAVES_RANK or 4 * k * (2 if distinct else 1) > LEAF:
            return False
        if self.boxes is None:
            depth = max(1, int(np.ceil(np.log2(2 * len(self) / LEAF))))
            tree = Tree(self.vectors[:: max(1, len(self) // (16 << depth))], depth)
            # Shells by falling length, each twice as large as the one before, so a leaf's vectors are about as long.
            shell = np.log2(np.arange(len(self)) / BLOCK + 1).astype(np.int64)
            order = np.lexsort((tree.leaves(self.vectors), shell))
            self.ids, self.vectors, self.length = self.ids[order], self.vectors[order], self.length[order]
            starts = np.arange(0, len(self), LEAF)
            low, high = (f.reduceat(self.vectors, starts) for f in (np.minimum, np.maximum))
            self.boxes = Boxes(low, high, np.maximum.reduceat(self.length, starts))
        return True


class Best:
    """The best ``k`` targets so far for each of ``n`` source rows.

    Unused places score minus infinity. ``distinct`` keeps one entry per
    target id, the higher of at most two. ``least`` are scores known to be reached elsewhere; what lies below is left out.
    """

    def __init__(self, n: int, k: int, distinct: bool, least: np.ndarray | None = None):
        self.k, self.distinct = k, distinct
        self.id = np.zeros((n, 0), np.int32)
        self.score = np.zeros((n, 0))
        self.least = np.full(n, -np.inf) if least is None else np.where(np.isnan(least), -np.inf, least)
        self.floor = self.least.copy()

    def add(self, rows: np.ndarray, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Merge candidates of ``rows[at]``; ``at`` is ascending. Score desc, id asc."""
        if at.size == 0:
            return
        counts = np.bincount(at, minlength=rows.size)
        place = np.arange(at.size) - np.repeat(np.cumsum(counts) - counts, counts)
        new_id = np.full((rows.size, counts.max()), UNUSED, np.int32)
        new_score = np.full(new_id.shape, -np.inf)
        new_id[at, place], new_score[at, place] = ids, score
        new_id = np.concatenate((self.id[rows], new_id), axis=1)
        new_score = np.concatenate((self.score[rows], new_score), axis=1)
        if self.distinct:
            order = np.argsort(new_id, axis=1)
            new_id, new_score = _take(new_id, order), _take(new_score, order)
            pair = new_id[:, 1:] == new_id[:, :-1]
            second_lower = new_score[:, 1:] <= new_score[:, :-1]
            new_score[:, 1:][pair & second_lower] = -np.inf
            new_score[:, :-1][pair & ~second_lower] = -np.inf
        new_id, new_score = _ranked(new_id, new_score, self.k)
        width = new_id.shape[1]
        if width > self.id.shape[1]:
            grow = ((0, 0), (0, width - self.id.shape[1]))
            self.id = np.pad(self.id, grow, constant_values=UNUSED)
            self.score = np.pad(self.score, grow, constant_values=-np.inf)
        self.id[rows], self.score[rows] = new_id, new_score
        if width == self.k:
            self.floor = np.maximum(self.least, self.score[:, -1])

    @property
    def empty(self) -> bool:
        return self.id.shape[1] == 0

    def lists(self, source_ids: np.ndarray) -> pa.RecordBatch:
        """One row per source id that has a match."""
        used = self.score > -np.inf
        counts = used.sum(axis=1)
        some = counts > 0
        offsets = np.concatenate(([0], np.cumsum(counts[some]))).astype(np.int32)
        pairs = pa.StructArray.from_arrays(
            [pa.array(self.id[used], pa.int32()), pa.array(self.score[used], pa.float64())], names=["id", "score"]
        )
        matches = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
        return pa.RecordBatch.from_arrays([pa.array(source_ids[some], pa.int32()), matches.cast(MATCHES)], schema=LISTS)


def _take(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.take_along_axis(values, order, axis=1)


def _ranked(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by score desc, id asc, cut to ``k``.

    Rows are sorted by score alone; runs of equal scores, if any, are then put
    in id order by sorting (run, id) as one integer.
    """
    order = np.argsort(-score, axis=1)
    ids, score = _take(ids, order), _take(score, order)
    step = score[:, 1:] != score[:, :-1]
    if not step.all():
        key = np.zeros(ids.shape, np.int64)
        np.cumsum(step, axis=1, out=key[:, 1:])
        key = (key << 32) + (ids.astype(np.int64) + (1 << 31))
        key.sort(axis=1)
        ids = ((key & 0xFFFFFFFF) - (1 << 31)).astype(np.int32)
    return ids[:, :k], score[:, :k]


def _score_all(sources: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """All inner products of two term-major matrices, terms added in index order."""
    total = np.zeros((sources.shape[1], targets.shape[1]))
    term = np.empty_like(total)
    for a, b in zip(sources, targets):
        np.multiply(a[:, None], b[None, :], out=term)
        total += term
    return total


def _score_pairs(sources: np.ndarray, at: np.ndarray, targets: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of ``sources[:, at]`` and ``targets[:, col]``, terms added in index order."""
    total = np.zeros(at.size)
    for a, b in zip(sources, targets):
        total += a.take(at) * b.take(col)
    return total


def visit(best: Best, sources: np.ndarray, targets: Targets) -> None:
    """Offer every target to every source row."""
    if len(targets) == 0 or sources.shape[0] == 0:
        return
    reach = np.sqrt((sources * sources).sum(axis=1))
    rank = sources.shape[1]
    slack = 8 * (rank + 2) * np.finfo(float).eps * reach * targets.length.max()
    if targets.by_leaves(best.k, best.distinct):
        _visit_leaves(best, sources, targets, slack)
        return
    step, width, dense = _plan(len(targets), best.k, best.distinct)
    for start in range(0, len(targets), step):
        part = slice(start, start + step)
        active = np.flatnonzero(reach * targets.length[start] + slack >= best.floor - slack)
        if active.size == 0:
            break
        _offer(best, sources, active, targets.vectors[part], targets.ids[part], slack, width, dense)


def _visit_leaves(best: Best, sources: np.ndarray, targets: Targets, slack: np.ndarray) -> None:
    """Each source row meets the leaf that may hold its best first, and then the others that may still reach its floor."""
    width = 2 * best.k if best.distinct else best.k
    first, _ = targets.boxes.best(sources)
    order = np.argsort(first, kind="stable")
    ends = np.r_[np.flatnonzero(np.diff(first[order])) + 1, len(order)]
    visits = [(first[order[low]], order[low:high]) for low, high in zip([0, *ends], ends)]
    for leaf, rows in visits:
        part = slice(leaf * LEAF, (leaf + 1) * LEAF)
        _offer(best, sources, rows, targets.vectors[part], targets.ids[part], slack, width, False)
    for leaf, rows in targets.boxes.reached(sources, lambda: best.floor - 2 * slack):
        rows = rows[first[rows] != leaf]
        if rows.size:
            part = slice(leaf * LEAF, (leaf + 1) * LEAF)
            _offer(best, sources, rows, targets.vectors[part], targets.ids[part], slack, width, False)


def _offer(best: Best, sources: np.ndarray, active: np.ndarray, block: np.ndarray, ids: np.ndarray, slack: np.ndarray, width: int, dense: bool) -> None:
    """Offer a block of targets to the source rows ``active``."""
    by_term = np.ascontiguousarray(block.T)
    part = max(1, CELLS // block.shape[0])
    for lo in range(0, active.size, part):
        rows = active[lo : lo + part]
        terms = np.ascontiguousarray(sources[rows].T)
        scores = _score_all(terms, by_term) if dense else sources[rows] @ by_term
        need = (best.floor - slack)[rows]
        if block.shape[0] > width and not np.isfinite(need).all():
            cut = block.shape[0] - width
            need = np.maximum(need, np.partition(scores, cut, axis=1)[:, cut] - 2 * slack[rows])
        keep = scores >= need[:, None]
        at, col = np.divmod(np.flatnonzero(keep), block.shape[0])
        exact = scores[keep] if dense else _score_pairs(terms, at, by_term, col)
        hit = np.zeros(rows.size, bool)  # rows without a candidate stay as they are
        hit[at] = True
        best.add(rows[hit], (np.cumsum(hit) - 1)[at], ids[col], exact)


def _plan(n: int, k: int, distinct: bool) -> tuple[int, int, bool]:
    """Targets per block, candidates to keep per block, and whether most will be kept.

    When a list takes a good part of the catalogue, bounds save nothing: all
    targets form one block and are scored term by term at once.
    """
    width = 2 * k if distinct else k
    if 8 * width >= n:
        return max(n, 1), width, True
    return max(BLOCK, 2 * k), width, False


def top_lists(
    ids: np.ndarray, sources: np.ndarray, targets: Targets, k: int, distinct: bool = False, least: np.ndarray | None = None
) -> Iterator[pa.RecordBatch]:
    """Best-k lists, a bounded number of source rows at a time."""
    block, width, _ = _plan(len(targets), k, distinct)
    step = max(1, CELLS // max(min(block, len(targets)), min(width, len(targets)), 1))
    if targets.by_leaves(k, distinct):
        step = min(AT_ONCE, max(1, CELLS // width))
    for start in range(0, ids.size, step):
        part = sources[start : start + step]
        best = Best(part.shape[0], k, distinct, None if least is None else least[start : start + step])
        visit(best, part, targets)
        if not best.empty:
            yield best.lists(ids[start : start + step])


class Boxes:
    """Groups of targets by the least and the greatest of each feature and the greatest length.

    What no target of a group can exceed is known from these alone. Groups next to each other are bounded in packs first; NaN in a
    group or a source rules nothing out.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, length: np.ndarray):
        self.groups = low, high, length
        starts = np.arange(0, len(length), PACK)
        self.packs = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(length, starts)

    def __len__(self) -> int:
        return len(self.groups[2])

    def _bound(self, vectors: np.ndarray, sides: tuple[np.ndarray, ...], part: slice = slice(None)) -> np.ndarray:
        low, high, length = (s[part] for s in sides)
        with np.errstate(invalid="ignore"):
            most = np.maximum(vectors, 0) @ high.T + np.minimum(vectors, 0) @ low.T
            reach = np.sqrt((vectors * vectors).sum(axis=1))[:, None] * length[None, :]
            return np.minimum(most, reach) + SLACK * reach

    def needed(self, vectors: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, group), rows ascending, where a target may score the row's ``floor`` or more; NaN is no floor."""
        floor = np.where(np.isnan(floor), -np.inf, floor)
        found = [(rows, np.full(rows.size, group)) for group, rows in self.reached(vectors, lambda: floor)]
        at, group = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        order = np.argsort(at, kind="stable")
        return at[order], group[order]

    def reached(self, vectors: np.ndarray, floor: Callable[[], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """Groups with the rows that may score their floor or more there, as the floors are by then."""
        packs = self._bound(vectors, self.packs)
        for pack in range(packs.shape[1]):
            rows = np.flatnonzero(~(packs[:, pack] < floor()))
            if not rows.size:
                continue
            start = pack * PACK
            bound = self._bound(vectors[rows], self.groups, slice(start, start + PACK))
            for group in range(bound.shape[1]):
                hit = rows[~(bound[:, group] < floor()[rows])]
                if hit.size:
                    yield start + group, hit

    def best(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A group per row that may score highest, and what it may score; only the packs that may score highest are looked into."""
        packs = self._bound(vectors, self.packs)
        n = packs.shape[1]
        beam = np.argpartition(packs, n - BEAM, axis=1)[:, -BEAM:] if n > BEAM else np.broadcast_to(np.arange(n), packs.shape)
        asked = np.zeros(packs.shape, bool)
        np.put_along_axis(asked, beam, True, axis=1)
        best, most = np.zeros(len(vectors), np.int64), np.full(len(vectors), -np.inf)
        for pack in range(n):
            rows = np.flatnonzero(asked[:, pack])
            if rows.size:
                bound = self._bound(vectors[rows], self.groups, slice(pack * PACK, (pack + 1) * PACK))
                group = bound.argmax(axis=1)
                top = bound[np.arange(rows.size), group]
                better = ~(top <= most[rows])
                best[rows[better]], most[rows[better]] = group[better] + pack * PACK, top[better]
        return best, most


class Tree:
    """Halves of halves of a sample, each across its widest feature; vectors that lie near each other come to leaves near each other."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.feature, self.value = np.zeros(1 << depth, np.int32), np.full(1 << depth, np.inf)
        open_ = [(1, sample)]
        while open_:
            node, rows = open_.pop()
            if node >= 1 << depth or len(rows) < 2:
                continue
            widest = np.argmax(rows.max(axis=0) - rows.min(axis=0))
            self.feature[node], self.value[node] = widest, np.median(rows[:, widest])
            right = rows[:, widest] > self.value[node]
            open_ += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        node, rows = np.ones(len(vectors), np.int64), np.arange(len(vectors))
        for _ in range(self.depth):
            node = 2 * node + (vectors[rows, self.feature[node]] > self.value[node])
        return (node - (1 << self.depth)).astype(np.int32)
