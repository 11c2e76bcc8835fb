"""N-gram Jaccard self-join: a blocked sparse product of the document by n-gram incidence matrix.

1.  Each text becomes its set of word shingles. Documents with equal sets are one class and one row
    of the matrix from here on.
2.  A row keeps its prefix: by size alone, two sets similar enough share one of the first
    ``n - ceil(t n) + 1`` shingles in any common order. Shingles in many documents come last in that order
    (by a count sketch of fixed size over all documents), so prefixes hold rare ones.
3.  Columns are dealt into blocks by shingle. In each column, every document is paired with the first: a
    number of pairs linear in the column. Pairs found similar, by exact overlap, are contracted.
4.  Only columns that still hold several components remain. Their product, summed per pair over
    the columns, counts overlaps in the prefixes; pairs whose count leaves them below the bound
    that their sizes set are discarded and the others are compared exactly. Before any sets are compared, counts of
    their shingles by ranges of hashes bound what two sets can share, and only sets of pairs that this leaves open are sent. Where columns are long,
    the product is taken in blocks of rows, so that no pair of rows leaves a task but the open ones.

Pairs inside a component are never made, so a large group of near copies costs as much as a star.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwell.functions.frames import union_all
from pickwell.llm.common import CHUNK_CHARS, chunk_bounds, runs, small, stored, texts_of
from pickwell.llm.components import components
from pickwell.llm.shingles import WORDS, shingle_sets

SKETCH_BITS = 18
SLICE_BITS = 12
FEW_ROWS = 64
"""Rows of a column up to which its pairs are made by a join."""
BLOCK_ROWS, STRIPE, PRODUCTS = 32_768, 256, 1 << 20
"""Rows of a block, about, rows counted at a time (32 MB of counts), and products of entries summed at a time."""
PAIRS_AT_ONCE = 256
"""Pairs with the same first row that are sent to one place, about."""
SMALL_IDS = 1_000_000
"""Ids up to this number (8 MB) are broadcast; more are joined by a shuffle."""


def _percent(value: float) -> int:
    """Thresholds are taken in whole percent, so that bounds are exact in integers."""
    percent = round(value * 100)
    if not 0 < percent <= 100 or abs(percent - value * 100) > 1e-9:
        raise ValueError("the threshold is a whole percentage")
    return percent


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and shingle sets of some rows at a time."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        for start, stop in chunk_bounds(sizes, CHUNK_CHARS):
            yield ids.slice(start, stop - start), shingle_sets(texts.slice(start, stop - start).to_pylist(), words)


def measured(rows: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, key`` of each row, ``key`` a 128-bit hash of the set; and the count sketch of each
    task, as rows with ``slice`` and ``counts`` and a null size."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "key", "slice", "counts"]
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for ids, sets in _sets(batches, words):
            buckets = np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)
            sketch += np.bincount(buckets.view(np.int64), minlength=len(sketch))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()),
            ], names)
        parts = sketch.reshape(-1, 1 << SLICE_BITS)
        used = [i for i in range(len(parts)) if parts[i].any()]
        yield pa.RecordBatch.from_arrays([
            pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary()),
            pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary()),
        ], names)

    return rows.mapInArrow(mapped, "doc_id long, n_shingles long, key binary, slice int, counts binary")


def sketch_levels(sets: DataFrame) -> np.ndarray:
    """The logarithm of how often shingles of a bucket occur, over all documents: a fixed 256 KB.

    Slices of the tasks' sketches are summed in two steps, so no group holds those of all tasks.
    """

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table["counts"].to_pylist())
        return pa.table({"slice": table["slice"][:1].cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = sets.where("slice is not null").select("slice", "counts").withColumn("salt", F.floor(F.rand(3) * 64).cast("int"))
    some = parts.groupBy("slice", "salt").applyInArrow(added, "slice int, counts binary")
    total = np.zeros((1 << (SKETCH_BITS - SLICE_BITS), 1 << SLICE_BITS), np.int64)
    for row in some.groupBy("slice").applyInArrow(added, "slice int, counts binary").collect():
        total[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return np.log2(1 + total.ravel()).astype(np.uint8)


def prefixes(rows: DataFrame, words: int, percent: int, levels: np.ndarray) -> DataFrame:
    """``gram, lead, doc, n`` for the shingles in each row's prefix.

    ``lead`` is less the more often the prefix's shingles occur: what others are copies of has none of its own, and
    comes before them in all columns they share.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, words):
            grams, owners, sizes, leads = [], [], [], []
            for i, one in enumerate(sets):
                n = len(one)
                if n:
                    length = n - -(-percent * n // 100) + 1
                    level = levels[one >> np.uint64(64 - SKETCH_BITS)]
                    order = np.argsort(level, kind="stable")[:length]
                    grams.append(one[order])
                    leads.append(np.full(length, -round(100 * float(level[order].mean())), np.int32))
                    owners.append(np.full(length, i))
                    sizes.append(np.full(length, n, np.int32))
            if grams:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(leads)),
                    ids.take(pa.array(np.concatenate(owners))), pa.array(np.concatenate(sizes)),
                ], ["gram", "lead", "doc", "n"])

    return rows.mapInArrow(mapped, "gram long, lead int, doc long, n int")


def stars(postings: DataFrame, percent: int) -> DataFrame:
    """From postings sorted by column: pairs ``a, b`` of a column's first document with each other one, if
    their sizes allow, with a null ``gram`` and the ``times`` they met; and the postings of columns with several documents."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first posting of the column that the last batch ended in, and whether it was given out
        for batch in batches:
            gram, doc, n = (batch.column(i).to_numpy() for i in range(3))
            if not len(gram):
                continue
            given = False
            if held is not None:
                gram, doc, n = (np.r_[h, x] for h, x in zip(held[0], (gram, doc, n)))
                given = held[1]
            start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            first = np.repeat(start, np.diff(np.r_[start, len(gram)]))
            other = np.flatnonzero(first != np.arange(len(gram)))
            center = first[other]
            small, large = np.minimum(n[center], n[other]), np.maximum(n[center], n[other])
            fits = (100 * small.astype(np.int64) >= percent * large.astype(np.int64)) & (doc[center] != doc[other])
            pairs, times = np.unique(np.c_[doc[center[fits]], doc[other[fits]]], axis=0, return_counts=True)
            several = np.zeros(len(gram), bool)
            several[other] = several[center] = True
            if given:
                several[0] = False
            last = int(start[-1])
            held = ((gram[last], doc[last], n[last]), bool(several[last]) or (given and last == 0))
            k, m = len(pairs), int(several.sum())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[np.zeros(k, np.int64), gram[several]], mask=np.arange(k + m) < k),
                pa.array(np.r_[pairs[:, 0], doc[several]]),
                pa.array(np.r_[pairs[:, 1], n[several].astype(np.int64)]),
                pa.array(np.r_[times, np.zeros(m, np.int64)]),
            ], ["gram", "a", "b", "times"])

    return postings.mapInArrow(mapped, "gram long, a long, b long, times long")


def only(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose ``doc_id`` is (``left_semi``) or is not (``left_anti``) among ``ids``. Few ids are
    broadcast, so that texts stay where they are."""
    return rows.join(small(ids, SMALL_IDS), "doc_id", how)


def bins(one: np.ndarray) -> bytes | None:
    """How many shingles of a set fall into each of some equal ranges of hashes, two to four a range; None if a byte cannot count them."""
    bits = max(1, len(one) // 2).bit_length() - 1
    places = (one >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(one), np.int64)
    counts = np.bincount(places, minlength=1 << bits)
    return None if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def most_common(one: bytes | None, other: bytes | None) -> float:
    """The most shingles that two sets with such bins can share."""
    if one is None or other is None:
        return float("inf")
    x, y = sorted((np.frombuffer(b, np.uint8) for b in (one, other)), key=len)
    return int(np.minimum(x, y.reshape(len(x), -1).sum(axis=1, dtype=np.int64)).sum())


def possible(pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` without those whose counts by ranges of hashes show that they are not similar. Whole sets are
    many times larger than the counts, so only sets of the pairs left need to be sent to each other."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, words):
            columns = [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([bins(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "bins"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = percent * (batch["n"].to_numpy() + batch["m"].to_numpy())
            most = np.array([most_common(*(b.as_py() for b in two)) for two in zip(batch["left"], batch["right"])], float)
            yield batch.select(["a", "b"]).filter(pa.array(most * (100 + percent) >= need))

    ids = stored(union_all(pairs.select(F.col("a").alias("doc_id")), pairs.select(F.col("b").alias("doc_id"))).distinct(), "bounded-ids")
    counts = stored(only(rows, ids, "left_semi").mapInArrow(counted, "doc_id long, n long, bins binary"), "shingle-counts")
    left = counts.join(small(pairs, SMALL_IDS), F.col("doc_id") == F.col("a")).select("a", "b", "n", F.col("bins").alias("left"))
    right = counts.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("bins").alias("right"))
    return left.join(right, "b").select("a", "b", "n", "m", "left", "right").mapInArrow(bounded, "a long, b long").distinct()


def similar(pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sets are similar, by the exact overlap of the whole sets."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "grams"])

    pairs = stored(pairs.select("a", "b").distinct(), "similar-pairs")
    pairs = stored(possible(pairs, rows, words, percent), "possible-pairs")
    spots = F.ceil(F.count(F.lit(1)) / PAIRS_AT_ONCE).cast("int").alias("spots")
    firsts = stored(pairs.groupBy("a").agg(spots), "first-rows")
    dealt = pairs.join(firsts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("spots")).cast("int").alias("spot"))
    ids = stored(union_all(pairs.select(F.col("a").alias("doc_id")), pairs.select(F.col("b").alias("doc_id"))).distinct(), "pair-ids")
    grams = stored(only(rows, ids, "left_semi").mapInArrow(mapped, "doc_id long, grams array<long>"), "shingle-sets")
    # A set is sent once for each pair it is the second of, and to each spot of those that it is the first of.
    left = grams.join(small(firsts, SMALL_IDS), F.col("doc_id") == F.col("a")).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("spots") - 1)).alias("spot"), F.col("grams").alias("left"))
    right = grams.join(small(stored(dealt, "dealt-pairs"), SMALL_IDS), F.col("doc_id") == F.col("b")).select("a", "spot", "b", F.col("grams").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    alike = 100 * both >= percent * (F.size("left") + F.size("right") - both)
    return right.join(left, ["a", "spot"]).where(alike).select("a", "b").distinct()


def product(live: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different components whose overlap in the columns ``gram, doc, n, component`` leaves
    them above the bound of their sizes.

    Columns of at most :data:`FEW_ROWS` rows are multiplied by a join. Rows that longer columns tie together are
    multiplied in blocks, over all their columns. A pair is counted by one of the two ways as a whole.
    """
    long = stored(live.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), F.min("doc").alias("center")).where(
        F.col("rows") > FEW_ROWS).select("gram", "center"), "long-columns")
    if long.isEmpty():
        return by_join(live.withColumn("tie", F.lit(None).cast("long")), percent)
    edges = live.join(long, "gram").select(F.col("doc").alias("a"), F.col("center").alias("b"))
    ties = components(edges).select(F.col("node").alias("doc"), F.col("component").alias("tie"))
    tied = stored(live.join(ties, "doc", "left"), "tied-columns")
    short = tied.join(long.select("gram"), "gram", "left_anti")
    return union_all(by_join(short, percent), by_blocks(tied.where("tie is not null"), percent))


def by_join(live: DataFrame, percent: int) -> DataFrame:
    x, y = live.alias("x"), live.alias("y")
    pairs = x.join(
        y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.doc") < F.col("y.doc"))
        & (F.col("x.component") != F.col("y.component")) & F.coalesce(F.col("x.tie") != F.col("y.tie"), F.lit(True))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")),
    ).groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(
        F.count(F.lit(1)).alias("common")
    )
    # What is not in both prefixes lies in the rest of the row whose prefix ends first.
    rest = F.ceil(percent * F.greatest("na", "nb") / F.lit(100)) - 1
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    return pairs.where(F.col("common") + rest >= need).select("a", "b")


def by_blocks(tied: DataFrame, percent: int) -> DataFrame:
    """The product in blocks of at most about :data:`BLOCK_ROWS` rows that are tied together.

    Large components have blocks of their own, which are not multiplied with each other; smaller ones
    share blocks. So the work grows with the rows of a large component times the rows outside it.
    """
    rows = tied.select("doc", "component", "tie").distinct()
    sizes = rows.groupBy("tie", "component").agg(F.count(F.lit(1)).alias("size"))
    pooled = sizes.where(F.col("size") <= BLOCK_ROWS // 2).groupBy("tie").agg(F.sum("size").alias("pooled"))
    large = F.col("size") > BLOCK_ROWS // 2
    deal = lambda by, total: F.pmod(F.xxhash64(by), F.ceil(F.col(total) / BLOCK_ROWS))
    block = F.when(large, F.concat_ws(".", "component", deal("doc", "size"))).otherwise(F.concat(F.lit("s"), deal("component", "pooled")))
    placed = stored(rows.join(sizes, ["tie", "component"]).join(pooled, "tie", "left").select(
        "doc", "tie", block.alias("block"), F.when(large, F.col("component")).alias("alone")), "row-blocks")
    blocks = placed.select("tie", "block", "alone").distinct()
    p, q = blocks.alias("p"), blocks.alias("q")
    meets = stored(p.join(
        q, (F.col("p.tie") == F.col("q.tie")) & (F.col("p.block") <= F.col("q.block"))
        & F.coalesce(F.col("p.alone") != F.col("q.alone"), F.lit(True)),
    ).select(F.col("p.tie").alias("tie"), F.col("p.block").alias("left"), F.col("q.block").alias("right")), "block-pairs")
    held = tied.join(placed.select("doc", "block"), "doc")
    left = held.join(meets.withColumn("block", F.col("left")), ["tie", "block"]).withColumn("side", F.lit(0))
    right = held.join(meets.where("left != right").withColumn("block", F.col("right")), ["tie", "block"]).withColumn("side", F.lit(1))
    names = ["tie", "left", "right", "side", "gram", "doc", "n", "component"]

    def multiplied(table: pa.Table) -> pa.Table:
        side, gram, doc, n, component = (table[c].to_numpy() for c in ("side", "gram", "doc", "n", "component"))
        one = not side.any()
        halves = [(side == 0), (side == 0) if one else (side == 1)]
        # An id that is repeated has a row for each of its sizes.
        orders = [np.lexsort((n[h], doc[h])) for h in halves]
        firsts = [np.r_[True, (np.diff(doc[h][o]) != 0) | (np.diff(n[h][o]) != 0)] for h, o in zip(halves, orders)]
        own = []
        for o, first in zip(orders, firsts):
            own.append(np.empty(len(o), np.int64))
            own[-1][o] = np.cumsum(first) - 1
        docs, sizes_, groups = ([x[h][o][first] for h, o, first in zip(halves, orders, firsts)] for x in (doc, n, component))
        row, column = own[0], gram[halves[0]]
        order = np.argsort(row, kind="stable")
        row, column = row[order], column[order]
        by = np.argsort(gram[halves[1]], kind="stable")
        right_gram, right_row = gram[halves[1]][by], own[1][by]
        begin, end = (np.searchsorted(right_gram, column, side) for side in ("left", "right"))
        width, found = len(docs[1]), []
        # Each entry on the left meets the right's entries of its column, for some rows at a time.
        for top in range(0, len(docs[0]), STRIPE):
            here = slice(*np.searchsorted(row, [top, top + STRIPE]))
            common = np.zeros(STRIPE * width, np.int32)
            for start, stop in runs(np.cumsum((end - begin)[here]) // PRODUCTS):
                times, low, mine = ((x[here])[start:stop] for x in (end - begin, begin, row))
                met = right_row[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
                places, counts = np.unique(np.repeat(mine - top, times) * width + met, return_counts=True)
                common[places] += counts.astype(np.int32)
            met = np.flatnonzero(common)
            i, j, common = met // width + top, met % width, common[met]
            na, nb = sizes_[0][i], sizes_[1][j]
            rest = -(-percent * np.maximum(na, nb) // 100) - 1
            need = -(-percent * (na + nb) // (100 + percent))
            open_ = (common + rest >= need) & (groups[0][i] != groups[1][j])
            open_ &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            found.append(np.c_[docs[0][i[open_]], docs[1][j[open_]]])
        a, b = np.concatenate(found).T
        pairs = np.unique(np.c_[np.minimum(a, b), np.maximum(a, b)], axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return union_all(left.select(*names), right.select(*names)).groupBy("tie", "left", "right").applyInArrow(multiplied, "a long, b long")


def jaccard_components(
    docs: DataFrame, threshold: float = 0.8, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two rows link when the Jaccard similarity of their shingle sets reaches ``threshold``; the component is the
    smallest id reachable by links. Rows without words (null text too) link with nothing. Ids are integers and
    taken for a key: rows that repeat an id are one document in links. Rows with a null id link with
    nothing and have a null component. Shingles are told apart by 64-bit hashes, equal sets by 128 bits.
    """
    percent = _percent(threshold)
    rows = texts_of(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    everything = stored(measured(rows, words), "set-sizes")
    sets = everything.where("slice is null").select("doc_id", "n_shingles", "key")
    levels = sketch_levels(everything)
    usable = sets.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("key").agg(F.min("doc_id").alias("first"))
    member = stored(
        sets.join(classes, "key", "left").select(
            "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("first")
        ), "set-classes",
    ).withColumn("first", F.when(F.col("doc_id").isNotNull(), F.col("first")))
    # Rows that repeat an id may lie in several classes, and head one while they are copies in another.
    ids = member.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(
        F.min("first").alias("low"), F.max("first").alias("high")
    )
    several = member.where("n_shingles > 0").join(ids.where("low != high"), "doc_id", "left_semi")
    repeated = several.select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    copies = stored(ids.where("high != doc_id").select("doc_id"), "copies")
    own = rows.where(F.col("doc_id").isNotNull())
    heads = only(own, copies, "left_anti")

    postings = prefixes(heads, words, percent, levels)
    dealt = postings.repartition("gram").sortWithinPartitions("gram", "lead", "doc").select("gram", "doc", "n")
    found = stored(stars(dealt, percent), "stars")
    pairs = stored(found.where("gram is null").groupBy("a", "b").agg(F.sum("times").alias("times")), "star-pairs")
    # Each document with the first one that it meets most, a pair a document; only those that this leaves alone with their others.
    most = F.max_by("a", F.struct("times", (-F.col("a")).alias("less"))).alias("a")
    nearest = stored(pairs.groupBy("b").agg(most).select("a", "b"), "nearest")
    linked = stored(similar(nearest, own, words, percent), "nearest-links")
    alone = pairs.select("a", "b").join(linked.select("b").distinct(), "b", "left_anti").join(nearest, ["a", "b"], "left_anti")
    others = stored(alone.select("a", "b"), "other-pairs")
    first_pairs = union_all(nearest, others).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near = stored(components(union_all(linked, similar(others, own, words, percent))), "contracted")

    columns = found.where("gram is not null").select("gram", F.col("a").alias("doc"), F.col("b").alias("n"))
    marked = columns.join(near.withColumnRenamed("node", "doc"), "doc", "left").withColumn(
        "component", F.coalesce("component", "doc")
    )
    marked = stored(marked, "columns")
    mixed_columns = marked.groupBy("gram").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows")
    ).where("low != high and rows > 2").select("gram")
    live = stored(marked.join(mixed_columns, "gram", "left_semi"), "live-columns")
    # Pairs of a first document that were left out as the other one had its link; columns of two rows hold no other pairs.
    apart = near.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    left_out = pairs.select("a", "b").join(linked.select("b").distinct(), "b", "left_semi").join(apart, "a", "left").join(
        apart.select(F.col("a").alias("b"), F.col("of_a").alias("of_b")), "b", "left"
    ).where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    unlike = union_all(product(live, percent), left_out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    open_pairs = stored(unlike.distinct().join(first_pairs, ["a", "b"], "left_anti"), "open-pairs")
    more = similar(open_pairs, own, words, percent)

    joined = components(union_all(near.select(F.col("node").alias("a"), F.col("component").alias("b")), more, repeated.select("a", "b")))
    return member.join(joined.withColumnRenamed("node", "first"), "first", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id")
    )


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, words: int = WORDS) -> DataFrame:
    """Rows of ``docs`` but those of a component whose smallest id is another row's, all columns as they are."""
    groups = jaccard_components(docs, threshold, words)
    later = stored(groups.where("component_id != doc_id").select(F.col("doc_id").alias("_later")).distinct(), "near-copies")
    return docs.join(small(later, SMALL_IDS), docs["doc_id"] == later["_later"], "left_anti")
