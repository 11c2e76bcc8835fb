"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwell.llm.chars import code_points, joined, mixed, odd_factors
from pickwell.llm.common import CHUNK_CHARS, chunk_bounds, over_texts, stored, texts_of

SIZES = (4, 5, 6)
SAMPLE_PER_CLASS = 2_000
"""Labelled rows of each class that a fit reads, chosen by a hash of the id."""
FEATURES = 4_096
LEAST_ROWS = 5
LEAST_CHI2 = 20.0
_SHIFT = np.uint64(42)


@dataclass(frozen=True)
class Model:
    """``grams`` are sorted 64-bit n-gram hashes; ``weights`` already hold the log-count ratios."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float


def grams_of(texts: list[str], sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the hash of the n-gram at every place and the number of its text.

    Texts are lower-cased, with a blank before and after, so that word starts and ends count.
    """
    full, starts = joined([f" {t.lower()} " for t in texts], "\0")
    codes = code_points(full).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    factors = odd_factors(max(sizes), 11)
    total = np.zeros(len(codes), np.uint64)
    for k in range(max(sizes)):
        total = total[: len(codes) - k] + codes[k:] * factors[k]
        if k + 1 in sizes:
            inside = owner[: len(total)] == owner[k:]
            # The gap belongs to the text before it; an n-gram that holds it ends in it.
            inside &= codes[k:] != 0
            yield mixed(total[inside]), owner[: len(total)][inside]


def count_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of each class that hold an n-gram, summed over some rows."""
    for frame in in_parts(frames):
        toxic = frame["toxic"].to_numpy() == 1
        for grams, owner in grams_of(frame["text"].tolist()):
            order = np.lexsort((owner, grams))
            grams, owner = grams[order], owner[order]
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
            grams, hit = grams[new], toxic[owner[new]]
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, int)
            if len(first):
                yield pd.DataFrame({
                    "gram": grams[first].view(np.int64),
                    "n_toxic": np.add.reduceat(hit, first, dtype=np.int64),
                    "n_clean": np.add.reduceat(~hit, first, dtype=np.int64),
                })


def in_parts(frames: Iterator[pd.DataFrame], limit: int = 1 << 19) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for start, stop in chunk_bounds(frame["text"].str.len().to_numpy(), limit):
            yield frame.iloc[start:stop]


def hits(texts: list[str], grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (text, place of the n-gram in ``grams``) of the n-grams a model knows."""
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.zeros(1 << 22, bool)
    maybe[grams >> _SHIFT] = True
    pairs = []
    for found, owner in grams_of(texts):
        some = np.flatnonzero(maybe[found >> _SHIFT])
        place = np.searchsorted(grams, found[some])
        same = grams[np.minimum(place, len(grams) - 1)] == found[some]
        pairs.append(owner[some[same]] * len(grams) + place[same])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // len(grams), pairs % len(grams)


def sample(labels: DataFrame, rows: Column, per_class: int) -> DataFrame:
    """``doc_id, toxic`` of at most ``per_class`` rows of each class; a row labelled both ways is toxic."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").alias("toxic"))
    known = known.where(rows & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit("sample")), "doc_id"]
    return known.where("toxic = 1").orderBy(*order).limit(per_class).unionByName(
        known.where("toxic = 0").orderBy(*order).limit(per_class)
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    rows: Column | None = None,
    per_class: int = SAMPLE_PER_CLASS,
    features: int = FEATURES,
    least_rows: int = LEAST_ROWS,
    least_chi2: float = LEAST_CHI2,
) -> Model:
    """Fit on a bounded sample of labelled rows; ``rows`` is a condition on ``doc_id`` of ``labels``.

    Counts of n-grams are taken by Spark. The ``features`` n-grams with the highest chi-squared statistic are
    kept, of those that ``least_rows`` rows hold and whose statistic is ``least_chi2`` at least; each is scaled by its log-count ratio, and a logistic regression with an L2
    penalty is fitted on what they leave of the sample (a few indices per row). Without
    rows of both classes, the score is the smoothed share of toxic rows.
    """
    chosen = sample(labels, F.lit(True) if rows is None else rows, per_class)
    # The sample has at most 2 * per_class narrow rows, so broadcasting it is safe at any input size.
    # Of rows that repeat an id one counts, so no id owns the fit.
    found = texts_of(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows_used = stored(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in rows_used.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 1) / (n_toxic + n_clean + 2)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    a, b = F.col("n_toxic"), F.col("n_clean")
    ratio = F.log((a + 1) / (n_toxic + 2)) - F.log((b + 1) / (n_clean + 2))
    n, both = n_toxic + n_clean, a + b
    chi2 = n * F.pow(a * n_clean - b * n_toxic, F.lit(2)) / (both * (F.lit(float(n)) - both + 0.5) * float(n_toxic) * float(n_clean))
    counted = rows_used.repartition(16, "doc_id").mapInPandas(count_grams, "gram long, n_toxic long, n_clean long")
    kept = (
        counted.groupBy("gram").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
        .where(both >= least_rows).select("gram", ratio.alias("ratio"), chi2.alias("chi2"))
        .where(F.col("chi2") >= least_chi2).orderBy(F.desc("chi2"), "gram").limit(features).collect()
    )
    grams = np.array([r["gram"] for r in kept], np.int64).view(np.uint64)
    order = np.argsort(grams)
    grams, ratios = grams[order], np.array([r["ratio"] for r in kept])[order]

    def known(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_parts(frames):
            owner, place = hits(frame["text"].tolist(), grams)
            lists = np.split(place, np.searchsorted(owner, np.arange(1, len(frame))))
            yield pd.DataFrame({"toxic": frame["toxic"].to_numpy(), "grams": [x.astype(np.int32) for x in lists]})

    held = rows_used.select("text", "toxic").mapInPandas(known, "toxic int, grams array<int>").collect()
    weights, bias = logistic([np.array(r["grams"], np.int64) for r in held], np.array([r["toxic"] for r in held]), ratios)
    return Model(grams, weights, bias)


def logistic(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, penalty: float = 1e-4, steps: int = 800) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on present n-grams, each worth its ratio.

    Full-batch descent with momentum. Each weight's step is the inverse of a bound of its
    curvature: values times the absolute sum of their rows, which together bound the Hessian.
    """
    order = sorted(range(len(rows)), key=lambda i: (labels[i], rows[i].tolist()))  # whatever order Spark returns
    rows, labels = [rows[i] for i in order], labels[order].astype(float)
    places = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    values, n, m = ratios[places], len(rows), len(ratios)
    reach = 1 + np.bincount(owner, np.abs(values), n)
    rate = 1 / (np.bincount(places, np.abs(values) * reach[owner], m) / (4 * n) + penalty)
    bias_rate = 1 / (reach.sum() / (4 * n))
    weights, bias, speed, lift = np.zeros(m), 0.0, np.zeros(m), 0.0
    for _ in range(steps):
        ahead, high = weights + 0.9 * speed, bias + 0.9 * lift
        margin = np.bincount(owner, values * ahead[places], n) + high
        error = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels
        speed = 0.9 * speed - rate * (np.bincount(places, values * error[owner], m) / n + penalty * ahead)
        lift = 0.9 * lift - bias_rate * float(error.mean())
        weights, bias = weights + speed, bias + lift
    return weights * ratios, bias


def scores(texts: list[str], model: Model) -> np.ndarray:
    owner, place = hits(texts, model.grams)
    margin = np.bincount(owner, model.weights[place], len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text; ids are passed through, null or repeated, and an empty or
    null text has the score of the bias alone."""
    return over_texts(
        texts_of(docs, id_col, text_col), lambda texts: {"score": scores(texts, model)}, {"score": pa.float64()}
    )


def below(docs: DataFrame, model: Model, limit: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that score less than ``limit``, all columns as they are."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)), "")
            sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            for start, stop in chunk_bounds(sizes, CHUNK_CHARS):
                kept = scores(texts.slice(start, stop - start).to_pylist(), model) < limit
                yield batch.slice(start, stop - start).filter(pa.array(kept))

    return docs.mapInArrow(mapped, docs.schema)
