"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Toxic documents go, then all but one of equal texts and all but one of near copies (five-word shingles,
similarity 0.8 or more). Secrets are replaced, and the texts are packed into sequences.
"""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pickwell.llm import exact_dedup, jaccard_join, packing, secret_scan, toxicity
from pickwell.llm.common import read, stored
from pickwell.session import fresh_path

TOXIC_AT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a classifier fitted on the labelled ones. Null texts count as empty, which score
    as the classifier's bias alone; every row is judged by its own text, whatever its id."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.below(docs, model, TOXIC_AT)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id; null texts count as empty, null ids come last, and a row
    repeated with its id shares the fate of its twin."""
    return exact_dedup.drop_exact_copies(docs, keep="max")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest id; texts without words are near to none, and rows that repeat an
    id are one document."""
    return jaccard_join.drop_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; null texts stay null."""
    ledger = fresh_path(spark, "secret-ledger")
    secret_scan.scan_unseen(docs, ledger)
    return secret_scan.redact(docs, ledger)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset; a null or empty text is one piece, its end id."""
    tokenizer = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    return packing.pack(packing.cut(docs, tokenizer))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("n-gram Jaccard join", drop_near),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

ORACLE_SQL = None  # a trained classifier and tokenisation are not SQL; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that all stages keep."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
