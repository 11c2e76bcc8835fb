"""Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("key", "keep_id", "kept", "blob", "holder", "findings", "_id", "size", "score", "part", "start", "word", "token")


def documents(spark, texts, ids=None):
    """A frame of the columns of documents, and columns named like an operator's own."""
    from pyspark.sql import functions as F

    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({name: F.lit("x") for name in CLASHING})


def empty(spark):
    return documents(spark, [])


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus
