"""Column expressions used across operators. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed left to right in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def blend(new: Column, old: Column, weight: float) -> Column:
    """Elementwise ``weight * new + (1 - weight) * old``."""
    return F.zip_with(new, old, lambda n, o: n * F.lit(weight) + o * F.lit(1 - weight))


def encode_ids(ids: Column) -> Column:
    """``array<int>`` to ``1,2,3``."""
    return F.array_join(ids.cast("array<string>"), ",")


def decode_ids(text: Column) -> Column:
    """``1,2,3`` to ``array<int>``; null or empty text gives an empty list."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).cast("int"))
    return F.when(F.length(F.trim(text)) > 0, parts).otherwise(F.array().cast("array<int>"))


def rank_key(n: Column) -> Column:
    """Number as text, zero-padded to five digits, longer numbers kept whole."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(5), F.length(text)), F.lit("0"))


def next_offset(num: Column, offset: Column) -> Column:
    """Key right after the ``num`` rows that start at ``offset``."""
    return rank_key(num + offset.cast("int"))


def circular_slice(items: Column, start: Column, n: Column) -> Column:
    """``n`` elements from 0-based ``start``, wrapping around; safe for empty lists."""
    length = F.size(items)
    positions = F.sequence(start, start + n - 1)
    wrapped = F.transform(positions, lambda i: F.element_at(items, (i % length + 1).cast("int")))
    return F.when((n > 0) & (length > 0), wrapped).otherwise(F.array().cast("array<int>"))
