"""Lines to ratings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Parser = Callable[[DataFrame], DataFrame]
"""A line parser: any function from a ``value`` frame to a ratings frame."""

INT_MAX = 2147483647.0


def _checked_id(number: Column) -> Column:
    """Truncated id, null when it is NaN or beyond the int range."""
    fits = ~F.isnan(number) & (F.abs(number) <= INT_MAX)
    return F.when(fits, number.try_cast("int"))


def parse_ratings(lines: DataFrame, delimiter: str = ",", on_malformed: str = "drop") -> DataFrame:
    """``value`` lines ``user,item,f2[,f3...]`` to ``(user, item, rating)``.

    The rating is ``f2 + 2*(f3 + ... + fn)``. ``delimiter`` is a regular
    expression; trailing empty fields do not count. A line with fewer than
    three fields, an empty inner field or a non-number is malformed and is
    dropped, or becomes ``(0, 0, 0.0)`` with ``on_malformed='default'``.
    """
    if on_malformed not in ("drop", "default"):
        raise ValueError("on_malformed is 'drop' or 'default'")
    trimmed = F.regexp_replace("value", f"(?:{delimiter})+$", "")
    fields = F.transform(F.split(trimmed, delimiter), lambda f: f.try_cast("double"))

    def read(f: Column) -> Column:
        user, item = _checked_id(F.try_element_at(f, F.lit(1))), _checked_id(F.try_element_at(f, F.lit(2)))
        extras = F.slice(f, 4, F.greatest(F.size(f) - 3, F.lit(0)))
        rating = F.aggregate(extras, F.try_element_at(f, F.lit(3)), lambda acc, x: acc + x * 2)
        return F.struct(user.alias("user"), item.alias("item"), rating.alias("rating"))

    def good(r: Column) -> Column:
        return r["user"].isNotNull() & r["item"].isNotNull() & r["rating"].isNotNull()

    # One element per line: a filter on columns would be moved below them and split the line again for each.
    parsed = F.transform(F.array(fields), read)
    if on_malformed == "drop":
        parsed = F.filter(parsed, good)
    else:
        zero = F.struct(F.lit(0).alias("user"), F.lit(0).alias("item"), F.lit(0.0).alias("rating"))
        parsed = F.transform(parsed, lambda r: F.when(good(r), r).otherwise(zero))
    return lines.select(F.inline(parsed))


def apply_parser(lines: DataFrame, parser: Parser | None = None) -> DataFrame:
    """Run a user's parser, or the standard one."""
    return lines.transform(parser or parse_ratings)


def triples_to_ratings(triples: DataFrame) -> DataFrame:
    """String columns ``u, i, r`` to ratings; bad text is an error (ANSI cast)."""
    return triples.select(
        F.col("u").cast("int").alias("user"),
        F.col("i").cast("int").alias("item"),
        F.col("r").cast("double").alias("rating"),
    )
