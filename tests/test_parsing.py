import pytest
from pyspark.sql import functions as F

from pickwell.functions.columns import circular_slice, decode_ids, encode_ids, rank_key
from pickwell.operators.ratings import parse_ratings, triples_to_ratings


def parsed(spark, texts, **how):
    lines = spark.createDataFrame([(t,) for t in texts], "value string")
    return [tuple(r) for r in parse_ratings(lines, **how).collect()]


def test_rating_is_first_feature_plus_twice_the_rest(spark):
    assert parsed(spark, ["1,2,3", "1,2,3,4", "1,2,3,4,5"]) == [(1, 2, 3.0), (1, 2, 11.0), (1, 2, 21.0)]


def test_ids_are_truncated_and_trailing_empty_fields_ignored(spark):
    assert parsed(spark, ["12.9,-3.9,1", "5,6,7,,", " 5 , 6 ,7"]) == [(12, -3, 1.0), (5, 6, 7.0), (5, 6, 7.0)]


BAD = ["", ",", "1,2", "1,,3", "a,2,3", "1,2,x", "NaN,2,3", "3e10,2,3", "1,2,,4", "1,2,"]


def test_malformed_lines_are_dropped_or_defaulted(spark):
    assert parsed(spark, BAD) == []
    assert parsed(spark, BAD, on_malformed="default") == [(0, 0, 0.0)] * len(BAD)
    with pytest.raises(ValueError):
        parsed(spark, ["1,2,3"], on_malformed="keep")


def test_delimiter_is_a_pattern(spark):
    assert parsed(spark, ["1|2|3||", "1;2|3"], delimiter="[|;]") == [(1, 2, 3.0), (1, 2, 3.0)]


def test_triples_are_strict(spark):
    good = spark.createDataFrame([("1", "2", "2.5")], "u string, i string, r string")
    assert [tuple(r) for r in triples_to_ratings(good).collect()] == [(1, 2, 2.5)]
    bad = spark.createDataFrame([("x", "2", "2.5")], "u string, i string, r string")
    with pytest.raises(Exception):
        triples_to_ratings(bad).collect()


def test_id_lists(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([],), (None,)], "ids array<int>")
    texts = df.select(encode_ids(F.col("ids")).alias("t"))
    assert [r.t for r in texts.collect()] == ["3,1,2", "", None]
    assert [r.b for r in texts.select(decode_ids(F.col("t")).alias("b")).collect()] == [[3, 1, 2], [], []]


def test_rank_key_pads_but_never_cuts(spark):
    df = spark.createDataFrame([(7,), (99999,), (123456,)], "n int")
    assert [r.k for r in df.select(rank_key(F.col("n")).alias("k")).collect()] == ["00007", "99999", "123456"]


@pytest.mark.parametrize("items,start,n,want", [
    ([1, 2, 3], 2, 5, [3, 1, 2, 3, 1]), ([1, 2, 3], 3, 2, [1, 2]), ([], 0, 4, []), ([1, 2], 0, 0, []),
])
def test_circular_slice(spark, items, start, n, want):
    df = spark.createDataFrame([(items, start, n)], "items array<int>, start bigint, n int")
    assert df.select(circular_slice(F.col("items"), F.col("start"), F.col("n")).alias("p")).first().p == want
