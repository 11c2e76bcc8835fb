import numpy as np
import pytest
from odd import documents, empty, fold
from pyspark.sql import functions as F

from pickwell.llm import toxicity as T
from pickwell.llm.queries import QUERIES

CLEAN = ["the calm sea and a boat", "green trees stand by the lake", "we read a book at night", "a warm day in spring"]


def labelled(spark, n=80):
    texts = [f"{CLEAN[i % 4]} {i}" + (" you vile Grubbish fool" if i % 2 else "") for i in range(n)]
    docs = documents(spark, [*texts, None, "", "x" * 50_000 + " grubbish", "grubbish", "quiet sea"])
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(n)] + [(3, 0, 1), (5, None, 1), (None, 1, 0)], "doc_id long, toxic int, quality int")
    return docs, labels


def test_learns_and_scores_whole_texts(spark):
    docs, labels = labelled(spark)
    model = T.fit(docs, labels, F.col("doc_id") < 60)
    rows = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    assert len(rows) == 85 and all(0 <= s <= 1 for s in rows.values())
    assert all((rows[i] >= 0.7) == bool(i % 2) for i in range(80))
    assert rows[82] > 0.5 and rows[83] > 0.5  # found at the end of a very long word, and alone
    assert rows[80] == rows[81] < 0.5 and rows[84] < 0.5


def test_fit_does_not_depend_on_partitions(spark):
    docs, labels = labelled(spark)
    one, two = T.fit(docs.repartition(1), labels), T.fit(docs.repartition(7), labels.repartition(3))
    assert (one.grams == two.grams).all() and np.allclose(one.weights, two.weights) and np.isclose(one.bias, two.bias)


def test_sample_is_bounded_and_a_row_labelled_both_ways_is_toxic(spark):
    _, labels = labelled(spark)
    rows = T.sample(labels, F.lit(True), 7).collect()
    assert sorted(r.toxic for r in rows) == [0] * 7 + [1] * 7
    assert {r.doc_id: r.toxic for r in T.sample(labels, F.lit(True), 99).collect()}[3] == 1


@pytest.mark.parametrize("rows,low,high", [("false", 0.49, 0.51), ("toxic = 1", 0.9, 1.0)])
def test_without_both_classes_the_score_is_a_share(spark, rows, low, high):
    docs, labels = labelled(spark)
    model = T.fit(docs, labels, F.expr(rows))
    scores = [r.score for r in T.score(docs, model).collect()]
    assert len(scores) == 85 and all(low <= s <= high for s in scores)


def test_empty_tables_null_and_repeated_ids(spark):
    docs, labels = labelled(spark)
    model = T.fit(empty(spark), labels)
    assert T.score(empty(spark), model).count() == 0
    assert T.fit(docs, labels.limit(0)).bias == 0
    rows = T.score(documents(spark, ["a", None, "a"], [None, 1, 1]), model).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]


def test_grams_are_those_of_each_text():
    texts = ["", "ab", "Ab cd", "é😀é", "abcdef" * 3]
    for size, (grams, owner) in zip(T.SIZES, T.grams_of(texts)):
        want = [(f" {t.lower()} "[i : i + size], k) for k, t in enumerate(texts) for i in range(len(t) + 2 - size + 1)]
        assert len(want) == len(grams)
        assert len({w[0] for w in want}) == len(set(grams.tolist()))
        assert sorted(k for _, k in want) == sorted(owner.tolist())


def test_query_holds_out_by_the_id_only(spark):
    rows = QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == (fold(r.doc_id, 3) == 1) for r in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in out]) > 0.9
