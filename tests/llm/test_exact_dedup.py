import hashlib

import pytest
from odd import documents, empty
from pyspark.sql import functions as F

from pickwell.llm.exact_dedup import drop_exact_copies, exact_groups

TEXTS = ["a", None, "", "b", "a", "A", "a ", "é" * 70_000, "é" * 70_000, "é", "é", "a", None]


def brute(texts, pick):
    texts = [t or "" for t in texts]
    same = {t: [i for i, u in enumerate(texts) if u == t] for t in texts}
    return {
        (i, pick(same[t]), len(same[t]), i == pick(same[t]), hashlib.sha256(t.encode()).hexdigest())
        for i, t in enumerate(texts)
    }


@pytest.mark.parametrize("keep,pick", [("min", min), ("max", max)])
@pytest.mark.parametrize("digest", [None, lambda t: F.length(t), lambda t: F.lit(b"x")])
def test_against_brute_force_even_when_hashes_collide(spark, keep, pick, digest):
    options = {"digest": digest} if digest else {}
    rows = exact_groups(documents(spark, TEXTS), keep=keep, **options)
    assert rows.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, rows.collect())) == sorted(brute(TEXTS, pick))


def test_null_and_repeated_ids(spark):
    rows = exact_groups(documents(spark, ["a", "a", "b", "a", "c"], [None, 3, None, 3, 4]))
    assert sorted(map(str, (tuple(r)[:4] for r in rows.collect()))) == sorted(map(str, [
        (None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, None, 1, True), (4, 4, 1, True)
    ]))


def test_empty_table(spark):
    assert exact_groups(empty(spark)).count() == 0
    assert drop_exact_copies(empty(spark)).columns == empty(spark).columns


def test_kept_rows_keep_their_columns(spark):
    docs = documents(spark, ["a", "b", "a", None, ""], [5, 5, 6, 7, 8])
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.select(docs.columns[:2]).fillna("").collect()) == [(5, "a"), (5, "b"), (7, "")]


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        exact_groups(empty(spark), keep="first")
