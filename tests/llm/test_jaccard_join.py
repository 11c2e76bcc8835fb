import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import documents, empty

from pickwell.llm import jaccard_join as J
from pickwell.llm.components import components
from pickwell.llm.queries import QUERIES
from pickwell.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts, percent=80):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, len(s), find(i)) for i, s in enumerate(sets)}


def corpus(seed, n=90):
    """Texts with chains of edits, copies, shared lines and short texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "😀", "Ab", "ab"]
    line = " ".join(r.choices(vocabulary, k=12))
    texts = [None, "", " \t\n", "one", "ONE", "a b c d", "A b\x0bc d", "a b c d e", "a b", "x " * 30_000]
    bases = [r.choices(vocabulary, k=r.randrange(5, 80)) for _ in range(8)]
    while len(texts) < n:
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        if r.random() < 0.3:
            words += line.split()
        if r.random() < 0.1:
            words = words[: r.randrange(1, 9)]
        texts.append(r.choice([" ", "\n", "  "]).join(words))
        if r.random() < 0.2:
            bases.append(words)
    r.shuffle(texts)
    return texts


def found(spark, texts, **options):
    return [tuple(r) for r in J.jaccard_components(documents(spark, texts), **options).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # columns cross batches
    if seed == 2:
        monkeypatch.setattr(J, "SMALL_IDS", 0)  # nothing is broadcast
        for name, value in {"FEW_ROWS": 3, "BLOCK_ROWS": 8, "PRODUCTS": 5, "STRIPE": 3}.items():
            monkeypatch.setattr(J, name, value)
    try:
        texts = corpus(seed)
        got = found(spark, texts)
        assert len(got) == len(texts) and set(got) == brute(texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_other_thresholds(spark):
    texts = corpus(9, 60)
    assert set(found(spark, texts, threshold=0.3)) == brute(texts, 30)
    assert set(found(spark, texts, threshold=1.0)) == brute(texts, 100)
    with pytest.raises(ValueError):
        J.jaccard_components(empty(spark), threshold=0.805)


def test_the_threshold_itself_links(spark):
    words = [f"w{i}" for i in range(84)]
    texts = [" ".join(words[:84]), " ".join(words[:68])]  # 64 of 80 shingles
    assert set(found(spark, texts)) == {(0, 80, 0), (1, 64, 0)}
    assert set(found(spark, [texts[0], " ".join(words[:67])])) == {(0, 80, 0), (1, 63, 1)}


def test_null_and_repeated_ids(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "x y", "p q", "x y"], [None, 4, 2, 2, 9, 7])
    rows = sorted(map(str, J.jaccard_components(docs).collect()))
    want = [(None, 2, None), (4, 2, 2), (2, 2, 2), (2, 1, 2), (9, 1, 9), (7, 1, 2)]
    assert rows == sorted(f"Row(doc_id={a}, n_shingles={b}, component_id={c})" for a, b, c in want)


def test_a_row_between_two_others_links_with_both(spark):
    """Every column holds two rows; the middle one meets both others equally often."""
    middle = [f"w{i}" for i in range(100)]
    left, right = (["x" if i in at else w for i, w in enumerate(middle)] for at in ((20, 40), (60, 80)))
    texts = [" ".join(t) for t in (left, right, middle)]
    assert {r[2] for r in brute(texts)} == {0}
    assert set(found(spark, texts)) == brute(texts)


@pytest.mark.parametrize("small", [False, True])
def test_an_id_that_heads_one_class_and_copies_another(spark, monkeypatch, small):
    if small:
        for name, value in {"FEW_ROWS": 1, "BLOCK_ROWS": 4}.items():
            monkeypatch.setattr(J, name, value)
    line = [f"w{i}" for i in range(60)]
    one, like_one, other = " ".join(line), " ".join([*line, "end"]), "p q r s t u"
    docs = documents(spark, [other, other, one, like_one, other], [1, 2, 2, 3, 9])
    got = {(r.doc_id, r.component_id) for r in J.jaccard_components(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 1)}
    # Classes of ids 1, 2 and 3, all tied by id 9.
    docs = documents(spark, ["a b", "c d", "e f", "a b", "c d", "e f"], [1, 2, 3, 9, 9, 9])
    assert {r.component_id for r in J.jaccard_components(docs).collect()} == {1}


def test_pairs_of_one_row_are_dealt_to_several_places(spark, monkeypatch):
    monkeypatch.setattr(J, "PAIRS_AT_ONCE", 2)
    line = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, [line, *(f"{line} e{i}" for i in range(8)), "x " + line + " y z v w u t s r q p o n m l k"]).cache()
    pairs = spark.createDataFrame([(0, i) for i in range(1, 10)], "a long, b long")
    got = J.similar(pairs, docs.select("doc_id", "text"), 5, 80).collect()
    assert {tuple(r) for r in got} == {(0, i) for i in range(1, 9)} and len(got) == 8


def test_empty_table(spark):
    assert J.jaccard_components(empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbBz \t\n\x0b\x1c é😀ÀÅ"), max_size=40), max_size=6))
def test_shingle_sets(texts):
    sets = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    for a, x in zip(sets, texts):
        for b, y in zip(sets, texts):
            assert len(set(a.tolist()) & set(b.tolist())) == len(shingles(x) & shingles(y))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(5, i) for i in range(30)] + [(40, 41), (41, 42), (60, 41)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got.pop(node) == min(seen)
    assert not got


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = [tuple(r) for r in QUERIES["op5_jaccard_join"](spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == len(rows) and set(got) == brute([r.text for r in rows])


def test_bins_bound_what_sets_share():
    draw = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 9), (40, 50), (700, 790), (700, 90)):
        one, other = (np.unique(draw.integers(0, 2**64 - 1, k, np.uint64)) for k in (n, m))
        for shared in (0, min(n, m) // 2, min(n, m)):
            x, y = one, np.unique(np.r_[one[:shared], other[shared:]])
            assert J.most_common(J.bins(x), J.bins(y)) >= len(np.intersect1d(x, y))
    crowded = np.arange(300, dtype=np.uint64)
    assert J.bins(crowded) is None and J.most_common(None, J.bins(one)) == float("inf")


def test_sets_of_unlike_rows_are_not_sent(spark):
    """Long texts of the same size that share a few shingles are told apart by their counts."""
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abcdefgh") + str(draw.randrange(500)) for _ in range(300)) for _ in range(4)]
    texts.append(texts[0] + " more words")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 4)], "a long, b long")
    assert [tuple(r) for r in J.possible(pairs, rows, 5, 80).collect()] == [(0, 4)]
