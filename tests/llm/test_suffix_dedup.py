import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import documents, empty

from pickwell.llm import suffix_dedup as S
from pickwell.llm.anchors import Hashed, half_runs
from pickwell.llm.queries import QUERIES


def brute(texts, length, keep="none"):
    """Kept bytes and spans, by all windows."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for i, t in enumerate(data):
        for at in range(len(t) - length + 1):
            seen.setdefault(t[at : at + length], []).append((i, at))
    out = []
    for i, t in enumerate(data):
        gone = np.zeros(len(t), bool)
        for at in range(len(t) - length + 1):
            places = seen[t[at : at + length]]
            if len(places) > 1 and (keep == "none" or places[0] != (i, at)):
                gone[at : at + length] = True
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out.append((i, len(t), np.frombuffer(t, np.uint8)[~gone].tobytes(), [tuple(x) for x in edges.reshape(-1, 2).tolist()]))
    return out


def corpus(seed, n=60):
    """Passages in changing surroundings, near copies, periodic texts, copies and short texts."""
    r = random.Random(seed)
    noise = lambda k: "".join(r.choices("abcdefghij é😀", k=k))
    passages = [noise(r.randrange(20, 120)) for _ in range(5)]
    texts = [None, "", "ab" * 300, "ab" * 90 + "c" + "ab" * 90, "x" * 500, "x" * 40, "x" * 39 + "é", noise(2_000)]
    while len(texts) < n:
        text = "".join(r.choice(passages) if r.random() < 0.5 else noise(r.randrange(60)) for _ in range(r.randrange(6)))
        if r.random() < 0.3 and text:
            at = r.randrange(len(text))
            texts += [text, text[:at] + "Z" + text[at + 1 :]]
        texts.append(text)
    r.shuffle(texts)
    return texts


def found(docs, **options):
    rows = S.remove_repeats(docs, **options).collect()
    return sorted((r.doc_id, r.n_bytes, bytes(r.kept), [tuple(s) for s in r.spans]) for r in rows)


@pytest.mark.parametrize("seed,keep", [(1, "none"), (2, "first"), (3, "none")])
def test_against_all_windows(spark, seed, keep, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(S, "SMALL_SPANS", 0)
    if seed == 3:
        monkeypatch.setattr(S, "MANY_RUNS", 1)  # windows are counted instead
    texts = corpus(seed)
    monkeypatch.setattr(S, "CHUNK_BYTES", 4_000)
    assert found(documents(spark, texts).repartition(5), length=40, keep=keep) == brute(texts, 40, keep)


def test_counting_keeps_the_first(spark, monkeypatch):
    monkeypatch.setattr(S, "MANY_RUNS", 1)
    texts = corpus(4, 30)
    assert found(documents(spark, texts).repartition(3), length=40, keep="first") == brute(texts, 40, "first")


def test_null_and_repeated_ids_and_empty_tables(spark):
    docs = documents(spark, ["a" * 50 + "b", "c" * 10, "d" * 41, None], [None, 1, 1, 1]).coalesce(1)
    rows = S.remove_repeats(docs, length=40, keep="none").collect()
    assert sorted((str(r.doc_id), r.n_bytes, bytes(r.kept)) for r in rows) == [
        ("1", 0, b""), ("1", 10, b"c" * 10), ("1", 41, b""), ("None", 51, b"b")
    ]
    assert S.remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        S.remove_repeats(empty(spark), keep="last")


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 40))
def test_orders_lengths_and_factors(data, cap):
    array = np.frombuffer(data, np.uint8)
    order, levels = S.suffix_order(array, cap)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: (data[i : i + cap], i))
    common = lambda i, j: next((k for k in range(cap) if max(i, j) + k >= len(data) or data[i + k] != data[j + k]), cap)
    lengths = S.common_lengths(array, order, levels, cap)
    assert lengths.tolist() == [common(a, b) if n else 0 for n, (a, b) in enumerate(zip([0, *order.tolist()], order.tolist()))]
    for least in (1, 3):
        want = [max([common(i, j) for j in range(i)], default=0) for i in range(len(data))]
        assert S.previous_factors(order, lengths, len(data), least).tolist() == [w if w >= least else 0 for w in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=120).map(lambda b: bytes(x % 2 for x in b)), max_size=5))
def test_equal_windows_are_filed_alike(texts):
    half = half_runs(Hashed(texts), 40)
    starts = np.cumsum([0, *map(len, texts)])
    keys = {}
    for owner, first, last, key in zip(half.owner.tolist(), half.first.tolist(), half.last.tolist(), half.key.tolist()):
        for at in range(first, last + 1):
            window = texts[owner][at - starts[owner] : at - starts[owner] + 40]
            assert len(window) == 40 and keys.setdefault(window, key) == key
    assert sum((half.last - half.first + 1).tolist()) == sum(max(0, len(t) - 39) for t in texts)


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = sorted(map(tuple, QUERIES["op10_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()))
    assert got == [(i, n, n - len(k), len(s), hashlib.sha256(k).hexdigest()) for i, n, k, s in brute([r.text for r in rows], 200)]
