import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from pickwell.llm import topk_search as T
from pickwell.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, block string, pivot string, v string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "x", "x") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, ids, k, is_query):
    known = {}
    for i, v in zip(ids, vectors):
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            v = [int(np.floor(64 * float(np.float32(x)))) for x in v]
            known[i] = min(known.get(i, v), v)
    out = []
    for q in filter(is_query, known):
        scores = sorted((-sum(a * b for a, b in zip(known[q], v)), i) for i, v in known.items() if i != q)
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "clustered", "ties"])
def test_against_brute_force(spark, kind, monkeypatch):
    for name, value in {"PIVOTS": 4, "BLOCK": 16, "QUERY_BLOCK": 5, "GROUP_BLOCKS": 2}.items():
        monkeypatch.setattr(T, name, value)
    r = np.random.default_rng(3)
    vectors = r.normal(size=(300, 6))
    if kind == "clustered":
        vectors = r.normal(size=(5, 6))[r.integers(0, 5, 300)] * 3 + vectors * 0.05
    if kind == "ties":
        vectors = r.integers(-1, 2, (300, 6)) / 2
    got = sorted(map(tuple, T.top_k(frame(spark, vectors), F.col("vec_id") % 7 == 0, 10).collect()))
    assert got == brute(vectors, range(300), 10, lambda i: i % 7 == 0)


def test_odd_rows(spark):
    vectors = [[1, 2], None, [1, None], [float("nan"), 1], [float("inf"), 1], [], [3], [-1.01, 1], [5, 5], [4, 9], [1e6, -1e6], [2, 2]]
    ids = [0, 1, 2, 3, 4, 5, 6, 20, 7, 7, 8, None]
    got = sorted(map(tuple, T.top_k(frame(spark, vectors, ids), F.col("vec_id") % 20 == 0).collect()))
    assert got == brute(vectors, ids, 20, lambda i: i % 20 == 0)
    assert {g[0] for g in got} == {0, 20} and len(got) == 10


def test_empty_one_vector_and_no_query(spark):
    rows = frame(spark, [[1, 2]])
    assert T.top_k(rows.limit(0), F.lit(True)).columns == ["query_id", "rank", "vec_id", "score"]
    assert T.top_k(rows, F.lit(True)).count() == 0
    assert T.top_k(frame(spark, [[1, 2], [3, 4]]), F.lit(False)).count() == 0


def test_large_scores_stay_exact():
    vectors = np.array([[2**31, 3], [2**31, 1]])
    assert [(i, p.tolist(), s.tolist()) for i, p, s in T.best(vectors[:1], np.array([5, 6]), vectors, np.array([5]), 2)] == [(0, [1], [2**62 + 3])]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), sf, QUERIES["op9_topk_search"], ORACLES["op9_topk_search"]) is None
