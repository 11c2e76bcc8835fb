import math
import random
import re
import string
from collections import Counter

import pytest
from odd import CLASHING, documents, empty
from oracle import compare, connect
from pyspark.sql import functions as F

from pickwell.llm import lexical_search as S
from pickwell.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """``(item, rank, doc_id, score)`` by scoring every pair."""
    found = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(x for _, t in found for x in set(t))
    asked = {}
    for item, text in items:
        asked.setdefault(item, []).extend(terms(text))
    out = []
    for item, words in asked.items():
        scores = []
        for doc_id, t in found:
            counts = Counter(t)
            m = 75 + 25 * len(t) * n_docs // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * counts[w] // (1000 * counts[w] + 12 * m))
                for w in words if w in counts
            )
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return out


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit("x") for c in (*CLASHING, "term", "block", "slot")})


def found(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


ODD = [None, "", "the cat", "The CAT, the end", "é É漢字 cat", "cat\0dog", "of " * 3_000 + "cat", "the cat", "...", "dog-cat_dog", "the"]


def test_terms():
    assert [t.decode() for part in S.terms_of("É é-AZ09_\0x\u0085y 漢") for t in part] == terms("É é-AZ09_\0x\u0085y 漢")


def test_long_texts_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(S, "SPLIT_BYTES", 7)
    text = "a bb ccc dddddddddddddddd é" * 20 + " end"
    assert [t.decode() for part in S.terms_of(text) for t in part] == terms(text)
    assert S.counted(text, {b"bb", b"end"}) == (len(terms(text)), {b"bb": 20, b"end": 1})


def test_odd_rows(spark):
    items = [(1, "the cat the dog"), (2, None), (3, ""), (None, "cat é"), (4, "nowhere"), (1, "of")]
    ids = [5, 4, None, 3, 9, 8, 7, 3, 1, 2, None]
    got = S.search(documents(spark, ODD, ids), items_of(spark, items), 4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == sorted(brute(zip(ids, ODD), items, 4), key=repr)
    assert S.search(empty(spark), items_of(spark, items)).count() == 0
    assert S.search(documents(spark, [None, "", "?"]), items_of(spark, items)).count() == 0
    assert S.search(documents(spark, ODD), items_of(spark, [])).count() == 0


@pytest.mark.parametrize("shares, wanted", [((), 100), ((256, 32, 8), 100), ((30, 9, 4, 2), 0)])
def test_against_all_pairs(spark, monkeypatch, shares, wanted):
    """Several bundles and blocks; owners leave scores behind; with and without the filter on terms."""
    monkeypatch.setattr(S, "WANTED_TERMS", wanted)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(300)] + [(1_000 + i, "w1 w50 w50 w3") for i in range(40)]
    items = [(i, text(8)) for i in range(13)] + [(50, "w50 w59 w50")]
    frame = documents(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(3)
    got = S.search(frame, items_of(spark, items), 5, block_docs=16, bundle_items=4, shares=shares)
    assert found(got) == sorted(brute(docs, items, 5), key=repr)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), sf, QUERIES["op13_lexical_search"], ORACLES["op13_lexical_search"]) is None
