import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import documents, empty
from tokenizers import Tokenizer

from pickwell.llm import packing as P
from pickwell.llm.queries import QUERIES

JSON = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
TEXTS = [None, "", "a", "two words", "x" * 3_000, "word 12 " * 2_000, "  \n\n é 😀 don't", "<|endoftext|>", "a", "one <|endoftext|> two"]


def check(rows, texts, capacity):
    """Every id is in one piece, sequences are gapless and not over the capacity."""
    tokenizer = Tokenizer.from_str(JSON)
    rest, places = {}, {}
    for r in rows:
        rest.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(rest.pop(i), key=lambda r: r.start):
            piece = ids[r.start : r.start + r.length]
            assert r.start == at and len(piece) == r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not rest
    for pieces in places.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_pieces_and_sequences(spark):
    docs = documents(spark, TEXTS)
    sequences = check(P.pack(P.cut(docs, JSON, 64), 64).collect(), TEXTS, 64)
    assert sequences <= 1 + sum(r.length for r in P.cut(docs, JSON, 64).collect()) / 60
    check(P.pack(P.cut(docs, JSON, 64), 64, group_pieces=7).collect(), TEXTS, 64)


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = P.pack(P.cut(documents(spark, ["a", "b", "c"], [None, 1, 1]), JSON)).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.doc_tokens) for r in rows) == [("1", 0, 2, 2), ("1", 0, 2, 2), ("None", 0, 2, 2)]
    assert sorted(r.offset for r in rows) == [0, 2, 4]
    assert P.pack(P.cut(empty(spark), JSON)).count() == 0


def test_other_tokenizers_get_whole_texts(spark):
    other = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    tokenizer = Tokenizer.from_str(other)
    for r in P.cut(documents(spark, ["Some  Words here", "x"]), other).collect():
        text = ["Some  Words here", "x"][r.doc_id]
        assert r.doc_tokens == len(tokenizer.encode(text, add_special_tokens=False).ids) + 1


def test_added_tokens_that_are_not_special(spark):
    parts = json.loads(JSON)
    size = 1 + max(parts["model"]["vocab"].values())
    flags = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}
    parts["added_tokens"].append({"id": size + 7, "content": "<tool> call", **flags})
    tokenizer = Tokenizer.from_str(json.dumps(parts))
    texts = ["plain words", "a <tool> call of words", "", "<tool> calls<tool> call", "<|endoftext|> <tool>", "more"]
    rows = P.cut(documents(spark, texts), json.dumps(parts)).collect()
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    new = tokenizer.token_to_id("<tool> call")
    assert [new in ids for ids in want] == [False, True, False, True, False, False]
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in rows}
    assert got == {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in enumerate(want)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_first_fit(sizes):
    used, want = [], []
    for size in sizes:
        bin_ = next((b for b, u in enumerate(used) if u + size <= 20), len(used))
        if bin_ == len(used):
            used.append(0)
        want.append((bin_, used[bin_]))
        used[bin_] += size
    assert list(zip(*P.first_fit(sizes, 20))) == want if sizes else P.first_fit(sizes, 20) == ([], [])


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = QUERIES["op7_packing"](spark, "/root/testdata/sf0.001").collect()
    sequences = check(got, [r.text for r in rows], 1_024)
    assert sum(r.length for r in got) > 0.97 * 1_024 * (sequences - 1)
