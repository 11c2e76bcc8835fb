import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import documents, empty

from pickwell.llm import byte_bpe as B
from pickwell.llm.pieces import PATTERN, PieceIds, split_all
from pickwell.llm.queries import QUERIES

TOKENS = B.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
CODER = B.Coder(TOKENS)
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
PARTS = [
    " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", " ", "'", "''", "'s", "'t", "'re", "'ve", "'m", "'ll",
    "'d", "'S", "'r", "'l", "s", "ll", "re", "1", "²", "½", "٣", "é", "ß", "ǅ", "中文", "😀", "á", "the", " the", "_", "-", "x" * 30, "\x00",
]
texts_of_parts = st.lists(st.sampled_from(PARTS), max_size=25).map("".join)


def test_the_pattern_is_the_public_one():
    assert PATTERN == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(texts_of_parts, st.text(max_size=20), st.text("abcd", max_size=60)), max_size=6))
def test_as_the_library_encodes(texts):
    ids = CODER.encode(texts)
    assert ids == [REFERENCE.encode_ordinary(t) for t in texts]
    assert [CODER.vocabulary.decode(x).decode() for x in ids] == texts


@settings(max_examples=60, deadline=None)
@given(st.lists(texts_of_parts, max_size=5))
def test_other_patterns(texts):
    assert split_all(texts, PATTERN + "|[^\\s\\S]") == split_all(texts)


def test_every_token_is_its_own_encoding():
    for i in random.Random(1).sample(range(len(TOKENS)), 3_000):
        assert B.PrefixTable(CODER.vocabulary, TOKENS[i]).ids() == [i]


def test_long_pieces():
    for text in ("a" * 20_000, " " * 5_000 + "b", "abc" * 5_000, "\n" * 3_000, "=" * 4_001):
        assert CODER.encode([text]) == [REFERENCE.encode_ordinary(text)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(97 + x % 6 for x in b)), min_size=2, max_size=5), st.integers(0, 60), st.integers(0, 30))
def test_tables_after_appends_and_edits(parts, start, length):
    table = B.PrefixTable(CODER.vocabulary)
    for part in parts:
        table.append(part)
    whole = b"".join(parts)
    assert table.last == B.PrefixTable(CODER.vocabulary, whole).last
    start = min(start, len(whole))
    stop = min(len(whole), start + length)
    table.edit(start, stop, parts[0])
    edited = whole[:start] + parts[0] + whole[stop:]
    assert table.data == edited and table.last == B.PrefixTable(CODER.vocabulary, edited).last


def test_an_edit_recomputes_little():
    table = B.PrefixTable(CODER.vocabulary, b"abcdefgh" * 1_000)
    assert table.edit(100, 103, b"xyz") < 3 * CODER.vocabulary.longest
    assert table.ids() == B.PrefixTable(CODER.vocabulary, table.data).ids()


@settings(max_examples=150, deadline=None)
@given(texts_of_parts, texts_of_parts, texts_of_parts, st.integers(0, 60), st.integers(0, 20))
def test_texts_after_appends_and_edits(text, new, more, start, length):
    encoded = B.EncodedText(CODER.vocabulary, text)
    start = min(start, len(text))
    stop = min(len(text), start + length)
    encoded.edit(start, stop, new)
    encoded.append(more)
    want = text[:start] + new + text[stop:] + more
    assert encoded.text == want and encoded.ids() == REFERENCE.encode_ordinary(want)


def test_remembered_pieces_are_bounded():
    ids = PieceIds(lambda pieces: [p.encode() for p in pieces], most=10)
    for i in range(50):
        text = f"a{i} b{i} the end " + "z" * 100
        assert ids.of_texts([text, ""]) == [text.encode(), b""]
        assert len(ids.young) < 25 and len(ids.old) < 25 and "z" * 100 not in ids.young


def test_rows(spark):
    docs = documents(spark, ["don't stop", None, "", "don't stop"], [1, None, 2, 1])
    rows = sorted((str(r.doc_id), r.ids) for r in B.encode(docs, TOKENS).collect())
    ids = REFERENCE.encode_ordinary("don't stop")
    assert rows == [("1", ids), ("1", ids), ("2", []), ("None", [])]
    assert B.round_trip(empty(spark), TOKENS).count() == 0


def test_a_missing_byte_is_reported():
    with pytest.raises(ValueError):
        B.PrefixTable(B.Vocabulary([b"a"]), b"ab")


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = []
    for r in docs:
        ids = REFERENCE.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha(r.text.encode())))
    assert sorted(map(tuple, QUERIES["op3_byte_bpe"](spark, "/root/testdata/sf0.001").collect())) == want
