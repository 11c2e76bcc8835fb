from pathlib import Path

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pickwell.llm import token_ids as T

JSON = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
LIBRARY = Tokenizer.from_str(JSON)


def by_library(texts, tokenizer=LIBRARY):
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def split(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab '\n\0é漢😀́st0", max_size=40)), max_size=6), st.sampled_from([0, 3, 1_000]))
def test_ids_are_those_of_the_library(texts, most):
    of_texts = T.TokenIds(JSON, most)
    for _ in range(2):
        assert split(*of_texts(texts)) == by_library(texts)


def test_added_tokens_long_pieces_and_other_tokenizers():
    texts = ["one <|endoftext|> two", "", "x" * 40_000, "plain", "<|endoftext|>", "\n" * 300 + "a", "é" * 9_000]
    assert split(*T.TokenIds(JSON)(texts)) == by_library(texts)
    other = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    assert split(*T.TokenIds(other)(texts[:2])) == by_library(texts[:2], Tokenizer.from_str(other))
    assert T.TokenIds(JSON)([])[1].tolist() == [0]


def test_kinds_that_share_a_key(monkeypatch):
    monkeypatch.setattr(T, "mixed", lambda values: values & np.uint64(3))
    texts = ["a b c d e f g h abcdefghi abcdefghj abcdefghijklmnopqr a b"]
    assert split(*T.TokenIds(JSON)(texts)) == by_library(texts)


def test_end_ids():
    ids, starts = T.with_end(np.array([5, 6, 7], np.uint32), np.array([0, 2, 2, 3]), 0)
    assert ids.tolist() == [5, 6, 0, 0, 7, 0] and starts.tolist() == [0, 3, 4, 6]
