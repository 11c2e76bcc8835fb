"""Byte-level BPE by prefix dynamic programming, exact to the merge order.

For each prefix of a piece's bytes there is one token with which its encoding ends. Stored per prefix, these last
tokens give the encoding by walking back from the end; bytes appended only add entries, and after an
edit entries are recomputed from there until they agree with the old ones again.

A token may end a prefix if it keeps apart from the last token of the prefix before it: the
two neighbours, merged alone, must never join. That is decided on the spines of their merge trees.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pickwell.llm.common import over_texts, texts_of
from pickwell.llm.pieces import PATTERN, PieceIds

NEVER = 1 << 40
_KNOWN_PAIRS = 300_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


class Vocabulary:
    """Tokens by rank; a token's parts are the two neighbours whose merge makes it."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.longest = max(map(len, tokens))
        self.parts: list[tuple[int, int] | None] = [None] * len(tokens)
        self._lefts: dict[int, list[tuple[int, int]]] = {}
        self._rights: dict[int, list[tuple[int, int]]] = {}
        self._apart: dict[int, bool] = {}
        self._split: set[int] = set()

    def _parts_of(self, token: int) -> tuple[int, int] | None:
        """Found on first use: the only split whose halves rank lower and keep apart until this merge."""
        if token not in self._split:
            self._split.add(token)
            data = self.tokens[token]
            for cut in range(1, len(data)):
                left, right = self.rank.get(data[:cut], NEVER), self.rank.get(data[cut:], NEVER)
                if left < token and right < token and self._meets(left, right, token):
                    self.parts[token] = (left, right)
                    break
        return self.parts[token]

    def _spine(self, token: int, side: int, known: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """Nodes on one edge of the merge tree from the byte up, each with the rank that consumes it."""
        if token not in known:
            parts = self._parts_of(token)
            if parts is None:
                known[token] = [(token, NEVER)]
            else:
                below = self._spine(parts[side], side, known)
                known[token] = [*below[:-1], (below[-1][0], token), (token, NEVER)]
        return known[token]

    def _meets(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge ranked under ``limit`` joins nodes of the two across their border."""
        ls = self._spine(left, 1, self._rights)
        rs = self._spine(right, 0, self._lefts)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = ls[i], rs[j]
            merged = self.rank.get(self.tokens[x] + self.tokens[y], NEVER)
            # Of equal merges the leftmost goes first: the left node's own before the joint one,
            # the joint one before the right node's own.
            if merged < x_until and merged <= y_until and merged < limit:
                return False
            if x_until == NEVER and y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side."""
        key = left << 32 | right
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > _KNOWN_PAIRS:
                self._apart.clear()
            known = self._apart[key] = self._meets(left, right, NEVER)
        return known

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The last token of every prefix of some bytes; ``last[i]`` belongs to the first ``i + 1`` bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: entries of the old prefixes stay."""
        start, self.data = len(self.data), self.data + more
        self._extend(start, len(self.data))

    def _extend(self, start: int, stop: int) -> None:
        """Add the last tokens of the prefixes longer than ``start``, up to ``stop``."""
        data, last, longest = self.data, self.last, self.vocabulary.longest
        rank, known, apart = self.vocabulary.rank.get, self.vocabulary._apart.get, self.vocabulary.apart
        for end in range(start + 1, stop + 1):
            for begin in range(end - longest if end > longest else 0, end):
                token = rank(data[begin:end])
                if token is not None:
                    if not begin:
                        break
                    before = last[begin - 1]
                    fits = known(before << 32 | token)
                    if fits or fits is None and apart(before, token):
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)

    def copy(self) -> PrefixTable:
        twin = PrefixTable(self.vocabulary)
        twin.data, twin.last = self.data, self.last.copy()
        return twin

    def cut(self, size: int) -> None:
        """Keep the first ``size`` bytes and their entries."""
        self.data = self.data[:size]
        del self.last[size:]

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes ``start`` to ``stop``; how many entries were recomputed.

        An entry depends on as many bytes and entries before it as the longest token has. Once so many
        in a row agree with the old ones past the edit, the rest would too and is kept.
        """
        old, shift = self.last, len(new) - (stop - start)
        data = self.data[:start] + new + self.data[stop:]
        self.data, self.last = data, old[:start]
        agreed = 0
        for end in range(start + 1, len(data) + 1):
            self._extend(end - 1, end)
            token = self.last[-1]
            past = end > start + len(new) and end - 1 - shift >= stop
            agreed = agreed + 1 if past and old[end - 1 - shift] == token else 0
            if agreed >= self.vocabulary.longest:
                self.last += old[end - shift :]
                return end - start
        return len(data) - start

    def ids(self) -> list[int]:
        ids, end = [], len(self.data)
        while end:
            ids.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[ids[-1]])
        return ids[::-1]


class EncodedText:
    """A text with the prefix table of each piece; appends and edits redo the pieces they reach."""

    LOOK_AHEAD = 3
    """The pattern never looks further past a piece's end than so many characters."""

    def __init__(self, vocabulary: Vocabulary, text: str, pattern: str = PATTERN) -> None:
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.text, self.pieces, self.tables = "", [], []
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> None:
        text = self.text[:start] + new + self.text[stop:]
        shift = len(new) - (stop - start)
        kept, at = 0, 0
        while kept < len(self.pieces) and at + len(self.pieces[kept]) + self.LOOK_AHEAD <= start:
            at += len(self.pieces[kept])
            kept += 1
        old_starts = {}
        place = at
        for i in range(kept, len(self.pieces)):
            if place >= stop:
                old_starts[place + shift] = i
            place += len(self.pieces[i])
        pieces, tables = self.pieces[:kept], self.tables[:kept]
        reuse = self.tables[kept] if kept < len(self.tables) else None
        while at < len(text):
            if at >= start + len(new) and at in old_starts:
                pieces += self.pieces[old_starts[at] :]
                tables += self.tables[old_starts[at] :]
                break
            piece = self.pattern.match(text, at).group()
            data = piece.encode()
            if reuse is not None and self.text:
                same = _common(reuse.data, data)
                table = reuse.copy()
                table.cut(same)
                table.append(data[same:])
                reuse = None
            else:
                table = PrefixTable(self.vocabulary, data)
            pieces.append(piece)
            tables.append(table)
            at += len(piece)
        self.text, self.pieces, self.tables = text, pieces, tables

    def ids(self) -> list[int]:
        return [i for table in self.tables for i in table.ids()]


def _common(a: bytes, b: bytes) -> int:
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


class Coder:
    """Encodes whole texts; pieces are remembered up to a bound. Sent to tasks as its tokens only."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN) -> None:
        self.tokens, self.pattern = tokens, pattern

    def __reduce__(self):
        return Coder, (self.tokens, self.pattern)

    @cached_property
    def vocabulary(self) -> Vocabulary:
        return Vocabulary(self.tokens)

    @cached_property
    def _pieces(self) -> PieceIds:
        four = [i.to_bytes(4, "little") for i in range(len(self.tokens))].__getitem__

        def encode(pieces: list[str]) -> list[bytes]:
            """Pieces are taken in order, so that one keeps the entries of the start it shares with the last."""
            found, table = {}, PrefixTable(self.vocabulary)
            for piece in sorted(pieces):
                data = piece.encode()
                same = _common(table.data, data)
                table.cut(same)
                table.append(data[same:])
                found[piece] = b"".join(map(four, table.ids()))
            return [found[p] for p in pieces]

        return PieceIds(encode)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self._pieces.of_texts(texts, self.pattern)]


def encode(
    docs: DataFrame, tokens: list[bytes], pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, ids`` of every whole text; a null or empty text has no ids. Ids of documents are passed
    through, null or repeated."""
    coder = Coder(tokens, pattern)
    return over_texts(
        texts_of(docs, id_col, text_col), lambda texts: {"ids": coder.encode(texts)}, {"ids": pa.list_(pa.int32())}
    )


def round_trip(
    docs: DataFrame, tokens: list[bytes], pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded, and its ids decoded again,
    without sending the ids back to Spark."""
    coder, numbers = Coder(tokens, pattern), [str(i) for i in range(len(tokens))]

    def checked(texts: list[str]) -> dict[str, list]:
        ids = coder.encode(texts)
        return {
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(" ".join(map(numbers.__getitem__, x)).encode()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(coder.vocabulary.decode(x)).hexdigest() for x in ids],
        }

    fields = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return over_texts(texts_of(docs, id_col, text_col), checked, fields)
