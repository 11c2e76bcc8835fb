"""Token ids of whole texts by the tokenizers library, as flat arrays."""

from __future__ import annotations

import json
import os
from functools import cache, lru_cache
from itertools import accumulate, chain
from typing import Any

import numpy as np

from pickwell.llm.chars import code_points, joined, mixed
from pickwell.llm.pieces import piece_starts

REMEMBERED = 300_000
"""Pieces that a task remembers before it starts over, for some 60 MB; their characters are bounded alike."""
REMEMBERED_CHARS = 1 << 23


@lru_cache(maxsize=1)
def _tokenizer(tokenizer_json: str) -> Any:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer_json)


@cache
def _shown_bytes() -> np.ndarray:
    """The characters that byte-level tokenizers write for bytes: printable ones stay, others follow from 256 on."""
    shown = np.arange(256, dtype="<u4")
    stay = np.r_[33:127, 161:173, 174:256]
    others = np.setdiff1d(shown, stay)
    shown[others] = 256 + np.arange(len(others))
    return shown


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each run, run after run."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class _Numbers(dict):
    """Numbers things as they are asked for; ``new`` lists those not seen before."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, thing: str) -> int:
        number = self[thing] = len(self)
        self.new.append(thing)
        return number


class TokenIds:
    """Ids of texts as the tokenizer encodes them with ``add_special_tokens=False``.

    Where the tokenizer encodes each match of its pattern by itself, a piece is encoded once and its ids are gathered by
    its number; that changes nothing in the ids. Texts that hold an added token, and all texts of other
    tokenizers, are encoded whole. Travels to a task as the tokenizer's JSON alone; a task's pieces end with it.
    """

    def __init__(self, tokenizer_json: str, most: int = REMEMBERED) -> None:
        self.json, self.most = tokenizer_json, most
        settings = json.loads(tokenizer_json)
        first = settings.get("pre_tokenizer") or {}
        apart = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        self.by_piece = apart and not settings.get("normalizer") and settings["model"]["type"] == "BPE"
        self.added = [t["content"] for t in settings.get("added_tokens") or []]
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.chars = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # the end of a piece's ids; they start where those of the piece before end
        self.used = self.known = 0

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and where each text's ids start, with the end as last."""
        whole = [not self.by_piece or any(a in t for a in self.added) for t in texts]
        if not any(whole):
            return self._gathered(texts)
        pieces = self._gathered([t for t, w in zip(texts, whole) if not w])
        found = _tokenizer(self.json).encode_batch_fast([t for t, w in zip(texts, whole) if w], add_special_tokens=False)
        apart = iter(np.split(pieces[0], pieces[1][1:-1]) if len(pieces[1]) > 1 else [])
        together = iter(np.array(e.ids, np.uint32) for e in found)
        parts = [next(together if w else apart) for w in whole]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _gathered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(self.numbers) > self.most or self.chars > REMEMBERED_CHARS:
            self._forget()
        full, starts = joined(texts)
        codes = code_points(full)
        cuts = piece_starts(codes, starts)
        first, which = distinct(full, codes, cuts)
        after = np.append(cuts, len(full))
        pieces = map(full.__getitem__, map(slice, cuts[first].tolist(), after[first + 1].tolist()))
        numbers = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(first))
        self._learn(self.numbers.new)
        begin = np.where(numbers > 0, self.ends[numbers - 1], 0)
        begin, sizes = begin[which], (self.ends[numbers] - begin)[which]
        before = np.r_[0, np.cumsum(sizes)]
        return self.ids[ragged(begin, sizes)], before[np.searchsorted(cuts, starts)]

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        # A piece needs no more than the tokenizer's model, which takes bytes as printable characters.
        data = "".join(new).encode()
        shown = _shown_bytes()[np.frombuffer(data, np.uint8)].tobytes().decode("utf-32-le")
        ends = list(accumulate(len(p) if p.isascii() else len(p.encode()) for p in new))
        found = list(map(_tokenizer(self.json).model.tokenize, map(shown.__getitem__, map(slice, [0, *ends], ends))))
        ids = np.fromiter((t.id for t in chain.from_iterable(found)), np.uint32)
        ends = self.used + np.cumsum(list(map(len, found)))
        self.ids = _put(self.ids, self.used, ids)
        self.ends = _put(self.ends, self.known, ends)
        self.used, self.known = self.used + len(ids), self.known + len(new)
        self.chars += len(data)
        new.clear()


def distinct(full: str, codes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces that start at ``cuts``: the place of one of each kind, and the kind of each piece.

    Pieces of up to 15 bytes are told apart exactly, by their bytes and length in two words; longer ones are kinds of their own.
    """
    data = np.frombuffer(full.encode("utf-8", "surrogatepass") + bytes(16), np.uint8)
    if len(data) == len(codes) + 16:
        at = np.append(cuts, len(codes))
    else:
        size = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        at = np.r_[0, np.cumsum(size, dtype=np.int64)][np.append(cuts, len(codes))]
    length = np.diff(at)
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    keep = np.append(np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8)), np.uint64(0)) - np.uint64(1)
    low = words[at[:-1]] & keep[np.minimum(length, 8)]
    high = words[np.minimum(at[:-1] + 8, len(words) - 1)] & keep[np.clip(length - 8, 0, 7)] | (length.astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(length > 15)
    low[long], high[long] = long, np.uint64(1 << 63)
    key = mixed(low * np.uint64(0x9E3779B97F4A7C15) + high)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    if (low[first][which] != low).any() or (high[first][which] != high).any():  # two kinds share a key
        _, first, which = np.unique(np.stack([low, high], 1), axis=0, return_index=True, return_inverse=True)
    return first, which.reshape(-1)


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each text's, and where each text's start, with the end as last."""
    starts = bounds + np.arange(len(bounds))
    out = np.full(starts[-1], end, "<u4")
    out[ragged(starts[:-1], np.diff(bounds))] = ids
    return out, starts


def _put(into: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``values`` from ``at`` on, in an array that doubles when it is full."""
    if at + len(values) > len(into):
        into = np.concatenate([into[:at], np.zeros(max(at, len(values)) + len(values), into.dtype)])
    into[at : at + len(values)] = values
    return into
