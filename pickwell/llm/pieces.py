"""Cutting texts into the pieces that byte-level BPE encodes one by one."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import regex

from pickwell.llm.chars import LETTER, OTHER, SPACE, classes, code_points, joined

#: Fixed value: the pattern that :func:`piece_starts` finds by arrays. Others go through ``regex``.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHORT = {ord(c) for c in "stmd"}
_LONG = {(ord(a), ord(b)) for a, b in ("re", "ve", "ll")}

CACHED_PIECES = 100_000
CACHED_CHARS = 64
"""A worker remembers so many pieces of at most so many characters; others are encoded each time."""


def piece_starts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of :data:`PATTERN` start in the joined texts.

    Pieces are runs of letters, numbers, white space or other characters, but for three things: a blank
    before a run belongs to it, other white space before a run gives up its last character as
    a piece, and an apostrophe of its own takes the letters of a contraction.
    """
    n = len(codes)
    kind = classes()[codes]
    begin = np.ones(n + 1, bool)
    begin[1:n] = kind[1:] != kind[:-1]
    begin[starts] = True
    text_start = np.zeros(n + 1, bool)
    text_start[starts] = True
    cut = np.flatnonzero(begin)
    run, after = cut[:-1], cut[1:]
    if not n:
        return run
    spaces = (kind[run] == SPACE) & ~text_start[after]
    last = after[spaces] - 1
    blank = codes[last] == 32
    begin[last] = True
    begin[after[spaces][blank]] = False
    alone = (kind[run] == OTHER) & (after - run == 1) & (codes[run] == 39) & begin[run] & ~text_start[after]
    for at in run[alone].tolist():
        first = int(codes[at + 1])
        if kind[at + 1] != LETTER:
            continue
        if first in _SHORT:
            size = 2
        elif at + 2 < n and not text_start[at + 2] and (first, int(codes[at + 2])) in _LONG:
            size = 3
        else:
            continue
        begin[at + 1] = False
        begin[at + size] = True
    return np.flatnonzero(begin[:n])


def split_all(texts: list[str], pattern: str = PATTERN) -> list[list[str]]:
    """The pieces of each text; together they are the text."""
    if pattern != PATTERN:
        found = regex.compile(pattern)
        return [[m.group() for m in found.finditer(t)] for t in texts]
    full, starts = joined(texts)
    cuts = piece_starts(code_points(full), starts)
    ends = cuts.tolist()
    ends.append(len(full))
    pieces = [full[a:b] for a, b in zip(ends, ends[1:])]
    bounds = np.searchsorted(cuts, starts).tolist()
    return [pieces[a:b] for a, b in zip(bounds, bounds[1:])]


class PieceIds:
    """Ids of pieces as little-endian 32-bit bytes.

    Two generations of pieces are remembered: when the young one is full it becomes the old
    one, and pieces met again move on, so frequent ones stay and memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = CACHED_PIECES) -> None:
        self.encode, self.most = encode, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of_texts(self, texts: list[str], pattern: str = PATTERN) -> list[bytes]:
        """The ids of each text; the pieces that are not known yet are encoded in one call."""
        parts = split_all(texts, pattern)
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young = self.young
        missing = set(chain.from_iterable(parts)).difference(young)
        back = missing.intersection(self.old)
        young.update(zip(back, map(self.old.__getitem__, back)))
        new = list(missing - back)
        young.update(zip(new, self.encode(new)))
        get = young.__getitem__
        ids = [b"".join(map(get, p)) for p in parts]
        for piece in new:
            if len(piece) > CACHED_CHARS:
                del young[piece]
        return ids
