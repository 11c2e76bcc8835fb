"""Content-chosen anchors: every window of a text is filed under bytes that all its copies share.

A window of ``LENGTH`` bytes is anchored at its gram of least hash. Windows that follow each other with the same
anchor form a run; a run is halved by whether a window reaches further to the left or to
the right of its anchor, and each half is filed under a hash of the anchor with the bytes that all its
windows hold on that side. Equal windows, wherever they are, are filed under the same hash, at about two runs
in ``LENGTH`` bytes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from pickwell.llm.chars import mixed, odd_factors
from pickwell.llm.shingles import _powers

GRAM = 16
_VALUE = odd_factors(256, 21)


class Halves(NamedTuple):
    """Half runs: the text's number, the first window's start, the last one's, the file key and a hash of all their bytes."""

    owner: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    whole: np.ndarray


class Hashed:
    """Texts joined, with hashes of any byte range by differences of running sums."""

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        power, self.inverse = _powers(1 << max(16, int(len(self.data) + 1).bit_length()))
        self.total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_VALUE[self.data] * power[: len(self.data)], out=self.total[1:])

    def range(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the bytes ``first`` to ``stop``, wherever they stand."""
        return mixed((self.total[stop] - self.total[first]) * self.inverse[first] + (stop - first).astype(np.uint64))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in every window of ``width``, the first of equals.

    Minima from the left and from the right inside blocks of ``width``; a window spans two blocks.
    """
    n = len(values) - width + 1
    key = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def half_runs(hashed: Hashed, length: int) -> Halves:
    """The half runs of all texts; those shorter than ``length`` have none. Places are in the joined texts."""
    starts, size = hashed.starts, len(hashed.data)
    none = np.zeros(0, np.int64)
    if size < length:
        return Halves(none, none, none, none.view(np.uint64), none.view(np.uint64))
    gram_at = np.arange(size - GRAM + 1)
    grams = hashed.range(gram_at, gram_at + GRAM)
    width = length - GRAM + 1
    place = least_places(grams, width)  # anchors of all windows of the joined texts
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(place)]
    inside = np.arange(len(place)) + length <= starts[owner + 1]
    window = np.flatnonzero(inside)
    anchor, owner = place[window], owner[window]
    if not len(window):
        return Halves(none, none, none, none.view(np.uint64), none.view(np.uint64))
    side = (length - GRAM) // 2
    leftward = anchor - window >= side
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (leftward[1:] != leftward[:-1])]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(window)] - 1
    first, last, anchor, leftward = window[begin], window[end], anchor[begin], leftward[begin]
    other = length - GRAM - side
    key = np.where(
        leftward,
        hashed.range(np.where(leftward, anchor - side, 0), anchor + GRAM),
        hashed.range(anchor, np.where(leftward, anchor, anchor + GRAM + other)) * np.uint64(3) + np.uint64(1),
    )
    whole = hashed.range(first, last + length)
    # The anchor's place in the run belongs to it: equal bytes then have equal windows.
    whole = mixed(whole * np.uint64(5) + (anchor - first).astype(np.uint64))
    return Halves(owner[begin], first, last, key, whole)
