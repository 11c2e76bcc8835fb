"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from functools import cache

import numpy as np

from pickwell.llm.chars import mixed, odd_factors

WORDS = 5
"""Words of a shingle."""


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Which bytes are white space, a random number for each byte (capital letters as small ones), and the base."""
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    value = odd_factors(256, 5)
    value[65:91] = value[97:123]
    return space, value, np.uint64(0x9E3779B97F4A7C15 | 5)


HELD_POWERS = 1 << 20


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, for some bytes; only a bounded table outlives the call."""
    if size > HELD_POWERS:
        return _run_of_powers(size)
    power, inverse = _held_powers()
    return power[:size], inverse[:size]


@cache
def _held_powers() -> tuple[np.ndarray, np.ndarray]:
    return _run_of_powers(HELD_POWERS)


def _run_of_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_tables()[2])
    pair = []
    for b in (base, pow(base, -1, 1 << 64)):
        run = np.full(size, b, np.uint64)
        run[0] = 1
        pair.append(np.cumprod(run, dtype=np.uint64))
    return pair[0], pair[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes start, and their hashes. The last byte is white space.

    Bytes are taken in stretches that end in white space, so little is held at once but for the words.
    """
    space, value, _ = _tables()
    firsts, words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    start = 0
    while start < len(data):
        stop = min(start + HELD_POWERS, len(data))
        while stop < len(data) and not (last := space[data[start:stop]]).any():
            stop = min(2 * stop - start, len(data))  # a word longer than the stretch
        if stop < len(data):
            stop = start + int(np.flatnonzero(last)[-1]) + 1
        part = data[start:stop]
        gaps = space[part]
        before = np.r_[True, gaps[:-1]]
        first = np.flatnonzero(~gaps & before)
        after = np.flatnonzero(gaps & ~before)
        power, inverse = _powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value[part] * power, out=total[1:])
        words.append(mixed((total[after] - total[first]) * inverse[first] + (after - first).astype(np.uint64)))
        firsts.append(first + start)
        start = stop
    return np.concatenate(firsts), np.concatenate(words)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Words are runs of bytes other than blank and tab to carriage return, capitals A-Z
    as small letters. A text with fewer than ``words`` words is one shingle, one without words none.
    """
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    first, word = word_hashes(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
    owner = np.searchsorted(first, starts)  # words before each text
    counts = np.diff(owner)
    factors = odd_factors(words, 6)
    n = max(0, len(word) - words + 1)
    run = np.zeros(n, np.uint64)
    for k in range(words):
        run += word[k : k + n] * factors[k]
    run = mixed(run)
    sets = []
    for at, count in zip(owner[:-1].tolist(), counts.tolist()):
        if count >= words:
            one = np.sort(run[at : at + count - words + 1])
            sets.append(one[np.r_[True, one[1:] != one[:-1]]])
        elif count:
            short = (word[at : at + count] * factors[:count]).sum(dtype=np.uint64) + np.uint64(count)
            sets.append(mixed(np.array([short], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
