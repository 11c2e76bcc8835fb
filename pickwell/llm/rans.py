"""A static range asymmetric numeral system over many interleaved lanes, in numpy.

A table of frequencies that sum to a power of two is shared by blocks that are coded independently. Token ``t`` of a
block belongs to lane ``t % lanes``; each lane has a state of its own and all lanes write 32-bit
words into one stream, in the order in which a decoder asks for them. All blocks of a call advance together.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np

LANES = 128
STEPS = 512
BLOCK_TOKENS = LANES * STEPS
LEAST_BITS = 18
LOW = np.uint64(1 << 32)
"""States are at least this, and under its square."""

_TABLE, _BLOCK = b"rTAB", b"rBLK"
_32 = np.uint64(32)


class Damaged(ValueError):
    """A table or block whose checksum or end state is wrong."""


class Table(NamedTuple):
    """Symbols in ascending order with frequencies that sum to ``2 ** bits``."""

    bits: int
    symbols: np.ndarray
    frequencies: np.ndarray

    @property
    def before(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.frequencies)[:-1]].astype(np.uint64)


def table_of(ids: np.ndarray) -> Table:
    """The table of some tokens: a symbol gets 1, and a share of what is left by its count; the most frequent gets the rest."""
    symbols, counts = np.unique(ids, return_counts=True)
    bits = max(LEAST_BITS, len(symbols).bit_length() + 2)
    room = (1 << bits) - len(symbols)
    frequencies = 1 + counts * room // max(1, len(ids))
    if len(symbols):
        frequencies[np.argmax(counts)] += (1 << bits) - frequencies.sum()
    return Table(bits, symbols.astype(np.uint32), frequencies.astype(np.uint64))


def _sealed(data: bytes) -> bytes:
    return data + struct.pack("<I", zlib.crc32(data))


def _opened(data: bytes, magic: bytes, what: str) -> memoryview:
    if len(data) < 8 or data[:4] != magic or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise Damaged(f"{what} is damaged")
    return memoryview(data)[4:-4]


def pack_table(table: Table) -> bytes:
    gaps = np.diff(table.symbols, prepend=np.uint32(0)).astype("<u4")
    body = zlib.compress(gaps.tobytes() + table.frequencies.astype("<u4").tobytes(), 6)
    return _sealed(_TABLE + struct.pack("<BI", table.bits, len(table.symbols)) + body)


def unpack_table(data: bytes) -> Table:
    body = _opened(data, _TABLE, "a frequency table")
    bits, count = struct.unpack("<BI", body[:5])
    values = np.frombuffer(zlib.decompress(body[5:]), "<u4")
    return Table(bits, np.cumsum(values[:count], dtype=np.uint32), values[count:].astype(np.uint64))


def encode(ids: np.ndarray, table: Table) -> list[bytes]:
    """The tokens as sealed blocks of :data:`BLOCK_TOKENS`, the last with what is left."""
    places = np.searchsorted(table.symbols, ids)
    full = len(ids) // BLOCK_TOKENS
    blocks = _encode(places[: full * BLOCK_TOKENS].reshape(full, STEPS, LANES), [BLOCK_TOKENS] * full, table) if full else []
    rest = places[full * BLOCK_TOKENS :]
    if len(rest):
        steps = -(-len(rest) // LANES)
        padded = np.full(steps * LANES, np.argmax(table.frequencies))
        padded[: len(rest)] = rest
        blocks += _encode(padded.reshape(1, steps, LANES), [len(rest)], table)
    return blocks


def _encode(places: np.ndarray, sizes: list[int], table: Table) -> list[bytes]:
    count, steps, lanes = places.shape
    bits, high = np.uint64(table.bits), np.uint64(64 - table.bits)
    frequencies, before = table.frequencies, table.before
    state = np.full((count, lanes), LOW)
    words = np.zeros((steps, count, lanes), "<u4")
    written = np.zeros((steps, count, lanes), bool)
    for step in range(steps - 1, -1, -1):
        at = places[:, step]
        frequency = frequencies[at]
        written[step] = over = (state >> high) >= frequency
        words[step] = state  # the low half
        state = np.where(over, state >> _32, state)
        share, rest = np.divmod(state, frequency)
        state = (share << bits) + rest + before[at]
    out = []
    for i, size in enumerate(sizes):
        stream = words[:, i][written[:, i]]
        out.append(_sealed(_BLOCK + struct.pack("<I", size) + state[i].astype("<u8").tobytes() + stream.tobytes()))
    return out


def decode(blocks: list[bytes], table: Table) -> list[np.ndarray]:
    """The tokens of each block; blocks of equal length advance together."""
    opened = [_opened(b, _BLOCK, f"block {i}") for i, b in enumerate(blocks)]
    sizes = [struct.unpack("<I", body[:4])[0] for body in opened]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    slots = np.repeat(np.arange(len(table.symbols), dtype=np.int32), table.frequencies.astype(np.int64))
    for size in set(sizes):
        same = [i for i, s in enumerate(sizes) if s == size]
        for i, ids in zip(same, _decode([opened[i] for i in same], size, table, slots)):
            out[i] = ids
    return out


def _decode(bodies: list[memoryview], size: int, table: Table, slots: np.ndarray) -> np.ndarray:
    count, steps, head = len(bodies), -(-size // LANES), 4 + 8 * LANES
    if any(len(b) < head or (len(b) - head) % 4 for b in bodies):
        raise Damaged("a block is cut off")
    state = np.stack([np.frombuffer(b[4:head], "<u8") for b in bodies])
    # One word more, for lanes that ask for none at the end.
    stream = np.frombuffer(b"".join([*(b[head:] for b in bodies), bytes(4)]), "<u4").astype(np.uint64)
    at = np.r_[0, np.cumsum([(len(b) - head) // 4 for b in bodies])]
    ends, at = at[1:], at[:-1].copy()
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    frequencies, before = table.frequencies, table.before
    places = np.zeros((count, steps, LANES), np.int32)
    for step in range(steps):
        slot = state & mask
        places[:, step] = place = slots[slot]
        state = frequencies[place] * (state >> bits) + slot - before[place]
        low = state < LOW
        nth = np.cumsum(low, axis=1)
        # A damaged stream that passes its checksum must not lead past the end.
        word = stream[np.minimum(at[:, None] + nth - 1, len(stream) - 1)]
        state = np.where(low, (state << _32) | word, state)
        at += nth[:, -1]
    if (state != LOW).any() or (at != ends).any():
        raise Damaged("a block does not end where it began")
    return table.symbols[places.reshape(count, -1)[:, :size]]
