"""Word-aligned coding of whole numbers: a selector and as many numbers as fit, per 64 bits.

The top four bits of a word are its selector. Selectors 1 to 14 say how many numbers of which
width fill the other 60 bits. Selector 0 is an escape: the other bits are the place of one
number of more than 60 bits in a list behind the words. Numbers are coded in blocks of
`BLOCK`; every block begins a new word, and the place of its first word is stored, so a block
is decoded without those before it. The last word of a block may have room to spare.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np

BLOCK = 1024
# Fixed values of the format: numbers in a word, by selector; each takes 60 // count bits.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = 60 // COUNTS
ESCAPE_BITS = 60
SMALL_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
MAGIC = b"S8B1"
HEADER = "<4sIQIIII"


class Packed(NamedTuple):
    """Coded numbers: how many, the words, the first word of each block, the escaped numbers."""

    size: int
    words: np.ndarray
    offsets: np.ndarray
    escapes: np.ndarray


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each number, zero for zero."""
    if values.size and values.max() < len(SMALL_BITS):
        return SMALL_BITS[values]
    if values.size and values.max() < 1 << 53:  # exact as floating point
        return np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    high, low = (values >> np.uint64(32)).astype(np.float64), (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    bits = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
    return bits.astype(np.uint8)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """The selector that takes most numbers from each place on; a row is a block and the room
    behind it, which counts as zeros. Sliding maxima of all counts are built from shorter ones."""
    place = bits.shape[1] - int(COUNTS.max())
    most = {1: bits}
    for count in sorted(set(COUNTS.tolist()) - {1}):
        part = max(c for c in most if c < count)  # at least half of count, so two cover it
        wider = most[part].copy()
        wider[:, :part - count] = np.maximum(most[part][:, :part - count], most[part][:, count - part:])
        most[count] = wider
    best = np.ones((bits.shape[0], place), np.uint8)
    for selector in range(1, len(COUNTS)):  # where more numbers fit, fewer do too
        best += most[int(COUNTS[selector])][:, :place] > WIDTHS[selector]
    best[best == len(COUNTS)] = 0
    return best


def pack(values: np.ndarray) -> Packed:
    """Codes unsigned 64-bit numbers, taking the fullest word that fits at every step."""
    values = np.ascontiguousarray(values, np.uint64)
    size = len(values)
    blocks = -(-size // BLOCK)
    room = int(COUNTS.max())
    padded = np.zeros((blocks, BLOCK + room), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:size] = values
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    best = _selectors(_bit_lengths(padded))
    ends = np.minimum(size - np.arange(blocks) * BLOCK, BLOCK)
    at, active = np.zeros(blocks, np.int64), np.arange(blocks)
    steps_block, steps_at = [], []
    while len(active):  # one word of every block that has numbers left
        steps_block.append(active)
        steps_at.append(at[active])
        at[active] += COUNTS[best[active, at[active]]]
        active = active[at[active] < ends[active]]
    block = np.concatenate(steps_block) if steps_block else np.zeros(0, np.int64)
    start = np.concatenate(steps_at) if steps_at else np.zeros(0, np.int64)
    order = np.argsort(block.astype(np.uint16) if blocks < 1 << 16 else block, kind="stable")  # steps come in order
    block, start = block[order], start[order]
    selector = best[block, start]
    words = selector.astype(np.uint64) << np.uint64(60)
    for kind in range(1, len(COUNTS)):
        rows = np.flatnonzero(selector == kind)
        if not len(rows):
            continue
        coded, first = words[rows], block[rows] * (BLOCK + room) + start[rows]
        for k in range(int(COUNTS[kind])):
            coded |= padded.ravel()[first + k] << np.uint64(k * int(WIDTHS[kind]))
        words[rows] = coded
    escaped = np.flatnonzero(selector == 0)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    offsets = np.searchsorted(block, np.arange(blocks)).astype(np.uint32)
    return Packed(size, words, offsets, padded[block[escaped], start[escaped]])


def unpack(packed: Packed) -> np.ndarray:
    """The numbers of all blocks, decoded selector by selector for all words at once."""
    size, words, offsets, escapes = packed
    values = np.zeros(size + int(COUNTS.max()), np.uint64)
    if size == 0:
        return values[:0]
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    start = before - before[offsets[block]] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, size)
    for kind in range(1, len(COUNTS)):
        rows = np.flatnonzero(selector == kind)
        if not len(rows):
            continue
        first, room, coded = start[rows], limit[rows] - start[rows], words[rows]
        mask = np.uint64((1 << int(WIDTHS[kind])) - 1)
        for k in range(int(COUNTS[kind])):
            held = room > k
            values[first[held] + k] = (coded[held] >> np.uint64(k * int(WIDTHS[kind]))) & mask
    rows = np.flatnonzero(selector == 0)
    values[start[rows]] = escapes[(words[rows] & np.uint64((1 << ESCAPE_BITS) - 1)).astype(np.int64)]
    return values[:size]


def unpack_block(packed: Packed, block: int) -> np.ndarray:
    """The numbers of one block, found by its offset."""
    first = int(packed.offsets[block])
    last = int(packed.offsets[block + 1]) if block + 1 < len(packed.offsets) else len(packed.words)
    size = min(BLOCK, packed.size - block * BLOCK)
    return unpack(Packed(size, packed.words[first:last], np.zeros(1, np.uint32), packed.escapes))


def to_bytes(packed: Packed) -> bytes:
    """Header, block offsets, words and escaped numbers, closed by a CRC-32 of all of it."""
    body = struct.pack(HEADER, MAGIC, BLOCK, packed.size, len(packed.offsets), len(packed.words), len(packed.escapes), 0)
    body += packed.offsets.astype("<u4").tobytes() + packed.words.astype("<u8").tobytes()
    body += packed.escapes.astype("<u8").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def from_bytes(data: bytes) -> Packed:
    """The coded numbers of `to_bytes`; raises ValueError on damaged bytes."""
    if len(data) < struct.calcsize(HEADER) + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged block of coded numbers")
    magic, block, size, blocks, words, escapes, _ = struct.unpack_from(HEADER, data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a block of coded numbers of this format")
    at = struct.calcsize(HEADER)
    offsets = np.frombuffer(data, "<u4", blocks, at)
    coded = np.frombuffer(data, "<u8", words, at + 4 * blocks)
    return Packed(size, coded, offsets, np.frombuffer(data, "<u8", escapes, at + 4 * blocks + 8 * words))
