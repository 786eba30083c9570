"""Vectorized text scanning over Arrow string buffers: words, word hashes, BPE segments.

All functions work on whole texts. Nothing loops over characters or words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are scanned in groups of about this many bytes, to bound a worker's memory.
CHUNK_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)

_WORD = np.zeros(256, dtype=bool)
for _c in range(256):
    _WORD[_c] = _c >= 0x80 or chr(_c).isalnum()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

# 1: may end white space, 2: may begin it, 7: a plain space
_SEGMENT = np.zeros(256, dtype=np.uint8)
_SEGMENT[:33] = 3
_SEGMENT[[0xC2, 0xE1, 0xE2, 0xE3]] = 2
_SEGMENT[[0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, *range(0x80, 0x8B)]] |= 1
_SEGMENT[32] = 7
#: Keeps the first n bytes of eight, in the order of memory.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer for 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and its offsets (n + 1); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    if not large and not pa.types.is_string(column.type):
        column, large = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    width = np.int64 if large else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=width, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def groups(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words: letters, digits and non-ASCII characters other than punctuation."""
    word = _WORD[data]
    if len(data) > 2:
        # U+0080..U+00BF (C2 xx), general punctuation (E2 80 xx, E2 81 xx) and CJK punctuation (E3 80 xx)
        two = np.flatnonzero(data[:-1] == 0xC2)
        word[two] = word[two + 1] = False
        lead = np.flatnonzero(((data[:-2] == 0xE2) & ((data[1:-1] & 0xFE) == 0x80)) | ((data[:-2] == 0xE3) & (data[1:-1] == 0x80)))
        for k in range(3):
            word[lead + k] = False
    return word


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of some texts (case is folded for ASCII; fold the rest before), the number of words before each text (n + 1), and the words' start bytes."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    word = _word_bytes(data)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return span_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offsets), starts


def span_chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans as 64-bit chunks on end (the last of a span filled up with zeros), and where each span's begin (spans + 1)."""
    size = ends - starts
    first = np.concatenate(([0], np.cumsum((size + 7) >> 3)))
    place = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = np.repeat(size, np.diff(first)) - (place << 3)
    return eight[np.repeat(starts, np.diff(first)) + (place << 3)] & _FIRST[np.minimum(left, 8)], first


def hash_chunks(chunks: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans from their chunks: each chunk is mixed with its place before they are added, so no algebra of sums makes spans equal."""
    place = (np.arange(len(chunks)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
    mixed = mix(chunks + mix(place * _STEP + _M1))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    return mix((sums[first[1:]] - sums[first[:-1]]) ^ mix(size.astype(np.uint64) + _STEP))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    chunks, first = span_chunks(data, starts, ends)
    return hash_chunks(chunks, first, ends - starts)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the number of segments before each text.

    A segment begins at a text's start, and at each space that has a non-space on both sides. Byte-level BPE
    with the usual pattern never joins across such a point, so texts may be encoded segment by segment.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    flags = _SEGMENT[data]
    cut = np.zeros(n, dtype=bool)
    cut[1:-1] = (flags[1:-1] == 7) & (flags[:-2] & 1 == 0) & (flags[2:] & 2 == 0) if n > 2 else False
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    # a text's own first or last byte has no neighbour within the text
    cut[first] = True
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    lone = last[~np.isin(last, first)]
    cut[lone] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(starts, offsets)


class HashTable:
    """An open-addressing table from 64-bit hashes to int32 values that is filled and read with whole arrays."""

    def __init__(self, bits: int = 16) -> None:
        self._allocate(bits)

    def _allocate(self, bits: int) -> None:
        self.bits, self.size = bits, 0
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The next slots to try, an odd step away that depends on the key."""
        step = (keys * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(65 - self.bits)).astype(np.int64) << 1 | 1
        return (slots + step) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Their values; -1 where absent."""
        slot = self._slots(keys)
        out = self.values[slot]
        todo = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        slot, wanted = slot[todo], keys[todo]
        while len(todo):
            slot = self._next(slot, wanted)
            value = self.values[slot]
            out[todo] = value
            more = (self.keys[slot] != wanted) & (value >= 0)
            todo, slot, wanted = todo[more], slot[more], wanted[more]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New distinct keys, with values of at least 0."""
        if (self.size + len(keys)) * 2 > len(self.keys):
            old, kept = self.keys[self.values >= 0], self.values[self.values >= 0]
            self._allocate(max(self.bits, int((len(old) + len(keys)) * 2).bit_length()))
            if len(old):
                self.add(old, kept)
        slot, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.values[at] < 0
            self.values[at[free]] = values[todo[free]]
            self.keys[at[free]] = keys[todo[free]]
            # of several keys that fell on one free slot the last has it
            done = free & (self.keys[at] == keys[todo])
            todo = todo[~done]
            slot[todo] = self._next(slot[todo], keys[todo])
        self.size += len(keys)
