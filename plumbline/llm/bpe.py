"""Byte-level BPE over Arrow text, by segments: each distinct segment is encoded once per worker.

A segment is looked up by hash and then compared byte by byte with the one that was encoded, so that no collision
gives it another's ids.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np

from plumbline.llm import tokens

#: Public vocabulary files; a parameter of everything that encodes.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual pattern of these vocabularies: contractions, words, numbers, marks, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[str, Encoder] = {}


class Encoder:
    """A vocabulary with a cache of segments' ids."""

    def __init__(self, path: str, cache_segments: int = 800_000) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.dtype = np.uint16 if self.size < 1 << 16 else np.uint32
        self.limit = cache_segments
        self._reset()

    def _reset(self) -> None:
        self.table = tokens.HashTable(18)
        self.pool = np.zeros(1 << 20, dtype=self.dtype)
        self.start = np.zeros(1 << 18, dtype=np.int64)
        self.length = np.zeros(1 << 18, dtype=np.int32)
        # the cached segments themselves, as 64-bit chunks
        self.chunks = np.zeros(1 << 19, dtype=np.uint64)
        self.chunk = np.zeros(1 << 18, dtype=np.int64)
        self.bytes = np.zeros(1 << 18, dtype=np.int64)
        self.n = self.used = self.used_chunks = 0

    def _add(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, chunks: np.ndarray, first: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Encodes segments and returns their new places in the cache."""
        encode = self.encoding._core_bpe.encode_ordinary
        ids = [encode(raw[x:y].decode("utf-8", "replace")) for x, y in zip(starts[which].tolist(), ends[which].tolist())]
        lengths = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        total, places = int(lengths.sum()), np.arange(self.n, self.n + len(ids))
        self.pool = _room(self.pool, self.used + total)
        self.start, self.length = _room(self.start, self.n + len(ids)), _room(self.length, self.n + len(ids))
        self.pool[self.used : self.used + total] = np.fromiter((x for one in ids for x in one), dtype=self.dtype, count=total)
        self.start[places] = self.used + np.concatenate(([0], np.cumsum(lengths[:-1])))
        self.length[places] = lengths
        n = np.diff(first)[which]
        begin = np.concatenate(([0], np.cumsum(n)))
        self.chunks = _room(self.chunks, self.used_chunks + int(begin[-1]))
        self.chunk, self.bytes = _room(self.chunk, self.n + len(ids)), _room(self.bytes, self.n + len(ids))
        self.chunks[self.used_chunks : self.used_chunks + begin[-1]] = chunks[np.repeat(first[:-1][which] - begin[:-1], n) + np.arange(begin[-1])]
        self.chunk[places] = self.used_chunks + begin[:-1]
        self.bytes[places] = (ends - starts)[which]
        self.n, self.used, self.used_chunks = self.n + len(ids), self.used + total, self.used_chunks + int(begin[-1])
        return places

    def _places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each segment's place in the cache, and the number of segments before each text."""
        if self.n > self.limit:
            self._reset()
        starts, ends, before = tokens.segments(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), before
        chunks, first = tokens.span_chunks(data, starts, ends)
        hashes = tokens.hash_chunks(chunks, first, ends - starts)
        found = self.table.get(hashes)
        missing, raw = np.flatnonzero(found < 0), None
        if len(missing):
            raw = data.tobytes()
            new, at = np.unique(hashes[missing], return_index=True)
            self.table.add(new, self._add(raw, starts, ends, chunks, first, missing[at]))
            found[missing] = self.table.get(hashes[missing])
        same = self.chunks[np.minimum(np.repeat(self.chunk[found] - first[:-1], np.diff(first)) + np.arange(len(chunks)), len(self.chunks) - 1)] == chunks
        other = np.flatnonzero((self.bytes[found] != ends - starts) | ~np.logical_and.reduceat(same, first[:-1]))
        if len(other):
            # equal hashes of unequal segments: these get places of their own, outside the table
            found[other] = self._add(raw or data.tobytes(), starts, ends, chunks, first, other)
        return found, before

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        found, before = self._places(data, offsets)
        sums = np.concatenate(([0], np.cumsum(self.length[found], dtype=np.int64)))
        return sums[before[1:]] - sums[before[:-1]]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, and the number of ids before each text (n + 1)."""
        found, before = self._places(data, offsets)
        lengths = self.length[found].astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(lengths)))
        at = np.arange(sums[-1]) + np.repeat(self.start[found] - sums[:-1], lengths)
        return self.pool[at], sums[before]


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    out = np.zeros(max(n, len(array) * 2), dtype=array.dtype)
    out[: len(array)] = array
    return out


def encoder(path: str = VOCABULARY) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def text_groups(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts of an Arrow column with their bytes and offsets."""
    data, offsets = tokens.texts_of(column)
    for i, j in tokens.groups(offsets):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
