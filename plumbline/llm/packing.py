"""Best-fit packing of token sequences into fixed-length ones: bounded-space online best-fit.

Documents are cut into pieces of at most ``length`` tokens. Each of ``streams`` independent packers (a document's
stream follows from the hash of its id and text) takes its pieces in a fixed order and puts each into the open bin
with the least room that still holds it. At most ``open_bins`` bins are open: when none fits and all are in use, the
fullest one closes. Open bins are kept in a bitset keyed by free space (one integer, bit f set while a bin with f
free tokens is open), so the best bin is one shift and one lowest-bit operation away.

Texts are encoded where they are read; only their token ids are shuffled, once, to the stream that packs them, which
writes each bin's ids when it closes. So a task holds its open bins and nothing else, and the result is whole training
sequences: ids, mask, and which part of which document stands where. It is the same for any number of executors.

Defined results: null and empty texts have no tokens and are in no bin. Null ids are carried as null in a bin's
lists; ``keys`` (the hash of id and text) tells rows of null or repeated ids apart. Repeated rows are packed each.
Ties of free space: the bin that reached it last. A piece as long as a bin has it alone. An empty table gives no
bins. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import VOCABULARY, encoder, text_groups
from plumbline.llm.common import map_text

LENGTH, OPEN_BINS, STREAM_BYTES = 2048, 256, 1 << 25
#: Bins of an output batch.
OUT_BINS = 256

PACKED = "stream long, bin long, doc_ids array<long>, keys array<long>, starts array<long>, lengths array<long>, n_tokens long, input_ids array<int>, mask array<tinyint>"


class Packer:
    """One online packer: ``add`` returns the bins that it closes, as lists of pieces."""

    def __init__(self, length: int, open_bins: int) -> None:
        self.length, self.limit = length, open_bins
        self.bits, self.open = 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> list:
        stack = self.by_free[free]
        out = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return out

    def add(self, piece, size: int) -> list[list]:
        closed = []
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.limit:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, bin_ = self.length, []
        bin_.append(piece)
        free -= size
        if free == 0:
            closed.append(bin_)
        else:
            self.by_free[free].append(bin_)
            self.bits |= 1 << free
            self.open += 1
        return closed

    def flush(self) -> list[list]:
        return [self._take((self.bits & -self.bits).bit_length() - 1) for _ in range(self.open)]


def _encode_batches(vocabulary: str):
    """Per text with tokens: stream, key, doc_id, and its ids as 16 or 32-bit integers on end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for i, j, data, offsets in text_groups(batch.column(3)):
                ids, before = own.encode(data, offsets)
                some = np.flatnonzero(np.diff(before))
                if not len(some):
                    continue
                at = np.concatenate(([0], before[1:][some])) * own.dtype().itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())
                take = pa.array(some)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i).take(take) for c in range(3)), packed], names=["stream", "key", "doc_id", "ids"])

    return run


def encoded(docs: DataFrame, streams: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row with tokens: ``stream``, ``key`` (of id and text), ``doc_id`` and ``ids``."""
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(F.pmod(key, F.lit(streams)).cast("long").alias("stream"), key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return map_text(rows, _encode_batches(vocabulary), "stream long, key long, doc_id long, ids binary")


def _pack_batches(length: int, open_bins: int, vocabulary: str):
    names = ["stream", "bin", "doc_ids", "keys", "starts", "lengths", "n_tokens", "input_ids", "mask"]

    def made_of(out: list[tuple[int, int, list]]) -> pa.RecordBatch:
        counts = np.array([len(b) for _, _, b in out])
        lists = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        flat = [p for _, _, b in out for p in b]
        column = lambda c: pa.ListArray.from_arrays(lists, pa.array([p[c] for p in flat], pa.int64()))
        sizes = np.array([len(p[3]) for p in flat])
        used = np.add.reduceat(sizes, np.concatenate(([0], np.cumsum(counts)[:-1])))
        mask = (np.arange(length)[None, :] < used[:, None]).astype(np.int8)
        ids = np.zeros((len(out), length), dtype=np.int32)
        ids[mask.view(bool)] = np.concatenate([p[3] for p in flat])
        whole = pa.array(np.arange(len(out) + 1, dtype=np.int32) * length)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.int64()),
                *(column(c) for c in range(3)),
                pa.ListArray.from_arrays(lists, pa.array(sizes, pa.int64())),
                pa.array(used, pa.int64()),
                pa.ListArray.from_arrays(whole, pa.array(ids.ravel())),
                pa.ListArray.from_arrays(whole, pa.array(mask.ravel())),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(vocabulary).dtype
        packers: dict[int, tuple[Packer, list[int]]] = {}
        out: list[tuple[int, int, list]] = []

        def closed(stream: int, count: list[int], bins: list[list]) -> None:
            for b in bins:
                out.append((stream, count[0], b))
                count[0] += 1

        def ready() -> Iterator[pa.RecordBatch]:
            while len(out) >= OUT_BINS:
                yield made_of(out[:OUT_BINS])
                del out[:OUT_BINS]

        for batch in batches:
            for stream, key, doc_id, raw in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if stream not in packers:
                    # rows come stream by stream: the one before has had all of its
                    for s, (packer, count) in packers.items():
                        closed(s, count, packer.flush())
                    packers = {stream: (Packer(length, open_bins), [0])}
                packer, count = packers[stream]
                ids = np.frombuffer(raw, dtype=dtype)
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    closed(stream, count, packer.add((doc_id, key, start, piece), len(piece)))
                    yield from ready()
        for s, (packer, count) in packers.items():
            closed(s, count, packer.flush())
        yield from ready()
        if out:
            yield made_of(out)

    return run


def pack(docs: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, streams: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per packed sequence: ``stream``, ``bin``, ``input_ids`` and ``mask`` (``length`` each, 0 on the padding), ``n_tokens``, and per piece its ``doc_ids``, ``keys``, token ``starts`` in the document and ``lengths``.

    By default there are as many streams as ``STREAM_BYTES`` bytes of text go into all.
    """
    if streams is None:
        streams = max(1, -(-(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // STREAM_BYTES))
    # streams are dealt out evenly: one a partition, or several where there are more streams than the session has partitions
    parts = min(streams, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = encoded(docs, streams, vocabulary).repartitionById(parts, F.pmod("stream", F.lit(parts)).cast("int")).sortWithinPartitions("stream", "key", "doc_id")
    return map_text(ordered, _pack_batches(length, open_bins, vocabulary), PACKED)
