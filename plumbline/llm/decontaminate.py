"""Benchmark decontamination by spaced-seed hashing.

A mask such as 1101100101 covers a window of words and ignores those under 0. Hashes of the selected words of each
window of benchmark and corpus are joined, so a passage is found although words in it were replaced. Around each
hit, document and item are laid side by side on the hit's diagonal; the document is contaminated by the item if
there is any stretch of at least ``min_words`` words (all of a shorter item) of which ``min_share`` agree. Whether
there is one is decided exactly, by the running minimum of one running sum.

The corpus side is filtered, before the join, by a Bloom filter of the benchmark's hashes whose size is fixed by
their counted number (at most ``max_bloom_bytes``, beyond which only more rows pass on to the join). It is made of
segments that tasks fill; the driver and the workers hold it as bits. Documents
without a candidate send nothing; the others send their word hashes once. No text is shuffled.

The masks miss no stretch of the default ``min_words`` and ``min_share``. Items shorter than 12 words have masks of
their own, which documents are only searched for if there are such items.

Defined results: null and empty texts match nothing. Items shorter than ``min_words`` are found whole, in the same
share of their words. Null doc_ids and item_ids are carried as null. Repeated rows give one result row per id, repeated items
each their own. Ties between stretches go to the first. Other columns are ignored, whatever their names, and kept as they are
by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import tokens
from plumbline.llm.common import broadcast_if_small, fresh, map_text, materialize

#: Every stretch of 12 to 23 words of which 75 % agree has one of these, wherever the others are; a longer one that agrees as
#: much has a part of 12 to 23 words that does. Found by greedy choice over all 108,297 such patterns, which a test goes through.
MASKS = ("110111", "1101000011", "11001011", "110000001011")
#: For items under 12 words, by their number of words: a run that they have if 75 % of them agree.
SHORT = {1: "1", 2: "11", 3: "111", 4: "11", 5: "11", 6: "111", 7: "111", 8: "11", 9: "111", 10: "111", 11: "111"}
MIN_WORDS, MIN_SHARE, MAX_BLOOM_BYTES = 12, 0.75, 64 << 20


def spaced_hashes(hashes: np.ndarray, before: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """The masked hash of each whole window, and the window's first word."""
    width, n = len(mask), len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    at = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    acc = np.full(n - width + 1, int(mask, 2), dtype=np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            acc = tokens.mix(acc * np.uint64(0x100000001B3) + hashes[k : n - width + 1 + k])
    return acc[at], at


#: Bits of a filter that one row fills.
SEGMENT = 19


class Bloom:
    """A Bloom filter with four probes, 128 bits or more per key up to its greatest size."""

    def __init__(self, n: int, max_bytes: int) -> None:
        self.bits = max(16, min(int(n * 128).bit_length(), int(max_bytes).bit_length() + 2))
        self.field = np.zeros(1 << self.bits - 3, dtype=np.uint8)

    def places(self, keys: np.ndarray, k: int) -> np.ndarray:
        """The bit of each key's k-th probe."""
        return (keys * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)[k]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        for k in range(4):
            at = self.places(keys, k)
            np.bitwise_or.at(self.field, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Indices of the keys that may be in the set."""
        left = np.arange(len(keys))
        for k in range(4):
            at = self.places(keys[left], k)
            left = left[self.field[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1]
        return left


def _seed(hashes: np.ndarray, before: np.ndarray, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Items' masked hashes and their first words: of ``masks``, or for a short item of the mask for its length."""
    n, found = np.diff(before), []
    for m in (*masks, *sorted(set(SHORT.values()))):
        h, at = spaced_hashes(hashes, before, m)
        own = np.repeat(n > max(SHORT) if m in masks else np.isin(n, [k for k, v in SHORT.items() if v == m]), n)
        found.append((h[own[at]], at[own[at]]))
    return np.concatenate([h for h, _ in found]), np.concatenate([p for _, p in found])


def _benchmark_batches(masks: tuple[str, ...]):
    """Per item: its word hashes and all its masked hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.texts_of(batch.column(2))
            for i, j in tokens.groups(offsets):
                hashes, before, _ = tokens.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield _per_text(batch, i, j, hashes, before, *_seed(hashes, before, masks))

    return run


def _corpus_batches(masks: tuple[str, ...], bloom):
    """Per document with a candidate: its word hashes and the hashes that may be in the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = bloom.value
        for batch in batches:
            data, offsets = tokens.texts_of(batch.column(2))
            for i, j in tokens.groups(offsets):
                hashes, before, _ = tokens.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                h, p = [], []
                for m in masks:
                    own, at = spaced_hashes(hashes, before, m)
                    maybe = filter_.maybe(own)
                    h.append(own[maybe])
                    p.append(at[maybe])
                out = _per_text(batch, i, j, hashes, before, np.concatenate(h), np.concatenate(p), only_hit=True)
                if out.num_rows:
                    yield out

    return run


def _per_text(batch: pa.RecordBatch, i: int, j: int, hashes: np.ndarray, before: np.ndarray, found: np.ndarray, at: np.ndarray, only_hit: bool = False) -> pa.RecordBatch:
    order = np.argsort(at, kind="stable")
    found, at = found[order], at[order]
    hits = np.searchsorted(at, before)
    keep = np.flatnonzero(np.diff(hits) > 0) if only_hit else np.arange(j - i)
    text = np.repeat(np.arange(j - i), np.diff(before))
    chosen = np.isin(text, keep) if only_hit else slice(None)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).slice(i, j - i).take(pa.array(keep)),
            batch.column(1).slice(i, j - i).take(pa.array(keep)),
            pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.diff(before)[keep]))), pa.int32()), pa.array(hashes[chosen].view(np.int64))),
            pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.diff(hits)[keep]))), pa.int32()), pa.array(found.view(np.int64))),
            pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(np.diff(hits)[keep]))), pa.int32()), pa.array(at - np.repeat(before[:-1], np.diff(hits)))
            ),
        ],
        names=["key", "id", "words", "hashes", "at"],
    )


def best_stretch(doc: np.ndarray, item: np.ndarray, diagonal: int, min_words: int, min_share: float) -> tuple[int, int, int] | None:
    """The stretch with doc[k] beside item[k - diagonal] that exceeds ``min_share`` by most words: its first word in doc, its length, and how many words agree; None if none of ``min_words`` reaches the share."""
    low, high = max(0, diagonal), min(len(doc), diagonal + len(item))
    least = min(min_words, len(item))
    if high - low < least:
        return None
    same = doc[low:high] == item[low - diagonal : high - diagonal]
    sums = np.concatenate(([0.0], np.cumsum(same - min_share)))
    lowest = np.minimum.accumulate(sums)[: len(sums) - least]
    gain = sums[least:] - lowest
    end = int(np.argmax(gain))
    if gain[end] < -1e-9:
        return None
    start = int(np.flatnonzero(sums[: end + 1] == lowest[end])[0])
    return low + start, end + least - start, int(same[start : end + least].sum())


def _verify_batches(min_words: int, min_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, item = batch.column(2), batch.column(3)
            rows = []
            for k, diagonals in enumerate(batch.column(4).to_pylist()):
                d, t = doc[k].values.to_numpy(), item[k].values.to_numpy()
                for diagonal in diagonals:
                    found = best_stretch(d, t, diagonal, min_words, min_share)
                    if found:
                        rows.append((k, *found, len(t)))
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *(pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2, 3, 4))],
                names=["doc_id", "item_id", "first_word", "n_words", "n_same", "item_words"],
            )

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, max_bloom_bytes: int = MAX_BLOOM_BYTES
) -> DataFrame:
    """One row per document and benchmark item that overlap: ``doc_id``, ``item_id``, the best stretch's ``first_word``, ``n_words``, ``n_same``, and ``item_words``."""
    spark = docs.sparkSession
    schema = "key long, id long, words array<long>, hashes array<long>, at array<long>"
    # a number per row; written with the row, so that it is the same whenever it is read
    part = lambda d, c: d.select(F.monotonically_increasing_id().alias("key"), F.col(c).cast("long").alias("id"), F.lower("text").alias("text")).where("text <> ''")
    items = materialize(map_text(part(benchmark, "item_id"), _benchmark_batches(masks), schema), "items")
    seeds = materialize(items.select("key", F.explode(F.arrays_zip("hashes", "at")).alias("s")).select(F.col("key").alias("item"), F.col("s.hashes").alias("hash"), F.col("s.at").alias("item_at")), "seeds")
    bloom = spark.sparkContext.broadcast(_bloom(seeds, max_bloom_bytes))
    lengths = {r[0] for r in items.select(F.size("words")).where(F.size("words") <= max(SHORT)).distinct().collect()}
    searched = (*masks, *sorted({SHORT[n] for n in lengths if n}))
    found = materialize(map_text(part(docs, "doc_id"), _corpus_batches(searched, bloom), schema), "candidates")
    hits = (
        found.select("key", F.explode(F.arrays_zip("hashes", "at")).alias("s"))
        .select("key", F.col("s.hashes").alias("hash"), F.col("s.at").alias("doc_at"))
        .join(broadcast_if_small(seeds, 24), "hash")
        .groupBy("key", "item")
        .agg(F.collect_set(F.col("doc_at") - F.col("item_at")).alias("diagonals"))
    )
    entries = items.select(F.col("key").alias("item"), F.col("id").alias("item_id"), F.col("words").alias("item_words"))
    pairs = (
        hits.join(found.select("key", F.col("id").alias("doc_id"), F.col("words").alias("doc_words")), "key")
        .join(entries, "item")
        .select("doc_id", "item_id", "doc_words", "item_words", "diagonals")
    )
    verified = map_text(pairs, _verify_batches(min_words, min_share), "doc_id long, item_id long, first_word long, n_words long, n_same long, item_words long")
    best = F.max(F.struct("n_same", (-F.col("n_words")).alias("n"), (-F.col("first_word")).alias("f"), "item_words"))
    return (
        verified.groupBy("doc_id", "item_id")
        .agg(best.alias("b"))
        .select("doc_id", "item_id", (-F.col("b.f")).alias("first_word"), (-F.col("b.n")).alias("n_words"), F.col("b.n_same").alias("n_same"), F.col("b.item_words").alias("item_words"))
    )


def _bloom(seeds: DataFrame, max_bytes: int) -> Bloom:
    """A filter of all seeds' hashes: tasks fill its segments, which the driver puts side by side."""
    out = Bloom(seeds.count(), max_bytes)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.unique(batch.column(0).to_numpy()).view(np.uint64)
            at = np.unique(np.concatenate([out.places(keys, k) for k in range(4)]))
            yield pa.RecordBatch.from_arrays([pa.array(at >> SEGMENT), pa.array((at & (1 << SEGMENT) - 1).astype(np.int32))], names=["segment", "bit"])

    def fill(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << SEGMENT, dtype=np.uint8)
        own[table["bit"].to_numpy()] = 1
        return pa.table({"segment": table["segment"][:1], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()])})

    for r in seeds.select("hash").mapInArrow(places, "segment long, bit int").groupBy("segment").applyInArrow(fill, "segment long, bits binary").toLocalIterator():
        own = np.frombuffer(r.bits, dtype=np.uint8)[: len(out.field)]
        out.field[r.segment << SEGMENT - 3 :][: len(own)] = own
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without contaminated documents; rows without a doc_id stay."""
    (name,) = fresh(docs.columns, "_gone")
    gone = materialize(contaminated(docs, benchmark, **options).where("doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(broadcast_if_small(gone, 16), docs["doc_id"] == gone[name], "left_anti")
