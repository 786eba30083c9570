"""Near-duplicate documents: banded MinHash candidates, verified by odd sketches.

Words (case folded) give shingles of ``shingle`` consecutive words; ``bands * rows`` MinHash samples are taken of
them. Equal signatures are one node from then on, so exact copies cost one row each and never meet in pairs.
Nodes that share a band are candidates. A document's samples are also folded into an odd sketch, a bitmap in
which each sample flips one bit; the population count of two sketches' XOR estimates the Jaccard similarity
(Mitzenmacher, Pagh and Pham, 2014), most precisely where it is high. Per set of nodes that met, a search over
similar sketches leaves a spanning forest rather than all pairs, so a group of m copies costs m - 1 edges.
A band that more than ``CROWD`` nodes share is cut into parts that meet in pairs, each pair in a row of its own, so
the variants of one template are spread over tasks and all still meet. Connected components of the edges are the groups.

Defined results: a null doc_id is never in a group. Null texts and texts without any character are in no group;
texts without words (only symbols) match only when equal. Repeated rows of one doc_id are one document. Ties:
the smallest doc_id of a group stands for it. An empty table gives no rows. Other columns are ignored, whatever their names,
and kept as they are by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import tokens
from plumbline.llm.common import broadcast_if_small, fresh, map_text, materialize

BANDS, ROWS, SHINGLE, BITS, THRESHOLD = 40, 6, 2, 512, 0.62
#: Nodes of a band that are compared in one row; one node in ``LOOK`` is counted to find bands of more.
CROWD, LOOK = 4_096, 16

_SIGNATURE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("sig", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20140407)
    return rng.integers(1, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def shingle_hashes(hashes: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words (fewer in a shorter text), and where each text's begin (texts + 1)."""
    count = np.diff(before)
    out_count = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    starts = np.concatenate(([0], np.cumsum(out_count)))
    first = np.repeat(before[:-1] - starts[:-1], out_count) + np.arange(starts[-1])
    last = np.repeat(before[1:], out_count)
    acc = np.zeros(starts[-1], dtype=np.uint64)
    for k in range(n):
        at = first + k
        inside = at < last
        acc = np.where(inside, acc * np.uint64(0x100000001B3) + hashes[np.minimum(at, len(hashes) - 1)], acc) if len(hashes) else acc
    return tokens.mix(acc), starts


def signatures(data: np.ndarray, offsets: np.ndarray, bands: int, rows: int, shingle: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MinHash samples (texts x bands*rows), sketches (texts x bits/8), and whether a text has any sample."""
    k = bands * rows
    a, b = _coefficients(k)
    hashes, before, _ = tokens.words(data, offsets)
    wordless = np.flatnonzero((np.diff(before) == 0) & (np.diff(offsets) > 0))
    shingles, starts = shingle_hashes(hashes, before, shingle)
    count = np.diff(starts)
    some = np.flatnonzero(count > 0)
    n = len(offsets) - 1
    samples = np.zeros((n, k), dtype=np.uint32)
    if len(some):
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        at = starts[some]
        columns = np.empty((k, len(some)), dtype=np.uint32)
        v = np.empty_like(h)
        for i in range(k):
            np.multiply(h, a[i], out=v)
            v += b[i]
            np.minimum.reduceat(v, at, out=columns[i])
        samples[some] = columns.T
    if len(wordless):
        # symbols only: samples from the whole text's hash, so that equal texts meet
        whole = tokens.span_hashes(data, offsets[wordless], offsets[wordless + 1])
        samples[wordless] = (tokens.mix(whole[:, None] + np.arange(1, k + 1, dtype=np.uint64)[None, :]) >> np.uint64(32)).astype(np.uint32)
    bit = (tokens.mix((samples.astype(np.uint64) << np.uint64(16)) ^ np.arange(k, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount((bit + np.arange(n)[:, None] * bits).ravel(), minlength=n * bits).reshape(n, bits) & 1
    has = np.zeros(n, dtype=bool)
    has[some] = has[wordless] = True
    return samples, np.packbits(flips.astype(np.uint8), axis=1), has


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per text and band."""
    parts = samples.reshape(len(samples), bands, rows).astype(np.uint64)
    acc = np.broadcast_to(tokens.mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(rows):
        acc = tokens.mix(acc * np.uint64(0x100000001B3) + parts[:, :, r])
    return acc.view(np.int64)


def estimate(xor_bits: np.ndarray, bits: int, k: int) -> np.ndarray:
    """Jaccard similarity from the number of differing sketch bits."""
    share = 1 - 2 * np.asarray(xor_bits, dtype=float) / bits
    return np.clip(1 + bits / (4 * k) * np.log(np.maximum(share, 1e-9)), 0, 1)


def most_bits(threshold: float, bits: int, k: int) -> int:
    """The most differing bits at which the estimate still reaches ``threshold``."""
    return int(np.flatnonzero(estimate(np.arange(bits + 1), bits, k) >= threshold).max())


def _signature_batches(bands: int, rows: int, shingle: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.texts_of(batch.column(1))
            ids = batch.column(0)
            for i, j in tokens.groups(offsets):
                samples, sketch, has = signatures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bands, rows, shingle, bits)
                keep = np.flatnonzero(has & ids.slice(i, j - i).is_valid().to_numpy(zero_copy_only=False))
                if not len(keep):
                    continue
                samples, sketch = np.ascontiguousarray(samples[keep]), np.ascontiguousarray(sketch[keep])
                keys = band_keys(samples, bands, rows)
                # 128 bits of the whole signature
                wide = np.stack([tokens.mix(keys.view(np.uint64) * np.uint64(m)).sum(axis=1, dtype=np.uint64) for m in (3, 0x9E3779B97F4A7C15)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i).take(pa.array(keep)).cast(pa.int64()),
                        _binary(wide.view(np.uint8).reshape(len(keep), 16)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * bands), pa.array(keys.ravel())),
                        _binary(sketch),
                    ],
                    names=["doc_id", "sig", "bands", "sketch"],
                )

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def forest(ids: np.ndarray, sketches: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph in which sketches (n x words) differing in at most ``limit`` bits are joined."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(ids))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(sketches[left] ^ sketches[at]).sum(axis=1, dtype=np.int64) <= limit
            found = left[near]
            left = left[~near]
            out.extend((int(ids[at]), int(ids[x])) for x in found)
            queue.extend(found)
    return out


def _forest_batches(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            if not len(members):
                continue
            off = members.offsets.to_numpy().astype(np.int64)
            flat = members.flatten()
            ids = flat.field(0).to_numpy()
            raw = flat.field(1)
            data, _ = np.frombuffer(raw.buffers()[2], dtype=np.uint8), None
            where = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1]
            sketches = data[where[0] : where[-1]].reshape(len(ids), -1).view(np.uint64)
            off = off - off[0]
            size = np.diff(off)
            two = off[:-1][size == 2]
            near = np.bitwise_count(sketches[two] ^ sketches[two + 1]).sum(axis=1, dtype=np.int64) <= limit
            a, b = [ids[two[near]]], [ids[two[near] + 1]]
            for k in np.flatnonzero(size > 2):
                pairs = forest(ids[off[k] : off[k + 1]], sketches[off[k] : off[k + 1]], limit)
                if pairs:
                    p = np.array(pairs, dtype=np.int64)
                    a.append(p[:, 0])
                    b.append(p[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: columns ``node`` and ``root``, the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a map-side minimum and a join, so no
    neighbourhood is ever collected; the number of rounds grows with the logarithm of the largest component.
    """
    edges = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )

    def least(of: DataFrame) -> DataFrame:
        """Each row with ``m``, the least v of its u: map-side minima, joined back, so that a hub's rows can be split among tasks."""
        return of.join(of.groupBy("u").agg(F.min("v").alias("m")), "u")

    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).withColumn("m", F.least("m", "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = least(large)
        small = low.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = materialize(small.where("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first())
        if now[0] == now[2] and now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now


def _lists(nodes: DataFrame, crowd: int, look: int) -> DataFrame:
    """``members`` (node and sketch) of each set of nodes that met in a band; of a crowded band, a row for each pair of its parts."""
    banded = nodes.select("node", F.explode("bands").alias("band"))
    # which bands to cut is a matter of work, not of results: their size is told from one node in ``look``
    some = nodes.where(F.pmod(F.xxhash64(F.lit("look"), "node"), F.lit(look)) == 0).select(F.explode("bands").alias("hot"))
    hot = materialize(some.groupBy("hot").agg(F.ceil(F.count("*") * look / crowd).cast("int").alias("parts")).where("parts > 1"), "hot-bands")
    side = broadcast_if_small(hot, 16)
    sets = (
        banded.join(side, F.col("band") == F.col("hot"), "left_anti")
        .groupBy("band")
        .agg(F.array_sort(F.collect_set("node")).alias("members"))
        .where(F.size("members") > 1)
        .select("members")
        .distinct()
    )
    met = sets.select(F.xxhash64(F.size("members"), "members").alias("set"), F.explode("members").alias("node"))
    # a node may have several signatures if rows of one doc_id differ; then each counts
    member = F.collect_list(F.struct("node", "sketch")).alias("members")
    lists = met.join(nodes.select("node", "sketch"), "node").groupBy("set").agg(member).select("members")
    if hot.isEmpty():
        return lists
    part, other = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cut = (
        nodes.select("node", "sketch", F.explode("bands").alias("band"))
        .join(side, F.col("band") == F.col("hot"))
        .select("node", "sketch", "band", part.alias("part"), other.alias("other"))
        .groupBy("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        .agg(member)
        .select("members")
    )
    return lists.unionByName(cut)


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, bits: int = BITS, crowd: int = CROWD, look: int = LOOK
) -> DataFrame:
    """Members of groups of near-duplicates: ``doc_id``, and ``group_id``, the smallest doc_id of the group (see the module)."""
    limit = most_bits(threshold, bits, bands * rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    sig = materialize(map_text(text, _signature_batches(bands, rows, shingle, bits), _SIGNATURE), "signatures")
    # equal signatures: one node
    nodes = materialize(
        sig.groupBy("sig").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("n")).select("sig", F.col("n.doc_id").alias("node"), "n.bands", "n.sketch"),
        "nodes",
    )
    copies = materialize(sig.select("doc_id", "sig").join(nodes.select("sig", "node"), "sig").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct(), "copies")
    edges = map_text(_lists(nodes, crowd, look), _forest_batches(limit), "a long, b long")
    # a copy of one node only follows it; those whose rows connect several nodes are edges
    own = copies.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("last")).join(nodes.select(F.col("node").alias("also")).distinct(), F.col("a") == F.col("also"), "left")
    own = materialize(own.select("a", "b", ((F.col("b") == F.col("last")) & F.col("also").isNull()).alias("leaf")), "own-copies")
    links = copies.join(own.where("NOT leaf").select("a"), "a", "left_semi")
    found = components(edges.unionByName(links))
    leaves = own.where("leaf").select(F.col("a").alias("doc_id"), F.col("b").alias("first"))
    found = materialize(found, "components")
    followed = leaves.join(found, F.col("first") == F.col("node"), "left").select("doc_id", F.coalesce("root", "first").alias("group_id"), "first")
    alone = followed.select(F.col("first").alias("doc_id")).distinct().join(found, F.col("doc_id") == F.col("node"), "left_anti").select("doc_id", F.col("doc_id").alias("group_id"))
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id")).unionByName(followed.select("doc_id", "group_id")).unionByName(alone)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the members of each group other than its smallest doc_id; rows without doc_id stay."""
    (name,) = fresh(docs.columns, "_gone")
    groups = near_duplicates(docs, **options)
    gone = materialize(groups.where("doc_id <> group_id").select(F.col("doc_id").alias(name)), "gone")
    return docs.join(broadcast_if_small(gone, 16), docs["doc_id"] == gone[name], "left_anti")
