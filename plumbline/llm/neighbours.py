"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: the vectors are centred at the mean of all rows, and rotations, learned by iterative quantization (Gong and
Lazebnik, 2011) from sums over all rows, give one bit a dimension (its sign). The code is cut into substrings of s
bits, each of which is indexed (Norouzi, Punjani and Fleet, 2012): a row meets the rows of its own bucket and of the
s buckets that one flipped bit leads to. By the pigeonhole principle T substrings so probed retrieve every code
within Hamming radius 2T - 1 of the query's, and many beyond it. All that is retrieved is ranked by its floats.

Every row is a query, and each takes as many substrings as it needs. A first round of ``first`` substrings gives its
k-th best similarity so far, which the true k-th reaches at least. A vector that similar lies at an angle of at most
a, so each bit differs with probability p = a / pi, a substring retrieves it with P = (1-p)^s + s p (1-p)^(s-1), and
T of them miss it with (1-P)^T. A second round takes T so that this is at most ``miss``. The radius is thus a row's
own, not one drawn from a sample. Where T substrings would meet more rows than there are (T (s+1) >= 2^s), the row is
compared with all rows instead, which is exact. s follows from the number of rows: buckets hold ``bucket_rows``.

Rows are shuffled by substring and the leading bits of its value, so only rows whose codes collide meet; a task holds
about ``task_rows`` rows, and buckets of more are cut into pieces that meet in pairs, so a hot one has many tasks.

Similarity is the cosine. Defined results: null vectors, those of another length than most, with a null or
non-finite element or of zero norm, have no neighbours and are nobody's. Null ids are left out. Repeated ids are each other's
neighbours as other rows are. A row is not its own neighbour. Ties of similarity go to the smaller id. With fewer
than k + 1 rows, all others are returned. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

K, MISS, FIRST, BUCKET_ROWS, TASK_ROWS, LEAST_BITS, ROUNDS = 10, 0.08, 4, 400, 1 << 16, 9, 3
#: Lists of k that a task merges.
MERGED_LISTS = 100_000
#: Roles of a row in a task: it is indexed, it is a query.
INDEXED, QUERY = 1, 2

_EMITTED = "part long, piece int, role int, own boolean, bucket int, row long, id long, vector binary"
_FOUND = "row long, best array<struct<s:float,id:long,row:long>>"


def substring_bits(n: int, bucket_rows: int = BUCKET_ROWS, least: int = LEAST_BITS) -> int:
    """Bits of a substring, so that a bucket holds about ``bucket_rows`` of n rows."""
    return max(least, ceil(log2(max(1, n) / bucket_rows)))


def chance(similarity: float, s: int) -> float:
    """The probability that a substring of s bits, probed to one flipped bit, retrieves a vector this similar."""
    p = np.arccos(np.clip(similarity, -1, 1)) / np.pi
    return float((1 - p) ** s + s * p * (1 - p) ** (s - 1))


def substrings_needed(similarity: Column, s: int, miss: float) -> Column:
    """How many substrings retrieve vectors of at least a similarity but for ``miss`` of them."""
    p = F.acos(F.least(F.greatest(similarity, F.lit(-1.0)), F.lit(1.0))) / np.pi
    found = F.pow(1 - p, F.lit(s)) + s * p * F.pow(1 - p, F.lit(s - 1))
    return F.when(found >= 1 - 1e-12, 1).otherwise(F.ceil(np.log(miss) / F.log1p(-F.greatest(found, F.lit(1e-300))))).cast("double")


def sums_by_task(rows: DataFrame, function, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of ``function`` (matrix of vectors to an array), added up by task and then by groups of tasks."""
    size = int(np.prod(shape))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += function(matrix(batch.column(0), np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([total.tobytes()])], names=["g", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b) for b in table["sums"].to_pylist()], axis=0)
        return pa.table({"g": table["g"][:1], "sums": pa.array([total.tobytes()])})

    parts = rows.select("vector").mapInArrow(partial, "g int, sums binary").groupBy("g").applyInArrow(add, "g int, sums binary").collect()
    return np.sum([np.frombuffer(r.sums) for r in parts], axis=0).reshape(shape) if parts else np.zeros(size).reshape(shape)


def first_rotation(d: int, k: int, seed: int = 5) -> np.ndarray:
    """The random rotation that the k-th learned one starts from."""
    return np.linalg.qr(np.random.default_rng((seed, k)).standard_normal((d, d)))[0]


def learn_rotations(rows: DataFrame, mean: np.ndarray, first: int, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Rotations ``first`` to ``first + count`` (count x d x d) that bring centred rows close to corners of the cube; each round is one pass over all rows."""
    d = len(mean)
    now = np.stack([first_rotation(d, first + k) for k in range(count)])
    for _ in range(rounds):
        rotations = now.astype(np.float32)

        def outer(x: np.ndarray, rotations=rotations) -> np.ndarray:
            centred = x - mean
            return np.stack([np.where(centred @ r >= 0, np.float32(1), np.float32(-1)).T @ centred for r in rotations])

        made = []
        for k, total in enumerate(sums_by_task(rows, outer, now.shape)):
            u, _, v = np.linalg.svd(total)
            made.append((u @ v).T if np.isfinite(total).all() else now[k])
        now = np.stack(made)
    return now


def substring_values(x: np.ndarray, mean: np.ndarray, rotations: np.ndarray, s: int, t: int) -> np.ndarray:
    """The value of substring t of each row's code: s bits of the code, from the rotations on end."""
    d = len(mean)
    value = np.zeros(len(x), dtype=np.int64)
    centred = x - mean
    for bit in range(t * s, t * s + s):
        value = value << 1 | (centred @ rotations[bit // d][:, bit % d].astype(np.float32) >= 0)
    return value


def matrix(column, dtype=np.float32) -> np.ndarray:
    """Binaries of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 1), dtype)
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].view(dtype).reshape(n, -1)


def best_of(q: np.ndarray, qrow: np.ndarray, x: np.ndarray, row: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """Per block of queries: their places, and the places in x and similarities of each query's best k; a row is not its own neighbour."""
    out = []
    order = np.argsort(row, kind="stable")
    own = np.minimum(np.searchsorted(row[order], qrow), len(row) - 1)
    self_at = np.where(row[order[own]] == qrow, order[own], -1)
    step = max(1, (1 << 22) // len(x))
    for a in range(0, len(q), step):
        sims = q[a : a + step] @ x.T
        has = np.flatnonzero(self_at[a : a + step] >= 0)
        sims[has, self_at[a : a + step][has]] = -3
        # the k-th of the maxima of some chunks is at most the k-th of all
        g = max(1, len(x) // (4 * k))
        whole = len(x) // g * g
        if whole // g > k:
            maxima = sims[:, :whole].reshape(len(sims), -1, g).max(axis=2)
            bound = np.partition(maxima, -k, axis=1)[:, -k, None] - np.float32(1e-5)
        else:
            bound = np.float32(-2.5)
        i, j = np.nonzero(sims >= np.maximum(bound, np.float32(-2.5)))
        if not len(i):
            continue
        # each pair's similarity is the same wherever it is computed
        exact = (q[a + i].astype(np.float64) * x[j]).sum(axis=1).astype(np.float32)
        rank = np.lexsort((row[j], ids[j], -exact, i))
        i, j, exact = i[rank], j[rank], exact[rank]
        first = np.concatenate(([0], np.flatnonzero(i[1:] != i[:-1]) + 1))
        place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        keep = place < k
        out.append((a + i[keep], j[keep], exact[keep]))
    return out


def meet(bits: int, k: int):
    """One task's work: each query meets the indexed rows of its bucket and, in its own part, of the buckets one of ``bits`` flipped bits away."""

    def run(table: pa.Table) -> pa.Table:
        role, own, bucket = (table[c].to_numpy() for c in ("role", "own", "bucket"))
        row, ids, x = table["row"].to_numpy(), table["id"].to_numpy(), matrix(table["vector"])
        indexed = np.flatnonzero(role & INDEXED)
        indexed = indexed[np.argsort(bucket[indexed], kind="stable")]
        starts = np.searchsorted(bucket[indexed], np.arange((1 << bits) + 1))
        found: list[tuple[np.ndarray, ...]] = []
        for near in (True, False):
            asked = np.flatnonzero((role & QUERY > 0) & (own == near))
            asked = asked[np.argsort(bucket[asked], kind="stable")]
            cut = np.flatnonzero(np.concatenate(([True], bucket[asked][1:] != bucket[asked][:-1]))) if len(asked) else np.zeros(0, np.int64)
            for a, b in zip(cut, np.append(cut[1:], len(asked))):
                q, v = asked[a:b], int(bucket[asked[a]])
                probes = [v, *(v ^ 1 << f for f in range(bits))] if near else [v]
                met = np.concatenate([indexed[starts[p] : starts[p + 1]] for p in probes])
                if len(met):
                    found.extend((q[i], met[j], s) for i, j, s in best_of(x[q], row[q], x[met], row[met], ids[met], k))
        i, j, s = (np.concatenate([f[c] for f in found]) for c in range(3)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)
        best = pa.StructArray.from_arrays([pa.array(-s), pa.array(ids[j]), pa.array(row[j])], names=["s", "id", "row"])
        return pa.table({"row": pa.array(row[i[first]]), "best": pa.ListArray.from_arrays(pa.array(np.append(first, len(i)), pa.int32()), best)})

    return run


def _emit(mean: np.ndarray, rotations: np.ndarray, s: int, low: int, first: int, last: int, hot: dict[int, int]):
    """Per row and substring of ``first`` to ``last``: the row for its own part, as indexed and, where it asks, as a query; as a query for the parts one flipped bit away.

    ``hot`` gives the number of pieces of parts with many rows; their indexed and asking pieces meet in pairs.
    """

    def record(batch: pa.RecordBatch, at: np.ndarray, part: np.ndarray, piece: np.ndarray, role: np.ndarray | int, own: bool, bucket: np.ndarray) -> pa.RecordBatch:
        take = pa.array(at)
        fill = lambda v, kind: pa.array(np.broadcast_to(v, len(at)).astype(kind))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[at]), fill(piece, np.int32), fill(role, np.int32), pa.array(np.full(len(at), own)), pa.array(bucket[at].astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take)],
            names=["part", "piece", "role", "own", "bucket", "row", "id", "vector"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, need, row = matrix(batch.column(2)), batch.column(3).to_numpy(), batch.column(0).to_numpy()
            for t in range(first, last):
                value = substring_values(x, mean, rotations, s, t)
                bucket, asks = value & (1 << low) - 1, need > t
                for flip in (0, *(1 << f for f in range(s - low))):
                    part = (value >> low ^ flip) | t << s - low
                    pieces = np.array([hot.get(p, 1) for p in part.tolist()]) if hot else np.ones(len(part), np.int64)
                    calm = pieces == 1
                    at = np.flatnonzero(calm if flip == 0 else calm & asks)
                    if len(at):
                        yield record(batch, at, part, np.int64(0), np.where(asks[at], INDEXED | QUERY, INDEXED) if flip == 0 else QUERY, flip == 0, bucket)
                    for n in np.unique(pieces[~calm]).tolist():
                        mine = pieces == n
                        for j in range(n):
                            at = np.flatnonzero(mine)
                            if flip == 0:
                                yield record(batch, at, part, row[at] % n * n + j, INDEXED, True, bucket)
                            at = np.flatnonzero(mine & asks)
                            if len(at):
                                yield record(batch, at, part, j * n + row[at] % n, QUERY, flip == 0, bucket)

    return run


def _crowded(rows: DataFrame, mean: np.ndarray, rotations: np.ndarray, s: int, low: int, first: int, last: int, task_rows: int) -> dict[int, int]:
    """The parts that hold more than twice ``task_rows``, and into how many pieces they are cut."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                part = np.concatenate([substring_values(x, mean, rotations, s, t) >> low | t << s - low for t in range(first, last)])
                parts, n = np.unique(part, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(n)], names=["part", "n"])

    sums = rows.select("vector").mapInArrow(count, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))
    return {r.part: ceil(r.n / task_rows) for r in sums.where(F.col("n") > 2 * task_rows).collect()}


def _round(rows: DataFrame, mean: np.ndarray, rotations: np.ndarray, s: int, first: int, last: int, k: int, n: int, task_rows: int) -> DataFrame:
    """The best k of each query (``need`` > t) from substrings ``first`` to ``last``: ``row`` and ``best``, one row per task that it met."""
    low = max(0, s - max(0, ceil(log2(max(1, n) / task_rows))))
    hot = _crowded(rows, mean, rotations, s, low, first, last, task_rows) if n > 2 * task_rows else {}
    emitted = rows.select("row", "id", "vector", "need").mapInArrow(_emit(mean, rotations, s, low, first, last, hot), _EMITTED)
    return emitted.groupBy("part", "piece").applyInArrow(meet(low, k), _FOUND)


def _against_all(rows: DataFrame, queries: DataFrame, k: int, n: int, n_queries: int, task_rows: int) -> DataFrame:
    """The best k of each query from all rows."""
    cells, blocks = ceil(n / task_rows), ceil(n_queries / task_rows)
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    shape = lambda df, part, piece, role: df.select(part.alias("part"), piece.alias("piece"), F.lit(role).alias("role"), F.lit(True).alias("own"), F.lit(0).alias("bucket"), "row", "id", "vector")
    cell, block = (F.pmod(F.xxhash64("row"), F.lit(count)) for count in (cells, blocks))
    left = shape(rows.withColumn("other", each(blocks)), cell, F.col("other").cast("int"), INDEXED)
    right = shape(queries.withColumn("other", each(cells)), F.col("other").cast("long"), block.cast("int"), QUERY)
    return left.unionByName(right).groupBy("part", "piece").applyInArrow(meet(0, k), _FOUND)


def _merge_lists(k: int):
    """Of the lists of each row, the best k; a pair that met more than once counts once."""

    def run(table: pa.Table) -> pa.Table:
        lists = table["best"].combine_chunks()
        flat = lists.flatten()
        sim, ids, other = (flat.field(c).to_numpy() for c in range(3))
        row = np.repeat(table["row"].to_numpy(), lists.value_lengths().to_numpy())
        order = np.lexsort((other, ids, sim, row))
        row, sim, ids, other = row[order], sim[order], ids[order], other[order]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (other[1:] != other[:-1]) | (sim[1:] != sim[:-1]))) if len(row) else np.zeros(0, bool)
        row, sim, ids, other = row[new], sim[new], ids[new], other[new]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        row, sim, ids, other = row[place < k], sim[place < k], ids[place < k], other[place < k]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else first
        best = pa.StructArray.from_arrays([pa.array(sim), pa.array(ids), pa.array(other)], names=["s", "id", "row"])
        return pa.table({"row": pa.array(row[first]), "best": pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), best)})

    return run


def _merged(found: DataFrame, k: int, lists: int) -> DataFrame:
    """The best k of each row over all tasks, of about ``lists`` lists in all."""
    groups = max(1, ceil(lists / MERGED_LISTS))
    return found.groupBy(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("g")).applyInArrow(_merge_lists(k), _FOUND)


def nearest(
    vectors: DataFrame, k: int = K, miss: float = MISS, first: int = FIRST, bucket_rows: int = BUCKET_ROWS, task_rows: int = TASK_ROWS, report: dict | None = None
) -> DataFrame:
    """For each row its ``rank`` 1 to k neighbours: ``vec_id``, ``neighbour_id``, cosine ``similarity`` and ``rank``.

    ``report`` gets the figures of the search: ``rows``, ``bits`` of a substring, the greatest number of ``substrings`` that a row
    took, and how many rows were compared with ``all``.
    """
    spark = vectors.sparkSession
    usable = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("e"))
    usable = usable.where(F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0))
    lengths = usable.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "vec_id long, neighbour_id long, similarity float, rank int")
    d, n = lengths

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                v /= np.abs(v).max(axis=1, keepdims=True)
                v = np.ascontiguousarray((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32))
                at = np.arange(len(v) + 1, dtype=np.int32) * (4 * d)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(at), pa.py_buffer(v)])], names=["row", "id", "vector"])

    # a number per row; written, so that it is the same whenever it is read
    keyed = usable.where(F.size("e") == d).select(F.monotonically_increasing_id().alias("row"), "id", "e")
    rows = materialize(keyed.mapInArrow(unit, "row long, id long, vector binary"), "vectors")
    wanted, s = min(k, n - 1), substring_bits(n, bucket_rows)
    if not wanted:
        return spark.createDataFrame([], "vec_id long, neighbour_id long, similarity float, rank int")
    most = max(first, ((1 << s) - 1) // (s + 1))
    mean = (sums_by_task(rows, lambda x: x.sum(axis=0, dtype=np.float64), (d,)) / n).astype(np.float32)
    rotations = learn_rotations(rows, mean, 0, ceil(first * s / d))
    asked = rows.withColumn("need", F.lit(float(first)))
    early = materialize(_merged(_round(asked, mean, rotations, s, 0, first, k, n, task_rows), k, n * first), "neighbours-first")

    # the k-th similarity so far bounds the angle of what is still to be found
    kth = -F.element_at("best", -1)["s"].cast("double")
    needs = early.where(F.size("best") >= wanted).select("row", substrings_needed(kth, s, miss).alias("need"))
    asked = materialize(rows.join(needs, "row", "left").na.fill({"need": float("inf")}), "queries")
    far = F.col("need") > most
    figures = asked.agg(F.max(F.when(~far, F.col("need"))).alias("last"), F.count(F.when(far, 1)).alias("far")).first()
    last = max(first, int(figures.last or 0))
    if report is not None:
        report.update(rows=n, bits=s, substrings=last, all=figures.far)
    parts = [early]
    if last > first:
        have = len(rotations)
        rotations = np.concatenate([rotations, learn_rotations(rows, mean, have, ceil(last * s / d) - have)]) if last * s > have * d else rotations
        ready = asked.withColumn("need", F.when(far, 0.0).otherwise(F.col("need")))
        parts.append(_round(ready, mean, rotations, s, first, last, k, n, task_rows))
    if figures.far:
        parts.append(_against_all(rows, asked.where(far), k, n, figures.far, task_rows))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    out = rows.select("row", F.col("id").alias("vec_id")).join(_merged(found, k, n * last), "row").select("vec_id", F.posexplode("best").alias("at", "b"))
    return out.select("vec_id", F.col("b.id").alias("neighbour_id"), (-F.col("b.s")).alias("similarity"), (F.col("at") + 1).alias("rank"))
