"""Quality filter by an interpolated modified Kneser-Ney character n-gram model trained on trusted text.

Characters are mapped to 1023 symbols (ASCII letters and marks as they are, digits as one, other characters by
hash), and an n-gram is one integer of 10 bits a symbol. One pass over the corpus gives each file's distinct n-grams,
another the counts of the trusted documents; they are summed by n-gram over the shards of a shuffle. Continuation
counts, context totals and the three discounts per order (Chen and Goodman, 1999) follow by aggregation, and the
interpolated probability of every n-gram that the corpus has by joining the sharded counts order by order, from single
symbols up. Unseen n-grams are resolved the same way, by their contexts' back-off mass.

The costs go back to where they are needed: by sharded joins each file's distinct n-grams get theirs, which are written
to the shared folder, a table for each file. The scoring pass reads the texts where they are and, for each file, that
file's table only. So no text is shuffled, nothing is broadcast or sent to the driver, a task holds the n-grams of
one file, and there is one plan for every size of corpus. Texts that come from no file (as in tests) count as one file.

Trusted documents are halved by a hash of their id, and a model is trained on each half; every document is scored
by the model of the half that it doesn't belong to. So trusted documents' perplexities are those of unseen text, and
a limit drawn from them holds for new documents however small the corpus is. A document is kept if its perplexity is
at most the ``quantile`` of its language's trusted documents times ``slack``. All trusted documents are counted:
nothing is sampled.

Defined results: a null or empty text has a null perplexity and is rejected. A null language is a language of its
own; a language without trusted documents takes the limit of all trusted documents; without any trusted document
nothing is judged, and all rows with text are kept. If one half has no trusted text, both models are that of the other. A document is trusted if any label row of its id has quality 1
and toxic 0 (a null toxic is not 0); null ids are never trusted. Repeated rows are judged (and counted) each. Other columns are ignored, whatever their
names; ``drop_low_quality`` keeps them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import tokens
from plumbline.llm.common import broadcast_if_small, fresh, map_text, materialize, scratch_path
from plumbline.plans.aggplan import quantiles_of_counts

ORDER, QUANTILE, SLACK = 5, 0.98, 1.15
SYMBOLS, WIDTH = 1024, 10

_MAP = 128 + (np.arange(1 << 16, dtype=np.int64) * 2654435761 >> 7) % 895
_MAP[:32] = 1
_MAP[ord("\n")] = 2
_MAP[32:128] = np.arange(32, 128)
_MAP[ord("0") : ord("9") + 1] = 3


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols on end, and offsets (n + 1)."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _MAP[np.where(points < 1 << 16, points, points & 0xFFFF | 0x8000)], offsets


def ngrams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """One n-gram code per character (the text's first ones begin with 0, a text's start), and offsets."""
    sym, offsets = symbols(texts)
    code = sym.copy()
    position = np.arange(len(sym)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order):
        past = np.zeros_like(sym)
        past[k:] = sym[:-k]
        past[position < k] = 0
        code |= past << (WIDTH * k)
    return code, offsets


#: Texts are cut into n-grams in groups of about this many bytes; each byte takes some 60 while it is.
GROUP_BYTES = 1 << 18


def _chunks(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of whole texts of about ``limit`` bytes, a null as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets = tokens.texts_of(column)
    for i, j in tokens.groups(offsets, limit):
        yield i, j, column.slice(i, j - i).to_pylist()


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Keys and counts of several parts, each key once."""
    keys = np.concatenate([p[0] for p in parts])
    if len(parts[0]) == 1:
        # parts are sorted, and a stable sort merges such runs
        keys.sort(kind="stable")
        return (keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys,)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    sums = [np.concatenate([p[c] for p in parts])[order] for c in range(1, len(parts[0]))]
    return keys[at], *(np.add.reduceat(x, at) if len(at) else x for x in sums)


def _flush(parts: dict[str, list], names: list[str]) -> Iterator[pa.RecordBatch]:
    """What was gathered for each file, as batches."""
    for block, own in parts.items():
        columns = _merge(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), int(block))), *map(pa.array, columns)], names=names)
    parts.clear()


#: Distinct n-grams that a worker gathers before it passes them on.
HELD = 700_000
#: N-grams of single groups that are merged at least at once; else as many as have been merged.
MERGED = HELD // 4


def _distinct_batches(order: int):
    """Each file's distinct n-grams, as far as one task has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        merged = new = 0
        for batch in batches:
            blocks = batch.column(1).to_numpy()
            for i, j, texts in _chunks(batch.column(0)):
                code, offsets = ngrams(texts, order)
                for block in np.unique(blocks[i:j]).tolist():
                    own = code if (blocks[i:j] == block).all() else code[np.repeat(blocks[i:j] == block, np.diff(offsets))]
                    parts.setdefault(block, []).append((np.unique(own),))
                    new += len(parts[block][-1][0])
                if new > max(merged, MERGED):
                    for block, own in parts.items():
                        parts[block] = [_merge(own)]
                    merged, new = sum(len(own[0][0]) for own in parts.values()), 0
                    if merged > HELD:
                        yield from _flush(parts, ["block", "g"])
                        merged = 0
        yield from _flush(parts, ["block", "g"])

    return run


def _count_batches(order: int):
    """Per task the n-grams of trusted texts with their counts in either half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # n-grams with the half as their last bit, and counts
        parts: list[tuple[np.ndarray, ...]] = []
        merged = new = 0

        def made() -> pa.RecordBatch:
            marked, n = _merge(parts)
            parts.clear()
            g, first = np.unique(marked >> 1, return_index=True)
            out = [np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)]
            place = np.repeat(np.arange(len(g)), np.diff(np.append(first, len(marked))))
            for half in (0, 1):
                own = marked & 1 == half
                out[half][place[own]] = n[own]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (g, *out)], names=["g", "c0", "c1"])

        for batch in batches:
            halves = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, texts in _chunks(batch.column(0)):
                code, offsets = ngrams(texts, order)
                marked = code << 1 | np.repeat(halves[i:j], np.diff(offsets))
                parts.append(np.unique(marked, return_counts=True))
                new += len(parts[-1][0])
                if new > max(merged, MERGED):
                    parts[:] = [_merge(parts)]
                    merged, new = len(parts[0][0]), 0
                    if merged > HELD:
                        yield made()
                        merged = 0
        if parts:
            yield made()

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen once to four times; where these are degenerate, 0.5, 1 and 1.5."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))  # type: ignore[return-value]


def probabilities(counts: DataFrame, order: int, models: int = 1) -> DataFrame:
    """The interpolated probabilities ``p0``, ... of each n-gram ``g`` of ``counts`` (``g``, and ``c0``, ... in each model's trusted text, 0 allowed)."""
    each = range(models)
    # sharded counts: raw for the full order, numbers of distinct left neighbours below it
    tables = {order: counts}
    for n in range(order - 1, 0, -1):
        cut = F.col("g").bitwiseAND((1 << WIDTH * n) - 1)
        tables[n] = materialize(tables[n + 1].groupBy(cut.alias("g")).agg(*[F.count(F.when(F.col(f"c{m}") > 0, 1)).alias(f"c{m}") for m in each]), f"continuations{n}")
    lower = None
    for n in range(1, order + 1):
        table = tables[n]
        of = table.agg(*[F.count(F.when(F.col(f"c{m}") == k, 1)) for m in each for k in (1, 2, 3, 4)]).first()
        off = {}
        for m in each:
            d1, d2, d3 = discounts(*of[4 * m : 4 * m + 4])
            c = F.col(f"c{m}")
            off[m] = F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        context = F.shiftright("g", WIDTH)
        totals = table.groupBy(context.alias("ctx")).agg(*[x for m in each for x in (F.sum(f"c{m}").alias(f"total{m}"), F.sum(off[m]).alias(f"back{m}"))])
        own = [(F.col(f"c{m}") - off[m]).alias(f"own{m}") for m in each]
        rows = table.select("g", context.alias("ctx"), F.col("g").bitwiseAND((1 << WIDTH * (n - 1)) - 1).alias("suffix"), *own).join(totals, "ctx")
        if lower is None:
            rows = rows.select("*", *[F.lit(1.0 / SYMBOLS).alias(f"q{m}") for m in each])
        else:
            rows = rows.join(lower.select(F.col("g").alias("suffix"), *[F.col(f"p{m}").alias(f"q{m}") for m in each]), "suffix")
        p = [F.when(F.col(f"total{m}") == 0, F.col(f"q{m}")).otherwise((F.col(f"own{m}") + F.col(f"back{m}") * F.col(f"q{m}")) / F.col(f"total{m}")).alias(f"p{m}") for m in each]
        lower = materialize(rows.select("g", *p), f"p{n}")
    return lower


def _score_batches(order: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        loaded, table, costs = None, None, None
        for batch in batches:
            blocks, halves = batch.column(5).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, texts in _chunks(batch.column(6)):
                code, offsets = ngrams(texts, order)
                n = np.diff(offsets)
                of, half = np.repeat(blocks[i:j], n), np.repeat(halves[i:j], n)
                cost = np.zeros(len(code), dtype=np.float64)
                for block in np.unique(of).tolist():
                    if block != loaded:
                        table = costs = None  # before the next ones are read
                        own = ds.dataset(f"{path}/block={block}", format="parquet", filesystem=system).to_table(columns=["g", "cost0", "cost1"], use_threads=False)
                        # several tasks may have met an n-gram of one file
                        keys, first = np.unique(own["g"].to_numpy(), return_index=True)
                        table = tokens.HashTable()
                        table.add(keys.view(np.uint64), np.arange(len(keys)))
                        costs, loaded = np.stack([own[c].to_numpy()[first] for c in ("cost0", "cost1")], axis=1).ravel(), block
                        del own, keys, first
                    at = of == block
                    cost[at] = costs[table.get(code[at].view(np.uint64)) * 2 + half[at]]
                sums = np.concatenate(([0.0], np.cumsum(cost)))
                total = sums[offsets[1:]] - sums[offsets[:-1]]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(5)), pa.array(total), pa.array(n)], names=["row", "row2", "doc_id", "lang", "half", "cost", "n_chars"])

    return run


def _row(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes that tell a row from others by id, language and text."""
    own = [docs[c] for c in ("doc_id", "lang", "text")]
    nulls = F.concat(*[c.isNull().cast("string") for c in own])
    return F.xxhash64(F.lit("row"), nulls, *own), F.xxhash64(F.lit("row again"), nulls, *own)


def score(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """Per document row: ``row`` and ``row2`` (its key), ``doc_id``, ``lang``, ``trusted``, ``half``, ``n_chars`` and ``perplexity`` per character, materialized."""
    ids = materialize(labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct(), "trusted")
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id").cast("long")), F.lit(2)).cast("int")
    # a file's texts share a table, however the file is split among tasks
    block = F.xxhash64(F.input_file_name())
    text = F.col("text")
    wanted = materialize(map_text(docs.select(text, block.alias("block")), _distinct_batches(order), "block long, g long"), "wanted")
    trusted = docs.select(text, half.alias("half"), F.col("doc_id").cast("long").alias("id")).join(broadcast_if_small(ids, 16), F.col("id") == F.col("trusted_id")).select("text", "half")
    counted = map_text(trusted, _count_batches(order), "g long, c0 long, c1 long")
    counts = materialize(
        counted.unionByName(wanted.select("g", F.lit(0).cast("long").alias("c0"), F.lit(0).cast("long").alias("c1"))).groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "ngrams"
    )
    some = counts.agg(F.sum("c0"), F.sum("c1")).first()
    # what scores a half is trained on the other one
    if some[0] and some[1]:
        models = counts.select("g", F.col("c1").alias("c0"), F.col("c0").alias("c1"))
    else:
        models = counts.select("g", (F.col("c0") + F.col("c1")).alias("c0"))
    two = bool(some[0] and some[1])
    p = probabilities(models, order, 1 + two)
    cost = p.select("g", (-F.log("p0")).cast("float").alias("cost0"), (-F.log("p1" if two else "p0")).cast("float").alias("cost1"))
    folder = scratch_path(docs.sparkSession, "costs")
    wanted.join(cost, "g").repartition("block").sortWithinPartitions("block").write.partitionBy("block").parquet(folder)
    key = _row(docs)
    marked = docs.select(key[0].alias("row"), key[1].alias("row2"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), half.alias("half"), block.alias("block"), text)
    scored = map_text(marked, _score_batches(order, folder), "row long, row2 long, doc_id long, lang string, half int, cost double, n_chars long")
    perplexity = F.when(F.col("n_chars") > 0, F.exp(F.col("cost") / F.col("n_chars"))).alias("perplexity")
    scored = materialize(scored.select("row", "row2", "doc_id", "lang", "half", "n_chars", perplexity), "perplexities")
    return materialize(scored.join(broadcast_if_small(ids, 16), F.col("doc_id") == F.col("trusted_id"), "left").select("row", "row2", "doc_id", "lang", F.col("trusted_id").isNotNull().alias("trusted"), "half", "n_chars", "perplexity"), "scores")


def judge(scores: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """``scores`` with the ``threshold`` of the row's language, and ``keep``."""
    # exact quantiles by bucketed ranks: of each language, and of all
    named = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null"))
    trusted = scores.where("trusted AND perplexity IS NOT NULL")
    counts = trusted.select(F.explode(F.array(named, F.lit("all"))).alias("column"), F.col("perplexity").alias("number")).groupBy("column", "number").agg(F.count("*").alias("n"))
    limits = {r["column"]: r["value"] * slack for r in quantiles_of_counts(materialize(counts, "perplexity-counts"), [quantile]).collect()}
    table = scores.sparkSession.createDataFrame(sorted(limits.items()) or [("", 0.0)], "limit_of string, limit double")
    overall = F.lit(limits.get("all")).cast("double")
    out = scores.join(F.broadcast(table), named == F.col("limit_of"), "left").withColumn("threshold", F.coalesce("limit", overall)).drop("limit_of", "limit")
    return out.withColumn("keep", F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))))


def quality_kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass: ``doc_id``, ``lang``, ``n_chars``, ``perplexity``, ``threshold``."""
    return judge(score(docs, labels, **options)).where("keep").select("doc_id", "lang", "n_chars", "perplexity", "threshold")


def drop_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that the model rejects."""
    a, b = fresh(docs.columns, "_row", "_row2")
    rejected = materialize(judge(score(docs, labels, **options)).where("NOT keep").select(F.col("row").alias(a), F.col("row2").alias(b)).distinct(), "rejected")
    key = _row(docs)
    return docs.join(broadcast_if_small(rejected, 24), (key[0] == rejected[a]) & (key[1] == rejected[b]), "left_anti")
