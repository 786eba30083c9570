"""The language model against a direct implementation of the formulas."""

import functools
import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import kneser_ney as K


def brute(trusted, texts, order):
    """Perplexities by dictionaries."""
    sym = lambda t: [0] * (order - 1) + K.symbols([t])[0].tolist()
    grams = lambda t: [tuple(s[i : i + order]) for s in [sym(t)] for i in range(len(s) - order + 1)]
    counts = {order: Counter(g for t in trusted for g in grams(t))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d = {n: K.discounts(*[sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4)]) for n in counts}
    total, back = defaultdict(Counter), defaultdict(Counter)
    for n in counts:
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            back[n][g[:-1]] += d[n][min(c, 3) - 1]

    @functools.cache
    def p(g):
        n = len(g)
        if n == 0:
            return 1 / K.SYMBOLS
        lower = p(g[1:])
        ctx = g[:-1]
        if not total[n][ctx]:
            return lower
        c = counts[n].get(g, 0)
        own = c - d[n][min(c, 3) - 1] if c else 0
        return own / total[n][ctx] + back[n][ctx] / total[n][ctx] * lower

    out = []
    for t in texts:
        g = grams(t or "")
        out.append(math.exp(-sum(math.log(p(x)) for x in g) / len(g)) if g else None)
    return out


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, lang, "s", 0, True, 5, 6, False) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, trusted boolean, _row long, block int, keep boolean")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


GOOD = ["the cat sat on the mat and the dog ran off", "a man and a cat and a hat", "the rain in spain stays mainly in the plain", "then they sat and ate the cake", "one of the men went to the sea"]


@pytest.mark.parametrize("files", [0, 3])
def test_perplexities_against_brute_force(spark, files, tmp_path):
    rows = [(i, t, "en") for i, t in enumerate(GOOD)] + [(10, "the cat ran", "en"), (11, "XQZJ 99 ###", "en"), (12, "", "en"), (13, None, "en"), (14, "Ünïcode 日本 \U0001f600", None), (15, "the mat " * 40_000, "en")]
    docs, labels = tables(spark, rows, [(i, 1, 0) for i in range(5)] + [(11, 0, 0), (None, 1, 0), (0, 1, 1)])
    if files:
        docs.repartition(files, "doc_id").write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    scores = K.score(docs, labels).collect()
    got, half = {r.doc_id: r.perplexity for r in scores}, {r.doc_id: r.half for r in scores}
    assert {half[i] for i in range(5)} == {0, 1}
    for d, t, _ in rows:
        value = brute([GOOD[i] for i in range(5) if half[i] != half[d]], [t], K.ORDER)[0]
        assert (got[d] is None) == (value is None) and (value is None or abs(got[d] - value) < 1e-3 * value)


def test_probabilities_sum_to_one(spark):
    codes, _ = K.ngrams(GOOD, 3)
    keys, n = np.unique(codes, return_counts=True)
    ctx = int(keys[5]) >> K.WIDTH
    every = [(ctx << K.WIDTH) | s for s in range(K.SYMBOLS)]
    seen = dict(zip(keys.tolist(), n.tolist()))
    counts = spark.createDataFrame([(g, seen.get(g, 0)) for g in {*every, *seen}], "g long, c0 long")
    p = {r.g: r.p0 for r in K.probabilities(counts, 3).collect()}
    assert abs(sum(p[g] for g in every) - 1) < 1e-9


def test_junk_goes_and_clean_text_stays(spark):
    import random

    rng = random.Random(1)
    words = [w for t in GOOD for w in t.split()]
    clean = lambda: " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, clean(), "en" if i % 2 else None) for i in range(200)] + [(900 + i, "".join(rng.choice("QX#%&|!@") for _ in range(200)), "en") for i in range(10)] + [(950, "", "en"), (951, None, "xx"), (7, clean(), "en")]
    docs, labels = tables(spark, rows, [(i, 1, 0) for i in range(100)])
    kept = [r.doc_id for r in K.quality_kept(docs, labels).collect()]
    assert not {*range(900, 910), 950, 951} & set(kept) and len({*range(200)} & set(kept)) >= 197
    out = K.drop_low_quality(docs, labels)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(kept)


def test_one_half_without_trusted_text(spark):
    docs, labels = tables(spark, [(i, t, "en") for i, t in enumerate(GOOD)], [(0, 1, 0)])
    want = brute(GOOD[:1], GOOD, K.ORDER)
    assert all(abs(r.perplexity - want[r.doc_id]) < 1e-3 * want[r.doc_id] for r in K.score(docs, labels).collect())


def test_without_trusted_text_nothing_is_judged(spark):
    docs, labels = tables(spark, [(1, "abc", "en"), (2, None, "en")], [])
    assert [r.doc_id for r in K.quality_kept(docs, labels).collect()] == [1]


def test_empty_table(spark):
    docs, labels = tables(spark, [], [])
    assert K.quality_kept(docs, labels).count() == 0


def test_toxic_text_is_never_trusted(spark):
    docs, labels = tables(spark, [(i, t, "en") for i, t in enumerate(GOOD)], [(0, 1, 0), (1, 1, 1), (2, 1, None)])
    assert {r.doc_id for r in K.score(docs, labels).where("trusted").collect()} == {0}
    want = brute(GOOD[:1], GOOD, K.ORDER)
    assert all(abs(r.perplexity - want[r.doc_id]) < 1e-3 * want[r.doc_id] for r in K.score(docs, labels).collect())


@pytest.mark.parametrize("made", [K._distinct_batches, K._count_batches])
def test_memory_of_a_batch(made):
    """Wide batches are cut into n-grams by small groups: a worker's memory doesn't follow the batch."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefgh "), 40_000)) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(np.arange(100, dtype=np.int64) % 2)], names=["text", "of"])
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in made(5)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > 50_000
    assert peak < 50 << 20, peak


def test_counts_of_both_halves():
    texts, halves = ["abab", "ba", "", "abab"], [0, 1, 1, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(halves, pa.int32())], names=["text", "half"])
    wanted: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for text, half in zip(texts, halves):
        for g in K.ngrams([text], 3)[0].tolist():
            wanted[g][half] += 1
    got = pa.Table.from_batches(list(K._count_batches(3)(iter([batch])))).to_pylist()
    assert {r["g"]: [r["c0"], r["c1"]] for r in got} == wanted and len(got) == len(wanted)
