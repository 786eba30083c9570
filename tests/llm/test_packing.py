"""Packing against a list-based packer, and its invariants."""

import random
from collections import Counter

from plumbline.llm import packing as P
from plumbline.llm.bpe import encoder


def brute(sizes, length, limit):
    """Best-fit with a bounded number of open bins, by scanning lists."""
    opened, closed = [], []
    for k, size in enumerate(sizes):
        fits = [b for b in opened if length - sum(b[1]) >= size]
        if fits:
            best = min(fits, key=lambda b: (length - sum(b[1]), -b[2]))
        else:
            if len(opened) >= limit:
                full = max(opened, key=lambda b: (sum(b[1]), b[2]))
                opened.remove(full)
                closed.append(full[0])
            best = [[], [], 0]
            opened.append(best)
        best[0].append(k)
        best[1].append(size)
        best[2] = k
        if sum(best[1]) == length:
            opened.remove(best)
            closed.append(best[0])
    return sorted(closed + [b[0] for b in opened])


def test_packer_against_brute_force():
    rng = random.Random(4)
    for length, limit in ((10, 3), (64, 5), (100, 1)):
        sizes = [rng.randint(1, length) for _ in range(400)]
        packer, bins = P.Packer(length, limit), []
        for k, size in enumerate(sizes):
            bins += packer.add(k, size)
            assert packer.open <= limit
        assert sorted(bins + packer.flush()) == brute(sizes, length, limit)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "b", 2, "c") for d, t in rows], "doc_id long, text string, stream int, bin string, key int, ids string")


def test_every_token_is_in_one_bin(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "x1"]) for _ in range(rng.randint(0, 120)))) for i in range(300)]
    rows += [(None, "no id here"), (5, None), (6, ""), (7, "long " * 9000), (8, "same text"), (8, "same text")]
    own = encoder().encoding
    want = Counter()
    for d, t in rows:
        want[d] += len(own.encode_ordinary(t or ""))
    bins = P.pack(frame(spark, rows), 128, 8, 3).collect()
    got, spans = Counter(), {}
    texts = {}
    for b in bins:
        assert b.n_tokens == sum(b.lengths) == sum(b.mask) <= 128 == len(b.input_ids) and b.mask == sorted(b.mask, reverse=True)
        at = 0
        for d, key, s, n in zip(b.doc_ids, b["keys"], b.starts, b.lengths):
            got[d] += n
            spans.setdefault(d, []).append((s, n))
            texts.setdefault((d, key), []).append((s, b.input_ids[at : at + n]))
            at += n
    # every text comes back from its pieces
    back = Counter()
    for (d, _), pieces in texts.items():
        ids = {}
        for s, part in pieces:
            ids.setdefault(s, []).append(part)
        copies = len(ids[0])
        back[d, own.decode([x for s in sorted(ids) for x in ids[s][0]])] += copies
    assert back == Counter((d, t) for d, t in rows if t)
    assert {d: n for d, n in want.items() if n} == dict(got)
    long = sorted(spans[7])
    assert [s for s, _ in long] == list(range(0, got[7] - want[7] + sum(n for _, n in long), 128))[: len(long)] or len(long) > 1
    assert len({(b.stream, b.bin) for b in bins}) == len(bins)


def test_result_does_not_depend_on_partitions(spark):
    rows = [(i, "word " * (i % 50 + 1)) for i in range(200)]
    pack = lambda df: sorted((r.stream, r.bin, r.doc_ids, r.input_ids) for r in P.pack(df, 64, 4, 2).collect())
    assert pack(frame(spark, rows).repartition(1)) == pack(frame(spark, rows[::-1]).repartition(7))


def test_empty_table(spark):
    assert P.pack(frame(spark, [])).count() == 0


def test_documents_of_one_long_text(spark):
    bins = P.pack(frame(spark, [(1, "alpha beta " * 60_000)]), 256, 4).collect()
    assert sum(b.n_tokens for b in bins) == 120_001 and sorted(b.starts[0] for b in bins) == list(range(0, 120_001, 256))
