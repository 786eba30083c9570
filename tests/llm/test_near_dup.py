"""Near-duplicates against exact Jaccard similarities and union-find."""

import random
import re

import numpy as np

from plumbline.llm import near_dup as N


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0, 1, 2) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, sig int, node int")


def groups(spark, rows):
    out = {}
    for r in N.near_duplicates(documents(spark, rows)).collect():
        out.setdefault(r.group_id, set()).add(r.doc_id)
    return out


def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))}


def test_planted_copies_and_clean_documents(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(800)]
    rows, owner = [], {}
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        for k in range(rng.choice([1, 1, 2, 4])):
            copy = list(base)
            for _ in range(k and max(1, len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            owner[len(rows)] = g
            rows.append((len(rows), " ".join(copy).upper() if k == 3 else " ".join(copy)))
    got = groups(spark, rows)
    want = {}
    for d, g in owner.items():
        want.setdefault(g, set()).add(d)
    want = {min(v): v for v in want.values() if len(v) > 1}
    assert got == want


def test_hard_cases(spark):
    same = "the very same text stands here, twice and more"
    rows = [(1, same), (2, same.upper()), (2, same.upper()), (None, same), (3, None), (4, ""), (5, "$$$ ###"), (6, "$$$ ###"), (7, "!!!"), (8, "word"), (9, "word"), (10, "w " * 200_000), (11, "  ")]
    assert groups(spark, rows) == {1: {1, 2}, 5: {5, 6}, 8: {8, 9}}


def test_many_copies_are_one_group(spark):
    assert groups(spark, [(i, "a text of some words that many documents share as a whole") for i in range(3000)]) == {0: set(range(3000))}


def test_empty_table(spark):
    assert N.near_duplicates(documents(spark, [])).count() == 0


def test_dropping_keeps_the_smallest_and_the_columns(spark):
    docs = documents(spark, [(5, "one two three four"), (2, "one two three four"), (None, "one two three four"), (9, "other words are here")])
    out = N.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 2), (False, 9), (True, 0)]


def test_sketch_estimates_jaccard():
    import pyarrow as pa

    from plumbline.llm import tokens

    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(400)]
    for edits in (0, 10, 25):
        other = list(base)
        for i in rng.sample(range(400), edits):
            other[i] = "new" + str(i)
        a, b = " ".join(base), " ".join(other)
        data, offsets = tokens.texts_of(pa.array([a, b]))
        _, sketch, _ = N.signatures(data, offsets, N.BANDS, N.ROWS, N.SHINGLE, N.BITS)
        true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        got = N.estimate(np.bitwise_count(sketch[0] ^ sketch[1]).sum(), N.BITS, N.BANDS * N.ROWS)
        assert abs(got - true) < 0.12


def test_forest_equals_components_of_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, (6, 8)).astype(np.uint64)
    rows = np.concatenate([base, base ^ np.uint64(1), base[:3] ^ np.uint64(3)])
    edges = N.forest(np.arange(len(rows)), rows, 9)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert root(a) != root(b)
        parent[root(a)] = root(b)
    for a in range(len(rows)):
        for b in range(a):
            near = np.bitwise_count(rows[a] ^ rows[b]).sum() <= 9
            assert not near or root(a) == root(b)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.root for r in N.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_crowded_bands_give_the_same_groups(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefghijklmnop") * 3 + str(rng.randint(0, 99)) for _ in range(80)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"x{rng.randint(0, 999)}" for w in base)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    want = sorted(tuple(r) for r in N.near_duplicates(docs).collect())
    assert len(want) >= 50 and sorted(tuple(r) for r in N.near_duplicates(docs, crowd=4, look=1).collect()) == want
