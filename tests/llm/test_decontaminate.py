"""Decontamination against comparing every window."""

import random
import re

from plumbline.llm import decontaminate as D


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, "en", 3, "k") for d, t in docs], "doc_id long, text string, lang string, item_id int, key string"),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"),
    )


def found(spark, docs, items):
    return sorted(((r.doc_id, r.item_id) for r in D.contaminated(*tables(spark, docs, items)).collect()), key=str)


def brute(docs, items):
    """Pairs with an ungapped alignment whose best stretch passes."""
    import numpy as np

    out = set()
    for d, t in docs:
        w = np.array([hash(x) for x in re.findall(r"\w+", (t or "").lower())])
        for i, b in items:
            v = np.array([hash(x) for x in re.findall(r"\w+", (b or "").lower())])
            least = min(D.MIN_WORDS, len(v))
            for diagonal in range(-len(v) + 1, len(w)):
                low, high = max(0, diagonal), min(len(w), diagonal + len(v))
                same = (w[low:high] == v[low - diagonal : high - diagonal]).tolist()
                if sum(same) >= 6 and any(sum(same[x:y]) >= D.MIN_SHARE * (y - x) for x in range(len(same)) for y in range(x + least, len(same) + 1)):
                    out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(14, 40)))) for i in range(20)]
    docs = [(i, " ".join(text(80))) for i in range(20)]
    for k in range(40):
        own = items[k % 20][1].split()
        for _ in range(k % 4):
            own[rng.randrange(len(own))] = rng.choice(words)
        docs.append((100 + k, " ".join(text(30) + own + text(30)).upper() + "."))
    got, want = set(found(spark, docs, items)), brute(docs, items)
    assert {(d, i) for d, i in want if d < 100} == {(d, i) for d, i in got if d < 100} == set()
    assert got <= want and len(want - got) <= 0.05 * len(want)
    assert {(100 + k, k % 20) for k in range(40) if k % 4 == 0} <= got


def test_hard_cases(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs = [(1, item), (1, item), (None, item), (2, None), (3, ""), (4, "alpha beta"), (5, "pad " * 100_000 + item), (6, item.replace("eta ", "changed ", 1))]
    items = [(10, item), (11, item), (12, None), (13, ""), (14, "too short"), (15, "one two three four five six seven eight nine")]
    docs.append((7, "so one two three four five six seven eight nine it is"))
    got = set(found(spark, docs, items))
    assert {(1, 10), (1, 11), (None, 10), (5, 10), (6, 10), (7, 15)} <= got
    assert not {d for d, _ in got} & {2, 3, 4}


def test_dropping(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs, bench = tables(spark, [(1, f"x {item} y"), (2, "clean text"), (None, item), (3, None)], [(1, item)])
    out = D.drop_contaminated(docs, bench)
    assert out.columns == docs.columns and sorted((r.doc_id or -1) for r in out.collect()) == [-1, 2, 3]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "alpha beta gamma delta epsilon zeta eta theta")]) == []
    assert found(spark, [(1, "alpha beta gamma delta epsilon zeta eta theta")], []) == []


def test_best_stretch_bridges_substitutions():
    import numpy as np

    a = np.arange(30)
    b = a.copy()
    b[[10, 20]] = -1
    assert D.best_stretch(a, b, 0, 12, 0.75) == (0, 30, 28)
    assert D.best_stretch(a, -a - 1, 0, 12, 0.75) is None


def test_masks_miss_no_accepted_stretch():
    """All stretches of 12 to 23 words with as many replaced words as are accepted; longer ones hold one of these."""
    import itertools

    import numpy as np

    for n in range(12, 24):
        replaced = [sum(1 << k for k in c) for c in itertools.combinations(range(n), int(n * (1 - D.MIN_SHARE)))]
        same = (1 << n) - 1 - np.array(replaced, dtype=np.int64)
        hit = np.zeros(len(same), dtype=bool)
        for m in D.MASKS:
            for k in range(n - len(m) + 1):
                hit |= (same >> k) & int(m, 2) == int(m, 2)
        assert hit.all(), n
    for n, m in D.SHORT.items():
        for c in itertools.combinations(range(n), int(n * (1 - D.MIN_SHARE))):
            assert m in "".join("0" if k in c else "1" for k in range(n)), (n, c)


def test_recall_by_length_and_replaced_words(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(9))
    docs, items, want = [], [], set()
    for n in [*range(1, 13), 15, 20, 25, 40]:
        for k in range(10):
            own = [word() for _ in range(n)]
            items.append((len(items), " ".join(own)))
            # first every 4th word, then random ones
            for at in range(3, n, 4) if k == 0 else rng.sample(range(n), n // 4):
                own[at] = word()
            docs.append((items[-1][0], " ".join([word() for _ in range(20)] + own + [word() for _ in range(20)])))
            want.add((docs[-1][0], items[-1][0]))
    assert set(found(spark, docs, items)) == want
