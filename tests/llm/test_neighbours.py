"""Nearest neighbours against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import neighbours as N


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, b"y") for i, v in rows], "vec_id long, embedding array<float>, label int, row string, need int, vector binary")


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    d, s, n = 16, 4, 300
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[100:200] = x[:100] + 0.2 * rng.standard_normal((100, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, rotations = np.zeros(d, np.float32), np.stack([N.first_rotation(d, k) for k in range(2)])
    for count in (1, 2, 4, 8):
        values = np.stack([N.substring_values(x, mean, rotations, s, t) for t in range(count)])
        apart = np.bitwise_count(values[:, :, None] ^ values[:, None, :]).sum(axis=0)
        want = {(i, j) for i, j in zip(*np.nonzero(apart <= 2 * count - 1)) if i != j}
        got = set()
        for t in range(count):
            task = pa.table({"role": pa.array([3] * n), "own": pa.array([True] * n), "bucket": pa.array(values[t]), "row": pa.array(np.arange(n)), "id": pa.array(np.arange(n)), "vector": pa.array([v.tobytes() for v in x])})
            for r in N.meet(s, n)(task).to_pylist():
                got |= {(r["row"], b["row"]) for b in r["best"]}
        assert want <= got and len(want) > 100


def recall(spark, x, k=10, **options):
    got = {}
    for r in N.nearest(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), k, **options).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = r.neighbour_id
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    k = min(k, len(x) - 1)
    best = np.argsort(-sims, axis=1)[:, :k]
    assert all(sorted(got[i]) == list(range(1, k + 1)) for i in range(len(x)))
    each = [len(set(got[i].values()) & set(best[i])) / k for i in range(len(x))]
    return np.array(each)


def test_recall_on_random_and_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    flat = rng.standard_normal((1500, 24)).astype(np.float32)
    report = {}
    assert recall(spark, flat, report=report).mean() >= 0.95
    # the index does the work: rows that are compared with all others would not count as probing
    assert report["rows"] == 1500 and report["all"] <= 30
    # a dense bulk, and a sparse minority whose neighbours are far
    skewed = np.concatenate([rng.standard_normal(24) + 0.05 * rng.standard_normal((1200, 24)), 3 * rng.standard_normal((200, 24))]).astype(np.float32)
    each = recall(spark, skewed)
    assert each.mean() >= 0.9 and each[1200:].mean() >= 0.9


def test_crowded_parts_are_cut_into_pieces(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((1, 16)) + 0.1 * rng.standard_normal((500, 16)), rng.standard_normal((300, 16))]).astype(np.float32)
    assert recall(spark, x, task_rows=90).mean() >= 0.9


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)] + [(100, [-1.0, 2.0, 0.5])]
    for r in N.nearest(frame(spark, rows), 3).collect():
        assert r.neighbour_id == [j for j in range(60) if j != r.vec_id][r["rank"] - 1]


def test_hard_cases(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v), (2, v), (2, v), (3, [4.0, 3.0, 2.0, 1.0]), (None, v), (4, None), (5, [0.0] * 4), (6, [1.0, float("nan"), 0.0, 0.0]), (7, [1.0]), (8, [1.0, None, 2.0, 2.0])]
    got = N.nearest(frame(spark, rows), 2).collect()
    assert {r.vec_id for r in got} == {1, 2, 3}
    assert sorted(r.neighbour_id for r in got if r.vec_id == 1) == [2, 2]
    assert [r.neighbour_id for r in sorted((r for r in got if r.vec_id == 3), key=lambda r: r["rank"])] == [1, 2]
    assert len([r for r in got if r.vec_id == 2]) == 4


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_and_no_rows(spark, n):
    assert N.nearest(frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])][:n])).count() == {0: 0, 1: 0, 2: 2}[n]


def test_need_follows_the_angle(spark):
    row = spark.range(1).select(*[N.substrings_needed(N.F.lit(c), 9, 0.08).alias(f"c{k}") for k, c in enumerate((1.0, 0.9, 0.4, -1.0))]).first()
    assert row.c0 == 1 and row.c0 <= row.c1 < row.c2 < row.c3
    assert row.c2 == np.ceil(np.log(0.08) / np.log(1 - N.chance(0.4, 9)))
