"""Hard negatives against plain loops over exact integers."""

import math
import random

import numpy as np
import pytest

from cuboid.llm.negatives import Mining, hard_negatives, window


def plain(rows, need=Mining(), every=50):
    """rows: (vec_id, label, vector). The contract, one anchor after another."""
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i not in best or (label, v) < best[i]:
            best[i] = (label, v)
    whole = {i: (label, [math.floor(need.scale * x) for x in v]) for i, (label, v) in best.items()}
    whole = {i: r for i, r in whole.items() if sum(x * x for x in r[1]) <= 1 << 62}
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in whole.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][0] == label][: need.positives]:
            fit = [i for i in order if whole[i][0] != label and need.low * score[p] <= 100 * score[i] <= need.high * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[: need.negatives])]
    return sorted(out)


def mined(spark, rows, need=Mining(), kind="float", every=50):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")
    return sorted(map(tuple, hard_negatives(df, f"vec_id % {every} = 0", need).collect()))


@pytest.mark.parametrize("shape", ["normal", "clusters", "lengths"])
def test_against_loops(spark, shape):
    r = np.random.default_rng(7)
    n, dim = 1500, 12
    x = r.normal(size=(n, dim))
    if shape == "clusters":
        x = r.normal(size=(20, dim))[r.integers(0, 20, n)] + 0.05 * x
    if shape == "lengths":
        x *= r.choice([0.01, 1, 30], (n, 1))
    rows = [(i * 5, int(r.integers(0, 4)), [float(np.float32(v)) for v in x[i]]) for i in range(n)]
    need = Mining(branches=5, sample=64, piece=200, fan=4, leaf=16)
    assert mined(spark, rows, need) == plain(rows, need)


def test_ties_copies_and_a_hot_vector(spark):
    """A third of all rows are one vector: scores tie, and the hot subtree is cut into pieces."""
    r = random.Random(3)
    rows = [(i, r.randrange(3), [1.0, 0.5, 0.0] if i % 3 else [r.choice([0.25, 0.5, 1.0]), r.choice([0.0, 0.5]), r.choice([0.0, 0.75])]) for i in range(900)]
    need = Mining(branches=4, sample=32, piece=50, fan=3, leaf=8)
    assert mined(spark, rows + rows[100:200], need, every=10) == plain(rows, need, 10)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (0, 2, [9.0, 9.0]), (1, 1, [1.0, 1.5, 0.25]), (2, 1, []), (3, 2, [1.0]), (4, 2, [0.5, 1.0]), (5, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]),
        (6, 1, None), (7, 1, [1.0, None]), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]), (10, 2, [-1.0, -2.0]), (50, 2, [-1.0, 0.0]), (100, 7, [1.0, 1.0]), (150, 2, [1e30, 0.0]), (11, 2, [1.5, 0.1, 0.0]),
    ]
    got = mined(spark, rows, kind="double")
    assert got == plain(rows) and got
    assert {r[0] for r in got} <= {0, 50}  # a label of its own has no positives; too long a vector takes no part


def test_large_products(spark):
    """Products beyond what doubles hold."""
    r = random.Random(5)
    rows = [(i, r.randrange(2), [r.uniform(-1, 1) * 2**21 + r.random(), r.uniform(0, 1) * 2**21]) for i in range(150)]
    need = Mining(scale=1 << 7, branches=3, sample=16, piece=40, fan=2, leaf=8)
    assert mined(spark, rows, need, "double", 5) == plain(rows, need, 5)


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives(none).count() == 0
    df = spark.createDataFrame([(0, 1, [1.0], 5, "x"), (1, 1, [1.0], 5, "x"), (2, 2, [0.75], 5, "x")], "vec_id long, label int, embedding array<float>, rank int, node string")
    assert [tuple(r) for r in hard_negatives(df).collect()] == [(0, 1, 1, 2, 65536, 49152)]


def test_windows_are_exact():
    s = np.array([-(1 << 61), -7, -1, 0, 1, 2, 99, 101, (1 << 61) + 13])
    low, high = window(s, 50, 95)
    for x, a, b in zip(s.tolist(), low.tolist(), high.tolist()):
        assert (a, b) == (-((-50 * x) // 100), 95 * x // 100)
