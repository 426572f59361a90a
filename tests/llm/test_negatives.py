"""Hard negatives against all pairs in plain Python, and the bounds they are sifted with."""

import math
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives as hn

ROWS = "vec_id long, embedding array<double>, label int, place long, score string"


def brute(rows, every, positives=5, count=5, percent=80):
    live = []
    for key, vec, label, *_ in rows:
        if key is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        live.append((key, [math.floor(256 * x) for x in vec], label))
    out = []
    for key, vec, label in live:
        if key % every:
            continue
        scored = [
            (sum(a * b for a, b in zip(vec, v, strict=True)), k, lab) for k, v, lab in live if k != key and len(v) == len(vec)
        ]
        same = sorted(((-s, k) for s, k, lab in scored if lab == label))[:positives]
        for s, k in same:
            others = sorted((-t, o) for t, o, lab in scored if lab != label and 80 * -s <= 100 * t <= 100 * -s)
            out += [(key, k, n + 1, o, -s, -t) for n, (t, o) in enumerate(others[:count])]
    return sorted(out)


def table(rng, n, dim, labels, spread=0.3):
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        vec = centres[rng.integers(6)] + spread * rng.normal(size=dim)
        vec /= np.linalg.norm(vec)
        rows.append((i, vec.tolist(), int(rng.integers(labels)), 1, "clash"))
    return rows


def mined(spark, rows, every, **sizes):
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = hn.hard_negatives(df, F.col("vec_id") % every == 0, **sizes)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[k] for k in names) for r in got.collect())


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 70, "wave_rows": 9}])
def test_against_all_pairs(spark, sizes):
    rows = table(np.random.default_rng(3), 400, 24, 3)
    assert mined(spark, rows, 10, **sizes) == brute(rows, 10)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = table(rng, 120, 8, 2)
    same = rows[5][1]
    rows += [(200 + i, same, i % 2, 0, "") for i in range(60)]  # ties
    rows += [(10, rows[11][1], 1, 0, ""), (10, rows[12][1], 0, 0, "")]  # an anchor's id once more
    rows += [
        (None, same, 1, 0, ""), (310, None, 1, 0, ""), (320, same, None, 0, ""), (330, [None] * 8, 1, 0, ""),
        (340, [float("nan")] * 8, 1, 0, ""), (350, [float("inf")] * 8, 1, 0, ""), (360, [0.0] * 8, 1, 0, ""),
        (370, [1.0, 2.0], 1, 0, ""), (371, [1.0, 2.0], 0, 0, ""), (372, [1.0, 2.0], 1, 0, ""), (380, [], 1, 0, ""), (381, [], 0, 0, ""),
        (382, [], 1, 0, ""),
    ]
    got = mined(spark, rows, 10, block_rows=50, wave_rows=7)
    assert got == brute(rows, 10)
    assert (380, 382, 1, 381, 0, 0) in got


def test_negative_scores_and_few_rows(spark):
    rows = [(0, [1.0, 0.0], 0, 0, ""), (1, [-1.0, 0.0], 0, 0, ""), (2, [-0.9, 0.1], 1, 0, ""), (3, [0.0, 1.0], 1, 0, "")]
    assert mined(spark, rows, 2) == brute(rows, 2)
    assert mined(spark, rows[:1], 2) == [] and mined(spark, [], 2) == []


def test_too_long_vectors_are_an_error(spark):
    with pytest.raises(Exception, match="too long for exact scores"):
        mined(spark, [(0, [1e6], 0, 0, ""), (1, [1e6], 0, 0, "")], 2)


@pytest.mark.parametrize("dim", [1, 2, 7, 64, 100])
def test_bounds_hold_and_tighten(dim):
    rng = np.random.default_rng(dim)
    x = np.floor(256 * (rng.normal(size=(40, dim)) + rng.normal(size=dim)))
    short, exact = hn.summaries(x), x @ x.T
    at, gaps = 0, []
    for edges in hn.levels(dim):
        n = len(edges) - 1
        mean, dev = short[:, at : at + n], short[:, at + n : at + 2 * n]
        at += 2 * n
        middle, reach = mean @ mean.T, dev @ dev.T + 1e-6
        assert (middle - reach <= exact).all() and (exact <= middle + reach).all()
        gaps.append(reach.mean())
    assert all(b <= a for a, b in pairwise(gaps))


def test_sifting_scores_fewer_pairs():
    rng = np.random.default_rng(9)
    rows = [r for r in table(rng, 3_000, 64, 2, spread=0.05)]
    x = np.floor(256 * np.array([r[1] for r in rows]))
    side = hn.Side(
        np.arange(len(x)), np.array([r[2] for r in rows]), x, hn.summaries(x).astype("<f4"), np.sqrt((x * x).sum(axis=1))
    )
    live = np.ones((50, len(x)), bool)
    exact = x[:50] @ x.T
    low = np.sort(exact, axis=1)[:, -50]
    got, scored = hn.sift(side.take(slice(0, 50)), side, live, low, np.full(50, np.inf))
    assert (np.where(exact >= low[:, None], exact, 0) == np.where(got >= low[:, None], got, 0)).all()
    assert scored < 0.5 * live.size
