"""Isotonic fits in two levels against the max-min formula."""

import numpy as np
import pytest

from slopeline.operators.isotonic import isotonic_blocks, isotonic_steps, pool


def max_min(x, y, w):
    """The fitted value of every distinct score: the greatest, over starts, of the least mean from there."""
    levels = np.unique(x)
    t = np.array([(y * w)[x == v].sum() for v in levels])
    n = np.array([w[x == v].sum() for v in levels])
    mean = lambda a, b: t[a:b + 1].sum() / n[a:b + 1].sum()
    return levels, [max(min(mean(a, b) for b in range(i, len(levels))) for a in range(i + 1)) for i in range(len(levels))]


@pytest.mark.parametrize("ranges", ["1", "8"])
@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "ties"])
def test_fit(spark, kind, ranges):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 8 if kind == "ties" else 80, 400) / 10
    y = {"noise": rng.integers(0, 2, 400), "ties": rng.integers(0, 2, 400), "rising": (x > 4) * 1, "falling": (x < 4) * 1}[kind].astype(float)
    w = rng.integers(1, 4, 400).astype(float)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x, y, w)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), (3.0, None, 1.0), (float("nan"), 1.0, 1.0), (3.0, 1.0, 0.0)], "s double, y double, w double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        blocks = isotonic_blocks(df, "y", "s", "w")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    levels, want = max_min(x, y, w)
    got = [next(t / n for lo, hi, t, n in blocks if lo <= v <= hi) for v in levels]
    assert got == pytest.approx(want) and [b[1] < c[0] for b, c in zip(blocks, blocks[1:])] == [True] * (len(blocks) - 1)


def test_pooling_in_parts_is_pooling_at_once():
    rng = np.random.default_rng(9)
    blocks = [(float(i), float(i), float(rng.integers(0, 5)), 4.0) for i in range(200)]
    parts = [b for k in range(0, 200, 17) for b in pool(iter(blocks[k:k + 17]))]
    assert pool(iter(parts)) == pool(iter(blocks))


def test_steps(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (3.0, 0.0), (4.0, 1.0)], "s double, y double")
    assert isotonic_steps(df, "y", "s") == ([1.0, 2.0, 3.0, 4.0], [0.0, 0.5, 0.5, 1.0])
    assert isotonic_steps(df.limit(0), "y", "s") == ([], [])
