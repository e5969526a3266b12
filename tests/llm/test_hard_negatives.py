"""Hard negatives against plain integer arithmetic."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeline.llm import catalog, hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<double>, label int, g int, score string, rank string"


def plain(rows, anchor, low=80, high=100, n=5):
    """Every anchor against every row, in Python integers."""
    fine = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, q, y in fine:
        if not anchor(a):
            continue
        met = sorted((-sum(s * t for s, t in zip(q, v)), i, z) for i, v, z in fine if i != a and len(v) == len(q))
        for ps, p, _ in [m for m in met if m[2] == y][:n]:
            hits = [(i, -s) for s, i, z in met if z != y and low * -ps <= -100 * s <= high * -ps][:n]
            out += [(a, p, r, i, -ps, s) for r, (i, s) in enumerate(hits, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "s", "r") for i, v, y in rows], SCHEMA).repartition(4)


def clusters(n, dim, k, seed=3, noise=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((k, dim))
    return [(i, (centres[i % k] + noise * rng.standard_normal(dim)).tolist(), int(rng.integers(3))) for i in range(n)]


ODD = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2), (3, [0.0, 0.0], 2), (4, None, 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 2),
       (7, [float("inf"), 1.0], 1), (8, [1.0, 1.5], None), (None, [1.0, 2.0], 2), (9, [1.0, 2.0, 3.0], 1), (10, [1.0, 2.0, 3.0], 2), (11, [1.0, 2.0, 2.9], 1),
       (12, [], 1), (13, [], 2), (14, [], 1), (15, [-1.0, -2.0], 1), (16, [-1.0, -1.9], 2), (20, [0.9, 1.9], 1), (21, [0.9, 1.9], 2), (21, [0.9, 1.9], 2)]


@pytest.mark.parametrize("rows", [ODD, clusters(700, 5, 9), clusters(300, 70, 4), [(i, [float(i % 2), 1.0], i % 2) for i in range(400)],
                                  [(i, [0.5, 0.25, -0.5], 1 + (i % 90 == 0)) for i in range(600)]])
def test_against_plain_arithmetic(llm_spark, rows, monkeypatch):
    for name, size in (("BLOCK", 16), ("READ", 4), ("ZONES", 8), ("GROUP", 5), ("SPLIT", 2)):
        monkeypatch.setattr(hn, name, size)
    df = hn.hard_negatives(table(llm_spark, rows), F.col("vec_id") % 10 == 0)
    assert found(df) == plain(rows, lambda i: i % 10 == 0)


def test_query_against_plain_arithmetic(llm_spark, small):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in llm_spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    df = catalog.op13_hard_negatives(llm_spark, small)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found(df) == plain(rows, lambda i: i % 100 == 0) != []


def test_the_curve_visits_neighbours():
    """Each cell once, and consecutive cells share a side."""
    for dim, bits in ((1, 4), (2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dim)))
        key = hn.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(1)
    rows, x = rng.integers(-300, 300, (20, 6)), rng.integers(-300, 300, (50, 6))
    least, most = hn.bounds(rows, x.min(0)[None], x.max(0)[None])
    assert (least <= rows @ x.T).all() and (rows @ x.T <= most).all()
    big = np.array([[1 << 30, 3], [1 << 29, -7]])
    assert hn.product(big, big).tolist() == [[(1 << 60) + 9, (1 << 59) - 21], [(1 << 59) - 21, (1 << 58) + 49]]


def test_zones_leave_blocks_unread(llm_spark, monkeypatch):
    """Clustered vectors: most blocks are out of every window of an anchor group."""
    for name, size in (("BLOCK", 16), ("GROUP", 4)):
        monkeypatch.setattr(hn, name, size)
    rows = clusters(2000, 6, 12, noise=0.02)
    df = table(llm_spark, rows).select("vec_id", "label", F.col("embedding").alias("vector"), (F.col("vec_id") % 50 == 0).alias("asks"))
    parts = hn.blocks(df)
    groups = hn.anchor_groups(parts, 5)
    total, asking = parts.count(), groups.count()
    picks = hn.chosen_blocks(groups, parts, True, total, asking).select(F.explode("picks")).count()
    assert 0 < picks < 0.25 * total * asking


def test_empty_tables(llm_spark):
    assert hn.hard_negatives(table(llm_spark, ODD).limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(table(llm_spark, ODD), F.col("vec_id") == 999).count() == 0
