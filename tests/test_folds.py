"""All folds in one fit against fits of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeline.plans import folds


def fit(x, y, ridge=1.0):
    """Balanced ridge-penalised logistic fit on standardised features; returns a scorer."""
    mean, dev = x.mean(0), x.std(0)
    dev[dev < 1e-12] = 1
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / dev])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    penalty, b = np.diag([0.0] + [ridge] * x.shape[1]), np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + penalty + 1e-12 * np.eye(len(b)), z.T @ (w * (p - y)) + penalty @ b)
    return lambda q: 1 / (1 + np.exp(-(b[0] + ((q - mean) / dev) @ b[1:])))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    out = []
    for i in range(400):
        g = "abcde"[i % 5] if i % 3 else "hot"
        u, v = float(rng.normal()), None if i % 9 == 0 else float(rng.integers(0, 6))
        out.append((i, g, i // 40, u, v, int(u + rng.normal() > 0)))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "i int, g string, t int, u double, v double, label int").repartition(6)


def matrix(rows):
    known = [r[4] for r in rows if r[4] is not None]
    mean = sum(known) / len(known)
    return np.array([[r[3], mean if r[4] is None else r[4], 0.0, float(r[4] is None)] for r in rows]), np.array([r[5] for r in rows], float)


def test_leave_one_out(spark, rows):
    extra = [(900, None, 1, 0.5, 1.0, 1), (901, "a", 1, 0.5, 1.0, None)]
    got = {r.i: r for r in folds.leave_one_out_scores(table(spark, [*rows, *extra]), ["u", "v"], "g", baselines=["v"], key=["i"]).collect()}
    x, y = matrix(rows)
    g = np.array([r[1] for r in rows])
    assert set(got) == {r[0] for r in rows}
    for name in set(g):
        want = fit(x[g != name], y[g != name])(x[g == name])
        assert [got[i].raw_probability for i in np.flatnonzero(g == name)] == pytest.approx(want.tolist(), abs=1e-6)
        others = np.array([r[4] for r in rows if r[1] != name and r[4] is not None])
        for r in rows:
            if r[1] == name:
                assert got[r[0]].v_percentile == pytest.approx(0.0 if r[4] is None else (others <= r[4]).mean())


def test_groups_whose_others_hold_one_class(spark):
    df = spark.createDataFrame([(1, "a", 0.5, 1), (2, "a", 0.1, 0), (3, "b", 0.7, 1), (4, "b", 0.2, 1)], "i int, g string, u double, label int")
    got = {r.i: r.raw_probability for r in folds.leave_one_out_scores(df, ["u"], "g", key=["i"]).collect()}
    assert got[1] == got[2] == 0.5 and got[3] != 0.5
    assert folds.leave_one_out_scores(df.limit(0), ["u"], "g").count() == 0


def test_expanding(spark, rows):
    df = table(spark, rows).withColumn("event", F.col("t").cast("string"))
    got = {r.i: (r.fold, r.raw_probability) for r in folds.expanding_scores(df, ["u", "v"], event="event", time="t", min_train=4, n_val=2, key=["i"]).collect()}
    x, y = matrix(rows)
    t = np.array([r[2] for r in rows]) + 1
    assert {f for f, _ in got.values()} == {4, 6}
    for upto in (4, 6):
        at = np.flatnonzero(t == upto + 3)
        assert [got[i] for i in at] == [(upto, pytest.approx(p, abs=1e-6)) for p in fit(x[t <= upto], y[t <= upto])(x[at])]
    assert len(got) == sum((t == 7) | (t == 9))
