"""Windows, as-of joins, labels, splits and calendar features on hand-made rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slopeline.functions import season as s
from slopeline.operators import alerts, asof, intervals, ordered, splits, windows

D = dt.date


def daily(spark, items, anchor=D(2024, 3, 1)):
    rows = [(1, anchor + dt.timedelta(days=o), v) for o, v in items]
    return spark.createDataFrame(rows, "key long, d date, v double"), spark.createDataFrame([(1, anchor)], "key long, p date")


def one(spark, items, w, partial=False):
    obs, anchors = daily(spark, items)
    out = windows.trailing_features(obs, anchors, windows=(w,), partial_prefix="part_").first()
    return out[f"part_{w}day"] if partial else out[f"rainfall_{w}day"]


def test_sentinel(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.5, -9999.0, -0.5, 12.0)], "v double")
    assert [r.x for r in df.select(windows.clean_reading(F.col("v")).alias("x")).collect()] == [0.0, 1.5, None, None, 12.0]


@pytest.mark.parametrize("items,w,partial,want", [
    ([(-5, 0.0), (-4, 0.0), (-3, 1.0), (-2, 2.0), (-1, 3.0)], 3, False, 6.0),
    ([(-5, 5.0), (-4, 6.0), (-3, 7.0), (-2, 8.0), (-1, 9.0)], 3, False, 24.0),
    ([(0, 999.0), (-2, 1.0), (-1, 2.0)], 5, False, 3.0),
    ([(-3, 1.0), (-2, None), (-1, 3.0)], 3, False, None),
    ([(-3, 1.0), (-2, None), (-1, 3.0)], 3, True, 4.0),
    ([(-3, None), (-2, None)], 3, True, None),
    ([(-4, 1.0), (-3, 2.0), (-2, None), (-1, 4.0)], 7, False, None),
    ([(-4, 1.0), (-3, 2.0), (-2, None), (-1, 4.0)], 7, True, 7.0),
    ([(1, 1.0), (2, 2.0), (3, 3.0)], 7, False, None),
    ([(-3, 1.0), (-1, 3.0)], 3, False, 4.0),
])
def test_trailing(spark, items, w, partial, want):
    assert one(spark, items, w, partial) == want


def test_trailing_blocks_match_brute_force(spark):
    rng = np.random.default_rng(5)
    days = pd.date_range("2020-01-01", periods=400)
    rows = [(k, d.date(), None if rng.random() < 0.1 else float(rng.integers(0, 50)))
            for k in range(3) for d in days if rng.random() < 0.8]
    out = windows.trailing_features(spark.createDataFrame(rows, "key long, d date, v double")).collect()
    table = {(k, d): v for k, d, v in rows}
    for r in out:
        for w in windows.WINDOWS:
            vals = [table[(r.key, r.p - dt.timedelta(days=i))] for i in range(1, w + 1)
                    if (r.key, r.p - dt.timedelta(days=i)) in table]
            want = None if not vals or any(v is None for v in vals) else sum(vals)
            assert r[f"rainfall_{w}day"] == want


def test_lookback_required(spark):
    obs, anchors = daily(spark, [(-40, 1.0)])
    assert windows.trailing_features(obs, anchors, require_lookback=True).count() == 0


LABEL_CASES = [
    ([D(2024, 1, 1)], [("e", "2024-01-02 00:00:00")], [(1, 1)]),
    ([D(2024, 1, 1), D(2024, 1, 5)], [("e", "2024-01-02 00:00:00")], [(1, 1), (0, 0)]),
    ([D(2024, 1, 10)], [("e", "2024-01-01 00:00:00")], [(0, 0)]),
    ([D(2024, 1, 5)], [("e", "2024-01-05 00:00:00")], [(0, 0)]),
    ([D(2024, 1, 1)], [("e", "2024-01-03 00:00:00")], [(0, 0)]),
    ([D(2024, 1, 1)], [("e", "2024-01-01 06:00:00"), ("f", "2024-01-02 00:00:00")], [(1, 2)]),
]


@pytest.mark.parametrize("samples,events,want", LABEL_CASES)
def test_labels(spark, samples, events, want):
    smp = spark.createDataFrame([(7, p) for p in samples], "road_segment_id long, prediction_time date")
    ev = spark.createDataFrame([(i, t, 7) for i, t in events], "event_id string, event_time string, affected_segment_id long")
    out = intervals.label_samples(smp, intervals.qualifying_events(ev), horizon_days=1).orderBy("prediction_time").collect()
    assert [(r.label, r.matching_event_count) for r in out] == want
    if want == [(1, 2)]:
        assert out[0].lead_seconds == 6 * 3600


def test_labels_type_filter(spark):
    ev = spark.createDataFrame([("a", "2024-01-02", 7, "landslide"), ("b", "2024-01-02", 7, "flood")],
                               "event_id string, event_time string, affected_segment_id long, event_type string")
    smp = spark.createDataFrame([(7, D(2024, 1, 1))], "road_segment_id long, prediction_time date")
    out = intervals.label_samples(smp, intervals.qualifying_events(ev, ["landslide"]), horizon_days=1).first()
    assert (out.label, out.matching_event_count) == (1, 1)


def small_slices(monkeypatch, rows):
    """Cut groups into slices of about so many rows, however small the input; None keeps plain windows."""
    monkeypatch.setattr(ordered, "SMALL_BYTES", (1 << 70) if rows is None else -1)
    if rows:
        monkeypatch.setattr(ordered, "PICK_ONE_IN", 2)
        monkeypatch.setattr(ordered, "PICKS_PER_SLICE", max(1, rows // 2))
        monkeypatch.setattr(ordered, "STRETCH", 3)


@pytest.mark.parametrize("seconds,rows", [(36_000, None), (None, None), (None, 20), (None, 0)])
def test_labels_small_slices_match_pairs(spark, monkeypatch, seconds, rows):
    small_slices(monkeypatch, rows)
    rng = np.random.default_rng(3)
    base = dt.datetime(2024, 1, 1)
    ev = [(i, base + dt.timedelta(minutes=int(rng.integers(0, 40000))), 0 if rng.random() < 0.5 else int(rng.integers(1, 5)))
          for i in range(200)]
    sm = list({(int(rng.integers(0, 5)), base + dt.timedelta(minutes=int(rng.integers(0, 40000)))) for _ in range(150)})
    e = spark.createDataFrame(ev, "event_id long, event_time timestamp_ntz, affected_segment_id long")
    p = spark.createDataFrame(sm, "road_segment_id long, prediction_time timestamp_ntz")
    out = intervals.label_samples(p, e, horizon_days=3, slice_seconds=seconds).collect()
    assert len(out) == len(sm)
    for r in out:
        hit = [t for _, t, k in ev if k == r.road_segment_id and r.prediction_time < t <= r.prediction_time + dt.timedelta(days=3)]
        assert r.matching_event_count == len(hit)
        assert r.earliest_event_time == (min(hit) if hit else None)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("seconds,rows", [(24 * 3600, None), (None, None), (None, 12), (None, 0)])
def test_asof_matches_merge_asof(spark, monkeypatch, direction, seconds, rows):
    small_slices(monkeypatch, rows)
    rng = np.random.default_rng(11)
    base = pd.Timestamp("2024-01-01")
    obs = pd.DataFrame({"key": rng.integers(0, 3, 120), "t": base + pd.to_timedelta(rng.integers(0, 2000, 120), "h")})
    obs = obs.drop_duplicates(["key", "t"]).reset_index(drop=True)
    obs["v"] = np.arange(len(obs))
    smp = pd.DataFrame({"key": rng.integers(0, 4, 80), "p": base + pd.to_timedelta(rng.integers(-50, 2100, 80), "h"),
                        "i": np.arange(80)})
    want = pd.merge_asof(smp.sort_values("p"), obs.sort_values("t"), left_on="p", right_on="t", by="key", direction=direction)
    o = spark.createDataFrame(obs).withColumn("t", F.col("t").cast("timestamp_ntz"))
    s_ = spark.createDataFrame(smp).withColumn("p", F.col("p").cast("timestamp_ntz"))
    out = asof.asof_join(s_, o, cols=["v"], direction=direction, slice_seconds=seconds).collect()
    assert {r.i: r.v for r in out} == {int(i): None if pd.isna(v) else int(v) for i, v in zip(want.i, want.v)}


def test_leakage_guard(spark):
    df = spark.createDataFrame([(D(2024, 1, 10), D(2024, 1, 9)), (D(2024, 1, 11), None)], "p date, f date")
    assert asof.guard_no_future(df, "p", "f").count() == 2
    bad = spark.createDataFrame([(D(2024, 1, 10), D(2024, 1, 12))], "p date, f date")
    with pytest.raises(Exception, match="temporal leakage"):
        asof.guard_no_future(bad, "p", "f").collect()


def test_season(spark):
    days = ["2024-06-01", "2024-09-30", "2024-05-31", "2024-10-01", "2024-01-15", "2024-04-01", "2024-11-01", "2024-08-01", "2024-02-29"]
    df = spark.createDataFrame([(d,) for d in days], "x string").select(F.col("x").cast("date").alias("d"))
    r = df.select(s.monsoon_active(F.col("d")).alias("m"), s.season(F.col("d")).alias("s"), s.days_into_monsoon(F.col("d")).alias("n")).collect()
    assert [x.m for x in r[:4]] == [1, 1, 0, 0]
    assert [r[i].s for i in (4, 5, 6)] == ["winter", "pre_monsoon", "post_monsoon"]
    assert (r[0].n, r[2].n, r[7].n) == (0, -1, 61)


def test_temporal_split(spark):
    df = spark.createDataFrame([(d,) for d in ("2020-01-01", "2020-01-11", "2020-01-16", "2020-01-21")], "x string")
    t = F.col("x").cast("date")
    got = [r.s for r in df.select(splits.temporal_split(t, "2020-01-10", "2020-01-15", "2020-01-20").alias("s")).collect()]
    assert got == ["train", "validation", "gap", "test"]
    with pytest.raises(ValueError):
        splits.geographic_split(F.col("x"), ["a"], ["a"])


def test_monotonic(spark):
    rows = [(D(2024, 1, 1), "test"), (D(2024, 1, 5), "train"), (D(2024, 1, 6), "odd")]
    out = splits.monotonic_violations(spark.createDataFrame(rows, "t date, split string"), "t", "split").collect()
    assert {(r.split, r.problem) for r in out} == {("test", "overlap"), ("odd", "unknown_label")}


def test_event_split_expands_validation(spark):
    rows = [(f"e{i}", D(2024, 1, 1) + dt.timedelta(days=i), 1 if i < 4 else 0) for i in range(10)]
    out = splits.split_by_events(spark.createDataFrame(rows, "event_id string, prediction_time date, label int"), 2, 2)
    got = {r.event_id: r.split for r in out.collect()}
    assert [got[f"e{i}"] for i in range(10)] == ["train"] * 3 + ["validation"] * 5 + ["test"] * 2
    flat = spark.createDataFrame([(f"e{i}", D(2024, 1, 1) + dt.timedelta(days=i), 1) for i in range(6)],
                                 "event_id string, prediction_time date, label int")
    with pytest.raises(ValueError):
        splits.split_by_events(flat, 1, 1)


@pytest.mark.parametrize("size", [None, 0, 2, 60])
def test_running_sums_any_slicing(spark, monkeypatch, size):
    small_slices(monkeypatch, size)
    rng = np.random.default_rng(2)
    rows = [("hot" if rng.random() < 0.6 else str(rng.integers(0, 4)), float(rng.integers(0, 30)), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, s double, id long")
    out = ordered.rank_rows(df, ["g"], [("s", False), "id"], "rk").collect()
    want = {}
    for g in {r[0] for r in rows}:
        for k, r in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2])), 1):
            want[r[2]] = k
    assert {r.id: r.rk for r in out} == want
    if size:
        per = {r.g: (r.n, r.most) for r in ordered.with_slices(df, ["g"], [("s", False), "id"]).groupBy("g", "_slice").count().groupBy("g").agg(
            F.count("*").alias("n"), F.max("count").alias("most")).collect()}
        assert per["hot"][0] > 500 / (3 * size) and per["hot"][1] < 12 * size


def test_exact_quantiles(spark):
    rng = np.random.default_rng(8)
    rows = [(("a", "b")[i % 2], float(v)) for i, v in enumerate(rng.normal(size=301).round(1))] + [("a", None)]
    out = ordered.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p01": 0.01, "p50": 0.5, "p99": 0.99})
    for r in out.collect():
        vals = [v for g, v in rows if g == r.g and v is not None]
        for n, p in (("p01", 1), ("p50", 50), ("p99", 99)):
            assert r[n] == pytest.approx(np.percentile(vals, p))


def test_consecutive_forced_slices(spark, monkeypatch):
    small_slices(monkeypatch, 30)
    df = spark.createDataFrame([(1, i, 100 + i) for i in range(700)], "w long, i long, n long")
    out = ordered.consecutive(df, ["w"], ["i"], "n")
    assert sorted((r.pos, r.a, r.b) for r in out.collect()) == [(i + 1, 100 + i, 101 + i) for i in range(699)]


@pytest.mark.parametrize("asc", [True, False])
@pytest.mark.parametrize("kind", ["double", "bigint", "string", "timestamp"])
def test_unknown_keys_rank_last_in_both_plans(spark, monkeypatch, kind, asc):
    rng = np.random.default_rng(6)
    base = dt.datetime(2024, 1, 1)
    make = {"double": float, "bigint": lambda x: (1 << 53) + x, "string": lambda x: f"{x:02d}", "timestamp": lambda x: base + dt.timedelta(hours=x)}[kind]
    rows = [(i, None if i % 7 == 0 else float("nan") if kind == "double" and i % 7 == 1 else make(int(rng.integers(0, 40)))) for i in range(900)]
    df = spark.createDataFrame(rows, f"id int, s {kind}")
    unknown = lambda v: v is None or v != v
    known = sorted((r for r in rows if not unknown(r[1])), key=lambda r: r[0])
    known = sorted(known, key=lambda r: r[1], reverse=not asc)
    want = [i for i, _ in [*known, *(r for r in rows if unknown(r[1]))]]
    for rows in (None, 40):
        small_slices(monkeypatch, rows)
        out = ordered.rank_rows(df, [], [("s", asc), "id"], "rk").collect()
        assert [r.id for r in sorted(out, key=lambda r: r.rk)] == want
    best = ordered.one_per_group(df.withColumn("g", F.lit(1)), ["g"], [("s", asc), "id"]).first()
    assert best.id == want[0]


def test_both_plans_agree_on_null_keys_and_times(spark, monkeypatch):
    base = dt.datetime(2024, 1, 1)
    hours = lambda n: base + dt.timedelta(hours=n)
    samples = [(None if i % 3 == 0 else i % 5, None if i % 11 == 0 else hours(3 * i), i) for i in range(120)]
    observed = [(None if i % 4 == 0 else i % 5, None if i % 9 == 0 else hours(2 * i), i) for i in range(200)]
    s_ = spark.createDataFrame(samples, "k int, p timestamp_ntz, i int")
    o = spark.createDataFrame(observed, "k int, t timestamp_ntz, v int")
    alerts_in = spark.createDataFrame([("w", i, None if i % 10 == 0 else float("nan") if i % 10 == 1 else i / 300) for i in range(300)], "w string, id int, s double")

    def answers():
        joined = [asof.asof_join(s_, o, key="k", cols=["v"], direction=d).select("i", "v") for d in ("backward", "forward")]
        labels = intervals.label_samples(s_, o, segment="k", prediction="p", event_segment="k", event_time="t")
        return [sorted(map(str, df.collect())) for df in (*joined, labels, alerts.window_top_k(alerts_in, ["w"]))]

    small_slices(monkeypatch, None)
    whole = answers()
    small_slices(monkeypatch, 16)
    assert answers() == whole
    assert len(whole[2]) == len({(k, p) for k, p, _ in samples})
    matched = {r.i: r.v for r in asof.asof_join(s_, o, key="k", cols=["v"]).collect()}
    assert all(matched[i] is None for k, p, i in samples if k is None or p is None)
    picked = {r.id for r in alerts.window_top_k(alerts_in, ["w"]).where("alert").collect()}
    assert len(picked) == 90 and not any(i % 10 < 2 for i in picked)
