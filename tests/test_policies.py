"""Metrics, thresholds, alert policies, missingness, validators and label gates."""

import pytest
from pyspark.sql import functions as F

from slopeline.functions import scoring as sc
from slopeline.functions import text as tx
from slopeline.functions import validate as va
from slopeline.operators import alerts, intervals, lookup, metrics, missing, quality, sets


def scored(spark, ys, ss):
    return spark.createDataFrame([("w", i, y, s) for i, (y, s) in enumerate(zip(ys, ss))], "window string, id long, y int, s double")


SIX = ([1, 0, 1, 1, 0, 0], [.9, .7, .6, .4, .3, .1])


def test_auc_ap(spark):
    r = metrics.ranking_metrics(scored(spark, *SIX), ["window"]).first()
    assert r.roc_auc == pytest.approx(7 / 9)
    assert r.avg_precision == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)
    assert metrics.ranking_metrics(scored(spark, [1, 1], [.1, .2]), []).first().roc_auc is None


def test_confusion(spark):
    r = metrics.classification_metrics(scored(spark, [1, 1, 0, 0], [.9, .2, .8, .1]), ["window"]).first()
    assert (r.tn, r.fp, r.fn, r.tp, r.false_negative_rate) == (1, 1, 1, 1, 0.5)


def test_recall_threshold(spark):
    df = scored(spark, [1, 1, 1, 0, 0, 0], [.90, .60, .40, .70, .30, .10])
    r = alerts.recall_threshold(df, ["window"], target=2 / 3).first()
    assert r.recall >= 2 / 3 and r.strategy == "target_recall_met_max_precision"
    df = scored(spark, [0, 0, 0, 0, 1, 1, 0, 0], [.90, .85, .80, .70, .40, .35, .20, .10])
    r = alerts.recall_threshold(df, ["window"], target=.7, max_rate=.30).first()
    assert not r.feasible and r.alert_rate <= .30 and r.threshold == .85
    r = alerts.recall_threshold(scored(spark, [0, 0], [.1, .2]), ["window"]).first()
    assert (r.threshold, r.strategy) == (0.5, "default_no_validation_positives")


def test_top_k_threshold(spark):
    df = scored(spark, [0] * 10, [i / 10 for i in range(10)])
    r = alerts.top_k_threshold(df, ["window"]).first()
    assert (r.selected, r.threshold) == (3, .7)
    tied = alerts.top_k_threshold(scored(spark, [0] * 10, [.5] * 10), ["window"]).first()
    assert (tied.selected, tied.threshold) == (0, None)


@pytest.mark.parametrize("ss,want", [
    ([.5 + i * 1e-9 for i in range(10)], {7, 8, 9}), ([.5036] * 12, {0, 1, 2}), ([.5] * 10, {0, 1, 2}), ([.4], {0})])
def test_window_top_k(spark, ss, want):
    out = alerts.window_top_k(scored(spark, [0] * len(ss), ss), ["window"]).where("alert").collect()
    assert {r.id for r in out} == want


def test_window_top_k_share(spark):
    with pytest.raises(ValueError):
        alerts.window_top_k(scored(spark, [0], [.1]), ["window"], share=1.2)
    assert alerts.window_top_k(scored(spark, [0] * 3, [.1, .2, .3]), ["window"], share=0.0).where("alert").count() == 1


def test_gates(spark):
    m = spark.createDataFrame([(3, .70, .55, .80)], "events int, roc_auc double, avg_precision double, recall double")
    out = {r.gate: r for r in alerts.evidence_gates(m, []).collect()}
    assert out["demo"].passed and not out["production"].passed
    assert "test events 3 < 30" in out["production"].reasons


def state_rows(spark):
    rows = [("A", 100.0, 1.0), ("A", 200.0, 2.0)] + [("B", None, None)] * 3
    return spark.createDataFrame(rows, "state string, elev double, slope double")


def test_missingness(spark):
    df, cols = state_rows(spark), ["elev", "slope"]
    rates = {r.feature: r.missing_rate for r in missing.missing_rates(df, cols).collect()}
    assert rates["elev"] == pytest.approx(0.6)
    assert [r.state for r in missing.testable_groups(df, "state", cols).collect()] == ["A"]
    kept = missing.apply_strategy(df, cols, "drop_any")
    r = missing.retention(df, kept).first()
    assert (r.retained_rows, r.retention_rate) == (2, pytest.approx(0.4))
    assert missing.apply_strategy(df, cols, "flag").agg(F.sum("is_missing_elev")).first()[0] == 3
    with pytest.raises(ValueError):
        missing.apply_strategy(df, cols, "impute_in_group")
    imp = spark.createDataFrame([("A", 100.0), ("A", None), ("B", None), ("B", None)], "state string, elev double")
    got = sorted((r.state, r.elev) for r in missing.apply_strategy(imp, ["elev"], "impute_in_group", "state").collect() if r.elev)
    assert got == [("A", 100.0), ("A", 100.0)]


INPUT = dict(rainfall_1day=10.0, rainfall_3day=25.0, rainfall_7day=50.0, rainfall_14day=80.0, rainfall_30day=120.0,
             elevation_m=1000.0, slope_degrees=20.0, latitude=26.0, longitude=91.0, highway="trunk")


@pytest.mark.parametrize("change,text", [
    ({}, None), ({"rainfall_7day": -1.0}, "rainfall_7day cannot be negative"), ({"latitude": 91.0}, "latitude must be between"),
    ({"longitude": 181.0}, "longitude must be between"), ({"highway": "teleporter"}, "not a supported road category"),
    ({"rainfall_30day": 1e12}, "supported physical maximum"), ({"rainfall_1day": float("nan")}, "must be finite"),
    ({"surprise": 1.0}, "unknown input fields"), ({"slope_degrees": 91.0}, "slope_degrees must be between")])
def test_scoring_validator(spark, change, text):
    df = spark.createDataFrame([{**INPUT, **change}])
    errors = df.select(va.scoring_errors(df).alias("e")).first().e
    assert (errors == []) if text is None else any(text in e for e in errors)


def test_bands_and_calibration(spark):
    df = spark.createDataFrame([(p,) for p in (.39, .4, .69, .7, .9)], "p double")
    assert [r.b for r in df.select(sc.risk_band(F.col("p")).alias("b")).collect()] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH"]
    c = df.select(sc.calibrate(F.col("p"), [.4, .8], [0.0, 1.0]).alias("c")).collect()
    assert c[0].c == 0.0 and c[4].c == 1.0 and c[3].c == pytest.approx(.75, abs=1e-6)
    assert df.select(sc.calibrate(F.col("p"), [.4], [.3]).alias("c")).first().c == pytest.approx(.3, abs=1e-7)


def test_derived_never_trusted(spark):
    from slopeline.plans.scoring import derive_inputs
    df = spark.createDataFrame([{**INPUT, "slope_x_rain7": -999999.0}]).withColumn("prediction_time", F.lit("2026-08-01").cast("date"))
    assert derive_inputs(df).first().slope_x_rain7 == 1000.0


def test_freshness(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    df = spark.range(1).select(sc.freshness(ts("2026-08-27 12:00:00"), ts("2026-08-27 00:00:00")).alias("a"),
                               sc.freshness(ts("2026-08-27 00:00:00"), ts("2026-08-19 00:00:00")).alias("b"),
                               sc.freshness(ts("2026-08-27 00:00:00"), F.lit(None).cast("timestamp_ntz")).alias("c"))
    assert tuple(df.first()) == ("FRESH", "EXPIRED", "MISSING_METADATA")


def test_ratio_keeps_unknown(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, 0.0)], "a double, b double")
    assert [r.x for r in df.select(sc.ratio(F.col("a"), F.col("b")).alias("x")).collect()] == [None, 500.0]


def test_label_gate(spark):
    rows = [(0, "assumed_unaffected_real_pool"), (0, "real_same_road_control"), (1, "real_confirmed_temporal")]
    r = quality.negative_label_gate(spark.createDataFrame(rows, "label int, label_source string")).first()
    assert (r.status, r.assumed_negatives) == ("FAIL", 1)
    ok = spark.createDataFrame([(0, "source_confirmed_unaffected")], "label int, label_source string")
    assert quality.negative_label_gate(ok).first().status == "PASS"


def test_highway_tokens(spark):
    df = spark.createDataFrame([("National Highway 6 and NH-102B, nh 010",)], "x string")
    assert sorted(df.select(tx.highway_tokens(F.col("x")).alias("t")).first().t) == ["nh10", "nh102", "nh6"]


def test_html_references_once(spark):
    df = spark.createDataFrame([("<p>a &amp;lt; b &#233; &#x1F600; &unknown; & c</p><SCRIPT>x</SCRIPT>",)], "h string")
    assert df.select(tx.strip_html(F.col("h")).alias("t")).first().t == " a &lt; b é 😀 &unknown; & c "


def test_snippets_overlap_and_limit(spark):
    text = "road " * 40
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(tx.snippets(F.col("t"), ["road"], 3, 9, 12).alias("s")).first().s
    want, seen = [], set()
    for i in range(40):
        snip = text[max(0, 5 * i - 3):5 * i + 4 + 9].strip()
        if snip not in seen:
            seen.add(snip)
            want.append(snip)
    assert [x.snippet for x in got] == want[:12]


def test_dated_blocks(spark):
    doc = "lost\nDate: 3rd June 2024\nNH10 open\n\n SH5 blocked \nDate: 4 June-2024\nclear"
    got = spark.createDataFrame([(doc,)], "t string").select(tx.dated_blocks(F.col("t")).alias("b")).first().b
    assert [(b.header, b.lines) for b in got] == [("Date: 3rd June 2024", ["NH10 open", "SH5 blocked"]), ("Date: 4 June-2024", ["clear"])]


def test_static_join_rejects_duplicate_keys(spark):
    left = spark.createDataFrame([(1,)], "k long")
    right = spark.createDataFrame([(1, 2), (1, 3)], "k long, v long")
    with pytest.raises(Exception, match="duplicate key"):
        lookup.join_static(left, right, ["k"]).collect()


def test_empty_results_fail_when_read(spark):
    df = spark.createDataFrame([("Assam", "2024-01-02"), (None, "never")], "state string, event_time string")
    assert [r.state for r in lookup.rows_of(df, "state", "ASSAM").collect()] == ["Assam"]
    with pytest.raises(Exception, match="no row with state"):
        lookup.rows_of(df, "state", "Bihar").collect()
    assert intervals.qualifying_events(df, required=True).count() == 1
    with pytest.raises(Exception, match="no event has a usable time"):
        intervals.qualifying_events(df.where("state IS NULL"), required=True).collect()


def test_reissue(spark):
    ex = spark.createDataFrame([("old_1", 1), ("old_2", 2), ("x", 3)], "observation_id string, k long")
    inc = spark.createDataFrame([("n1", 1), ("n3", 3)], "observation_id string, k long")
    out = sets.reissue(ex, inc, ["k"], F.col("observation_id").startswith("old_"))
    assert sorted(r.observation_id for r in out.collect()) == ["n1", "old_2", "x"]


def test_files_too_long_for_the_reader_are_verified(spark, tmp_path, monkeypatch):
    from slopeline.sources import files
    (tmp_path / "small.txt").write_text("a")
    (tmp_path / "large.txt").write_text("b" * 100)
    monkeypatch.setattr(files, "HASHED_BYTES", 10)
    inventory = files.file_inventory(spark, str(tmp_path))
    assert {r.size_bytes: r.sha256 is None for r in inventory.collect()} == {1: False, 100: False}
    manifest = files.build_manifest(inventory, tmp_path.name)
    assert [r.status for r in files.verify_manifest(manifest, manifest).collect()] == ["OK", "OK"]
    unknown = manifest.withColumn("sha256", F.when(F.col("size_bytes") < 10, F.col("sha256")))
    assert sorted(r.status for r in files.verify_manifest(unknown, manifest).collect()) == ["OK", "UNHASHED"]


def test_features_that_leak_the_target_are_refused(spark):
    from slopeline.plans import model
    df = spark.createDataFrame([(1.0, 0.2, 1), (2.0, 0.4, 0)], "a double, risk_score double, label int")
    for features in (["a", "risk_score"], ["a", "label"]):
        with pytest.raises(ValueError, match="would leak"):
            model.fit_logistic(df, features)
