"""Every registered query against its SQL twin, and assertions on the plans."""

import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entrypoint
from slopeline.catalog import QUERIES, learning, registry, run
from slopeline.operators import ordered

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_twin(spark, small, name):
    assert oracle.compare(name, spark, small) == []


def test_entry(spark):
    rows = entrypoint.entry(spark).collect()
    assert rows and set(entrypoint.oracle_sql()) <= set(entrypoint.queries())


@pytest.mark.parametrize("name", ["a10_file_inventory", "j7_preprocess", "j9_logistic_baseline", "j12_multiclass_proxy",
                                  "j17_readiness_table", "j24_risk_feed"])
def test_runs(spark, small, name):
    assert run(name, spark, small).count() >= 1


def test_trace_records(spark, small):
    """The records name their segment, place and time, one for each test row."""
    rows = run("h56_a20_trace_records", spark, small).collect()
    tests = learning.parts(registry.Tables(spark, small), "osm_id", "prediction_time")[2].collect()
    assert rows and len(rows[0]) == 22
    assert Counter((r.road_segment_id, r.prediction_timestamp[:10]) for r in rows) == Counter((str(r.osm_id), str(r.prediction_time)[:10]) for r in tests)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["flagship_rain_by_label", "c3_asof_backward", "c5_d1_horizon_labels", "h12_listing_cards",
                                  "j22_production_dataset", "c11_e7_road_district_overlap", "e11_window_top_k"])
def test_no_python_no_cross_join(spark, small, name):
    text = plan(run(name, spark, small))
    for word in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


@pytest.mark.parametrize("name", ["e11_window_top_k", "e16_split_by_events", "c3_asof_backward", "c5_d1_horizon_labels", "e15_percentile_score",
                                  "e24_consecutive_nodes", "d19_d20_auc_average_precision", "d11_feature_profile"])
def test_twin_with_sliced_groups(spark, small, monkeypatch, name):
    for setting, value in (("SMALL_BYTES", -1), ("PICK_ONE_IN", 3), ("PICKS_PER_SLICE", 4)):
        monkeypatch.setattr(ordered, setting, value)
    assert oracle.compare(name, spark, small) == []


def test_hops_shuffle_lines_once(spark, small, monkeypatch):
    """Only ways of millions of lines, of which there are none, are counted and numbered in slices."""
    monkeypatch.setattr(ordered, "SMALL_BYTES", -1)
    df = run("e24_consecutive_nodes", spark, small)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(way_id") == 1


def test_equal_rows_of_sliced_groups_keep_their_positions(spark, monkeypatch):
    rows = [(g, i // 3) for g in (1, None) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, o int").withColumn("v", F.col("o"))
    want = sorted((g or 0, i + 1, i // 3, (i + 1) // 3) for g in (1, None) for i in range(299))
    found = []
    for small_bytes, one_in in ((1 << 30, 3), (-1, 3), (-1, 1 << 30)):
        monkeypatch.setattr(ordered, "SMALL_BYTES", small_bytes)
        monkeypatch.setattr(ordered, "PICK_ONE_IN", one_in)
        monkeypatch.setattr(ordered, "PICKS_PER_SLICE", 4)
        found.append(sorted((r.g or 0, r.pos, r.a, r.b) for r in ordered.consecutive(df, ["g"], ["o"], "v").collect()))
    assert found == [want] * 3


def test_the_risk_feed_is_planned_at_once(spark, small):
    """Rules do not ride through the joins and windows above them."""
    from slopeline.catalog.learning import BOOKKEEPING, RELEASED, derived, scoring
    from slopeline.catalog.registry import Tables
    begun = time.monotonic()
    feed = scoring.risk_feed(derived.risk_input(Tables(spark, small)), RELEASED, list(RELEASED.weights), ignore=BOOKKEEPING, window=["ref"], key="o_orderkey")
    plan(feed)
    assert time.monotonic() - begun < 20


def test_filters_reach_the_scan(spark, small):
    text = plan(run("a1_a2_pruned_scan", spark, small))
    assert "PushedFilters: [" in text and "EqualTo(o_orderpriority,1-URGENT)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderpriority:string>" in text


@pytest.mark.parametrize("small_bytes", [1 << 40, -1])
@pytest.mark.parametrize("name", ["flagship_rain_by_label", "c3_asof_backward", "c5_d1_horizon_labels", "e6_c3_asof_keep_last_ties",
                                  "e11_window_top_k", "e15_percentile_score", "d11_feature_profile", "e24_consecutive_nodes", "f3_feed_order"])
def test_building_a_query_starts_no_job(spark, small, monkeypatch, name, small_bytes):
    """Neither for tables that get plain windows nor for those whose groups are cut."""
    monkeypatch.setattr(ordered, "SMALL_BYTES", small_bytes)
    sc = spark.sparkContext
    sc.setJobGroup(f"build {name}", name)
    try:
        run(name, spark, small)
    finally:
        sc.setJobGroup("", "")
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(f"build {name}") for s in tracker.getJobInfo(j).stageIds]
    # the schema of a table is read by a job over its footer
    assert all(s is None or s.name.startswith("parquet") for s in stages)


def test_entry_stands_without_the_training_data_folder():
    code = ("import sys; sys.modules['corpus_pipeline'] = None; sys.modules['slopeline.llm'] = None; import __spark_entry__ as e; "
            "names = set(e.queries()); assert len(names) > 190 and not any(n.startswith('op') or n == 'pipeline' for n in names); "
            "assert set(e.oracle_sql()) <= names")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_training_data_folder():
    for path in [*(ROOT / "slopeline").rglob("*.py"), ROOT / "bench.py", *(ROOT / "tests").glob("*.py")]:
        if "llm" not in path.parts and path.name != "test_queries.py":
            assert "slopeline.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()
