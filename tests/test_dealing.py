"""Tables are dealt to as many tasks as their size asks for, with the same rows."""

from pyspark.sql import functions as F

from slopeline import session
from slopeline.operators import windows
from slopeline.plans import folds, model


def test_forest_rows_are_dealt_by_their_number(spark, small, monkeypatch):
    """one small file must not leave all rows in one task's memory."""
    rows = spark.read.parquet(f"{small}/part.parquet").coalesce(1)
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    parts = session.spread(rows).rdd.getNumPartitions()
    assert parts == rows.count() // 20 > 1 and sorted(session.spread(rows).collect()) == sorted(rows.collect())
    seen = []
    monkeypatch.setattr(model, "spread", lambda df: seen.append(df.columns) or session.spread(df))
    given = rows.select("p_size", "p_type", (F.col("p_partkey") % 4).alias("risk_class"), "p_name")
    model.fit_multiclass(given, ["p_size"], ["p_type"], trees=2, depth=2)
    assert seen == [["p_size", "p_type", "risk_class"]]


def test_trailing_windows_follow_the_input(spark, small, monkeypatch):
    """the number of window tasks follows the bytes, and is not merged again at run time."""
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    daily = lines.select(F.col("l_suppkey").alias("key"), F.col("l_shipdate").cast("date").alias("d"), F.col("l_quantity").alias("v"))
    want = sorted(windows.trailing_features(daily).collect())
    monkeypatch.setattr(session, "TASK_BYTES", session.input_bytes(daily) // 11)
    got = windows.trailing_features(daily)
    assert sorted(got.collect()) == want and got.rdd.getNumPartitions() == 11


def test_newton_steps_read_equal_rows_once(spark, monkeypatch):
    """the passes of the fits follow the distinct rows."""
    rows = spark.range(4000).select(F.array((F.col("id") % 7).cast("double")).alias("x"), (F.col("id") % 3 % 2).cast("double").alias("y"), (F.col("id") % 2).alias("tag"))
    read = []
    real = folds.durable
    monkeypatch.setattr(folds, "durable", lambda df: read.append(real(df)) or read[-1])
    folds.fit_folds(rows, 1, folds.Folds(2))
    assert [t.count() for t in read] == [rows.distinct().count()] and read[0].agg(F.sum("times")).first()[0] == 4000
