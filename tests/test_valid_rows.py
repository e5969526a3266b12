"""Valid rows are found by one comparison for each column, with the rows that the messages leave."""

from pyspark.sql import functions as F

from slopeline.catalog import learning
from slopeline.catalog.quality import BOOKKEEPING
from slopeline.catalog.registry import Tables
from slopeline.functions import validate as va
from slopeline.plans import scoring
from slopeline.schema import nan_to_null
from slopeline.sources import derived

GOOD = {"osm_id": 1, "latitude": 10.0, "longitude": 20.0, "highway": " Trunk ", "elevation_m": 100.0, "slope_degrees": 10.0, "highway_prior": 0.1,
        "bridge_flag": 1.0, "rainfall_days_available": 3.0} | {c: 5.0 for c in va.RAINFALL}
NUMBERS = [None, float("nan"), float("inf"), float("-inf"), -1e308, 1.7e308, -500.0, -500.5, -180.0, -90.0, -90.5, -0.5, -0.0, 0.0, 30.0, 30.5, 90.0, 90.5, 180.0, 180.5,
           9000.0, 9000.5, 10000.0, 10000.5]


def test_valid_is_no_message(spark):
    numeric = [c for c in GOOD if c not in ("osm_id", "highway")]
    rows = [GOOD | {c: v} for c in numeric for v in NUMBERS] + [GOOD | {"highway": v} for v in (None, "", "teleporter", "ROAD")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'bigint' if c == 'osm_id' else 'string' if c == 'highway' else 'double'}" for c in GOOD))
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    odd = spark.createDataFrame([{k: str(v) for k, v in GOOD.items()} | {c: v} for c in numeric for v in ("", "abc", " 7 ", "1e400", "NaN", "5")],
                                ", ".join(f"{c} string" for c in GOOD))
    for table, ignore in ((df, ()), (text, ()), (odd, ()), (df.withColumn("extra", F.lit(1)), ()), (df.withColumn("extra", F.lit(1)), ("extra",))):
        for metadata in (True, False):
            got = table.select((F.size(va.scoring_errors(table, ignore, metadata)) == 0).alias("a"), va.scoring_valid(table, ignore, metadata).alias("b"))
            assert got.where("NOT (a <=> b)").count() == 0
            known = nan_to_null(table)
            errors = [F.size(va.scoring_errors(known, ignore, metadata)) == 0, va.scoring_valid(known, ignore, metadata)]
            want, found = known.select(errors[0]).collect(), table.select(va.scoring_valid(table, ignore, metadata, nan_is_null=True)).collect()
            assert [r[0] for r in want] == [r[0] for r in found] == [r[0] for r in known.select(errors[1]).collect()]
            assert got.where("a").count() > 0 or "extra" in table.columns and not ignore


def rules_in(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_valid_rows_need_no_messages(spark, small, monkeypatch):
    """neither the training rows nor the feed work out messages to see that there are none; the split keeps what the fits read."""
    t = Tables(spark, small)
    written = []
    for module in (learning, scoring):
        monkeypatch.setattr(module, "durable", lambda df, real=module.durable: written.append(df) or real(df))
    learning.parts(t)
    rows = derived.risk_input(t)
    scoring.risk_feed(rows, learning.RELEASED, list(learning.RELEASED.weights), ignore=BOOKKEEPING, window=["ref"], key="o_orderkey")
    assert [c for c in written[0].columns if c in rows.columns or c == "split"] == ["o_orderkey", "label", "split", *learning.INPUTS]
    assert len(written) == 3 and not any("supported physical maximum" in rules_in(df) for df in written)
    valid, rejected = scoring.validate_inputs(rows, BOOKKEEPING)
    assert valid.count() + rejected.count() == rows.count() and valid.exceptAll(rows).count() == 0
    assert valid.join(rejected, "o_orderkey", "left_semi").count() == 0
