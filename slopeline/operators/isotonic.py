"""Isotonic fits by pooling adjacent violators in two levels.

Equal scores are pooled by an aggregate. Ranges of scores then pool their own neighbours, and what is left of
them, blocks of a sum and a weight, is pooled again over fewer ranges. Neighbours that violate the order end
up in one block in whatever order they are met, so the result is that of a single pass. The driver receives
the blocks of the second level, which are near the final steps, and joins those at the seams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "lo double, hi double, total double, weight double"
NAMES = ["lo", "hi", "total", "weight"]


def pool(blocks: Iterator[tuple[float, float, float, float]], done: list[tuple[float, float, float, float]] | None = None
         ) -> list[tuple[float, float, float, float]]:
    """Blocks (lo, hi, total, weight) in order, joined until their means rise."""
    out = [] if done is None else done
    for block in blocks:
        out.append(block)
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            lo, _, t, w = out[-2]
            _, hi, t2, w2 = out.pop()
            out[-1] = (lo, hi, t + t2, w + w2)
    return out


def _pooled(blocks: DataFrame, ranges: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[float, float, float, float]] = []
        for batch in batches:
            pool(zip(*(c.to_pylist() for c in batch.columns), strict=True), kept)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*kept, strict=True)], NAMES)

    return blocks.repartitionByRange(ranges, "lo").sortWithinPartitions("lo").select(*NAMES).mapInArrow(work, BLOCK)


def isotonic_blocks(df: DataFrame, label: str, score: str, weight: str | None = None) -> list[tuple[float, float, float, float]]:
    """The steps of the non-decreasing least-squares fit of ``label`` on ``score``: (lowest score, highest score,
    sum of labels, weight). Rows with an unknown label, score or weight, or a weight of zero, take no part."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.col(score).cast("double").alias("lo"), F.col(label).cast("double").alias("y"), w.alias("w")).where(
        "lo IS NOT NULL AND NOT isnan(lo) AND y IS NOT NULL AND NOT isnan(y) AND w > 0")
    levels = rows.groupBy("lo").agg(F.sum(F.col("y") * F.col("w")).alias("total"), F.sum("w").alias("weight")).withColumn("hi", F.col("lo"))
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    second = _pooled(_pooled(levels, n), max(1, round(n ** 0.5)))
    return pool(iter(sorted(tuple(r) for r in second.collect())))


def isotonic_steps(df: DataFrame, label: str, score: str, weight: str | None = None) -> tuple[list[float], list[float]]:
    """Scores and fitted values between which the calibration runs straight; flat below and above."""
    x, y = [], []
    for lo, hi, total, w in isotonic_blocks(df, label, score, weight):
        for at in (lo, hi)[:1 + (hi > lo)]:
            x.append(at)
            y.append(total / w)
    return x, y
