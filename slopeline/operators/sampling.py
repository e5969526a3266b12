"""Sample design: prediction times around events, controls, and capped draws per corridor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeline.operators.ordered import rank_rows

# Days before the event at which samples are taken.
POSITIVE_OFFSETS = (1, 3, 7)
CONTROL_OFFSETS = (14,)
CORRIDOR_OFFSET = 3
NEGATIVES_PER_CORRIDOR = 4


def event_samples(events: DataFrame, date: str = "event_date") -> DataFrame:
    """Three positives and one same-road control per event, by one explode."""
    kinds = [(o, 1, "positive") for o in POSITIVE_OFFSETS] + [
        (o, 0, "same_road_control") for o in CONTROL_OFFSETS]
    plan = F.array(*[F.struct(F.lit(o).alias("days"), F.lit(y).alias("label"),
                              F.lit(k).alias("sample_kind")) for o, y, k in kinds])
    return events.select("*", F.explode(plan).alias("_s")).select(
        *events.columns, F.date_sub(F.col(date), F.col("_s.days")).alias("prediction_time"),
        F.col("_s.label").alias("label"), F.col("_s.sample_kind").alias("sample_kind"))


def sample_dates(events: DataFrame, date: str = "event_date") -> DataFrame:
    """Distinct prediction dates over all events, controls and corridor draws."""
    offsets = sorted({*POSITIVE_OFFSETS, *CONTROL_OFFSETS, CORRIDOR_OFFSET})
    days = F.array(*[F.date_sub(F.col(date), o) for o in offsets])
    return events.select(F.explode(days).alias("p")).distinct()


def corridor_draw(events: DataFrame, roads: DataFrame, excluded: DataFrame, *,
                  corridor: str = "ref", road: str = "osm_id", event: str = "event_id",
                  per_event: int = NEGATIVES_PER_CORRIDOR, seed: int = 2026) -> DataFrame:
    """Unaffected roads of the event's corridor, never the same road twice.

    Roads of a corridor are ranked by hash; event k of the corridor takes ranks
    ``per_event*(k-1)+1 .. per_event*k``. Roads in ``excluded`` are never drawn.
    """
    pool = roads.join(excluded.select(road).distinct(), road, "left_anti").select(corridor, road)
    pool = pool.distinct().withColumn("_h", F.xxhash64(F.col(road), F.lit(seed)))
    ranked = rank_rows(pool, [corridor], ["_h", road], "_rank").withColumn(
        "_turn", F.floor((F.col("_rank") - 1) / per_event) + 1)
    turns = rank_rows(events.select(corridor, event).distinct(), [corridor], [event], "_turn")
    return turns.join(ranked, [corridor, "_turn"]).select(corridor, event, road)
