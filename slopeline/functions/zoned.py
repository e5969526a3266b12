"""Timestamps that must carry their zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = r"(Z|[+-]\d{2}:?\d{2})$"


def zoned_ok(x: Column) -> Column:
    """The text ends in a zone offset and parses."""
    return x.rlike(ZONE)


def parse_zoned(x: Column) -> Column:
    """Timestamp of ISO text with an offset; NULL when the offset is missing or the text is malformed."""
    full = F.regexp_replace(x, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(zoned_ok(x), F.try_to_timestamp(full))


def not_in_future(prediction: Column, now: Column, slack_minutes: int = 5) -> Column:
    return F.timestamp_diff("SECOND", now, prediction) <= slack_minutes * 60
