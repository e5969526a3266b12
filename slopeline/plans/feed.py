"""Risk feed documents: nested form and the flat rows of its readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def feed_row_json(columns: Sequence[str | Column]) -> Column:
    """One segment of a feed as a JSON line; a feed is written as lines, never as one document."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def api_segments(docs: DataFrame, doc: str, segment_ddl: str, rename: dict[str, str], zero: Sequence[str],
                 keep: Sequence[str] = ()) -> DataFrame:
    """Segments of feed documents under their served names, unknown numbers as zero."""
    segment = T._parse_datatype_string(segment_ddl)
    schema = T.StructType([T.StructField("segments", T.ArrayType(segment))])
    rows = docs.select(*keep, F.explode(F.from_json(doc, schema)["segments"]).alias("s")).select(*keep, "s.*")
    return rows.select(*keep, *[
        (F.coalesce(f.name, F.lit(0).cast(f.dataType)) if f.name in zero else F.col(f.name))
        .alias(rename.get(f.name, f.name)) for f in segment.fields])
