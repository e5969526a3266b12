"""What the two vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def whole(vector: Column) -> Column:
    """True for vectors that are not NULL or empty, with finite components that are not all zero."""
    wide = vector.cast("array<double>")
    fine = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(wide, lambda v: v != 0), F.lit(False))


def lengths(df: DataFrame, vector: str) -> list[int]:
    """The lengths of whole vectors, commonest first. Inner products and cosines belong to one length, so the
    operators run once per length."""
    sizes = df.where(whole(F.col(vector))).groupBy(F.size(vector).alias("n")).agg(F.count(F.lit(1)).alias("k"))
    return [r.n for r in sizes.orderBy(F.desc("k"), "n").collect()]


def float_kind(df: DataFrame, vector: str) -> str:
    """Components travel as they are stored: 32 bits where the table has floats."""
    return "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list array without NULLs as rows."""
    return np.asarray(column.flatten()).reshape(-1, dim)


def packed(rows: np.ndarray, kind: str) -> pa.Array:
    """Rows as binary values."""
    width = rows.shape[1] * np.dtype(kind).itemsize
    data = np.ascontiguousarray(rows, kind)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked(column: pa.ChunkedArray, dim: int, kind: str) -> np.ndarray:
    """The rows of ``packed`` in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
