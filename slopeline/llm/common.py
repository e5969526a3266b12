"""What the training-data operators share: session settings, row numbers, and words as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slopeline.session import durable, prepare

#: Texts are long: small Arrow batches keep a worker's memory level.
ARROW_ROWS = "500"
#: White space of the word rule: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Texts are turned into arrays in pieces of about so many bytes.
PIECE_BYTES = 1 << 20


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)).cast("int")


def row_numbers(df: DataFrame, by: list[str], order: list[Column], name: str = "row_no") -> DataFrame:
    """Gapless row numbers from 0 in the order of ``by`` and ``order``, restarting per value of ``by``.

    Rows are dealt to ranges of the order, so a group that holds a third of the rows spreads over many
    tasks; each range numbers its rows alone, and only one count per (range, group) is gathered. The
    numbered ranges are written once, since a second sampling could cut them elsewhere. Rows equal in the
    whole order are told apart by their place in the input, which may differ between readings of it.
    """
    keys = [F.col(c) for c in by]
    place = df.withColumn("__rn_place", F.monotonically_increasing_id())
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = place.repartitionByRange(n, *keys, *order, "__rn_place").sortWithinPartitions(*keys, *order, "__rn_place")
    mark = F.monotonically_increasing_id()
    kept = durable(dealt.drop("__rn_place").withColumn("__rn_part", F.shiftright(mark, 33)).withColumn(
        "__rn_local", mark.bitwiseAND(F.lit((1 << 33) - 1))))
    # one row per (range, group): at most ranges + groups rows, as each range holds a stretch of the order
    starts = kept.groupBy("__rn_part", *by).agg(F.min("__rn_local").alias("__rn_first"), F.count(F.lit(1)).alias("__rn_n"))
    before = Window.partitionBy(*by).orderBy("__rn_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("__rn_shift", F.coalesce(F.sum("__rn_n").over(before), F.lit(0)) - F.col("__rn_first"))
    a, b = kept.alias("a"), starts.select("__rn_part", *by, "__rn_shift").alias("b")
    on = F.col("a.__rn_part") == F.col("b.__rn_part")
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(F.broadcast(b), on).select("a.*", (F.col("__rn_local") + F.col("__rn_shift")).alias(name)).drop("__rn_part", "__rn_local")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array without copying; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts, wide = texts.cast(pa.large_string()), True
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES):
    """Ranges of texts of about ``size`` bytes together; a longer text is one range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of its first word."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Polynomial hashes modulo 2^64 of stretches of an array, by prefix sums and an odd base."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, PIECE_BYTES + 1)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]), dtype=np.uint64)
                                  for b in (self.base, self.inverse))

    def __call__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[:len(values)], out=total[1:])
        return mixed((total[ends] - total[starts]) * self.down[starts])


def stopping(rows):
    """Arrow tables as record batches."""
    for t in rows:
        yield from t.to_batches()
