"""Near-copy groups by fingerprints: pigeonhole blocks, a join on shared blocks, and a check of the distance.

A fingerprint is cut into ``distance + 3`` blocks. Two fingerprints within the distance differ in at most
``distance`` blocks, so they agree on three others: each fingerprint is listed under every choice of
three blocks and meets its candidates there. Only distinct fingerprints take part, so exact copies cost
one row. A bucket with many members is not paired up: its members are listed once more under each way of
blanking ``distance`` of the bits that may still differ. Those who share such a form lie within the
distance by construction, and at most 2^distance of them can.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.llm.common import utf8
from slopeline.operators.graph import weak_components
from slopeline.session import durable

BITS, KEPT_BLOCKS = 64, 3
#: Members of a bucket that are compared pair by pair; larger buckets go the other way.
PAIRED = 40


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of all shingles of lower-cased words; no words give 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(joined, seed)]
    else:
        ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
        hashes = [h(joined[a + 1:b], seed) for a, b in zip(ends, ends[shingle:], strict=False)]
    each = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    major = each.sum(0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(major, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns and ``fingerprint`` (a signed long) of every whole text; NULL and wordless texts have 0."""
    keep = list(keep)
    slim = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(len(keep)))
            raw = memoryview(data)
            out = [fingerprint(bytes(raw[a:b]), shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(out, pa.int64())], names=[*keep, "fingerprint"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(run, f"{kinds}, fingerprint bigint")


def block_masks(distance: int) -> list[int]:
    """Bit masks of every choice of three among ``distance + 3`` nearly equal blocks."""
    n = distance + KEPT_BLOCKS
    cuts = [BITS * i // n for i in range(n + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(block, KEPT_BLOCKS)]


def _long(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")


def links(prints: DataFrame, distance: int = 2, paired: int = PAIRED) -> DataFrame:
    """src, dst: links between different values of ``fingerprint`` that connect exactly those values which
    chains of at most ``distance`` differing bits connect. Every link itself lies within the distance."""
    values = prints.select(F.col("fingerprint").alias("f")).where("f IS NOT NULL").distinct()
    masks = block_masks(distance)
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("f").bitwiseAND(_long(m)).alias("v")) for i, m in enumerate(masks)])
    listed = values.select("f", F.explode(keys).alias("k")).select("f", "k.c", "k.v")
    shared = listed.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = durable(listed.join(shared, ["c", "v"]))
    a = members.where(F.col("n") <= paired).select("c", "v", F.col("f").alias("src"))
    b = a.withColumnRenamed("src", "dst")
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= distance
    few = a.join(b, ["c", "v"]).where((F.col("src") < F.col("dst")) & near).select("src", "dst")
    free = [[1 << i for i in range(BITS) if not m >> i & 1] for m in masks]
    blanks = F.array(*[F.array(*[_long(((1 << 64) - 1) ^ sum(c)) for c in combinations(bits, distance)]) for bits in free])
    forms = (members.where(F.col("n") > paired).select("f", F.explode(blanks[F.col("c")]).alias("blank"))
             .select("f", "blank", F.col("f").bitwiseAND(F.col("blank")).alias("form")).distinct())
    alike = forms.groupBy("blank", "form").agg(F.collect_set("f").alias("fs")).where(F.size("fs") > 1)
    many = alike.select(F.array_min("fs").alias("src"), F.explode("fs").alias("dst")).where("src <> dst")
    return few.unionByName(many).distinct()


def near_copies(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text: str = "text",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, fingerprint and component_id of every row.

    component_id is the smallest id that a chain of links reaches; rows with equal fingerprints are
    linked. Repeated rows keep their number. A NULL id is no candidate for the smallest one.
    """
    rows = durable(fingerprints(docs, shingle, text, (id_col, *keep)))
    low = rows.groupBy("fingerprint").agg(F.min(id_col).alias("_low"))
    group = weak_components(links(rows, distance)).select(F.col("node").alias("fingerprint"), F.col("component").alias("_group"))
    linked = durable(low.join(group, "fingerprint"))
    lowest = linked.groupBy("_group").agg(F.min("_low").alias("_best"))
    named = linked.join(lowest, "_group").select("fingerprint", "_best")
    # written, so that both sides of the join below are plain exchanges and a hot fingerprint's rows are split
    values = durable(low.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("_best", "_low").alias("component_id")))
    return rows.join(values, "fingerprint").select(id_col, *keep, "fingerprint", "component_id")


def as_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id; of repeated rows one, of different
    texts under one id in one group the one with the smaller hash. Rows without an id are all kept, as no
    id can name them."""
    print_ = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    named = docs.where(F.col(id_col).isNotNull())
    found = near_copies(named.withColumn("_text_hash", print_), shingle, distance, id_col, text, ("_text_hash",))
    best = found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col, "component_id").agg(F.min("_text_hash").alias("_text_hash"))
    keep = best.select(id_col, "_text_hash").distinct()
    kept = named.withColumn("_text_hash", print_).join(keep, [id_col, "_text_hash"], "left_semi").dropDuplicates([id_col, "_text_hash"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
