"""Reproducible sharding: a Feistel permutation of global row numbers gives every row a shard and a slot.

Only DataFrame functions. Rows are numbered in the order of their key; the number runs through a
Feistel network over a grid that is barely larger than the table and walks on while it falls outside.
Shard and slot are remainder and quotient of the result, so shard sizes differ by one row at most, a
shard's slots have no gaps, and both directions are plain arithmetic: ``place_of`` and ``row_at``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.llm.common import row_numbers

ROUNDS = 6
#: Outside the grid's table lies less than one number in its side; so many steps never suffice only with
#: a probability below 2^-384, and for tables under 4,096 rows they always do.
WALK = 64


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest nearly square grid that holds ``n`` numbers."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _round(x: Column, i: int, seed: int, side: int) -> Column:
    return F.pmod(F.xxhash64(x, F.lit(i), F.lit(seed)), F.lit(side))


def _forward(x: Column, a: int, b: int, seed: int) -> Column:
    left = F.pmod(x, F.lit(a))
    pair = F.struct(left.alias("l"), ((x - left) / F.lit(a)).cast("bigint").alias("r"))
    for i in range(ROUNDS):
        pair = _step(pair, i, a, b, seed, 1)
    return _let(pair, lambda p: p["l"] + p["r"] * F.lit(a))


def _backward(y: Column, a: int, b: int, seed: int) -> Column:
    left = F.pmod(y, F.lit(a))
    pair = F.struct(left.alias("l"), ((y - left) / F.lit(a)).cast("bigint").alias("r"))
    for i in reversed(range(ROUNDS)):
        pair = _step(pair, i, a, b, seed, -1)
    return _let(pair, lambda p: p["l"] + p["r"] * F.lit(a))


def _let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _step(pair: Column, i: int, a: int, b: int, seed: int, sign: int) -> Column:
    """Even rounds move the left half by a hash of the right one, odd rounds the other way round."""
    def move(p):
        if i % 2 == 0:
            return F.struct(F.pmod(p["l"] + F.lit(sign) * _round(p["r"], i, seed, a), F.lit(a)).alias("l"), p["r"].alias("r"))
        return F.struct(p["l"].alias("l"), F.pmod(p["r"] + F.lit(sign) * _round(p["l"], i, seed, b), F.lit(b)).alias("r"))
    return _let(pair, move)


def _walked(x: Column, n: int, seed: int, turn) -> Column:
    a, b = grid(n)
    one = turn(x, a, b, seed)
    if a * b == n:
        return one
    walk = lambda y: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), y, lambda z, _: F.when(z < n, z).otherwise(turn(z, a, b, seed)))
    checked = lambda y: _let(walk(y), lambda z: F.when(z < n, z).otherwise(F.raise_error(F.lit("the walk did not end")).cast("bigint")))
    return _let(one, lambda y: F.when(y < n, y).otherwise(checked(y)))


def permuted(row: Column, n: int, seed: int = 0) -> Column:
    """Place of row number ``row`` among ``n`` shuffled rows."""
    return _walked(row.cast("bigint"), n, seed, _forward)


def restored(place: Column, n: int, seed: int = 0) -> Column:
    """The row number at a place: the inverse of ``permuted``."""
    return _walked(place.cast("bigint"), n, seed, _backward)


def place_of(row: Column, n: int, shards: int, seed: int = 0) -> Column:
    """(shard, slot) of a row number."""
    return _let(permuted(row, n, seed), lambda p: F.struct(
        F.pmod(p, F.lit(shards)).cast("int").alias("shard"),
        ((p - F.pmod(p, F.lit(shards))) / F.lit(shards)).cast("bigint").alias("slot")))


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int = 0) -> Column:
    """The row number that lies at a slot of a shard; NULL beyond the shard's end."""
    place = slot.cast("bigint") * F.lit(shards) + shard.cast("bigint")
    return F.when(place < n, restored(place, n, seed))


def shard(df: DataFrame, key: str, shards: int, tie: list[Column] = (), seed: int = 0) -> DataFrame:
    """``df`` with row_no, shard and slot (law: rows). The order of ``key`` and ``tie`` fixes the numbers;
    rows equal in both are interchangeable. An empty table stays empty; a NULL key sorts first."""
    if shards < 1:
        raise ValueError("shards must be positive")
    numbered = row_numbers(df, [], [F.col(key), *tie])
    n = numbered.count()
    if n == 0:
        return numbered.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint")})
    return numbered.withColumn("_at", place_of(F.col("row_no"), n, shards, seed)).select(
        *numbered.columns, F.col("_at.shard").alias("shard"), F.col("_at.slot").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no of every document.

    A NULL text has size 8 and the checksum of empty text. Only sizes and checksums are shuffled, never
    texts. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.xxhash64(text).alias("_h"))
    out = shard(slim, "doc_id", shards, [F.col("size"), F.col("text_crc32"), F.col("_h")], seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "row_no")
