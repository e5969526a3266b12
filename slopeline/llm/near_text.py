"""Groups of texts whose sets of word shingles agree: SimHash and MinHash candidates, then exact Jaccard.

A text is the set of its shingles of five lower-cased words; a shorter text is one shingle. Two texts are
linked if the sets' Jaccard similarity is at least 4/5. Candidates come from SimHash (``simhash.links``: texts
whose fingerprints chains of at most ``DISTANCE`` differing bits connect), which finds the lightest edits. Pairs near
0.8 differ in some ten of the 64 bits, so texts are also listed under ``BANDS`` hashes of
``ROWS`` minima each and meet their candidates there: a pair at 0.8 shares no band with a probability of
(1 - 0.8^4)^32 = 5e-8, closer pairs more rarely. Every candidate pair is then measured by its sets.

A bucket with many members is not paired up at once: all are measured against its smallest member first.
Members that the links so far leave outside the bucket's largest group are then measured against all others,
piece by piece within tasks, which return spanning links only. Pieces grow with the product of the two counts.

Shingles and texts count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.llm import simhash
from slopeline.llm.common import Spans, mixed, pieces, utf8, word_spans
from slopeline.llm.simhash import PAIRED
from slopeline.operators.graph import weak_components
from slopeline.session import durable

SHINGLE, BANDS, ROWS = 5, 32, 4
#: Bits in which the fingerprints of candidates may differ.
DISTANCE = 2
#: Members of large buckets that are compared at once with as many others; shingles in one dense table.
PIECE, SLAB = 512, 4096
#: Multipliers and offsets of the minima's hash functions.
FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
OFFSETS = mixed(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


class Shingles:
    """Distinct shingle hashes of a piece of texts."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle = shingle
        self.words, self.runs = Spans(0xD6E8FEB86659FD93), Spans(0xE7037ED1A0B428DB)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, ascending within each text, and for each text the number of its first one."""
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        starts, ends, doc = word_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        text = np.repeat(np.arange(len(doc) - 1), np.diff(doc))
        at = np.arange(len(starts))
        first = (at + self.shingle <= doc[text + 1]) | (at == doc[text])
        at, text = at[first], text[first]
        x = self.runs(self.words(data, starts, ends), at, np.minimum(at + self.shingle, doc[text + 1]))
        order = np.lexsort((x, text))
        x, text = x[order], text[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (text[1:] != text[:-1])
        return x[new], np.searchsorted(text[new], np.arange(len(doc)))


def bands(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of band hashes for every text; all texts have shingles."""
    out = np.zeros((len(first) - 1, BANDS), np.uint64)
    for k, (a, b) in enumerate(zip(FACTORS, OFFSETS, strict=True)):
        out[:, k // ROWS] = mixed(out[:, k // ROWS] + np.minimum.reduceat(x * a + b, first[:-1]))
    return out


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def signatures(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """Kept columns, ``key`` (a hash of the lower-cased words), ``fingerprint`` (SimHash of the five-word shingles), ``n``
    (distinct shingles) and ``bands`` of every whole text; NULL and wordless texts have no bands."""
    keep = list(keep)
    slim = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            data, offsets = utf8(batch.column(len(keep)))
            raw = memoryview(data)
            texts = [bytes(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            keys = [xxhash.xxh3_64_intdigest(b" ".join(x.lower().split())) for x in texts]
            prints = [simhash.fingerprint(x, SHINGLE) for x in texts]
            counts, found = [], []
            for i, j in pieces(offsets):
                x, first = shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                n = np.diff(first)
                counts.append(n)
                if len(x):
                    found.append(bands(x, np.concatenate([first[:-1][n > 0], first[-1:]])))
            n = np.concatenate([np.zeros(0, np.int64), *counts])
            flat = np.concatenate([np.zeros((0, BANDS), np.uint64), *found]).ravel()
            lists = _lists(flat, np.concatenate([[0], np.cumsum((n > 0) * BANDS)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(prints, pa.int64()),
                                              pa.array(n, pa.int64()), lists], names=[*keep, "key", "fingerprint", "n", "bands"])

    return slim.mapInArrow(run, f"{_kinds(docs, keep)}, key bigint, fingerprint bigint, n bigint, bands array<bigint>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """key and ``x``, the distinct shingle hashes, for each row of key and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets):
                x, first = shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(x, first)], names=["key", "x"])

    return texts.mapInArrow(run, "key bigint, x array<bigint>")


def _sizes_allow(n: str, m: str) -> Column:
    """Sets of these sizes can agree to 4/5."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def close_prints(values: DataFrame, paired: int = PAIRED) -> DataFrame:
    """src, dst: pairs of ``key`` that connect exactly those whose fingerprints chains of at most DISTANCE differing bits
    connect. ``values``: key and fingerprint."""
    lead = durable(values.groupBy("fingerprint").agg(F.min("key").alias("lead")))
    same = values.join(lead, "fingerprint").where("key <> lead").select(F.col("lead").alias("src"), F.col("key").alias("dst"))
    across = simhash.links(lead, DISTANCE, paired)
    for end in ("src", "dst"):
        across = across.join(lead.select(F.col("fingerprint").alias(end), F.col("lead").alias(f"_{end}")), end)
    return same.unionByName(across.select(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst")))


def links(rows: DataFrame, docs: DataFrame, id_cols: list[str], text: str = "text", paired: int = PAIRED) -> DataFrame:
    """src, dst: links between values of ``key`` that connect exactly those that chains of pairs with a
    similarity of 4/5 connect. ``rows``: signatures; ``docs``: the same rows with their texts, matched by ``id_cols``."""
    values = durable(rows.where(F.size("bands") > 0).dropDuplicates(["key"]).select("key", "fingerprint", "n", "bands"))
    listed = values.select("key", "n", F.posexplode("bands").alias("c", "v"))
    shared = listed.groupBy("c", "v").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("lead"), F.min_by("n", "key").alias("lead_n")).where("size > 1")
    members = durable(listed.join(shared, ["c", "v"]))
    a = members.where(F.col("size") <= paired).select("c", "v", F.col("key").alias("src"), F.col("n").alias("n_src"))
    b = a.withColumnsRenamed({"src": "dst", "n_src": "n_dst"})
    few = a.join(b, ["c", "v"]).where((F.col("src") < F.col("dst")) & _sizes_allow("n_src", "n_dst")).select("src", "dst")
    large = members.where(F.col("size") > paired)
    star = large.where((F.col("lead") < F.col("key")) & _sizes_allow("lead_n", "n")).select(F.col("lead").alias("src"), F.col("key").alias("dst"))
    near = close_prints(values.select("key", "fingerprint"), paired)
    found = _measured(durable(near.unionByName(few).unionByName(star).distinct()), rows, docs, id_cols, text)
    if large.isEmpty():
        return found
    group = weak_components(found).select(F.col("node").alias("key"), "component")
    named = durable(large.select("c", "v", "key").join(group, "key", "left").withColumn("component", F.coalesce("component", "key")))
    # of each large bucket the largest group; the others' members are all that is left to measure
    sizes = named.groupBy("c", "v", "component").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.groupBy("c", "v").agg(F.max_by("component", F.struct("size", "component")).alias("top"), F.max("size").alias("in_top"), F.sum("size").alias("all"))
    parts = lambda n: F.ceil(n / PIECE).cast("int")
    open_ = named.join(top.where("in_top < all"), ["c", "v"]).select(
        "c", "v", "key", (F.col("component") == F.col("top")).alias("inside"), parts(F.col("in_top")).alias("t"), parts(F.col("all") - F.col("in_top")).alias("m"))
    # parts 0 to t - 1 hold the largest group, t to t + m - 1 the others; a piece is two parts, not both of the largest group
    h = F.xxhash64("key", F.lit(1))
    part = F.when(F.col("inside"), F.pmod(h, F.col("t"))).otherwise(F.col("t") + F.pmod(h, F.col("m"))).cast("int")
    other = F.explode(F.sequence(F.when(F.col("inside"), F.col("t")).otherwise(F.lit(0)), F.col("t") + F.col("m") - 1))
    dealt = durable(open_.withColumn("p", part).withColumn("q", other).select("c", "v", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "key"))
    sets = _sets(dealt.select("key").distinct(), rows, docs, id_cols, text)
    across = dealt.join(sets, "key").groupBy("c", "v", "i", "j").applyInArrow(_spanning, "src bigint, dst bigint")
    return found.unionByName(durable(across.distinct()))


def _spanning(piece: pa.Table) -> pa.Table:
    """Of the pairs of a piece's first and second part whose sets agree to 4/5, as many as connect what all of them do."""
    keys, p = piece["key"].to_numpy(), piece["p"].to_numpy()
    lists = piece["x"].combine_chunks()
    n = np.asarray(lists.value_lengths())
    _, code, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(n)), n)
    # only shingles of several members count; SLAB of them at a time are a dense table
    number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[code]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    a, b = np.flatnonzero(p == p.min()), np.flatnonzero(p == p.max())
    same = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(number[-1]) + 1, SLAB):
        i, j = np.searchsorted(number, [low, low + SLAB])
        table = np.zeros((len(n), SLAB), np.float32)
        table[owner[i:j], number[i:j] - low] = 1
        same += table[a] @ table[b].T
    u, v = np.nonzero((9 * same >= 4 * (n[a][:, None] + n[b][None, :])) & (a[:, None] != b[None, :]))
    root, links_ = list(range(len(n))), []
    for x, y in zip(a[u].tolist(), b[v].tolist(), strict=True):
        r, t = x, y
        while root[r] != r:
            root[r] = r = root[root[r]]
        while root[t] != t:
            root[t] = t = root[root[t]]
        if r != t:
            root[r] = t
            links_.append((x, y))
    ends = keys[np.array(links_, np.int64).reshape(-1, 2)]
    return pa.table({"src": ends.min(1), "dst": ends.max(1)}, schema=pa.schema({"src": pa.int64(), "dst": pa.int64()}))


def _sets(wanted: DataFrame, rows: DataFrame, docs: DataFrame, id_cols: list[str], text: str) -> DataFrame:
    """key and shingle hashes of the wanted keys, each from one text."""
    one = rows.join(wanted, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*id_cols)).alias("_id")).select("key", "_id.*")
    texts = docs.select(*id_cols, F.col(text).cast("string").alias("_text")).join(one, id_cols).dropDuplicates(["key"]).select("key", "_text")
    return durable(shingle_sets(texts))


def _measured(pairs: DataFrame, rows: DataFrame, docs: DataFrame, id_cols: list[str], text: str) -> DataFrame:
    """Those pairs whose sets agree to 4/5."""
    sets = _sets(pairs.select(F.explode(F.array("src", "dst")).alias("key")).distinct(), rows, docs, id_cols, text)
    both = pairs.join(sets.select(F.col("key").alias("src"), "x"), "src").join(sets.select(F.col("key").alias("dst"), F.col("x").alias("y")), "dst")
    same = F.size(F.array_intersect("x", "y"))
    return durable(both.where(9 * same >= 4 * (F.size("x") + F.size("y"))).select("src", "dst"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", paired: int = PAIRED) -> DataFrame:
    """``docs`` with one row of each group of linked texts: that with the smallest id; of repeated rows one, of
    different texts under one id in one group the one with the smaller hash. Texts with the same words are
    linked, wordless ones with each other. Rows without an id are all kept, as no id can name them."""
    named = docs.where(F.col(id_col).isNotNull()).withColumn("_text_hash", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    rows = durable(signatures(named, (id_col, "_text_hash"), text))
    group = weak_components(links(rows, named, [id_col, "_text_hash"], text, paired)).select(F.col("node").alias("key"), F.col("component").alias("_group"))
    # of each text the smallest row, then of each group the smallest of these
    low = rows.groupBy("key").agg(F.min(F.struct(id_col, "_text_hash")).alias("_low")).join(group, "key", "left")
    alone = low.where("_group IS NULL").select("_low.*")
    together = low.where("_group IS NOT NULL").groupBy("_group").agg(F.min("_low").alias("_low")).select("_low.*")
    keep = durable(alone.unionByName(together))
    kept = named.join(keep, [id_col, "_text_hash"], "left_semi").dropDuplicates([id_col, "_text_hash"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
