"""Packing token pieces into windows by multiway differencing.

Every document is tokenised once. Whole windows are cut off its front and stand alone; the rest is cut
into pieces of at most a quarter window. Pieces are dealt evenly into groups, or into stretches of a given order, and each
group is split over as few windows as its tokens need by the largest-differencing method: two partial partitions with the largest spreads are merged,
the fullest window of one with the emptiest of the other. While a window exceeds the capacity, the
group gets one window more.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeline.llm.common import pieces as pieces_of
from slopeline.llm.common import row_numbers, utf8
from slopeline.llm.token_counts import SETTLED, Merges
from slopeline.session import durable

CACHE = 400_000
#: Fixed value: how the vocabulary's library splits lower-cased text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class Ids:
    """Token ids of texts, word by word: the vocabulary drops white space and joins nothing across it.

    Words new to the cache are merged together by the vocabulary's ranks; a word with characters beyond
    Latin, or a special string, goes to the vocabulary's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self.split = regex.compile(PATTERN + "|\n").findall
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special)) or "(?!)").search
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        """Ids of new words; none holds white space."""
        text = b"\n".join(words).decode()
        if SETTLED.search(text) is not None or self.special(text) is not None:
            odd = [w for w in words if SETTLED.search(t := w.decode()) is not None or self.special(t) is not None]
            for w, e in zip(odd, self.library.encode_batch([w.decode() for w in odd], add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()
            words = [w for w in words if w not in self.known]
            text = b"\n".join(words).decode()
        # a line each for parts of words; the break between two words is a part too and leaves two empty lines
        data = np.frombuffer("\n".join(self.split(text.lower())).encode(), np.uint8)
        brk = np.flatnonzero(data == 10)
        lens = np.diff(brk, prepend=-1, append=len(data)) - 1
        word = (np.cumsum(lens == 0) // 2)[lens > 0]
        ids, n = self.merges.ids(data[data != 10], lens[lens > 0])
        each = np.bincount(word, n, len(words)).astype(np.int64)
        raw = ids.astype("<u4").tobytes()
        ends = (4 * np.cumsum(each)).tolist()
        self.known.update(zip(words, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=False))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit values."""
        split = [t.split() for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        missing = set(chain.from_iterable(split)) - self.known.keys()
        if missing:
            self.learn(list(missing))
        ids = self.known.__getitem__
        return [b"".join(map(ids, words)) for words in split]


def token_pieces(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, text: str = "text", order: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and the columns ``order``: documents with an end id, cut after each full window
    and what remains into pieces of a quarter window, which even out far better. NULL text is empty and gives the end id alone; every document has at least one piece."""
    slim = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), *order)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in order)
    end = np.array([end_id], "<u4").tobytes()
    rest = max(1, window // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw = memoryview(data)
            row, start, length, crc, total = [], [], [], [], []
            each = (x for a, b in pieces_of(offsets, 1 << 22) for x in ids([bytes(raw[offsets[j]:offsets[j + 1]]) for j in range(a, b)]))
            for i, out in enumerate(each):
                out += end
                n = len(out) // 4
                whole = n - n % window
                cuts = [*range(0, whole, window), *range(whole, n, rest), n]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    row.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(out[4 * a:4 * b]))
                    total.append(n)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), *(c.take(at) for c in batch.columns[2:])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *order])

    return slim.mapInArrow(run, f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint{more}")


def differencing(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Sizes split over ``k`` windows: (sum, items) of the windows in use, fullest first.

    A partial partition is kept as its windows in use, fullest first; the others are empty. Merging
    adds the fullest windows of one to the emptiest of the other, so windows only meet when both
    together use more than ``k``.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)] if k > 1 else []
    if k <= 1:
        return [(sum(sizes), list(range(len(sizes))))] if sizes else []
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        # b's fullest windows land on empty ones while there are any, the others on a's emptiest in turn
        low = min(len(b), k - len(a))
        meet = len(b) - low
        both = [(a[len(a) - 1 - j][0] + b[low + j][0], a[len(a) - 1 - j][1] + b[low + j][1]) for j in range(meet)]
        merged = sorted([*a[:len(a) - meet], *b[:low], *both], key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, tick, merged))
        tick += 1
    return heap[0][2] if heap else []


def fitted(sizes: list[int], window: int) -> list[tuple[int, list[int]]]:
    """Windows of at most ``window``: one more window whenever the fullest exceeds it."""
    k = max(1, math.ceil(sum(sizes) / window))
    while True:
        parts = differencing(sizes, k)
        if not parts or parts[0][0] <= window:
            return parts
        k += 1


def pack(pieces: DataFrame, window: int = 2048, group_rows: int = 1024, order: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` (length within the window) with sequence_id and offset; window_tokens is the sum of its sequence.

    Groups hold about ``group_rows`` rows whatever the documents' ids, lengths and copies, since rows are
    dealt by their place in the written table. With ``order``, columns that are dropped, groups are stretches of
    that order, then of start, and a group's sequences are numbered by their first piece, so the sequences follow it. An empty table stays empty.
    """
    if order:
        # written before they are numbered, which reads its rows twice
        kept = row_numbers(durable(pieces), [], [F.col(c) for c in (*order, "start")], "_place").drop(*order)
        group = F.floor(F.col("_place") / group_rows)
    else:
        kept = durable(pieces.withColumn("_place", F.monotonically_increasing_id()))
        group = F.pmod(F.xxhash64("_place"), F.lit(max(1, math.ceil(kept.count() / group_rows))))
    fields = kept.drop("_place").schema
    names = fields.names
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["sequence_id bigint", "offset bigint", "window_tokens bigint"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_place", ignore_index=True)
        size = rows["length"].to_numpy()
        sequence, offset, filled = (np.zeros(len(rows), np.int64) for _ in range(3))
        whole = np.flatnonzero(size == window)
        sequence[whole], filled[whole] = np.arange(len(whole)), window
        rest = np.flatnonzero(size < window)
        for w, (total, items) in enumerate(fitted(size[rest].tolist(), window), len(whole)):
            at = rest[items]
            sequence[at], filled[at] = w, total
            offset[at] = np.cumsum(size[at]) - size[at]
        if order:
            first = np.unique(sequence, return_index=True)[1]
            sequence = np.argsort(np.argsort(first))[sequence]
        return rows[names].assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset, window_tokens=filled)

    return kept.withColumn("_group", group).groupBy("_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, window: int = 2048, order: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece of every document with its sequence; see ``token_pieces`` and ``pack``. With ``order``, columns of
    ``docs``, the sequences follow the documents in that order."""
    return pack(token_pieces(docs, path, window, order=order), window, order=order)
