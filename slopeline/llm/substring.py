"""Removal of passages that occur more than once: a count-min prefilter, then exact groups.

A window is a stretch of consecutive words. Its anchor is the smallest hash among the short word runs
inside it, so equal windows have equal anchors at equal offsets, and neighbouring windows share one.

1. Each task counts anchors in a count-min sketch of its own (counts above one are all the same). The sketches
   are merged by slices. A window's count is at most that of its anchor, and that at most what the merged
   sketch says, so no repeated window is lost.
2. A second pass over the texts hashes (to 128 bits) only windows whose anchor is estimated repeated. A
   task that sees a window twice knows it is repeated; it sends one mark for it, so a passage that
   millions of documents share is one row per task. Windows seen once go to a hash bucket with their
   place and come back if the bucket holds them again.
3. Places are gathered per document, and words they cover go.

The merged sketch is sent to all workers: its size follows the bytes of text up to ``MAX_BITS``. Beyond
that it lets more unrepeated windows through to step 2, which stays exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeline.llm.common import Spans, mixed, pieces, utf8, word_spans

ANCHOR_WORDS = 12
#: Cells per sketch row, as a power of two: at most 64 MB of bits a row.
MIN_BITS, MAX_BITS, SLICE_BITS = 20, 29, 20
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Windows or anchors that a task gathers before it sends them on; bytes of text for each bucket.
UNIT, BUCKET_BYTES = 400_000, 12_000_000
#: Key of a text (two numbers), word number, and hash of a window (two numbers).
KINDS = ("<i8", "<i4", "<i4", "<u8", "<u8")


class Windows:
    """Windows of a piece of texts: hashes, anchors, and which starts are windows at all."""

    def __init__(self, width: int):
        self.width, self.short = width, min(ANCHOR_WORDS, width)
        self.first, self.second = Spans(0xD6E8FEB86659FD93), Spans(0xA0761D6478BD642F)
        self.runs, self.wide, self.check = Spans(0xE7037ED1A0B428DB), Spans(0x8EBC6AF09C88C6E3), Spans(0x589965CC75374CC3)

    def read(self, data: np.ndarray, offsets: np.ndarray) -> bool:
        """False if no text has a window."""
        starts, ends, self.doc = word_spans(data, offsets)
        n, w = len(starts), self.width
        if n < w:
            return False
        last = np.repeat(self.doc[1:], np.diff(self.doc))
        at = np.arange(n)
        self.start = np.flatnonzero(at + w <= last)
        if not len(self.start):
            return False
        self.words = self.first(data, starts, ends)
        self.data, self.spans = data, (starts, ends)
        runs = self.runs(self.words, at[:n - self.short + 1], at[self.short - 1:] + 1)
        # the run with the smallest hash, the leftmost of equals
        low = (runs >> np.uint64(32) << np.uint64(32)) | at[:len(runs)].astype(np.uint64)
        need, have = w - self.short + 1, 1
        while have < need:
            step = min(have, need - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        self.place = (low[self.start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(self.place), bool)
        new[1:] = self.place[1:] != self.place[:-1]
        self.which = np.cumsum(new) - 1
        self.anchors = runs[self.place[new]]
        return True

    def hashes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the chosen windows, from two independent hashes of every word."""
        a = self.start[chosen]
        return self.wide(self.words, a, a + self.width), self.check(self.second(self.data, *self.spans), a, a + self.width)

    def owner(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and word number of the chosen windows."""
        a = self.start[chosen]
        text = np.searchsorted(self.doc, a, "right") - 1
        return text, a - self.doc[text]


def cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(anchors ^ np.uint64(SEEDS[row])) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(slim: DataFrame, width: int, bits: int) -> list[np.ndarray]:
    """For each row of the merged sketch, packed bits of the cells counted twice or more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, gathered, size = Windows(width), [], 0

        def sent() -> pa.RecordBatch:
            found = np.concatenate(gathered)
            rows, slices, content = [], [], []
            for row in range(len(SEEDS)):
                cell, n = np.unique(cells(found, row, bits), return_counts=True)
                packed = ((cell & ((1 << SLICE_BITS) - 1)) << 1 | (n > 1)).astype("<u4")
                part = cell >> SLICE_BITS
                edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
                for a, b in zip(edge, edge[1:], strict=False):
                    rows.append(row)
                    slices.append(int(part[a]))
                    content.append(packed[a:b].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(slices, pa.int32()), pa.array(content, pa.binary())],
                                              names=["line", "slice", "cells"])

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in pieces(offsets):
                if windows.read(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]):
                    gathered.append(windows.anchors)
                    size += len(windows.anchors)
                if size >= UNIT:
                    yield sent()
                    gathered, size = [], 0
        if size:
            yield sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, part, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count = total.setdefault((row, part), np.zeros(1 << SLICE_BITS, np.uint8))
                x = np.frombuffer(content, "<u4")
                count[x >> 1] = np.minimum(count[x >> 1] + 1 + (x & 1), 2)
        for (row, part), count in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([part], pa.int32()),
                                              pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())],
                                             names=["line", "slice", "cells"])

    schema = "line int, slice int, cells binary"
    merged = slim.select("_text").mapInArrow(count, schema).repartition("line", "slice").mapInArrow(merge, schema)
    out = [np.zeros(max(1, 1 << bits - 3), np.uint8) for _ in SEEDS]
    step = 1 << SLICE_BITS - 3
    for r in merged.toLocalIterator():  # at most 2 x 2^MAX_BITS bits in all
        out[r.line][r.slice * step:(r.slice + 1) * step] = np.frombuffer(r.cells, np.uint8)
    return out


def repeated_places(slim: DataFrame, width: int) -> DataFrame:
    """_k1, _k2, places: for each text (``_k1``, ``_k2``, ``_text``) packed word numbers where a window
    starts that starts elsewhere too; one row for a text that has any."""
    size = slim.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(1, size / 20)))))
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    shared = slim.sparkSession.sparkContext.broadcast(sketch(slim, width, bits))
    schema = "bucket bigint, k1 binary, k2 binary, place binary, h1 binary, h2 binary"
    names = ["bucket", "k1", "k2", "place", "h1", "h2"]

    def rows(bucket: list[int], groups: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [pa.array([np.ascontiguousarray(g[i], k).tobytes() for g in groups], pa.binary()) for i, k in enumerate(KINDS)]
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *columns], names=names)

    def split(part: np.ndarray, *values: np.ndarray) -> tuple[list[int], list[tuple[np.ndarray, ...]]]:
        """Values by ``part``, keeping their order within a part."""
        order = np.argsort(part, kind="stable")
        part = part[order]
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, int)
        values = [v[order] for v in values]
        spans = list(zip(edge, edge[1:], strict=False))
        return [int(part[a]) for a, _ in spans], [tuple(v[a:b] for v in values) for a, b in spans]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, lines, gathered, many = Windows(width), shared.value, [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            k1, k2, place, h1, h2 = (np.concatenate(x) for x in zip(*gathered, strict=True))
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            group = np.cumsum(new) - 1
            again = np.bincount(group)[group] > 1
            twice = np.zeros(len(order), bool)
            twice[order] = again
            if twice.any():  # found here: straight to their documents
                part = -1 - (k1[twice].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                at, groups = split(part, k1[twice], k2[twice], place[twice])
                yield rows(at, [(*g, g[0][:0], g[0][:0]) for g in groups])
            mark = order[new & again]  # one mark for each window found here
            once = np.flatnonzero(~twice)
            send = np.concatenate([once, mark])
            spot = np.concatenate([place[once], np.full(len(mark), -1, place.dtype)])
            yield rows(*split((h1[send] % np.uint64(buckets)).astype(np.int64), k1[send], k2[send], spot, h1[send], h2[send]))

        for batch in batches:
            key1, key2 = (np.asarray(batch.column(i)) for i in (1, 2))
            data, offsets = utf8(batch.column(0))
            for i, j in pieces(offsets):
                if not windows.read(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]):
                    continue
                seen = np.ones(len(windows.anchors), bool)
                for row, line in enumerate(lines):
                    c = cells(windows.anchors, row, bits)
                    seen &= (line[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
                chosen = np.flatnonzero(seen[windows.which])
                if len(chosen):
                    text, place = windows.owner(chosen)
                    gathered.append((key1[i:j][text], key2[i:j][text], place.astype(np.int32), *windows.hashes(chosen)))
                    many += len(chosen)
                if many >= UNIT:
                    yield from sent()
                    gathered, many = [], 0
        if many:
            yield from sent()

    def read(table: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(table.column(n).to_pylist()), k) for n, k in zip(names[1:], KINDS, strict=True)]

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        """Places of a bucket that are repeated, packed by where their texts' places are gathered."""
        k1, k2, place, h1, h2 = read(table)
        if (bucket := key[0].as_py()) < 0:
            return pa.Table.from_batches([rows([-1 - bucket], [(k1, k2, place, h1, h2)])])
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        hit = np.zeros(len(order), bool)
        group = np.cumsum(new) - 1
        hit[order] = (np.bincount(group) > 1)[group]
        hit &= place >= 0  # a mark stands for places that its own task has reported
        at, groups = split((k1[hit].view(np.uint64) % np.uint64(buckets)).astype(np.int64), k1[hit], k2[hit], place[hit])
        return pa.Table.from_batches([rows(at, [(*g, h1[:0], h2[:0]) for g in groups])])

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        k1, k2, place, _, _ = read(table)
        order = np.lexsort((place, k2, k1))
        k1, k2, place = k1[order], k2[order], place[order]
        edge = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]), [True]])) if len(k1) else np.zeros(1, int)
        first = edge[:-1]
        return pa.table({"_k1": pa.array(k1[first], pa.int64()), "_k2": pa.array(k2[first], pa.int32()),
                         "places": pa.array([place[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary())})

    found = slim.select("_text", "_k1", "_k2").mapInArrow(search, schema)
    return found.groupBy("bucket").applyInArrow(settle, schema).groupBy("bucket").applyInArrow(gather, "_k1 bigint, _k2 int, places binary")


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_words, n_removed and kept_text (kept words joined by one space).

    A word goes if a window covers it whose word sequence also starts anywhere else in the input, in the
    same text or another. NULL and short texts have no windows. Rows are told apart by id and text; rows
    equal in both are copies of each other, so their windows are repeated. Columns of ``docs`` with the
    names of the new ones are replaced.
    """
    new = ["n_words", "n_removed", "kept_text"]
    docs = docs.drop(*new)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(body.alias("_text"), F.xxhash64(id_col, text).alias("_k1"), F.hash(text, id_col).alias("_k2"))
    places = repeated_places(slim, width)
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(id_col, text).alias("_k1"), F.hash(text, id_col).alias("_k2"))
    joined = keyed.join(places, ["_k1", "_k2"], "left").select("_row", "places")
    at, names = docs.columns.index(text), [*docs.columns, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            data, offsets = utf8(columns[at])
            raw = memoryview(data)
            total, gone, kept = [], [], []
            for i, places in enumerate(batch.column(1).to_pylist()):
                words = bytes(raw[offsets[i]:offsets[i + 1]]).split()
                total.append(len(words))
                if places:
                    start = np.unique(np.frombuffer(places, "<i4"))
                    cover = np.zeros(len(words) + 1, np.int64)
                    cover[start] += 1
                    np.subtract.at(cover, start + width, 1)
                    stay = np.cumsum(cover)[:-1] == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                             names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{kinds}, n_words bigint, n_removed bigint, kept_text string")

