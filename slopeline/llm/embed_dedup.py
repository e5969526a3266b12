"""All links between vectors above a cosine, by a pigeonhole over subspaces.

Unit vectors with cosine c lie at squared distance 2 - 2c. After a rotation the coordinates are cut into
blocks. If a pair exceeded in every block the share of that distance which is in proportion to the
block's dimensions, it would exceed the whole; so linked vectors are near each other in at least one
block. In each block a range join finds candidates: pivots cut the block into cells, a vector resides in
the cell of its nearest pivot and visits each other cell whose border is within the block's radius. The
union of the candidates is verified by the cosine of the original vectors in double precision.

Equal vectors are one row with a weight. Distinct vectors are written once, as plain arrays in the shared folder, and
cut into chunks. A task maps one chunk and holds a run of others against it, cell by cell in every block, so vectors
are not shuffled to the cells they visit and the disk grows with the vectors alone. A task sends back link counts
and a spanning set of links, never its pairs. Vectors without structure are hard for any exact join: cells then hold
back little, and the work is that of blocked products.
"""

from __future__ import annotations

import math
import os
import shutil
import uuid
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.llm.vectors import float_kind, lengths, matrix, whole
from slopeline.operators.graph import weak_components
from slopeline.session import durable, shared_folder

#: Vectors for each pivot, most pivots, most rows of a chunk and of those that a task holds against it, side of a tile.
PIVOT_ROWS, MAX_PIVOTS, CHUNK, SPLIT, TILE = 4096, 2048, 16_384, 65_536, 1024
#: A table has about so many chunks at least, unless they would be below so many rows; most components of a chunk and most tasks.
CHUNKS, SMALL_CHUNK, CHUNK_VALUES, TASKS = 24, 1024, 1 << 22, 20_000
#: Room for rounding; it only adds candidates.
SLACK = 1e-5


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation, which spreads differences evenly over the coordinates."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    # scaled first: squares of very large or small components leave the range
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's connected part."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Blocks:
    """The cut of rotated vectors into blocks, their radii and pivots."""

    def __init__(self, dim: int, cosine: float, count: int, sample: np.ndarray, pivots: int, seed: int):
        cuts = [dim * i // count for i in range(count + 1)]
        self.spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        self.turn = rotation(dim, seed)
        self.share = [(2 - 2 * cosine) * (b - a) / dim + SLACK for a, b in self.spans]
        turned = unit(sample) @ self.turn
        self.pivots = [self._spread(turned[:, a:b], pivots, math.sqrt(s)) for (a, b), s in zip(self.spans, self.share, strict=True)]

    @staticmethod
    def _spread(rows: np.ndarray, count: int, apart: float) -> np.ndarray:
        """Rows of the sample no two of which lie within ``apart``, as long as there are any."""
        chosen = [rows[0]]
        near = ((rows - rows[0]) ** 2).sum(1)
        while len(chosen) < count and (far := np.flatnonzero(near > apart ** 2)).size:
            chosen.append(rows[far[0]])
            near = np.minimum(near, ((rows - rows[far[0]]) ** 2).sum(1))
        return np.array(chosen)

    def cells(self, k: int, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The home cells in block ``k``, and by cell the rows that visit it from a cell of larger number."""
        (a, b), p = self.spans[k], self.pivots[k]
        square = (p ** 2).sum(1)
        twice = 2 * np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * p @ p.T, 1e-12))
        home, visit = np.zeros(len(turned), np.int64), np.zeros((len(p), len(turned)), bool)
        for i in range(0, len(turned), TILE):
            x = turned[i:i + TILE, a:b]
            d = (x ** 2).sum(1)[:, None] + square[None, :] - 2 * x @ p.T
            h = d.argmin(1)
            border = (d - d[np.arange(len(x)), h][:, None]) / twice[h]
            home[i:i + TILE] = h
            visit[:, i:i + TILE] = ((border <= math.sqrt(self.share[k]) + SLACK) & (np.arange(len(p))[None, :] < h[:, None])).T
        return home, visit

    def owner(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The first block in which pairs of turned rows are near."""
        near = [((left[:, a:b] - right[:, a:b]) ** 2).sum(1) <= s for (a, b), s in zip(self.spans, self.share, strict=True)]
        return np.argmax(np.array(near), axis=0)


def write_chunks(vectors: DataFrame, dim: int, kind: str, folder: str) -> DataFrame:
    """``vectors`` (vec, weight and others) without vec, with a uid. Each task appends its vectors and weights to a file of its
    own; the uid is the number of the task's attempt, which names the file, and the row in it."""
    rest = [c for c in vectors.columns if c != "vec"]
    at = rest.index("weight")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n = TaskContext.get().taskAttemptId(), 0
        for batch in batches:
            if batch.num_rows:
                for end, rows in (("vec", np.ascontiguousarray(matrix(batch.column(0), dim), kind)), ("weight", np.asarray(batch.column(1 + at)).astype("<i8"))):
                    with open(f"{folder}/{name}.{end}", "ab") as file:
                        file.write(rows.tobytes())
                uid = (name << 32) + np.arange(n, n + batch.num_rows, dtype=np.int64)
                n += batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(uid), *batch.columns[1:]], names=["uid", *rest])

    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in rest)
    return durable(vectors.select("vec", *rest).mapInArrow(write, f"uid bigint, {kinds}"))


Stretch = tuple[int, int, int]


def cut_files(files: list[tuple[int, int]], rows: int) -> list[list[Stretch]]:
    """Chunks of ``rows`` rows, the last one shorter, as stretches (file, first row, end) of the files (name, rows)."""
    out: list[list[Stretch]] = []
    room = 0
    for name, n in files:
        first = 0
        while first < n:
            if not room:
                out.append([])
                room = rows
            end = min(n, first + room)
            out[-1].append((name, first, end))
            room -= end - first
            first = end
    return out


class Chunk:
    """A chunk's rows as a task sees them, and their links: how many, and spanning ones."""

    def __init__(self, cut: Blocks, folder: str, chunk: list[Stretch], dim: int, kind: str):
        self.cut = cut
        self.uid = np.concatenate([(name << 32) + np.arange(a, b) for name, a, b in chunk])
        self.weight = np.concatenate([np.memmap(f"{folder}/{name}.weight", "<i8", "r")[a:b] for name, a, b in chunk])
        self.rows = unit(stored(folder, chunk, dim, kind))
        self.turned = self.rows @ cut.turn
        self.n = np.zeros(len(self.uid), np.int64)
        self.sides: dict[int, tuple] = {}

    def side(self, k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Of block ``k`` both factors of the squared distances, the residents of each cell and its visitors."""
        if k not in self.sides:
            a, b = self.cut.spans[k]
            low = self.turned[:, a:b].astype(np.float32)
            square = (low ** 2).sum(1)[:, None]
            # one product gives the squared distances: (x, |x|^2, 1) . (-2y, 1, |y|^2)
            one = np.ones_like(square)
            home, visit = self.cut.cells(k, self.turned)
            order = np.argsort(home, kind="stable")
            edge = np.searchsorted(home[order], np.arange(1, len(visit)))
            self.sides[k] = np.hstack([low, square, one]), np.hstack([-2 * low, one, square]), np.split(order, edge), visit
        return self.sides[k]


def stored(folder: str, chunk: list[Stretch], dim: int, kind: str) -> np.ndarray:
    return np.concatenate([np.memmap(f"{folder}/{name}.vec", kind, "r").reshape(-1, dim)[a:b] for name, a, b in chunk])


def meet(cut: Blocks, cosine: float, left: Chunk, right: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Counts the links between two chunks, or within one, and returns a spanning set of them as pairs of uids."""
    same = left is right
    uid = left.uid if same else np.concatenate([left.uid, right.uid])
    first, second = [], []

    def tile(k: int, x: Chunk, s: np.ndarray, y: Chunk, t: np.ndarray, upper: bool) -> None:
        near = np.flatnonzero(x.side(k)[0][s] @ y.side(k)[1][t].T <= np.float32(cut.share[k] + 10 * SLACK))
        i, j = np.divmod(near, len(t))
        if upper:
            i, j = i[i < j], j[i < j]
        for z in range(0, len(i), 1 << 16):
            p, q = s[i[z:z + (1 << 16)]], t[j[z:z + (1 << 16)]]
            linked = np.einsum("ij,ij->i", x.rows[p], y.rows[q]) >= cosine
            p, q = p[linked], q[linked]
            mine = cut.owner(x.turned[p], y.turned[q]) == k
            p, q = p[mine], q[mine]
            if not len(p):
                continue
            np.add.at(x.n, p, y.weight[q])
            np.add.at(y.n, q, x.weight[p])
            nodes, place = np.unique(np.concatenate([p + (0 if x is left else len(left.uid)), q + (0 if y is left else len(left.uid))]), return_inverse=True)
            low, high = spanning(len(nodes), place[:len(p)], place[len(p):])
            first.append(nodes[low])
            second.append(nodes[high])

    def product(k: int, x: Chunk, s: np.ndarray, y: Chunk, t: np.ndarray) -> None:
        for i in range(0, len(s), TILE):
            part = s[i:i + TILE]
            step = TILE * TILE // len(part)
            for j in range(0, len(t), step):
                tile(k, x, part, y, t[j:j + step], False)

    for k in range(len(cut.spans)):
        (_, _, ours, our_visits), (_, _, theirs, their_visits) = left.side(k), right.side(k)
        for c, (s, t) in enumerate(zip(ours, theirs, strict=True)):
            if same:
                for i in range(0, len(s), TILE):
                    tile(k, left, s[i:i + TILE], left, s[i:i + TILE], True)
                    product(k, left, s[i:i + TILE], left, s[i + TILE:])
            if len(s):
                product(k, left, s, right, np.flatnonzero(their_visits[c]))
            if len(t) and not same:
                product(k, left, s, right, t)
                product(k, right, t, left, np.flatnonzero(our_visits[c]))
    p, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second))
    low, high = spanning(len(uid), p, q)
    return uid[low], uid[high]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the smallest of its connected part."""
    label = parts(n, a, b)
    far = np.flatnonzero(label != np.arange(n))
    return label[far], far


def partners(chunks: int, base: int, first: int, end: int) -> list[int]:
    """Of the chunks at or behind ``base`` on a ring those ``first`` to ``end``; every pair of chunks has one base."""
    half = chunks // 2
    return [(base + o) % chunks for o in range(first, min(end, half + 1)) if chunks % 2 or o < half or base < half]


def found_links(vectors: DataFrame, folder: str, dim: int, kind: str, cosine: float, blocks: int = 4, sample: int = 16_384, seed: int = 7) -> DataFrame:
    """uid, n, other: weighted link counts (``other`` NULL) and links that span each connected part (n 0), written.

    ``vectors``: the rows of ``write_chunks`` in ``folder``, of one length. One row for each of its files comes to the driver,
    and a sample for the pivots.
    """
    files = sorted((r.name, r.n) for r in vectors.groupBy(F.shiftright("uid", 32).alias("name")).agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in files)
    chunks = cut_files(files, min(CHUNK, max(SMALL_CHUNK, min(CHUNK_VALUES // dim, -(-total // CHUNKS)))))
    some = np.eye(1, dim)
    if total:
        picked = np.unique(np.random.default_rng(seed).integers(total, size=sample)) if total > sample else np.arange(total)
        ends = np.cumsum([n for _, n in files])
        file = np.searchsorted(ends, picked, "right")
        starts = ends - [n for _, n in files]
        some = np.concatenate([np.memmap(f"{folder}/{files[f][0]}.vec", kind, "r").reshape(-1, dim)[picked[file == f] - starts[f]] for f in np.unique(file)])
        some = some[np.random.default_rng(seed).permutation(len(some))]
    cut = Blocks(dim, cosine, min(blocks, dim), some, min(MAX_PIVOTS, max(1, math.ceil(total / PIVOT_ROWS))), seed)
    n = len(chunks)
    run = max(1, SPLIT // sum(b - a for _, a, b in chunks[0])) if n else 1
    units = n * -(-(n // 2 + 1) // run)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                base, first = number % n, number // n * run
                left = Chunk(cut, folder, chunks[base], dim, kind)
                for other in partners(n, base, first, first + run):
                    right = left if other == base else Chunk(cut, folder, chunks[other], dim, kind)
                    low, high = meet(cut, cosine, left, right)
                    yield links(low, np.zeros(len(low), np.int64), pa.array(high))
                    if right is not left:
                        yield counts(right)
                yield counts(left)

    spark = vectors.sparkSession
    return durable(spark.range(0, units, 1, max(1, min(units, TASKS))).mapInArrow(work, "uid bigint, n bigint, other bigint"))


def counts(chunk: Chunk) -> pa.RecordBatch:
    some = np.flatnonzero(chunk.n)
    return links(chunk.uid[some], chunk.n[some], pa.nulls(len(some), pa.int64()))


def links(uid: np.ndarray, n: np.ndarray, other: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(n, pa.int64()), other], names=["uid", "n", "other"])


def _known(rows: DataFrame, dim: int, kind: str, cosine: float, blocks: int) -> DataFrame:
    """key, n, best: links and smallest reached id of the vectors of one length; written, so that both sides of a
    join with it are plain exchanges and a hot vector's rows are split."""
    spark = rows.sparkSession
    place = urlparse(shared_folder(spark))
    if place.scheme not in ("", "file"):
        raise ValueError("the vectors need a shared folder that workers can map into memory")
    folder = os.path.join(unquote(place.path), f"slopeline-{spark.sparkContext.applicationId}", f"vectors-{uuid.uuid4().hex}")
    os.makedirs(folder)
    distinct = rows.groupBy("vec").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("low"))
    distinct = write_chunks(distinct.withColumn("key", vector_key("vec")), dim, kind, folder)
    found = found_links(distinct, folder, dim, kind, cosine, blocks)
    shutil.rmtree(folder)
    number = found.groupBy(F.col("uid").alias("u")).agg(F.sum("n").alias("n"))
    group = weak_components(found.where("other IS NOT NULL").select(F.col("uid").alias("src"), F.col("other").alias("dst")))
    named = distinct.join(group.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    best = named.groupBy("component").agg(F.min("low").alias("best"))
    named = named.join(best, "component").join(number, F.col("uid") == F.col("u"), "left")
    return durable(named.select("key", "best", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n")))


def vector_key(vector: str) -> Column:
    """128 bits that stand for a vector where only equality counts."""
    return F.struct(F.xxhash64(vector).alias("a"), F.xxhash64(F.lit(1), vector).alias("b"))


def near_vectors(df: DataFrame, cosine: float = 0.9, blocks: int = 4, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept of every row, repeated rows included.

    n_links counts the other rows whose cosine is at least ``cosine``; component_id is the smallest id
    reached by links; kept marks that row. Vectors that are NULL, empty, zero or hold NULL or non-finite
    components link with nothing: they have 0 links and their own id; the others link with vectors of their
    own length. A NULL id is never the smallest; where a component has no other, component_id is NULL. Other
    columns are not read.
    """
    if not 0 < cosine < 1:
        raise ValueError("the cosine must lie between 0 and 1")
    kind = float_kind(df, vector)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("vec"), whole(F.col(vector)).alias("take"))
    parts = [_known(rows.where("take").where(F.size("vec") == dim), dim, kind, cosine, blocks) for dim in lengths(df, vector) or [1]]
    known = reduce(DataFrame.unionByName, parts)
    out = rows.where("take").select("id", vector_key("vec").alias("key")).join(known, "key").select("id", "n", "best").unionByName(
        rows.where(~F.col("take")).select("id", F.lit(0).cast("bigint").alias("n"), F.col("id").alias("best")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("best").alias("component_id"),
                      F.coalesce(F.col("id") == F.col("best"), F.lit(False)).alias("kept"))
