"""Approximate nearest neighbours by inner product: one robust-pruned directed graph per shard.

Vectors are dealt to shards of bounded size by a hash. A shard gets one more coordinate that makes all
its norms equal, so that the largest inner product is the smallest distance. Its graph grows in doubling
batches: greedy searches of the graph so far propose neighbours, relaxed distance pruning keeps diverse
ones, and kept edges are added backwards and pruned again. Graphs are written once. Every query runs a
beam search in every shard, in blocks of queries; the best of all shards are scored on the original
vectors in double precision.

Equal vectors are one node with the smallest ids of its rows, as many as a result can name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopeline.llm.vectors import float_kind, lengths, matrix, packed, unpacked, whole
from slopeline.session import durable

#: Nodes of a shard, queries of a block.
SHARD_ROWS, QUERY_ROWS = 8192, 2048
#: Out-edges, beam and relaxation while building; nodes a search expands at once; searches side by side.
DEGREE, BUILD_BEAM, RELAX, STEP, SIDE = 32, 64, 1.2, 4, 256


def beam_search(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest nodes found (-1 where fewer) and their squared distances, nearest first.

    Searches run side by side. Each keeps its best nodes, expands the nearest unexpanded ones and ends when
    all it keeps are expanded. ``graph``: neighbours by row, -1 for none.
    """
    n, q = len(x), len(queries)
    norm = (x ** 2).sum(1)
    ids = np.full((q, beam), -1, np.int64)
    far = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)  # the last column stands for no node
    seen[:, n] = True
    start = np.unique(entry)[:beam]
    ids[:, :len(start)] = start
    far[:, :len(start)] = norm[start] - 2 * queries @ x[start].T
    done[:, :len(start)] = False
    seen[:, start] = True
    live = np.arange(q)
    while len(live):
        open_ = np.where(done[live], np.inf, far[live])
        pick = np.argpartition(open_, STEP, axis=1)[:, :STEP] if beam > STEP else np.tile(np.arange(beam), (len(live), 1))
        good = np.isfinite(np.take_along_axis(open_, pick, 1))
        done[live[:, None], pick] = True
        node = np.where(good, ids[live[:, None], pick], -1)
        next_ = np.where(node[:, :, None] >= 0, graph[node], -1).reshape(len(live), -1)
        next_ = np.where(next_ < 0, n, next_)
        next_.sort(axis=1)
        fresh = ~seen[live[:, None], next_]
        fresh[:, 1:] &= next_[:, 1:] != next_[:, :-1]
        seen[live[:, None], next_] = True
        row, col = np.nonzero(fresh)
        new = np.full(next_.shape, np.inf, np.float32)
        if len(row):
            node = next_[row, col]
            new[row, col] = norm[node] - 2 * np.einsum("ij,ij->i", x[node], queries[live[row]])
        width = max(1, int(fresh.sum(1).max()) if len(row) else 1)
        if width < new.shape[1]:
            order = np.argpartition(new, width - 1, axis=1)[:, :width]
            new, next_ = np.take_along_axis(new, order, 1), np.take_along_axis(next_, order, 1)
        all_far = np.concatenate([far[live], new], 1)
        all_ids = np.concatenate([ids[live], np.where(np.isfinite(new), next_, -1)], 1)
        all_done = np.concatenate([done[live], ~np.isfinite(new)], 1)
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        far[live], ids[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_far, all_ids, all_done))
        live = live[~done[live].all(1)]
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1) + (queries ** 2).sum(1)[:, None]


def robust_prune(x: np.ndarray, nodes: np.ndarray, options: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Neighbours of ``nodes`` among ``options`` (-1: none): the nearest stays and drops those that are
    ``relax`` times nearer to it than to the node, and so on."""
    options = np.where(options == nodes[:, None], -1, options)
    options = np.sort(options, axis=1)
    options[:, 1:][options[:, 1:] == options[:, :-1]] = -1
    y = x[options]
    d = ((y - x[nodes][:, None, :]) ** 2).sum(2)
    d[options < 0] = np.inf
    order = np.argsort(d, axis=1)
    d, options = np.take_along_axis(d, order, 1), np.take_along_axis(options, order, 1)
    y = np.take_along_axis(y, order[:, :, None], 1)
    square = (y ** 2).sum(2)
    between = square[:, :, None] + square[:, None, :] - 2 * y @ y.transpose(0, 2, 1)
    drops = relax * relax * between <= d[:, None, :]
    out = np.full((len(nodes), degree), -1, np.int64)
    left = np.isfinite(d)
    rows = np.arange(len(nodes))
    for k in range(degree):
        if not left.any():
            break
        first = left.argmax(1)
        some = left[rows, first]
        out[some, k] = options[rows, first][some]
        left &= ~drops[rows, first]
        left[rows, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours by node, entry nodes) of one shard."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    # rows come in a random order: the first ones are a random sample; the middle-most of them starts all searches
    head = x[:1024]
    entry = np.array([((head - x.mean(0)) ** 2).sum(1).argmin()])
    order = np.concatenate([entry, np.delete(np.arange(n), entry[0])])
    at = 1
    while at < n:
        batch = order[at:min(n, at + max(1, min(at, 512)))]
        found = np.concatenate([beam_search(x, graph, entry, x[batch[i:i + SIDE]], beam)[0] for i in range(0, len(batch), SIDE)])
        # neighbours inside the batch are proposed too, else early batches never see each other
        if len(batch) > 1:
            d = (x[batch] ** 2).sum(1)[None, :] - 2 * x[batch] @ x[batch].T
            np.fill_diagonal(d, np.inf)
            k = min(8, len(batch) - 1)
            found = np.concatenate([found, batch[np.argpartition(d, k - 1, axis=1)[:, :k]]], 1)
        for i in range(0, len(batch), SIDE):
            graph[batch[i:i + SIDE]] = robust_prune(x, batch[i:i + SIDE], found[i:i + SIDE], degree, relax)
        src, dst = np.repeat(batch, degree), graph[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        sort = np.argsort(dst, kind="stable")
        src, dst = src[sort], dst[sort]
        edge = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1], [True]]))
        back, many = dst[edge[:-1]], np.diff(edge)
        place = np.arange(len(dst)) - np.repeat(edge[:-1], many)
        keep = place < 4 * degree
        options = np.full((len(back), degree + min(4 * degree, int(many.max()))), -1, np.int64)
        options[:, :degree] = graph[back]
        options[np.repeat(np.arange(len(back)), many)[keep], degree + place[keep]] = src[keep]
        full = (options >= 0).sum(1) > degree
        fits = np.sort(options[~full], axis=1)[:, ::-1][:, :degree]
        graph[back[~full]] = fits
        tight = np.flatnonzero(full)
        for i in range(0, len(tight), SIDE):
            part = tight[i:i + SIDE]
            graph[back[part]] = robust_prune(x, back[part], options[part], degree, relax)
        at += len(batch)
    return graph, entry


def nodes_of(df: DataFrame, id_col: str, vector: str, dim: int, named: int) -> DataFrame:
    """vec, ids: distinct whole vectors of length ``dim`` with the ``named`` smallest ids of their rows.

    The limit per vector applies before the shuffle, so a vector that a third of the rows hold sends a
    few rows per task.
    """
    rows = df.where(whole(F.col(vector)) & (F.size(vector) == F.lit(dim))).select(F.col(id_col).alias("id"), F.col(vector).alias("vec"))
    rank = F.row_number().over(Window.partitionBy("vec").orderBy(F.col("id").asc_nulls_last()))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= named)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def lifted(vec: np.ndarray) -> np.ndarray:
    """Vectors scaled to a largest norm of 1, with the coordinate that makes all norms equal to it."""
    top = np.abs(vec).max()
    vec = vec / top
    vec = vec / np.sqrt((vec ** 2).sum(1).max())
    return np.concatenate([vec, np.sqrt(np.maximum(0, 1 - (vec ** 2).sum(1)))[:, None]], 1).astype(np.float32)


def aimed(vec: np.ndarray) -> np.ndarray:
    """Queries beside ``lifted`` vectors: their length doesn't matter."""
    vec = vec / np.abs(vec).max(1, keepdims=True)
    vec = vec / np.sqrt((vec ** 2).sum(1, keepdims=True))
    return np.concatenate([vec, np.zeros((len(vec), 1))], 1).astype(np.float32)


def build_index(nodes: DataFrame, dim: int, kind: str, shards: int) -> DataFrame:
    """shard, uid, vec, edges, entry: the graph of every shard as packed arrays, one row each, written once."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), packed(matrix(b.column(1), dim), kind)], names=["uid", "vec"])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        uid = np.asarray(table.column("uid"))
        order = np.argsort(uid)[np.random.default_rng(0).permutation(len(uid))]
        vec = unpacked(table.column("vec"), dim, kind)[order]
        graph, entry = build_graph(lifted(vec))
        cell = lambda x, k: pa.array([np.ascontiguousarray(x, k).tobytes()], pa.binary())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "uid": cell(uid[order], "<i8"), "vec": cell(vec, kind),
                         "edges": cell(graph, "<i4"), "entry": pa.array([int(entry[0])], pa.int32())})

    flat = nodes.select("uid", "vec").mapInArrow(pack, "uid bigint, vec binary")
    dealt = flat.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
    return durable(dealt.groupBy("shard").applyInArrow(build, "shard int, uid binary, vec binary, edges binary, entry int"))


def search_index(index: DataFrame, queries: DataFrame, dim: int, kind: str, shards: int, beam: int, wanted: int) -> DataFrame:
    """query, uid, score: for each query (query, vec) the ``wanted`` best nodes its beam search finds in every shard."""
    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query": [np.zeros(0, np.int64)], "uid": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
        if left.num_rows and right.num_rows:
            uid = np.frombuffer(left.column("uid")[0].as_py(), "<i8")
            vec = np.frombuffer(left.column("vec")[0].as_py(), kind).reshape(-1, dim).astype(np.float64)
            graph = np.frombuffer(left.column("edges")[0].as_py(), "<i4").reshape(len(uid), -1).astype(np.int64)
            x, entry = lifted(vec), np.array([left.column("entry")[0].as_py()])
            name = np.asarray(right.column("query"))
            asked = matrix(right.column("vec").combine_chunks(), dim).astype(np.float64)
            k = min(wanted, beam, len(uid))
            for i in range(0, len(name), SIDE):
                part = asked[i:i + SIDE]
                found, _ = beam_search(x, graph, entry, aimed(part), beam)
                row, col = np.nonzero(found >= 0)
                node = found[row, col]
                score = np.full(found.shape, -np.inf)
                score[row, col] = np.einsum("ij,ij->i", part[row], vec[node])
                best = np.lexsort((uid[np.maximum(found, 0)], -score), axis=-1)[:, :k]
                row, col = np.nonzero(np.isfinite(np.take_along_axis(score, best, 1)))
                col = best[row, col]
                out["query"].append(name[i:i + SIDE][row])
                out["uid"].append(uid[found[row, col]])
                out["score"].append(score[row, col])
        return pa.table({c: pa.array(np.concatenate(x)) for c, x in out.items()})

    blocks = max(1, math.ceil(queries.count() / QUERY_ROWS))
    at = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return graphs.groupBy("shard", "block").cogroup(at.groupBy("shard", "block")).applyInArrow(search, "query bigint, uid bigint, score double")


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, beam: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the ``k`` rows of ``df`` with the largest inner products found for each row of
    ``queries``, itself excluded by its id; ties go to the smaller id.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components are neither found nor searched for;
    the others meet vectors of their own length. Rows of one id count as one candidate. Rows without an id take
    no part. Scores are inner products of the stored vectors in double precision.
    """
    kind, id_type = float_kind(df, vector), df.schema[id_col].dataType.simpleString()
    df, queries = df.where(F.col(id_col).isNotNull()), queries.where(F.col(id_col).isNotNull())
    out = [_nearest_of_length(df, queries, k, beam, id_col, vector, dim, kind) for dim in lengths(df, vector)]
    none = df.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, {id_col} {id_type}, score double")
    return reduce(DataFrame.unionByName, out) if out else none


def _nearest_of_length(df: DataFrame, queries: DataFrame, k: int, beam: int, id_col: str, vector: str, dim: int, kind: str) -> DataFrame:
    # uids rise with the smallest id of a node, so that cuts among equal scores keep the smallest ids
    nodes = nodes_of(df, id_col, vector, dim, k + 1).withColumn("low", F.col("ids")[0])
    shuffles = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nodes = nodes.repartitionByRange(shuffles, "low").sortWithinPartitions("low").drop("low")
    nodes = durable(nodes.withColumn("uid", F.monotonically_increasing_id()))
    shards = max(1, math.ceil(nodes.count() / SHARD_ROWS))
    index = build_index(nodes, dim, kind, shards)
    # equal query vectors are searched once
    asked = queries.where(whole(F.col(vector)) & (F.size(vector) == F.lit(dim))).select(F.col(id_col).alias("query_id"), F.col(vector).alias("vec")).distinct()
    vectors = durable(asked.select("vec").distinct().withColumn("query", F.monotonically_increasing_id()))
    found = search_index(index, vectors.select("query", "vec"), dim, kind, shards, max(beam, k + 1), k + 1)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "uid"))
    found = found.withColumn("place", best).where(F.col("place") <= k + 1)
    named = found.join(nodes.select("uid", F.explode("ids").alias("id")), "uid").select("query", "id", "score").dropDuplicates(["query", "id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out = asked.join(vectors, "vec").join(named, "query").where(F.col("id") != F.col("query_id")).withColumn("rank", rank)
    return out.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
