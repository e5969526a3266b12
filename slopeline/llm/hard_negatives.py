"""Hard negatives by zone maps over blocks along a Hilbert curve.

Integer vectors are ordered by label and by their place on a Hilbert curve through the coordinates that vary
most, and written as Parquet rows of some hundred vectors each, a block, with the least and greatest value of
every dimension. Interval arithmetic over those zones bounds every inner product of an anchor with a block. A
block is read for an anchor only if its bounds meet one of the anchor's score windows: everything from the
known fifth best upwards for positives, and 0.8 to 1 times a positive's score for its negatives.

Groups of anchors meet zones, and chosen blocks, in tiles of bounded size; a tile keeps the best few of each
window and sends on no more. Vectors without structure have wide zones: then nearly all blocks are chosen, and
the work is that of blocked products of the anchors with all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeline.session import durable

#: Rows of a block, blocks that are read together, zones that are looked through together, anchors of a group,
#: groups of a split. Two megabytes of vectors of 64 small components lie in 32 blocks.
BLOCK, READ, ZONES, GROUP, SPLIT = 512, 256, 16_384, 1_024, 16
#: Coordinates on the curve and bits of each; together one long.
AXES, BITS = 8, 8
#: Vector lengths whose rows are ordered along a curve; rows of further lengths are ordered by id.
CURVES = 64
#: Products below this are exact in double precision.
EXACT = float(1 << 53)
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of cell numbers below 2^bits; columns times bits are 64 at most.

    The coordinates are turned in place from the highest bit down, then Gray coded and interleaved."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        p = q - one
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(set_, p, swap)
            if i:
                x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        turn ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def bounds(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row with vectors inside each box."""
    up, down = np.maximum(rows, 0), np.minimum(rows, 0)
    return product(up, lo) + product(down, hi), product(up, hi) + product(down, lo)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; in double precision where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _small(rows: np.ndarray) -> tuple[bytes, str]:
    most = int(np.abs(rows).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return np.ascontiguousarray(rows, kind).tobytes(), kind


def _read(data: bytes, kind: str, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.int64).reshape(n, dim)


def _longs(values) -> bytes:
    return np.ascontiguousarray(values, "<i8").tobytes()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _integers(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per vector length: the places of its rows and the rows floor(256 x)."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, start = np.asarray(vectors.values, np.float64), vectors.offsets.to_numpy()[:-1]
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        rows = flat[start[at][:, None] + np.arange(dim)]
        yield at, np.clip(np.floor(256.0 * rows), LOWEST, HIGHEST).astype(np.int64)


def _spread(rows: DataFrame) -> dict[int, tuple[list[int], list[float], list[float]]]:
    """Per vector length: the coordinates of most variance, with their means and deviations.

    Tasks send sums per coordinate, so the driver gets one row per coordinate of the commonest lengths."""
    schema = pa.schema([("dim", pa.int32()), ("axis", pa.int32()), ("n", pa.int64()), ("s", pa.float64()), ("q", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for at, x in _integers(batch.column(0)):
                x = x.astype(np.float64)
                one = sums.setdefault(x.shape[1], [0, 0.0, 0.0])
                one[:] = one[0] + len(at), one[1] + x.sum(0), one[2] + (x * x).sum(0)
        yield _batch([(d, i, n, float(s[i]), float(q[i])) for d, (n, s, q) in sums.items() for i in range(d)], schema)

    met = rows.select("vector").mapInArrow(work, "dim int, axis int, n bigint, s double, q double").groupBy("dim", "axis").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    spread = met.select("dim", "axis", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("dev"))
    best = Window.partitionBy("dim").orderBy(F.desc("dev"), "axis")
    top = spread.withColumn("place", F.row_number().over(best)).where(F.col("place") <= AXES)
    found: dict[int, tuple] = {}
    for r in top.orderBy(F.desc("n"), "dim", "place").limit(AXES * CURVES).collect():
        for values, v in zip(found.setdefault(r.dim, ([], [], [])), (r.axis, r.mean, r.dev), strict=True):
            values.append(v)
    return found


BLOCKS = pa.schema([
    ("part", pa.int64()), ("idx", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("first_label", pa.int64()), ("last_label", pa.int64()),
    ("lo", pa.binary()), ("hi", pa.binary()), ("kind", pa.string()), ("rows", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()),
    ("asks", pa.binary())])
BLOCKS_SQL = ("part bigint, idx bigint, dim int, n int, first_label bigint, last_label bigint, lo binary, hi binary, kind string, rows binary, "
              "ids binary, labels binary, asks binary")


def blocks(rows: DataFrame) -> DataFrame:
    """The written blocks of ``rows`` (vec_id, label, vector, asks) with dense numbers ``block``.

    Rows are dealt by ranges of (length, label, place on the curve, id); numbers come from one count per range.
    """
    axes = _spread(rows)
    middle = 1 << (BITS - 1)
    keyed = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("asks", pa.bool_()), ("dim", pa.int32()), ("place", pa.int64()),
                       ("kind", pa.string()), ("row", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            for at, x in _integers(batch.column(2)):
                key = np.zeros(len(at), np.int64)
                axis, mean, dev = axes.get(x.shape[1], ((), (), ()))
                if len(axis):
                    # three deviations to either side fill the cells
                    cell = np.floor((x[:, axis] - np.array(mean)) / np.maximum(np.array(dev), 1e-9) * middle / 3) + middle
                    key = (hilbert(np.clip(cell, 0, 2 * middle - 1), BITS) ^ np.uint64(1 << 63)).view(np.int64)
                packed = [_small(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(labels[at]), pa.array(asks[at]), pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array(key),
                     pa.array([k for _, k in packed], pa.string()), pa.array([r for r, _ in packed], pa.binary())], schema=keyed)

    on_curve = rows.select("vec_id", "label", "vector", "asks").mapInArrow(
        place, "vec_id bigint, label bigint, asks boolean, dim int, place bigint, kind string, row binary")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ("dim", "label", "place", "vec_id")
    dealt = on_curve.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        idx = 0

        def block():
            dim, part = held[0][3], held[0][6]
            x = np.stack([np.frombuffer(r[5], r[4]).astype(np.int64) for r in held]).reshape(len(held), dim)
            ids, labels = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64)
            asks = np.array([r[2] for r in held], bool)
            # rows of a block lie by id, so that a stable sort by score breaks ties
            by_id = np.argsort(ids, kind="stable")
            data, kind = _small(x[by_id])
            return (part, idx, dim, len(held), int(labels.min()), int(labels.max()), _longs(x.min(0)), _longs(x.max(0)), kind, data,
                    _longs(ids[by_id]), _longs(labels[by_id]), asks[by_id].tobytes())

        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) >= BLOCK or row[3] != held[0][3]):
                    done.append(block())
                    idx += 1
                    held.clear()
                held.append(row)
            if done:
                yield _batch(done, BLOCKS)
        if held:
            yield _batch([block()], BLOCKS)

    written = durable(dealt.select("vec_id", "label", "asks", "dim", "kind", "row", "part").mapInArrow(cut, BLOCKS_SQL))
    # one row per range
    starts, total = [(-1, 0)], 0
    for r in written.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r.part, total))
        total += r.n
    first = rows.sparkSession.createDataFrame(starts, "part bigint, before bigint")
    return written.join(F.broadcast(first), "part").withColumn("block", F.col("before") + F.col("idx")).drop("part", "idx", "before")


GROUPS = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("kind", pa.string()), ("rows", pa.binary()), ("ids", pa.binary()),
                    ("labels", pa.binary()), ("bar", pa.binary())])


def anchor_groups(parts: DataFrame, positives: int) -> DataFrame:
    """Groups of anchors along the curve, with ``bar``: the score that as many rows of the anchor's own block
    and label reach as it wants positives, so that nothing below it needs reading."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def group():
            rows = np.stack([r[0] for r in held])
            data, kind = _small(rows)
            return _batch([(rows.shape[1], len(held), kind, data, *(_longs([r[i] for r in held]) for i in (1, 2, 3)))], GROUPS)

        for batch in batches:
            for dim, n, kind, data, ids, labels, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = _read(data, kind, dim, n)
                ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                for i in np.flatnonzero(np.frombuffer(asks, bool)):
                    scores = product(x[i:i + 1], x[(labels == labels[i]) & (ids != ids[i])])[0]
                    bar = int(np.partition(scores, len(scores) - positives)[len(scores) - positives]) if len(scores) >= positives else LOWEST
                    if held and (len(held) >= GROUP or held[0][0].shape[0] != dim):
                        yield group()
                        held.clear()
                    held.append((x[i], int(ids[i]), int(labels[i]), bar))
        if held:
            yield group()

    # blocks without an anchor send nothing
    found = parts.select("dim", "n", "kind", "rows", "ids", "labels", "asks").mapInArrow(
        work, "dim int, n int, kind string, rows binary, ids binary, labels binary, bar binary")
    return durable(found.withColumn("g", F.monotonically_increasing_id()))


class _Anchors:
    """A group of anchors with its score windows: [low, high] per anchor and window, in a table of one row per
    anchor; windows that are not used have low above high."""

    def __init__(self, row: dict, same: bool):
        self.g, self.dim, n = row["g"], row["dim"], row["n"]
        self.rows = _read(row["rows"], row["kind"], self.dim, n)
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.same = same
        if same:
            self.partners = np.zeros((n, 1), np.int64)
            self.low, self.high = np.frombuffer(row["bar"], "<i8")[:, None].copy(), np.full((n, 1), HIGHEST)
        else:
            found = row["windows"] or []
            wide = max((w["w"] for w in found), default=-1) + 1
            self.partners = np.zeros((n, wide), np.int64)
            self.low, self.high = np.full((n, wide), HIGHEST), np.full((n, wide), LOWEST)
            for w in found:
                at = w["i"], w["w"]
                self.partners[at], self.low[at], self.high[at] = w["partner"], w["low"], w["high"]

    def wanted(self, dim, lo, hi, first_label, last_label, low=None) -> np.ndarray:
        """Anchor x box: whether the bounds meet a window and the labels allow a partner."""
        least, most = bounds(self.rows, lo, hi)
        low = self.low if low is None else low
        mine = self.labels[:, None]
        fit = (first_label <= mine) & (mine <= last_label) if self.same else (first_label != mine) | (last_label != mine)
        fit = fit & (dim == self.dim)
        meets = np.zeros_like(fit)
        for w in range(low.shape[1]):
            meets |= (most >= low[:, w:w + 1]) & (least <= self.high[:, w:w + 1])
        return fit & meets


def chosen_blocks(groups: DataFrame, parts: DataFrame, same: bool, n_blocks: int, n_groups: int) -> DataFrame:
    """(g, s, c, picks): per anchor group, the blocks of each chunk of ``READ`` whose zones meet a window of one
    of its anchors. Zones meet groups in tiles of at most ``ZONES`` by about ``SPLIT`` groups."""
    chunks, splits = -(-n_blocks // ZONES), max(1, -(-n_groups // SPLIT))
    split = F.pmod(F.xxhash64("g"), F.lit(splits))
    left = groups.withColumn("s", split).withColumn("z", F.explode(F.expr(f"sequence(0L, {max(chunks - 1, 0)}L)")))
    zones = parts.select("block", "dim", "first_label", "last_label", "lo", "hi").withColumn("z", F.floor(F.col("block") / ZONES)).withColumn(
        "s", F.explode(F.expr(f"sequence(0L, {splits - 1}L)")))
    schema = pa.schema([("g", pa.int64()), ("s", pa.int64()), ("c", pa.int64()), ("picks", pa.list_(pa.int64()))])

    def work(key, mine: pa.Table, zone: pa.Table) -> pa.Table:
        out = []
        if mine.num_rows and zone.num_rows:
            groups_ = [_Anchors(r, same) for r in mine.to_pylist()]
            dims = zone["dim"].to_numpy()
            numbers, first, last = (zone[c].to_numpy() for c in ("block", "first_label", "last_label"))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                lo, hi = (_read(b"".join(zone[c].take(pa.array(at)).to_pylist()), "<i8", dim, len(at)) for c in ("lo", "hi"))
                for a in groups_:
                    if a.dim != dim:
                        continue
                    hit = [at[j:j + 1024][a.wanted(dim, lo[j:j + 1024], hi[j:j + 1024], first[at[j:j + 1024]], last[at[j:j + 1024]]).any(0)]
                           for j in range(0, len(at), 1024)]
                    picks = np.sort(numbers[np.concatenate(hit)])
                    for c in np.unique(picks // READ):
                        out.append((a.g, key[1].as_py(), int(c), picks[picks // READ == c].tolist()))
        return pa.Table.from_batches([_batch(out, schema)])

    return left.groupBy("z", "s").cogroup(zones.groupBy("z", "s")).applyInArrow(work, "g bigint, s bigint, c bigint, picks array<bigint>")


def _better(score: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n along the last axis: greatest score, then smallest id."""
    order = np.lexsort((ids, -score), axis=-1)[..., :n]
    return np.take_along_axis(score, order, -1), np.take_along_axis(ids, order, -1)


def _scan(a: _Anchors, block: dict, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Update the best scores and ids (anchor x window x n) of the anchors ``which`` with a block."""
    n = score.shape[2]
    x, theirs = _read(block["rows"], block["kind"], block["dim"], block["n"]), np.frombuffer(block["ids"], "<i8")
    labels = np.frombuffer(block["labels"], "<i8")
    got = product(a.rows[which], x)
    mine = a.labels[which][:, None]
    allowed = (labels == mine) & (theirs != a.ids[which][:, None]) if a.same else labels != mine
    got = np.where(allowed, got, LOWEST - 1)
    order = np.argsort(-got, axis=1, kind="stable")
    got = np.take_along_axis(got, order, 1)
    for w in range(a.low.shape[1]):
        begin = (got > a.high[which, w][:, None]).sum(1)
        at = begin[:, None] + np.arange(n)
        inside = at < got.shape[1]
        at = np.minimum(at, got.shape[1] - 1)
        s, i = np.take_along_axis(got, at, 1), theirs[np.take_along_axis(order, at, 1)]
        fits = inside & (s >= np.maximum(a.low[which, w], LOWEST)[:, None])
        if fits.any():
            s = np.where(fits, s, LOWEST - 1)
            score[which, w], ids[which, w] = _better(np.concatenate([score[which, w], s], 1), np.concatenate([ids[which, w], i], 1), n)


def best_in_windows(groups: DataFrame, parts: DataFrame, same: bool, n: int, n_blocks: int, n_groups: int) -> DataFrame:
    """(g, i, w, partner, anchor_id, vec_id, score, rank): the first ``n`` rows of every window of every anchor, from the
    chosen blocks alone. A tile reads its blocks by falling bounds and skips those that came too late."""
    picked = durable(chosen_blocks(groups, parts, same, n_blocks, n_groups))
    left = picked.join(groups, "g")
    needed = picked.select(F.col("s").alias("s_"), F.col("c").alias("c_"), F.explode("picks").alias("block")).distinct()
    right = parts.drop("asks").join(needed, "block")
    schema = pa.schema([("g", pa.int64()), ("i", pa.int32()), ("w", pa.int32()), ("partner", pa.int64()), ("anchor_id", pa.int64()),
                        ("vec_id", pa.int64()), ("score", pa.int64())])

    def work(key, mine: pa.Table, read: pa.Table) -> pa.Table:
        by_number = {b["block"]: b for b in read.to_pylist()}
        out = []
        for row in mine.to_pylist():
            a = _Anchors(row, same)
            score = np.full((len(a.rows), a.low.shape[1], n), LOWEST - 1)
            ids = np.zeros_like(score)
            todo = [by_number[b] for b in row["picks"]]
            lo, hi = (np.stack([np.frombuffer(b[k], "<i8") for b in todo]) for k in ("lo", "hi"))
            first, last = (np.array([b[k] for b in todo]) for k in ("first_label", "last_label"))
            for j in np.argsort(-bounds(a.rows, lo, hi)[1].max(0), kind="stable"):
                # what is worse than the n-th found is not wanted any more
                low = np.maximum(a.low, score[:, :, n - 1])
                which = np.flatnonzero(a.wanted(a.dim, lo[j:j + 1], hi[j:j + 1], first[j:j + 1], last[j:j + 1], low)[:, 0])
                if len(which):
                    _scan(a, todo[j], which, score, ids)
            i, w, r = np.nonzero(score >= LOWEST)
            out += zip([a.g] * len(i), i.tolist(), w.tolist(), a.partners[i, w].tolist(), a.ids[i].tolist(), ids[i, w, r].tolist(), score[i, w, r].tolist(),
                       strict=True)
        return pa.Table.from_batches([_batch(out, schema)])

    found = left.groupBy("c", "s").cogroup(right.groupBy("c_", "s_")).applyInArrow(
        work, "g bigint, i int, w int, partner bigint, anchor_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("g", "i", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(df: DataFrame, anchors: Column, label: Column | None = None, vector: str = "embedding", vec_id: str = "vec_id",
                   positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Each component x is floor(256 x), and scores are whole inner products. Of each anchor (a row where
    ``anchors`` holds) the first ``positives`` other rows of its label are its positives, by falling score and
    rising id. For each of them the first ``negatives`` rows of other labels with low * positive_score <=
    100 * score <= high * positive_score are returned, all if fewer; a negative positive_score has none.

    Rows with a NULL id, label or vector, or a NULL or non-finite component, take no part; other columns are
    not read. Rows meet rows of the same vector length only; zero and empty vectors take part. A row with the
    id of an anchor is the anchor itself; a repeated anchor gives its rows again, and a repeated row is a
    partner as often as it is there. Scores must fit in a long. An empty table, or one without anchors, gives
    no rows. Labels are whole numbers.
    """
    wide = F.col(vector).cast("array<double>")
    fine = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), (F.col("label") if label is None else label).cast("bigint").alias("label"),
                     wide.alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asks"), F.coalesce(fine, F.lit(False)).alias("fine"))
    parts = blocks(rows.where("fine AND vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"))
    groups = anchor_groups(parts, positives)
    n_blocks, n_groups = parts.count(), groups.count()
    found = durable(best_in_windows(groups, parts, True, positives, n_blocks, n_groups))
    # whole scores s with low * score <= 100 * s <= high * score
    windows = found.where("score >= 0").select("g", F.struct(
        "i", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("partner"), F.expr(f"(score * {low} + 99) div 100").alias("low"),
        F.expr(f"(score * {high}) div 100").alias("high")).alias("x"))
    # at most GROUP x positives entries in a list
    asked = groups.join(windows.groupBy("g").agg(F.collect_list("x").alias("windows")), "g")
    hits = best_in_windows(asked, parts, False, negatives, n_blocks, n_groups)
    a, b = hits.alias("a"), found.alias("b")
    same = (F.col("a.g") == F.col("b.g")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.w") == F.col("b.rank") - 1)
    return a.join(b, same).select(
        "a.anchor_id", F.col("a.partner").alias("positive_id"), "a.rank", F.col("a.vec_id").alias("negative_id"),
        F.col("b.score").alias("positive_score"), F.col("a.score").alias("negative_score"))
