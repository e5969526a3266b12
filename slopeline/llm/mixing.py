"""Interleaving sources by target weights with proportionate-fair scheduling.

Rows of a source are cut into blocks. A source with weight w owes its block j (from 1) the time window
from floor((j - 1) / w) to ceil(j / w); in every time slot the released block with the earliest deadline
goes. Windows come from the weights themselves, as exact ratios of integers, so no error adds up over the
slots. When a source ends, the others go on with their weights in proportion: each such phase is a
schedule of its own, in which no source ever deviates by a whole block from its share.
"""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeline.llm.common import row_numbers

Name = str | None
#: Slots of so many blocks of a source are one row of the schedule; a schedule of up to so many slots is broadcast.
CHUNK, BROADCAST_SLOTS = 1024, 4_000_000


def whole_weights(weights: dict[Name, float], period: int) -> dict[Name, int]:
    """Integer weights of at least 1 with the sum ``period``, by largest remainders; ties by name."""
    names = sorted(weights, key=lambda s: (s is None, s or ""))
    total = sum(weights.values())
    spare = period - len(names)
    exact = {s: weights[s] / total * spare for s in names}
    out = {s: 1 + int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: -(exact[s] - int(exact[s])))[:period - sum(out.values())]:
        out[s] += 1
    return out


def exact_weights(weights: dict[Name, float]) -> dict[Name, int]:
    """Integers in exactly the proportions of ``weights``."""
    ratios = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*[r.denominator for r in ratios.values()])
    return {s: int(r * scale) for s, r in ratios.items()}


def one_phase(left: dict[Name, int], share: dict[Name, int]) -> dict[Name, np.ndarray]:
    """Slots of the sources' blocks from 0 until the first source has no block left."""
    names, total = list(share), sum(share.values())
    weight, free = [share[s] for s in names], [left[s] for s in names]
    slots: list[array] = [array("q") for _ in names]
    # of each source its next block: waiting by release, then ready by deadline
    waiting = [(0, i) for i in range(len(names))]
    ready: list[tuple[int, int]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[i]) + 1) * total // weight[i]), i))
        deadline, i = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("a deadline was missed")
        slots[i].append(t)
        t += 1
        if len(slots[i]) == free[i]:
            return {s: np.frombuffer(x, np.int64) for s, x in zip(names, slots, strict=True) if x}
        heapq.heappush(waiting, (len(slots[i]) * total // weight[i], i))


def schedule(blocks: dict[Name, int], share: dict[Name, int]) -> dict[Name, np.ndarray]:
    """For each source the slots of its blocks.

    At most one phase per source; sources without a share come last, with equal ones.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    parts: dict[Name, list[np.ndarray]] = {s: [] for s in left}
    start = 0
    while left:
        active = {s: share[s] for s in left if share.get(s, 0) > 0} or dict.fromkeys(left, 1)
        found = one_phase(left, active)
        for s, slots in found.items():
            parts[s].append(slots + start)
            left[s] -= len(slots)
        start += sum(map(len, found.values()))
        left = {s: n for s, n in left.items() if n}
    return {s: np.concatenate(p) for s, p in parts.items()}


def tempered(counts: dict[Name, int], power: float) -> dict[Name, float]:
    """Target weights between the sources' own sizes (power 1) and equal ones (power 0)."""
    return {s: n ** power for s, n in counts.items() if n > 0}


def mixed_rows(docs: DataFrame, weights: dict[Name, float] | None = None, power: float = 0.5, by: str = "source", id_col: str = "doc_id",
               block_rows: int = 16, period: int | None = None, seed: int = 0, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or the named columns of it) with block, slot and place (row within its block).

    Every row appears once. Rows of a source are shuffled by a hash of their id, then cut into blocks of
    ``block_rows``, the last one shorter. ``weights``: target shares by source, NULL being a source like
    any; without them the sizes to the power ``power``. The schedule follows them exactly, unless a ``period``
    is named: then it repeats after so many slots, with weights rounded to it and at least one slot for
    each. A source without a weight follows when the others have ended. Row equality aside, the result
    depends on the rows alone. Counts of the sources and the schedule (8 bytes for each block) pass through
    the driver. Columns named block, slot and place are replaced.
    """
    keep = [c for c in (columns or docs.columns) if c not in ("block", "slot", "place")]
    order = [F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.col(id_col)]
    numbered = row_numbers(docs.select(*keep), [by], order, "__mix_row")
    counts = {r[0]: r[1] for r in numbered.groupBy(by).agg(F.count(F.lit(1))).collect()}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    target = weights if weights is not None else tempered(blocks, power)
    target = {s: w for s, w in target.items() if s in blocks and w > 0}
    share = {}
    if target:
        share = exact_weights(target) if period is None else whole_weights(target, max(period, 4 * len(target)))
    plan = schedule(blocks, share)
    cut = [(s, i, x[i:i + CHUNK]) for s, x in plan.items() for i in range(0, len(x), CHUNK)]
    chunks = pa.table([pa.array([s for s, _, _ in cut], pa.string()), pa.array([i // CHUNK for _, i, _ in cut], pa.int64()),
                       pa.array([x for _, _, x in cut], pa.list_(pa.int64()))], names=["__mix_source", "__mix_chunk", "__mix_slots"])
    slots = docs.sparkSession.createDataFrame(chunks)
    if sum(blocks.values()) <= BROADCAST_SLOTS:
        slots = F.broadcast(slots)
    block = F.floor(F.col("__mix_row") / block_rows).cast("bigint")
    chunk = F.shiftright("block", CHUNK.bit_length() - 1)
    at = numbered.withColumn("block", block).join(
        slots, F.col(by).cast("string").eqNullSafe(F.col("__mix_source")) & (chunk == F.col("__mix_chunk")))
    slot = F.col("__mix_slots")[(F.col("block") % CHUNK).cast("int")]
    return at.select(*keep, "block", slot.cast("bigint").alias("slot"), (F.col("__mix_row") % block_rows).cast("int").alias("place"))


def in_order(mixed: DataFrame, rows_per_part: int = 20_000) -> DataFrame:
    """Rows of ``mixed`` in the order of slot and place, partitions following each other, without those two
    columns and block. Written to files, the order is that of ``with_place``."""
    last, n = mixed.agg(F.max("slot"), F.count(F.lit(1))).first()
    if not n:
        return mixed.drop("block", "slot", "place")
    parts = max(1, -(-n // rows_per_part))
    dealt = mixed.repartitionById(parts, F.floor(F.col("slot") * parts / (last + 1)).cast("int"))
    return dealt.sortWithinPartitions("slot", "place").drop("block", "slot", "place")


def with_place(docs: DataFrame, name: str = "_mixed") -> DataFrame:
    """``docs`` with its rows' place in the files that it is read from: number and name of the file, and row in it.

    Spark reads files by their size, not one after the other; the place tells the order in which they were filled. Rows that
    come from no files have the place that the table's partitions give them.
    """
    try:
        at = docs.metadataColumn("_metadata")
    except AnalysisException:
        return docs.withColumn(name, F.monotonically_increasing_id())
    number = F.regexp_extract(at["file_name"], r"part-(\d+)", 1).try_cast("bigint")
    return docs.withColumn(name, F.struct(number.alias("number"), at["file_path"].alias("file"), at["row_index"].alias("row")))
