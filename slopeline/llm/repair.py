"""Repair of conversation structure by a suffix-shared automaton.

Every conversation becomes a signature, one letter per row for the first letter of its role and its first
fault. What the best repair of a row costs depends on the rows after it alone, so the distinct signatures are
laid out from their ends: signatures with a common suffix share its nodes, and the cost-to-go and the first
edit of the best audit are worked out once per node and grammar state. Signatures sorted by their reversal
build that automaton with only the path of the last one in memory.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.session import durable

#: White space of the word rule.
SPACES = " \t\n\x0b\x0c\r"
#: Letters of a signature, by first letter of the role (user, assistant, system, other), for rows without a
#: fault, truncated, blank and duplicate ones.
SOUND, TRUNCATED, BLANK, DUPLICATE = "uaso", "UASO", "bcde", "wxyz"
CLASSES = str.maketrans(TRUNCATED + BLANK + DUPLICATE, SOUND * 3)
#: Blank and duplicate rows must go, whatever their role.
NODES = str.maketrans(BLANK + DUPLICATE, "-" * 8)
LEGAL = frozenset({"su", "ua", "au"})
#: Costs of edits. Keeping or renaming a truncated row costs ``TRUNCATION`` more.
DELETE, INSERT, RENAME, TRUNCATION = 2, 5, 1, 5
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. What may follow, by role.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that a renamed or inserted row gets in a state, and the state after it.
FITTING = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
ACCEPTED = (START, ASSISTANT)
NEVER = 1 << 60
#: Symbols of one conversation that a task holds before it sends them on.
PIECE = 1 << 16
ROWS = 2_000


class Automaton:
    """The nodes on the path of the latest signature, from its end: node k stands for its last k letters.

    Per node and state: the cost-to-go and the first edit of the least cheapest audit, as 4 * letter + state
    after it. Different edits start with different letters, so the least letter among the cheapest edits
    begins the least audit.
    """

    LETTERS = "DIKR"

    def __init__(self):
        self.word = ""
        self.made = 0
        self.costs, self.edits = array("q"), bytearray()
        self._push([0 if s in ACCEPTED else NEVER for s in range(4)], [0] * 4)

    def _push(self, costs: list[int], edits: list[int]) -> None:
        # two insertions in a row are the most that a state needs
        for _ in range(2):
            for s in range(4):
                after = FITTING[s][1]
                price = costs[after] + INSERT
                if price < costs[s] or (price == costs[s] < NEVER and edits[s] >> 2 > 1):
                    costs[s], edits[s] = price, 4 | after
        self.costs.extend(costs)
        self.edits.extend(edits)
        self.made += 1

    def _grow(self, letter: str) -> None:
        base = len(self.costs) - 4
        ahead = self.costs[base:]
        costs = [c + DELETE for c in ahead]
        edits = [0 | s for s in range(4)]
        role = letter.translate(CLASSES)
        if letter != "-":
            late = TRUNCATION if letter in TRUNCATED else 0
            for s in range(4):
                options = [(ahead[FITTING[s][1]] + RENAME + late, 12 | FITTING[s][1])]
                if role in NEXT[s]:
                    options.append((ahead[NEXT[s][role]] + late, 8 | NEXT[s][role]))
                for price, edit in options:
                    if price < costs[s] or (price == costs[s] and edit >> 2 < edits[s] >> 2):
                        costs[s], edits[s] = price, edit
        self._push(costs, edits)

    def read(self, reversed_word: str) -> tuple[int, str]:
        """Cost and audit of a signature given from its end; nodes shared with the one before are kept."""
        shared, most = 0, min(len(self.word), len(reversed_word))
        if self.word[:most] == reversed_word[:most]:
            shared = most
        else:
            lo, hi = 0, most
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if self.word[:mid] == reversed_word[:mid] else (lo, mid - 1)
            shared = lo
        del self.costs[4 * (shared + 1):]
        del self.edits[4 * (shared + 1):]
        for letter in reversed_word[shared:]:
            self._grow(letter)
        self.word = reversed_word
        node, state, audit = len(reversed_word), START, bytearray()
        cost = self.costs[4 * node]
        while node or state not in ACCEPTED:
            edit = self.edits[4 * node + state]
            letter = edit >> 2
            audit.append(ord(self.LETTERS[letter]))
            state = edit & 3
            node -= letter != 1
        return cost, audit.decode()


def damaged(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (conv_id, turn, role, text) with faults that crc32 of ``conv_id:turn`` deals: 0 of 20
    drops the row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 sets the role to user. A NULL counts
    as one space, also in the string that is hashed; turn stays NULL."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = df.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                     (F.crc32(named) % 20).alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       copies.alias("copy")).drop("copy")


def _ready(rows: DataFrame) -> DataFrame:
    """Without NULL roles and texts, with the two hashes that order rows of equal turns and tell texts apart."""
    space = F.lit(" ")
    known = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    return known.select("*", F.xxhash64("role", "text").alias("tie"), F.xxhash64(F.lit("again"), "text", "role").alias("mark"))


def _letter(role: Column, letters: str) -> Column:
    first = F.substring(role, 1, 1)
    out = F.lit(letters[3])
    for c, letter in zip(SOUND[:3], letters):
        out = F.when(first == c, letter).otherwise(out)
    return out


def symbols(rows: DataFrame) -> DataFrame:
    """The signature in parts: one row per different (conversation, turn, role, text), with the letters of all
    its copies (``head``, then ``tail`` for the ``more`` others), which lie side by side."""
    stripped = F.rtrim("text", F.lit(SPACES))
    fault = F.when(F.length(stripped) == 0, 2).when(F.substring(stripped, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    known = _ready(rows).select("conv_id", "turn", "tie", "mark", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    met = known.groupBy("conv_id", "turn", "tie", "mark").agg(
        F.first("initial").alias("initial"), F.first("fault").alias("fault"), F.count(F.lit(1)).alias("n"))
    # a NULL turn is the earliest
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = met.groupBy("conv_id", "tie", "mark").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    a, b = met.alias("a"), again.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.tie") == F.col("b.tie")) & (F.col("a.mark") == F.col("b.mark"))
    later = F.coalesce(F.struct(F.col("a.turn").isNotNull().alias("known"), F.col("a.turn").alias("turn")) > F.col("b.first"), F.lit(False))
    by_fault = F.when(F.col("fault") == 2, _letter(F.col("initial"), BLANK)).when(
        F.col("later"), _letter(F.col("initial"), DUPLICATE)).when(F.col("fault") == 1, _letter(F.col("initial"), TRUNCATED)).otherwise(
        _letter(F.col("initial"), SOUND))
    tail = F.when(F.col("fault") == 2, _letter(F.col("initial"), BLANK)).otherwise(_letter(F.col("initial"), DUPLICATE))
    joined = a.join(b, same, "left").select("a.*", later.alias("later"))
    return joined.select("conv_id", "turn", "tie", "mark", by_fault.alias("head"), tail.alias("tail"), (F.col("n") - 1).alias("more"))


def signatures(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, signature and gaps (missing whole numbers between the least and the greatest turn).

    Parts are dealt by ranges of their order, and each range sends on the letters of its stretch, so the rows
    of one conversation may lie in many tasks. ``ids``: conversations to list even without rows.
    """
    parts = symbols(rows)
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ("conv_id", "turn", "tie", "mark")
    dealt = parts.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "head", "tail", "more", F.monotonically_increasing_id().alias("at"))
    names = ["conv_id", "at", "piece", "lo", "hi", "turns"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, id_type, piece, seen, done = None, None, None, None, []

        def close():
            nonlocal piece
            if piece is not None:
                done.append((open_id, seen[0], "".join(piece), *seen[1:]))
            piece = None

        def table():
            cols = list(zip(*done, strict=True))
            done.clear()
            types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        size = 0
        for batch in batches:
            id_type = batch.column(0).type
            for conv_id, turn, head, tail, more, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece is None or conv_id != open_id or size >= PIECE:
                    close()
                    open_id, piece, seen, size = conv_id, [], [at, None, None, 0], 0
                piece.append(head + tail * more)
                size += 1 + more
                if turn is not None:
                    if seen[1] is None:
                        seen[1] = turn
                    seen[3] += seen[2] != turn
                    seen[2] = turn
            if len(done) >= ROWS:
                yield table()
        close()
        if done:
            yield table()

    kind = rows.schema["conv_id"].dataType.simpleString()
    pieces = dealt.mapInArrow(work, f"conv_id {kind}, at bigint, piece string, lo bigint, hi bigint, turns bigint")
    if ids is not None:
        bare = ids.select("conv_id").distinct()
        pieces = pieces.unionByName(bare.select("conv_id", F.lit(-1).cast("bigint").alias("at"), F.lit("").alias("piece")), allowMissingColumns=True)
    met = pieces.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece", "lo", "hi"))).alias("p"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum("turns").alias("turns"))
    # a turn that two pieces hold was counted in both
    shared = F.size(F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: F.coalesce(
        F.get("p", i - 1)["hi"] == F.get("p", i)["lo"], F.lit(False))))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - (F.col("turns") - shared), F.lit(0)).cast("bigint")
    return met.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("signature"), gaps.alias("gaps"))


def audits(words: DataFrame) -> DataFrame:
    """Per distinct ``signature``: blank, duplicate, truncated, illegal, cost and audit.

    Signatures are dealt by ranges of their last 64 letters from the end, so nearly all that share a suffix
    lie in one task, in the order that shares most.
    """
    n = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    forms = F.reverse(F.translate("signature", BLANK + DUPLICATE, "-" * 8))
    dealt = words.select("signature").distinct().withColumn("word", forms).repartitionByRange(n, F.substring("word", 1, 64))
    names = ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            rows = []
            for signature, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                classes = np.frombuffer(signature.translate(CLASSES).encode(), np.uint8)
                pair = classes[:-1].astype(np.uint16) << 8 | classes[1:]
                legal = sum(int((pair == (ord(x) << 8 | ord(y))).sum()) for x, y in LEGAL)
                counts = [sum(map(signature.count, letters)) for letters in (BLANK, DUPLICATE, TRUNCATED)]
                rows.append((signature, *counts, len(pair) - legal, *automaton.read(word)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.string(), *[pa.int64()] * 5, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return dealt.sortWithinPartitions("word").select("signature", "word").mapInArrow(
        work, "signature string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def diagnose(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost and audit.

    ``rows`` holds conv_id, turn, role and text; other columns take no part. A NULL role or text counts as one
    space, rows with a NULL conv_id are one conversation, a NULL turn comes first, and rows of equal turns go by
    the hash of role and text. Repeated rows are duplicates. ``ids`` lists conversations without rows too.

    The first fault of a row counts: blank, duplicate (role and text seen earlier), truncated (its last
    character but white space is not one of ``.!?``). ``audit`` holds the first letters of the cheapest edits
    that give roles of the form (s?(ua)+)?, the least in ASCII order of equally cheap ones.
    """
    found = durable(signatures(rows, ids))
    best = audits(found)
    a, b = found.alias("a"), best.alias("b")
    return a.join(b, F.col("a.signature") == F.col("b.signature")).select(
        "a.conv_id", "a.gaps", "b.blank", "b.duplicate", "b.truncated", "b.illegal", "b.cost", "b.audit")


def repaired(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (from 0), edit (Keep, Rerole or Insert), role, text.

    ``verdicts``: conv_id and audit as from ``diagnose`` of the same rows. Inserted rows have an empty text.
    Texts are shuffled once, by conversation; a task follows one conversation row by row and holds its audit,
    a byte per row. The rows of a conversation lie in one partition, in order.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    heads = verdicts.select("conv_id", F.lit(0).alias("side"), "audit")
    both = heads.unionByName(_ready(rows).withColumn("side", F.lit(1)), allowMissingColumns=True)
    order = ("conv_id", "side", "turn", "tie", "mark")
    dealt = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "side", "audit", "role", "text")
    names = ["conv_id", "place", "edit", "role", "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place, id_type, out = None, "", 0, START, 0, None, []

        def emit(edit, role, text, after):
            nonlocal state, place
            out.append((conv, place, edit, role, text))
            state, place = after, place + 1

        def inserts():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                role, after = FITTING[state]
                emit("Insert", role, "", after)

        def table():
            cols = list(zip(*out, strict=True))
            out.clear()
            types = (id_type, pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            id_type = batch.column(0).type
            for conv_id, side, found, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if side == 0:
                    inserts()
                    conv, audit, at, state, place = conv_id, found, 0, START, 0
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    emit("Keep", role, text, NEXT[state][role[:1]])
                elif edit == "R":
                    emit("Rerole", *FITTING[state][:1], text, FITTING[state][1])
            if out:
                yield table()
        inserts()
        if out:
            yield table()

    return dealt.mapInArrow(work, f"conv_id {kind}, place bigint, edit string, role string, text string")


def text_digests(fixed: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 (``role:text`` of all rows, joined by newlines) of ``repaired``; conversations
    without rows are not in it. Rows lie in order, so nothing is shuffled."""
    kind = fixed.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, id_type, done = None, None, None, []

        def table():
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1])], ["conv_id", "repaired_sha256"])

        for batch in batches:
            id_type = batch.column(0).type
            for conv_id, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = conv_id, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield table()
        if digest is not None:
            done.append((conv, digest.hexdigest()))
            yield table()

    return fixed.select("conv_id", "place", "role", "text").mapInArrow(work, f"conv_id {kind}, repaired_sha256 string")


def repair_report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``diagnose`` with the digest of each repaired conversation; that of one without rows is of the empty text."""
    verdicts = durable(diagnose(rows, ids))
    a, b = verdicts.alias("a"), text_digests(repaired(rows, verdicts)).alias("b")
    digest = F.coalesce("b.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left").select("a.*", digest)
