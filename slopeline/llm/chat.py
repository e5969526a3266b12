"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans of its learnt
turns are intersected with the sorted spans of its tokens by binary search. The control strings are tokens
of their own, so a text can be cut at any turn without changing a token: conversations are rendered in
stretches of whole turns, and one that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of turns that are rendered and encoded together; a longer turn is one stretch.
STRETCH = 1 << 16
#: Characters that are encoded and sent on together.
BATCH = 1 << 21


@dataclass(frozen=True)
class Template:
    """``start`` role ``sep`` text ``end`` for every turn, nothing between turns.

    A control string inside a role or text gets a backslash after its first character, and one that was
    written with backslashes there gets one more, so that the original comes back by taking one away.
    """

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"

    def __post_init__(self):
        first = {c[0] for c in self.controls}
        if len(first) > 1 or len(set(self.controls)) < 3 or min(map(len, self.controls)) < 2 or "\\" in "".join(self.controls):
            raise ValueError("control strings are three, start with the same character and hold no backslash")
        if any(c[0] in c[1:] for c in self.controls):
            raise ValueError("the first character of a control string must not come again in it")

    @property
    def controls(self) -> tuple[str, str, str]:
        return self.start, self.sep, self.end

    @property
    def _rest(self) -> str:
        return "|".join(re.escape(c[1:]) for c in self.controls)

    def escape(self, text: str) -> str:
        head = self.start[0]
        if head not in text:
            return text
        return re.sub(rf"{re.escape(head)}(\\*)({self._rest})", lambda m: f"{head}\\{m[1]}{m[2]}", text)

    def unescape(self, text: str) -> str:
        head = self.start[0]
        if head + "\\" not in text:
            return text
        return re.sub(rf"{re.escape(head)}\\(\\*)({self._rest})", lambda m: f"{head}{m[1]}{m[2]}", text)

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """The roles and texts of a formatted string."""
        shape = rf"{re.escape(self.start)}(.*?){re.escape(self.sep)}(.*?){re.escape(self.end)}"
        for m in re.finditer(shape, formatted, re.S):
            yield self.unescape(m[1]), self.unescape(m[2])


def library(path: str, template: Template):
    """The tokenizer of a file with the template's control strings as tokens of their own.

    Its special tokens are ordinary text inside turns, and offsets keep the white space before words.
    """
    from tokenizers import AddedToken, Tokenizer, processors
    found = Tokenizer.from_file(path)
    found.add_tokens([AddedToken(c, normalized=False) for c in template.controls])
    found.encode_special_tokens = True
    found.post_processor = processors.ByteLevel(trim_offsets=False)
    found.no_padding()
    found.no_truncation()
    return found


def learnt_tokens(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which tokens share a character with one of the sorted spans [first, last)."""
    if not len(first):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(last, starts, "right")
    inside = at < len(first)
    return inside & (first[np.minimum(at, len(first) - 1)] < ends)


def learnt_spans(starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of characters that tokens under the mask cover, in order; characters that several
    tokens share count once."""
    a, b = starts[loss], ends[loss]
    if not len(a):
        return []
    reach = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    return list(zip(a[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)].tolist(), strict=True))


class _Stretch:
    """Turns of one conversation that are rendered together."""

    def __init__(self, conv_id, fresh: bool):
        self.conv_id, self.fresh, self.whole = conv_id, fresh, False
        self.parts: list[str] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.size = self.turns = 0

    def add(self, role: str, text: str, template: Template, learnt: bool) -> None:
        head, body = template.start + template.escape(role) + template.sep, template.escape(text)
        begin = self.size + len(head)
        if learnt and body:
            self.first.append(begin)
            self.last.append(begin + len(body))
        self.parts += [head, body, template.end]
        self.size = begin + len(body) + len(template.end)
        self.turns += 1


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else [], kind))


def _encoded(found, batch: list[_Stretch], id_type: pa.DataType, at: int) -> pa.RecordBatch:
    texts = ["".join(s.parts) for s in batch]
    ids, starts, ends, loss = [], [], [], []
    for s, e in zip(batch, found.encode_batch(texts, add_special_tokens=False), strict=True):
        spans = np.array(e.offsets, np.int32).reshape(-1, 2)
        a, b = spans[:, 0], spans[:, 1]
        mask = learnt_tokens(a, b, np.array(s.first, np.int64), np.array(s.last, np.int64))
        if sum(y - x for x, y in learnt_spans(a, b, mask)) < sum(s.last) - sum(s.first):
            raise ValueError("the tokenizer drops characters; take one whose tokens cover whole texts")
        ids.append(np.array(e.ids, np.int32))
        starts.append(a)
        ends.append(b)
        loss.append(mask)
    return pa.RecordBatch.from_arrays(
        [pa.array([s.conv_id for s in batch], id_type), pa.array(range(at, at + len(batch)), pa.int64()),
         pa.array([s.whole for s in batch]), pa.array([s.turns for s in batch], pa.int64()), pa.array(texts),
         _lists(ids, pa.int32()), _lists(starts, pa.int32()), _lists(ends, pa.int32()), _lists(loss, pa.bool_())],
        ["conv_id", "part", "whole", "n_turns", "formatted", "ids", "starts", "ends", "loss"])


def format_conversations(df: DataFrame, tokenizer: str, template: Template | None = None, learn: Sequence[str] = ("assistant",),
                         columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """One row per stretch of a conversation: ``conv_id``, ``part`` (rises along a conversation), ``whole``
    (the row is the whole conversation), ``n_turns``, ``formatted``, and per token its id (``ids``), the
    characters it covers (``starts``, ``ends``) and whether it is learnt (``loss``).

    ``columns`` names id, turn, role and text; other columns take no part. Rows go by turn (NULL first), ties
    by the hash of role and text; repeated rows are turns of their own. A NULL role or text is empty, and rows
    with a NULL id are one conversation. An empty learnt text has no token under the mask. An empty table gives
    no rows. Each task holds 64 K characters of a conversation, or one turn if that is longer.

    ``tokenizer`` is a file of the tokenizers library whose tokens cover every character (byte level).
    Rows are dealt by ranges of (id, turn, hash), which the hash spreads even for one id and turn.
    """
    template = template or Template()
    conv, turn, role, text = (F.col(c) for c in columns)
    rows = df.select(conv.alias("conv_id"), turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                     F.coalesce(text, F.lit("")).alias("text")).withColumn("tie", F.xxhash64("role", "text"))
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ("conv_id", "turn", "tie")
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    learn = frozenset(learn)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, pending, pending_size, current, at = None, [], 0, None, None
        id_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if found is None:
                found, id_type, at = library(tokenizer, template), batch.column(0).type, batch.column(4)[0].as_py()
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if current is None:
                    # the first conversation of a range may have begun in the one before
                    current = _Stretch(conv_id, False)
                elif conv_id != current.conv_id or current.size >= STRETCH:
                    fresh = conv_id != current.conv_id
                    current.whole = fresh and current.fresh
                    pending.append(current)
                    pending_size += current.size
                    current = _Stretch(conv_id, fresh)
                    if pending_size >= BATCH:
                        yield _encoded(found, pending, id_type, at)
                        at, pending, pending_size = at + len(pending), [], 0
                current.add(role, text, template, role in learn)
        if current is not None:
            yield _encoded(found, [*pending, current], id_type, at)

    out = (f"conv_id {df.schema[columns[0]].dataType.simpleString()}, part bigint, whole boolean, n_turns bigint, formatted string, "
           "ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")
    return dealt.select("conv_id", "turn", "role", "text", "at").mapInArrow(work, out)


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, read from the output of ``format_conversations``: ``conv_id``, ``n_turns``,
    ``turns_sha256`` (role, newline, text, newline per turn), ``loss_chars`` and ``loss_sha256`` (all text under
    the mask), ``formatted_chars``.

    Rows that are whole conversations are hashed where they lie. The others, at most two conversations per
    range and those beyond 64 K characters, send their texts on; a digest runs over a conversation in order,
    so one task streams it, holding one stretch at a time.
    """
    template = template or Template()
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("whole", "formatted", "starts", "ends", "loss")]
            for whole, text, starts, ends, loss in zip(*columns, strict=True):
                text = text.as_py()
                turns = "".join(f"{r}\n{t}\n" for r, t in template.turns(text)).encode()
                spans = learnt_spans(*(x.values.to_numpy(zero_copy_only=False) for x in (starts, ends, loss)))
                learnt = "".join(template.unescape(text[a:b]) for a, b in spans)
                said = learnt.encode()
                one = whole.as_py()
                rows.append((hashlib.sha256(turns).hexdigest() if one else None, hashlib.sha256(said).hexdigest() if one else None,
                             len(learnt), len(text), None if one else turns, None if one else said))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "part", "n_turns")]
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    names = ["conv_id", "part", "n_turns", "turns_sha256", "loss_sha256", "loss_chars", "formatted_chars", "turns", "said"]
    pieces = formatted.mapInArrow(read, f"conv_id {kind}, part bigint, n_turns bigint, turns_sha256 string, loss_sha256 string, "
                                        "loss_chars bigint, formatted_chars bigint, turns binary, said binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, sums, hashes, id_type, done = None, None, None, None, []

        def close():
            nonlocal sums
            if sums is not None:
                done.append((open_id, sums[0], hashes[0].hexdigest(), sums[1], hashes[1].hexdigest(), sums[2]))
                sums = None

        def table():
            cols = list(zip(*done, strict=True))
            done.clear()
            types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], result)

        for batch in batches:
            id_type = batch.column(0).type
            for i, (conv_id, n, sha, lsha, chars, size) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 2, 3, 4, 5, 6)), strict=True)):
                if sha is not None:
                    done.append((conv_id, n, sha, chars, lsha, size))
                    continue
                if sums is None or conv_id != open_id:
                    close()
                    open_id, sums, hashes = conv_id, [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
                sums = [sums[0] + n, sums[1] + chars, sums[2] + size]
                for h, j in zip(hashes, (7, 8), strict=True):
                    h.update(batch.column(j)[i].as_buffer())
            if done:
                yield table()
        close()
        if done:
            yield table()

    result = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    # nothing else is keyed alike, so conversations keep their order within the partition
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        merge, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: A conversation whose texts hold control strings, which must come back unchanged.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def with_control_case(df: DataFrame) -> DataFrame:
    """The conversations and one more, -1, of a user and an assistant row that both say ``CONTROL_TEXT``."""
    extra = df.sparkSession.range(2).select(
        F.lit(-1).cast(df.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(df.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return df.select("conv_id", "turn", "role", "text").unionByName(extra)
