"""Exact token counts of a byte-level merge vocabulary, without building the ids.

Distinct pre-tokens of a batch are laid end to end in one numpy array of symbols. In every round each
sequence merges all places of its lowest-rank pair, all sequences at once, and drops out when no pair
has a rank; what survives is its token count. A document's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how the vocabulary's library splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class is the same in every version of the character tables.
SETTLED = regex.compile("[^\u0000-ɏ‐-‧‰-⁞€]")
NONE = np.int32(1 << 30)
CACHE, PIECE = 200_000, 1 << 17
TABLE_BITS, HASH = 18, np.int64(0x1E3779B97F4A7C15)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free character from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Merges:
    """Ranks of a vocabulary file and the counting of merged symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.special = [t["content"] for t in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.symbol = np.array([vocab[c] for c in byte_alphabet()], np.int32)
        self.last = np.array([vocab[c + suffix] for c in byte_alphabet()], np.int32)
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in zip(*((a, b, a + b) for a, b in merges), strict=True))
        self.made = made.astype(np.int32)
        # pairs lie in an open-addressed table, four times as fast to look up as a sorted array
        self.key, self.rank = np.full(1 << TABLE_BITS, -1, np.int64), np.full(1 << TABLE_BITS, NONE, np.int32)
        key, rank = left << 32 | right, np.arange(len(left), dtype=np.int32)
        slot = self._slot(key)
        self.probes = 0
        while len(key):
            self.probes += 1
            free = self.key[slot] < 0
            self.key[slot[free]] = key[free]  # of several takers one stays
            put = self.key[slot] == key
            self.rank[slot[put]] = rank[put]
            key, rank, slot = key[~put], rank[~put], (slot[~put] + 1) & ((1 << TABLE_BITS) - 1)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * HASH >> np.int64(64 - TABLE_BITS - 1)) & ((1 << TABLE_BITS) - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        found = self.key[slot]
        out = self.rank[slot]
        wrong = found != key
        out[wrong] = NONE
        open_ = np.flatnonzero(wrong & (found >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << TABLE_BITS) - 1)
            found = self.key[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Number of tokens of each byte string."""
        out = np.zeros(len(tokens), np.int64)
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        for who, n, _ in self.merged(np.frombuffer(b"".join(tokens), np.uint8), lens):
            out[who] = n
        return out

    def ids(self, raw: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of byte strings that lie end to end, and how many each has."""
        out = np.zeros(len(lens), np.int64)
        parts = list(self.merged(raw, lens))
        if not parts:
            return np.zeros(0, np.int32), out
        who, n, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
        out[who] = n
        return flat[np.argsort(np.repeat(who, n), kind="stable")], out

    def merged(self, raw: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers, lengths and symbols of byte strings, as they have no pair left to merge."""
        at, ends = 0, np.cumsum(lens)
        while at < len(lens):  # in pieces that stay in the processor's cache
            begin = ends[at] - lens[at]
            to = max(at + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
            for who, n, sym in self._merged(raw[begin:ends[to - 1]], lens[at:to]):
                yield who + at, n, sym
            at = to

    def _merged(self, raw: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        who = np.flatnonzero(lens)
        lens = lens[who]
        if not len(who):
            return
        first = np.cumsum(lens) - lens
        sym = self.symbol[raw]
        sym[first + lens - 1] = self.last[raw[first + lens - 1]]
        # the rank of each symbol's pair with the next one; none at a sequence's end
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[first + lens - 1] = NONE
        while True:
            low = np.minimum.reduceat(rank, first)
            open_ = low < NONE
            if not open_.all():
                keep = np.repeat(open_, lens)
                yield who[~open_], lens[~open_], sym[~keep]
                sym, rank, who, lens, low = sym[keep], rank[keep], who[open_], lens[open_], low[open_]
                if not len(who):
                    return
                first = np.cumsum(lens) - lens
            hit = rank == np.repeat(low, lens)
            at = np.flatnonzero(hit)
            # of overlapping equal pairs every second one merges, from the left
            new = np.ones(len(at), bool)
            new[1:] = np.diff(at) > 1
            if not new.all():
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0]
            sym[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]  # it stands last if its right half did
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            moved = at - np.arange(len(at))
            lens = lens - np.add.reduceat(gone, first, dtype=np.int64)
            sym, rank = sym[~gone], rank[~gone]
            first = np.cumsum(lens) - lens
            # pairs on both sides of a new symbol; the last symbol of a sequence has none
            ends = np.zeros(len(sym), bool)
            ends[first + lens - 1] = True
            touch = np.concatenate([moved, moved[moved > 0] - 1])
            inner = touch[~ends[touch]]
            rank[inner] = self.ranks(sym[inner], sym[inner + 1])
            rank[touch[ends[touch]]] = NONE


class Counter:
    """Counts of texts, with the counts of recent pre-tokens kept."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special))) if self.merges.special else None
        self.slow = None
        self.path = path
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if SETTLED.search(text) is None:
            return self.split(text)
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
        return [text[a:b] for _, (a, b) in self.slow(text)]

    def parts(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings, which are one token each."""
        if self.special is None or self.special.search(text) is None:
            return self.pre_tokens(text), 0
        between = self.special.split(text)
        return [t for part in between if part for t in self.pre_tokens(part)], len(between) - 1

    def __call__(self, texts: list[str]) -> list[int]:
        split = [self.parts(t) for t in texts]
        counts, missing = {}, []
        for t in set(chain.from_iterable(p for p, _ in split)):
            n = self.recent.get(t) or self.older.get(t)
            if n is None:
                missing.append(t)
            else:
                counts[t] = n
        if missing:
            fresh = dict(zip(missing, self.merges.counts([t.encode() for t in missing]).tolist(), strict=True))
            counts |= fresh
            self.recent |= fresh
            if len(self.recent) > CACHE:
                self.older, self.recent = self.recent, {}
        return [sum(map(counts.__getitem__, p)) + n for p, n in split]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, n_bytes, n_tokens, over_limit for every row; NULL text counts as empty.

    ``path``: the vocabulary file, present on every executor. Nothing is shuffled; a worker holds one
    Arrow batch and a bounded cache. Repeated rows are counted each. Ids follow the library without
    begin, end or added special tokens; special strings inside a text are one token.
    """
    keep = list(keep)
    slim = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            n: list[int] = []
            step: list[str] = []
            size = 0
            for t in texts:
                step.append(t)
                size += len(t)
                if size > 4_000_000:
                    n += count(step)
                    step, size = [], 0
            n += count(step)
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(run, f"{kinds}, n_bytes bigint, n_tokens bigint, over_limit boolean")
