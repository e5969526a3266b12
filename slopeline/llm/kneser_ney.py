"""An interpolated modified Kneser-Ney bigram model of the corpus, and the log probability of texts under it.

Words are 64-bit hashes. Tasks count the words and word pairs of stretches of text in sorted arrays and
send them on by ranges of the first word's hash, so that all pairs of a context meet in one place and every
range is a sorted piece of the whole. From the merged counts come the discounts, the followers of each
context and the contexts of each word. The model is a folder of sorted hash arrays with their values
beside them, in the shared folder that the cluster names. Scoring reads the texts again; workers map the arrays into memory
and look up the sorted distinct words and pairs of each stretch of text, so that a lookup runs through the
files in order and touches few pages.

A text is its words and one end; the first word's context is the text's beginning, which is never predicted.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.llm.common import Spans, mixed, pieces, utf8, word_spans
from slopeline.session import shared_folder

#: Hashes of the end and the beginning of a text; words and pairs gathered before they are sent on; text bytes per range.
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
UNIT, RANGE_BYTES = 2_000_000, 20_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
FIRST = np.uint64(0x2545F4914F6CDD1D)


def tokens(data: np.ndarray, offsets: np.ndarray, spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of a stretch of texts, ends included, those of their contexts, and token counts."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)
    size = words + 1
    stop = np.cumsum(size) - 1
    token = np.empty(int(size.sum()), np.uint64)
    token[stop] = END
    inner = np.ones(len(token), bool)
    inner[stop] = False
    token[inner] = spans(data, starts, ends)
    context = np.empty(len(token), np.uint64)
    context[1:] = token[:-1]
    context[stop - words] = BEGIN
    return token, context, size


def pair_key(context: np.ndarray, token: np.ndarray, bits: int) -> np.ndarray:
    """Hash of a pair, led by the range of its context: a range of contexts is a range of keys."""
    tail = mixed(token + mixed(context ^ FIRST)) >> np.uint64(bits)
    return tail if not bits else context >> np.uint64(64 - bits) << np.uint64(64 - bits) | tail


def ranges_of(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)


def stretches(parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of the runs of a sorted array."""
    edge = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]])) if len(parts) else np.zeros(1, int)
    return [(int(parts[a]), int(a), int(b)) for a, b in zip(edge, edge[1:], strict=False)]


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Arrays as files that appear whole or not at all, so that a repeated task does no harm."""
    for key, value in arrays.items():
        path = os.path.join(folder, f"{name}-{key}.npy")
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, value)
        os.replace(part, path)


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2 and from 3, from how many counts are 1, 2, 3 and 4. Where the corpus is too
    small for the formula they are half the count; they stay between a twentieth and the count."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if min(n1, n2, n3, n4) == 0:
        return np.array([0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [1.0, 2.0, 3.0])


def how_many(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4, and how many are 3 or more."""
    return np.array([*(np.count_nonzero(counts == k) for k in (1, 2, 3, 4)), np.count_nonzero(counts >= 3)], np.int64)


def _rows(kinds: list[tuple], names: list[str], lead: list) -> pa.RecordBatch:
    """A batch of integer columns and binary columns."""
    columns = [pa.array([k[i] for k in kinds], lead[i]) for i in range(len(lead))]
    columns += [pa.array([np.ascontiguousarray(k[i]).tobytes() for k in kinds], pa.binary()) for i in range(len(lead), len(names))]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _bytes(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))


def count_pairs(slim: DataFrame, bits: int) -> DataFrame:
    """span, context, many, token, n: packed counts of each task's stretches of text by ranges of contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, gathered, size = Spans(0x9FB21C651E98DF25), [], 0

        def sent() -> pa.RecordBatch:
            token, context = (np.concatenate(x) for x in zip(*gathered, strict=True))
            # two pairs that share this key may alternate; then a pair comes twice and is added up later
            order = np.argsort(context >> np.uint64(32) << np.uint64(32) | token >> np.uint64(32))
            token, context = token[order], context[order]
            first = np.flatnonzero(changes(token, context))
            n = np.diff(np.append(first, len(token))).astype("<u4")
            token, context = token[first], context[first]
            out = []
            for r, a, b in stretches(ranges_of(context, bits)):
                lead = np.flatnonzero(changes(context[a:b]))
                out.append((r, context[a:b][lead], np.diff(np.append(lead, b - a)).astype("<u4"), token[a:b], n[a:b]))
            return _rows(out, ["span", "context", "many", "token", "n"], [pa.int32()])

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in pieces(offsets):
                token, context, _ = tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], spans)
                gathered.append((token, context))
                size += len(token)
                if size >= UNIT:
                    yield sent()
                    gathered, size = [], 0
        if size:
            yield sent()

    return slim.mapInArrow(run, "span int, context binary, many binary, token binary, n binary")


@dataclass(frozen=True)
class KneserNey:
    """A trained model: where its arrays lie, and its constants."""
    folder: str
    bits: int
    texts: int
    total: int
    words: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_classes: tuple[int, int, int]

    @staticmethod
    def train(docs: DataFrame, text: str = "text") -> KneserNey:
        """Learn from all rows of ``docs``; NULL is empty text, an empty text is an end alone."""
        spark = docs.sparkSession
        place = urlparse(shared_folder(spark))
        if place.scheme not in ("", "file"):
            raise ValueError("the arrays need a shared folder that workers can map into memory")
        folder = os.path.join(unquote(place.path), f"slopeline-{spark.sparkContext.applicationId}", f"ngrams-{uuid.uuid4().hex}")
        os.makedirs(folder)
        slim = _bytes(docs, text)
        size = slim.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
        bits = max(0, int(np.ceil(np.log2(max(1, size / RANGE_BYTES)))))
        schema = "span int, kind int, a binary, b binary, c binary, d binary, e binary"
        names = ["span", "kind", "a", "b", "c", "d", "e"]
        none = np.zeros(0, np.uint8)

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            """Pairs of one range: their file, the followers of their contexts, and each word's contexts."""
            span = key[0].as_py()
            context = np.repeat(_joined(table, "context", "<u8"), _joined(table, "many", "<u4"))
            token, n = _joined(table, "token", "<u8"), _joined(table, "n", "<u4")
            order = np.lexsort((token, context))
            context, token, n = context[order], token[order], n[order].astype(np.int64)
            first = np.flatnonzero(changes(context, token))
            context, token, n = context[first], token[first], np.add.reduceat(n, first)
            keys = pair_key(context, token, bits)
            order = np.argsort(keys)
            small = np.minimum(n[order], 255).astype(np.uint8)
            large = np.flatnonzero(small == 255)
            save(folder, f"pairs-{span}", key=keys[order], n=small, large=large.astype(np.int64), more=n[order][large])
            lead = np.flatnonzero(changes(context))
            follow = [np.add.reduceat(x.astype(np.int64), lead) for x in (n, n == 1, n == 2, n >= 3)]
            out = [(span, 0, context[lead], follow[0].astype("<u8"), *(x.astype("<u4") for x in follow[1:]))]
            word, before = np.unique(token, return_counts=True)
            out += [(r, 1, word[a:b], before[a:b].astype("<u4"), none, none, none) for r, a, b in stretches(ranges_of(word, bits))]
            out.append((-1, 2, how_many(n), np.array([len(n), n.sum(), len(lead)], np.int64), none, none, none))
            return pa.Table.from_batches([_rows(out, names, [pa.int32(), pa.int32()])])

        def words(key: tuple, table: pa.Table) -> pa.Table:
            """The words of one range: their file; sums pass through."""
            span = key[0].as_py()
            if span < 0:
                return table.select(names)
            kind = np.asarray(table.column("kind"))
            left, right = (table.filter(pa.array(kind == k)) for k in (0, 1))
            context, word = _joined(left, "a", "<u8"), _joined(right, "a", "<u8")
            known = np.union1d(context, word)
            followed = np.zeros(len(known), np.uint64)
            numbers = np.zeros((len(known), 4), np.uint32)
            at = np.searchsorted(known, context)
            followed[at] = _joined(left, "b", "<u8")
            for i, c in enumerate("cde"):
                numbers[at, i] = _joined(left, c, "<u4")
            np.add.at(numbers[:, 3], np.searchsorted(known, word), _joined(right, "b", "<u4"))
            save(folder, f"words-{span}", key=known, n=followed, numbers=numbers)
            return pa.Table.from_batches([_rows([(-1, 3, how_many(numbers[:, 3]), none, none, none, none)], names, [pa.int32(), pa.int32()])])

        merged = count_pairs(slim, bits).groupBy("span").applyInArrow(merge, schema)
        sums = merged.groupBy("span").applyInArrow(words, schema).collect()  # two rows a range
        total = lambda kind, c, k: np.sum([np.zeros(k, np.int64), *(np.frombuffer(r[c], np.int64) for r in sums if r.kind == kind)], axis=0, dtype=np.int64)
        pair, word, (pairs, everything, contexts) = total(2, "a", 5), total(3, "a", 5), total(2, "b", 3)
        # each text begins once, so the contexts hold one beginning and lack the end: as many as words
        model = KneserNey(folder, bits, 0, int(everything), int(contexts), int(pairs), tuple(discounts(pair)), tuple(discounts(word)),
                          (int(word[0]), int(word[1]), int(word[4])))
        begin = Arrays(model).words(np.array([BEGIN]))
        return KneserNey(**{**model.__dict__, "texts": int(begin[0][0])})

    def score(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
        """Kept columns, n_tokens, n_known, train_tokens, base_score, score of every row.

        score: log10 probability of the text with its end; base_score: that of counts plus one.
        """
        keep, model = list(keep), self
        slim = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
        names = [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spans, arrays = Spans(0x9FB21C651E98DF25), Arrays(model)
            for batch in batches:
                data, offsets = utf8(batch.column(len(keep)))
                parts = [arrays.scores(*tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], spans)) for i, j in pieces(offsets, 4 << 20)]
                n, known, base, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0)] * 4
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(keep)], pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
                     pa.array(np.full(len(n), model.total, np.int64)), pa.array(base.astype(np.float64)), pa.array(score.astype(np.float64))], names=names)

        kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
        return slim.mapInArrow(run, kinds + "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


class Arrays:
    """A worker's view of the model's files, mapped as they are needed."""

    def __init__(self, model: KneserNey):
        self.model = model
        self.files: dict[str, tuple[np.ndarray, ...] | None] = {}

    def _file(self, name: str, *keys: str) -> tuple[np.ndarray, ...] | None:
        if name not in self.files:
            path = os.path.join(self.model.folder, name)
            self.files[name] = tuple(np.load(f"{path}-{k}.npy", mmap_mode="r") for k in keys) if os.path.exists(f"{path}-{keys[0]}.npy") else None
        return self.files[name]

    def _found(self, kind: str, sorted_keys: np.ndarray, *columns: str) -> Iterator[tuple[slice, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
        """For each range of sorted keys: which of them are in the model, and where."""
        for r, a, b in stretches(ranges_of(sorted_keys, self.model.bits)):
            file = self._file(f"{kind}-{r}", "key", *columns)
            if file is None or not len(file[0]):
                continue
            at = np.searchsorted(file[0], sorted_keys[a:b])
            hit = np.flatnonzero(file[0][np.minimum(at, len(file[0]) - 1)] == sorted_keys[a:b])
            yield slice(a, b), hit, at[hit], file[1:]

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted words: how often followed, and how many followers came once, twice, more, and how many contexts."""
        followed, numbers = np.zeros(len(keys), np.int64), np.zeros((len(keys), 4), np.int64)
        for part, hit, at, (n, many) in self._found("words", keys, "n", "numbers"):
            followed[part.start + hit], numbers[part.start + hit] = n[at], many[at]
        return followed, numbers

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted pairs."""
        out = np.zeros(len(keys), np.int64)
        for part, hit, at, (small, large, more) in self._found("pairs", keys, "n", "large", "more"):
            n = small[at].astype(np.int64)
            full = np.flatnonzero(n == 255)
            n[full] = more[np.searchsorted(large, at[full])]
            out[part.start + hit] = n
        return out

    def scores(self, token: np.ndarray, context: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base and model log10 probability of each text."""
        m = self.model
        known, place = np.unique(np.concatenate([token, context]), return_inverse=True)
        followed, numbers = self.words(known)
        w, h = place[:len(token)], place[len(token):]
        count = np.where(token == END, m.texts, followed[w])
        if m.pairs:
            before = numbers[:, 3].astype(float)
            d = np.concatenate([[0.0], m.word_discounts])
            rest = float(np.dot(m.word_discounts, m.word_classes)) / m.pairs
            single = np.maximum(before - d[np.minimum(numbers[:, 3], 3)], 0) / m.pairs + rest / (m.words + 1)
            keys, which = np.unique(pair_key(context, token, m.bits), return_inverse=True)
            n = self.pairs(keys)[which]
            d = np.concatenate([[0.0], m.pair_discounts])
            free = numbers[:, :3] @ np.array(m.pair_discounts)
            total = followed[h]
            p = np.where(total > 0, (np.maximum(n - d[np.minimum(n, 3)], 0) + free[h] * single[w]) / np.maximum(total, 1), single[w])
        else:
            p = np.full(len(token), 1.0 / (m.words + 1))
        base = np.log10((count + 1) / (m.total + m.words + 1))
        first = np.cumsum(size) - size
        return size, np.add.reduceat((count > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)


def score_documents(docs: DataFrame, learns: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Scores of all rows by a model of the rows for which ``learns`` holds; see ``KneserNey.score``."""
    return KneserNey.train(docs.where(learns)).score(docs, keep)
