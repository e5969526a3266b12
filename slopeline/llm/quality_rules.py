"""A sparse rule ensemble over text statistics.

Statistics of the whole text are computed in one pass. Shallow trees of a random forest propose rules:
every path from a root is a conjunction of bounds on statistics. A logistic model with a lasso penalty
keeps a few of them. The kept rules become one column expression, so scoring is a projection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.llm.common import Spans, crc_fold, pieces, utf8, word_spans
from slopeline.session import durable

STATISTICS = ["log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "stop_share", "sign_share", "bar_share",
              "high_share", "break_share", "same_as_before", "distinct_words", "commonest_word", "short_words", "long_words",
              "capital_words", "signed_words", "bare_words", "byte_entropy", "sentence_words"]
#: Classes of bytes: 0 other letters, 1 upper case, 2 digits, 3 sentence marks, 4 other signs, 5 bar, 6 above ASCII, 7 line break, 8 blank.
KIND = np.zeros(256, np.int64)
KIND[:32], KIND[127] = 4, 4
KIND[ord("A"):ord("Z") + 1], KIND[ord("0"):ord("9") + 1], KIND[128:] = 1, 2, 6
for _c in range(33, 127):
    if not chr(_c).isalnum():
        KIND[_c] = 3 if chr(_c) in ".,;:?'\"()-" else 4
KIND[ord("|")], KIND[10] = 5, 7
KIND[[9, 11, 12, 13, 32]] = 8


class Statistics:
    """Statistics of a piece of texts, a row each."""

    def __init__(self):
        self.spans = Spans(0xD6E8FEB86659FD93)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, size = len(offsets) - 1, np.diff(offsets)
        text = np.repeat(np.arange(n), size)
        kinds = np.bincount(text * 9 + KIND[data], minlength=9 * n).reshape(n, 9) if len(data) else np.zeros((n, 9))
        ink = np.maximum(1, kinds[:, :7].sum(1))
        letters = np.maximum(1, kinds[:, 0] + kinds[:, 1])
        starts, ends, first = word_spans(data, offsets)
        words, length = np.diff(first), ends - starts
        some = np.maximum(1, words)
        owner = np.repeat(np.arange(n), words)

        def share(mask: np.ndarray) -> np.ndarray:
            return np.bincount(owner, mask, n) / some if len(owner) else np.zeros(n)

        out = np.zeros((n, len(STATISTICS)))
        hashes = self.spans(data, starts, ends)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        order = np.lexsort((hashes, owner))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        edge = np.flatnonzero(np.append(new, True))
        distinct = np.bincount(owner[order][new], minlength=n) if len(order) else np.zeros(n)
        commonest = np.zeros(n)
        if len(order):
            np.maximum.at(commonest, owner[order][new], np.diff(edge))
        head = KIND[data[starts]] if len(starts) else starts
        tail = KIND[data[ends - 1]] if len(starts) else starts
        inner = KIND[data[np.maximum(starts, ends - 2)]] if len(starts) else starts
        counts = np.zeros((n, 256))
        for i in range(n):
            counts[i] = np.bincount(data[offsets[i]:offsets[i + 1]], minlength=256)
        p = counts / np.maximum(1, size)[:, None]
        columns = [np.log1p(size), np.log1p(words), ink / some, kinds[:, 1] / letters, kinds[:, 2] / ink, kinds[:, 3] / ink, kinds[:, 4] / ink,
                   kinds[:, 5] / ink, kinds[:, 6] / ink, kinds[:, 7] / some, share(same), distinct / some, commonest / some,
                   share(length <= 3), share(length >= 15), share(head == 1), share((tail == 4) & (inner >= 3)),
                   share((head >= 2) & (head <= 5) & (length == 1)), -(p * np.log2(np.maximum(p, 1e-12))).sum(1), some / (1 + kinds[:, 3])]
        for i, c in enumerate(columns):
            out[:, i] = c
        return out


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns and the statistics of the whole text as doubles; NULL is empty text."""
    keep = list(keep)
    slim = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Statistics()
        for batch in batches:
            data, offsets = utf8(batch.column(len(keep)))
            parts = [measure(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]) for i, j in pieces(offsets)]
            rows = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *(pa.array(c) for c in rows.T)], names=[*keep, *names])

    names = [f"_{s}" for s in STATISTICS]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return slim.mapInArrow(run, kinds + ", ".join(f"{c} double" for c in names))


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics: (number of the statistic, greater than, at most); None where there is no bound."""
    bounds: tuple[tuple[int, float | None, float | None], ...]

    def column(self) -> Column:
        parts = []
        for i, low, high in self.bounds:
            c = F.col(f"_{STATISTICS[i]}")
            parts += [c > F.lit(low)] * (low is not None) + [c <= F.lit(high)] * (high is not None)
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def __str__(self) -> str:
        return " and ".join(f"{'' if a is None else f'{a:.6g} < '}{STATISTICS[i]}{'' if b is None else f' <= {b:.6g}'}" for i, a, b in self.bounds)


@dataclass(frozen=True)
class RuleModel:
    """score = 1 / (1 + exp(-(bias + the weights of the rules that hold)))."""
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def rules_of(forest_text: str) -> list[Rule]:
    """Every path from a root to a node below it, with the bounds on one statistic joined; each rule once."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, int, str, float]] = []
    for line in forest_text.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, int(m[3]), m[4], float(m[5])))
        bounds: dict[int, list[float | None]] = {}
        for _, i, sign, value in path:
            b = bounds.setdefault(i, [None, None])
            if sign == ">":
                b[0] = value if b[0] is None else max(b[0], value)
            else:
                b[1] = value if b[1] is None else min(b[1], value)
        found[Rule(tuple((i, *b) for i, b in sorted(bounds.items())))] = None
    return list(found)


def fit_rules(rows: DataFrame, label: str = "label", trees: int = 24, depth: int = 3, penalty: float = 0.0005, seed: int = 5) -> RuleModel:
    """A rule model of rows that hold the statistics and a label of 0 or 1.

    Without two classes the score is the smoothed share of label 1.
    """
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0))).first()
    bias = float(np.log((ones + 1) / (n - ones + 1)))
    if not 0 < ones < n:
        return RuleModel(bias, ())
    data = rows.select(F.col(label).cast("double").alias("label"), array_to_vector(F.array(*[F.col(f"_{s}") for s in STATISTICS])).alias("x"),
                       *[f"_{s}" for s in STATISTICS])
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, seed=seed,
                                    featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(data)
    rules = rules_of(forest.toDebugString)
    if not rules:
        return RuleModel(bias, ())
    held = durable(data.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("r")))
    line = LogisticRegression(featuresCol="r", labelCol="label", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=100).fit(held)
    kept = [(r, float(w)) for r, w in zip(rules, line.coefficients.toArray(), strict=True) if abs(w) > 1e-6]
    return RuleModel(float(line.intercept), tuple(sorted(kept, key=lambda x: -abs(x[1]))))


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, folds: int = 3, held_out: int = 1) -> RuleModel:
    """Fit on at most ``most`` labelled documents, the first in the order of a hash of their id, none of
    them from the held-out fold. NULL labels and ids teach nothing; a document labelled twice counts twice."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held_out))
    some = known.select("doc_id", F.col("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")
    return fit_rules(durable(statistics(texts).join(F.broadcast(some), "doc_id")))


def scored(docs: DataFrame, model: RuleModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text", folds: int = 3, held_out: int = 1) -> DataFrame:
    """Kept columns (doc_id among them), held_out, score, predicted of every row."""
    score = statistics(docs, text, keep).select(*keep, model.score().alias("score"))
    return score.select(*keep, (crc_fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))
