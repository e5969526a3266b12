"""Shares of the mixing schedule against the target weights themselves, over many slots."""

from collections import Counter

import pytest

from slopeline.llm import mixing


def deviation(order, weights):
    """Largest distance from the share of any source while all go on."""
    total, used, worst = sum(weights.values()), Counter(), 0.0
    last = {s: max(i for i, x in enumerate(order) if x == s) for s in weights}
    for t, s in enumerate(order[:min(last.values()) + 1]):
        used[s] += 1
        worst = max(worst, *(abs(used[x] - (t + 1) * w / total) for x, w in weights.items()))
    return worst


@pytest.mark.parametrize("weights", [
    {"a": 1 / 3, "b": 2 / 3}, {"a": 0.0001, "b": 0.9999}, {"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{i}": (i + 1) ** 0.5 for i in range(20)}, {None: 1e-9, "a": 1.0}])
def test_shares_follow_the_target(weights):
    blocks = {s: max(1, round(40_000 * w / sum(weights.values()))) for s, w in weights.items()}
    plan = mixing.schedule(blocks, mixing.exact_weights(weights))
    order = [s for _, s in sorted((int(t), s or "") for s, x in plan.items() for t in x)]
    assert {s: len(x) for s, x in plan.items()} == blocks
    assert sorted(int(t) for x in plan.values() for t in x) == list(range(sum(blocks.values())))
    assert deviation(order, {s or "": w for s, w in weights.items()}) < 1


def test_rows_follow_the_target(llm_spark):
    weights = {"a": 1 / 3, "b": 2 / 3}
    df = llm_spark.range(9000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', 'b') AS source")
    rows = sorted(mixing.mixed_rows(df, weights, block_rows=1).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(9000)) and sorted(r.doc_id for r in rows) == list(range(9000))
    assert deviation([r.source for r in rows], weights) < 1


def test_default_weights_over_many_rows(llm_spark):
    sizes = {"a": 200, "b": 3000, "c": 30_000}
    df = llm_spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id int, source string")
    rows = sorted(mixing.mixed_rows(df, block_rows=1).collect(), key=lambda r: r.slot)
    assert deviation([r.source for r in rows], mixing.tempered(sizes, 0.5)) < 1
