"""Nearest neighbours and embedding near-dedup against brute force."""

import shutil
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeline.llm import ann, embed_dedup
from slopeline.llm.catalog import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string, score string, kept string, n_links string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c", "d") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def clustered(llm_spark):
    """Groups of near and exact copies of different size among unrelated vectors."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 12))
    near = [c + 0.1 * rng.standard_normal(12) for c, n in zip(centres, [1, 2, 5, 40, 90, 3], strict=True) for _ in range(n)]
    rows = [*near, *rng.standard_normal((150, 12)), *[near[10]] * 30, *(3.0 * x for x in near[:20])]
    vectors = [np.asarray(x, np.float32).tolist() for x in rows]
    return [(int(i), v) for i, v in zip(rng.permutation(len(vectors)) - 5, vectors, strict=True)]


BAD = [(900, None), (901, []), (902, [0.0] * 12), (903, [1.0, None] + [0.0] * 10), (904, [float("nan")] + [1.0] * 11),
       (905, [float("inf")] + [1.0] * 11), (906, [1.0] * 5)]


def whole(v):
    return v is not None and len(v) == 12 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(rows, cosine):
    good = [(i, np.array(v, np.float64)) for i, v in rows if whole(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    linked = x @ x.T >= cosine
    ids = np.array([i for i, _ in good])
    label = np.arange(len(ids))
    while True:
        new = np.where(linked, label[None, :], len(ids)).min(1)
        if (new == label).all():
            break
        label = new
    out = Counter()
    for k in range(len(ids)):
        low = int(ids[label == label[k]].min())
        out[(int(ids[k]), int(linked[k].sum()) - 1, low, int(ids[k]) == low)] += 1
    out.update((i, 0, i, i is not None) for i, v in rows if not whole(v))
    return out


def found(df):
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("small_parts", [False, True])
@pytest.mark.parametrize("cosine", [0.8, 0.9, 0.99])
def test_links(llm_spark, clustered, cosine, small_parts, monkeypatch):
    if small_parts:
        for name, value in (("PIVOT_ROWS", 20), ("CHUNK", 16), ("SPLIT", 24), ("TILE", 7)):
            monkeypatch.setattr(embed_dedup, name, value)
    rows = [*clustered, *BAD]
    got = found(embed_dedup.near_vectors(table(llm_spark, rows).repartition(3), cosine, blocks=4))
    assert got == brute_links(rows, cosine)


def test_links_of_queries_and_empty_tables(llm_spark, small):
    rows = [(r.vec_id, r.embedding) for r in llm_spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert len(found(QUERIES["op10_embed_dedup"](llm_spark, small))) == len(rows)
    assert embed_dedup.near_vectors(table(llm_spark, [])).count() == 0
    assert found(embed_dedup.near_vectors(table(llm_spark, BAD[:3]))) == Counter((i, 0, i, True) for i, _ in BAD[:3])
    twice = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (None, None)]
    assert found(embed_dedup.near_vectors(table(llm_spark, twice))) == Counter({(1, 2, 1, True): 2, (None, 2, 1, False): 1, (None, 0, None, False): 1})


def test_vectors_are_written_once(llm_spark, monkeypatch):
    """Vectors without structure visit most cells, but are not sent there."""
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(9).standard_normal((700, 12)).astype(np.float32))]
    rows += [(1000 + i, v) for i, v in rows[:40]]
    for name, value in (("PIVOT_ROWS", 20), ("CHUNK", 64), ("SPLIT", 128)):
        monkeypatch.setattr(embed_dedup, name, value)
    plans, sizes, durable, delete = [], [], embed_dedup.durable, shutil.rmtree

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return durable(df)

    def deleted(folder):
        sizes.append({end: sum(f.stat().st_size for f in Path(folder).glob(f"*.{end}")) for end in ("vec", "weight")})
        delete(folder)

    monkeypatch.setattr(embed_dedup, "durable", kept)
    monkeypatch.setattr(shutil, "rmtree", deleted)
    assert found(embed_dedup.near_vectors(table(llm_spark, rows))) == brute_links(rows, 0.9)
    assert sum("hashpartitioning(vec" in p for p in plans) == 1 and not any("FlatMapGroupsInArrow" in p for p in plans)
    assert sizes == [{"vec": 700 * 12 * 4, "weight": 700 * 8}]


def test_chunks_and_their_partners():
    """Every row lies in one chunk, and every pair of chunks meets once."""
    files = [(3, 10), (5, 1), (9, 25), (12, 7)]
    chunks = embed_dedup.cut_files(files, 8)
    assert [sum(b - a for _, a, b in c) for c in chunks] == [8, 8, 8, 8, 8, 3]
    assert [(name, i) for c in chunks for name, a, b in c for i in range(a, b)] == [(name, i) for name, n in files for i in range(n)]
    for n in range(1, 12):
        for run in (1, 2, 5):
            pairs = [frozenset((i, j)) for i in range(n) for first in range(0, n // 2 + 1, run) for j in embed_dedup.partners(n, i, first, first + run)]
            assert len(pairs) == len(set(pairs)) == n * (n + 1) // 2


def test_signed_zeros_are_equal(llm_spark):
    got = found(embed_dedup.near_vectors(table(llm_spark, [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [1.0, -0.0]), (4, [1.0, 0.0])])))
    assert got == Counter([(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False)])


def test_near_in_some_block():
    """Every linked pair has a block that owns it."""
    rng = np.random.default_rng(4)
    a = rng.standard_normal((2000, 10))
    b = a + 0.2 * rng.standard_normal((2000, 10))
    a, b = embed_dedup.unit(a), embed_dedup.unit(b)
    cut = embed_dedup.Blocks(10, 0.9, 3, a[:50], 5, 7)
    linked = (a * b).sum(1) >= 0.9
    apart = (a @ cut.turn - b @ cut.turn) ** 2
    near = np.array([apart[:, s:e].sum(1) <= w for (s, e), w in zip(cut.spans, cut.share, strict=True)])
    assert linked.sum() > 100 and near[:, linked].any(0).all()


def recall(rows, got, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if whole(v)]
    x, ids = np.array([v for _, v in good]), np.array([i for i, _ in good])
    hits = total = 0
    for q, v in good:
        if q % 20:
            continue
        score = x @ v
        others = ids != q
        order = np.lexsort((ids[others], -score[others]))[:k]
        best, floor = ids[others][order], score[others][order][-1]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(best) + 1)) and len({r.vec_id for r in mine}) == len(mine)
        for r in mine:
            assert r.vec_id != q and r.score == pytest.approx(float(x[ids == r.vec_id][0] @ v), rel=1e-12)
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(mine, mine[1:], strict=False))
        hits += sum(r.score >= floor - 1e-9 for r in mine)
        total += len(best)
    return hits / total


@pytest.mark.parametrize("rows_of_a_shard", [60, 8192])
def test_nearest(llm_spark, clustered, rows_of_a_shard, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", rows_of_a_shard)
    monkeypatch.setattr(ann, "QUERY_ROWS", 5)
    rows = [*clustered, *BAD, (920, [0.5] * 12), (None, [1.0] * 12)]
    df = table(llm_spark, rows)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    assert recall([r for r in rows if r[0] is not None], got, 20) > 0.97
    assert not {r.query_id for r in got} & {i for i, v in BAD}


def test_nearest_of_few(llm_spark):
    df = table(llm_spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (4, None)])
    got = ann.nearest(df, df.where("vec_id = 0"), 20).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 2, 2.0), (0, 2, 3, 2.0), (0, 3, 1, 0.0)]
    assert ann.nearest(table(llm_spark, []), table(llm_spark, [])).count() == 0
    one = table(llm_spark, [(0, [1.0])])
    assert ann.nearest(one, one).count() == 0


def test_query_recall(llm_spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op4_ann"](llm_spark, folder).collect()
    vectors = llm_spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).collect()
    x, ids = np.array([r.v for r in vectors]), np.array([r.vec_id for r in vectors])
    near = {}
    for r in got:
        near.setdefault(r.query_id, set()).add(r.vec_id)
    asked = ids[ids % 20 == 0]
    assert set(near) == set(asked.tolist())
    hits = 0
    for q in asked:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hits += len(near[q] & set(ids[np.argsort(-score)[:20]].tolist()))
    assert hits / (20 * len(asked)) > 0.9


def test_vectors_of_several_lengths(llm_spark, clustered):
    """Those of a rarer length link and are found among themselves."""
    rng = np.random.default_rng(8)
    short = [(2000 + i, np.asarray(v, np.float32).tolist()) for i, v in enumerate([*rng.standard_normal((30, 5)), [1.0] * 5, [1.0] * 5, [2.0] * 5])]
    got = {r.vec_id: r for r in embed_dedup.near_vectors(table(llm_spark, [*clustered, *short])).collect()}
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in (2030, 2031, 2032)] == [(2, 2030, True), (2, 2030, False), (2, 2030, False)]
    assert all(got[i].n_links == n for i, n, _, _ in brute_links(clustered, 0.9))
    df = table(llm_spark, [*clustered, *short])
    mine = ann.nearest(df, df.where("vec_id = 2020"), 20).orderBy("rank").collect()
    x, q = np.array([v for _, v in short], np.float64), np.array(short[20][1], np.float64)
    order = [i for i in np.lexsort((np.arange(len(x)), -(x @ q))) if i != 20][:20]
    assert [r.vec_id for r in mine] == [2000 + i for i in order]


@pytest.mark.parametrize("rows_of_a_shard", [70, 8192])
def test_ties_go_to_the_smallest_id(llm_spark, rows_of_a_shard, monkeypatch):
    """Vectors of zeros and ones: most scores are shared by many different vectors."""
    monkeypatch.setattr(ann, "SHARD_ROWS", rows_of_a_shard)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2, (600, 12)).astype(float)
    ids = rng.permutation(600)
    df = table(llm_spark, [(int(i), v.tolist()) for i, v in zip(ids, x) if v.any()])
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20, beam=700).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    keep = x.any(1)
    for q in range(0, 600, 20):
        at = int(np.flatnonzero(ids == q)[0])
        if keep[at]:
            score = x[keep] @ x[at]
            assert got[q] == [i for i in ids[keep][np.lexsort((ids[keep], -score))] if i != q][:20]
