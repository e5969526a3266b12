"""The pipeline's near-copy stage against brute force over five-word Jaccard similarity."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slopeline.llm import near_text


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_ids(rows):
    """Smallest id of each group of texts linked at 4/5; wordless texts are one group."""
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    root = list(range(len(sets)))

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), d), d)
    return set(low.values())


def edited(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return " ".join(out)


@pytest.fixture(scope="module")
def near(llm_spark):
    """Light edits at similarities on both sides of 0.8, chains of them, one large group and shared halves."""
    rng, texts = random.Random(5), []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 400))]
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append(edited(base, max(1, round(share * len(base))), rng))
        texts.append(" ".join(base[: len(base) * 9 // 10]).upper())
    hot = [f"h{i}" for i in range(300)]
    texts += [edited(hot, rng.choice([1, 3, 6, 8]), rng) for _ in range(120)]
    texts += [" ".join(hot[:200] + [f"t{rng.random()}" for _ in range(k)]) for k in [20, 45, 60, 90] * 15]
    rng.shuffle(texts)
    return llm_spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def test_stage_finds_pairs_at_five_word_similarity(llm_spark, near):
    rows, kept = near.collect(), corpus_pipeline.near_duplicates(llm_spark, near, "")
    want = kept_ids(rows)
    assert {r.doc_id for r in kept.collect()} == want and len(want) < 0.6 * len(rows)


@pytest.mark.parametrize("paired", [1, 8])
def test_large_buckets_lose_nothing(near, paired):
    assert {r.doc_id for r in near_text.one_of_each(near, paired=paired).collect()} == kept_ids(near.collect())


def test_stage_over_documents(documents):
    kept = near_text.one_of_each(documents)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == kept_ids(documents.collect())


def test_odd_rows(odd, none):
    ids = [r.doc_id for r in near_text.one_of_each(odd).collect()]
    assert ids.count(None) == 2 and ids.count(5) == 1 and not {2, 3, 6} & set(ids) and 1 in ids
    assert {i for i in ids if i is not None} == kept_ids(odd.where(F.col("doc_id").isNotNull()).collect())
    assert near_text.one_of_each(none).count() == 0


def test_fingerprints_give_candidates(near):
    """Of the lightest edits, by pairs of all fingerprints; the pairs connect what chains of two bits connect."""
    words = [f"p{i}" for i in range(4000)]
    light = [" ".join([*words[:i], "other", *words[i + 1:]]) for i in range(0, 4000, 100)]
    texts = near.unionByName(near.sparkSession.createDataFrame([(10_000 + i, t) for i, t in enumerate(light)], near.schema))
    values = near_text.signatures(texts, ("doc_id",)).dropDuplicates(["key"]).select("key", "fingerprint").cache()
    prints = {r.key: r.fingerprint & (1 << 64) - 1 for r in values.collect()}

    def components(pairs):
        root = {k: k for k in prints}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v
        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for k in prints:
            groups.setdefault(find(k), set()).add(k)
        return {frozenset(g) for g in groups.values()}
    keys = sorted(prints)
    want = components((a, b) for i, a in enumerate(keys) for b in keys[:i] if (prints[a] ^ prints[b]).bit_count() <= 2)
    for paired in (1, 40):
        got = components((r.src, r.dst) for r in near_text.close_prints(values, paired).collect())
        assert got == want and max(map(len, want)) > 10
