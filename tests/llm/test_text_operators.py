"""Sharding, token counts, Kneser-Ney, packing, quality, SimHash, passages and mixing against brute force."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from math import log10

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slopeline.llm import kneser_ney, mixing, packing, quality_rules, sharding, simhash, substring, token_counts
from slopeline.llm.catalog import QUERIES
from slopeline.llm.common import crc_fold, row_numbers

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def held(doc_id, folds, at):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == at


# --- sharding

@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 101, 1000])
def test_permutation_and_its_inverse(llm_spark, n):
    df = llm_spark.range(n).withColumn("p", sharding.permuted(F.col("id"), n, 9))
    rows = df.withColumn("back", sharding.restored(F.col("p"), n, 9)).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    spots = df.withColumn("at", sharding.place_of(F.col("id"), n, 4, 9)).withColumn("back", sharding.row_at(F.col("at.shard"), F.col("at.slot"), n, 4, 9))
    assert all(r.back == r.id for r in spots.collect())


def test_row_numbers_restart_and_have_no_gaps(odd):
    got = defaultdict(list)
    for r in row_numbers(odd.select("source", "doc_id"), ["source"], [F.col("doc_id")]).collect():
        got[r.source].append((r.row_no, -1 << 60 if r.doc_id is None else r.doc_id))
    for rows in got.values():
        assert [n for n, _ in sorted(rows)] == list(range(len(rows))) and [d for _, d in sorted(rows)] == sorted(d for _, d in rows)


def test_shards(llm_spark, small, odd, none, texts):
    rows = QUERIES["op1_sharding"](llm_spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    count = Counter(r.shard for r in rows)
    assert set(count) == set(range(24)) and max(count.values()) - min(count.values()) <= 1
    assert {(r.shard, r.slot) for r in rows} == {(s, i) for s, n in count.items() for i in range(n)}
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(llm_spark.read.parquet(f"{small}/documents.parquet").repartition(7)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    hard = sharding.shard_documents(odd).collect()
    assert len(hard) == 17 and sum(r["size"] == 8 for r in hard) == 3
    assert sharding.shard_documents(none).count() == 0


# --- token counts

@pytest.fixture(scope="module")
def bytes_library():
    return Tokenizer.from_file(BYTES)


def test_token_counts(llm_spark, small, odd, none, texts, bytes_library):
    got = {r.doc_id: r for r in QUERIES["op2_token_counts"](llm_spark, small).collect()}
    for i, t in texts.items():
        n = len(bytes_library.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 1024)
    rows = odd.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), len(bytes_library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(odd, BYTES).collect()) == want
    assert token_counts.token_counts(none, BYTES).count() == 0


def test_merges_of_hard_strings(bytes_library):
    hard = ["a" * n for n in (1, 2, 3, 4, 5, 31, 1000)] + ["ab" * 500, "  \n\n \t x", "'s've'll", "  x", "\x1c\x1dy", "1234567890" * 40, "ﬀ ǅ \U0001F600 \U00010400"]
    assert token_counts.Counter(BYTES)(hard) == [len(e.ids) for e in bytes_library.encode_batch(hard, add_special_tokens=False)]


# --- Kneser-Ney

def brute_scores(rows, learns):
    words = [(i, (t or "").encode().lower().split() + ["end"]) for i, t in rows]
    single, pairs = Counter(), Counter()
    for i, w in words:
        if learns(i):
            single.update(w)
            pairs.update(zip(["begin", *w], w, strict=False))
    n, v = sum(single.values()), len(single)

    def discounts(counts):
        c = [sum(x == k for x in counts) for k in (1, 2, 3, 4)]
        if min(c) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = c[0] / (c[0] + 2 * c[1])
        return [0, *(min(max(k - (k + 1) * y * c[k] / c[k - 1], 0.05), k) for k in (1, 2, 3))]

    before = Counter(w for _, w in pairs)
    d2, d1 = discounts(list(pairs.values())), discounts(list(before.values()))
    total, free = Counter(), Counter()
    for (h, _), k in pairs.items():
        total[h] += k
        free[h] += d2[min(k, 3)]
    rest = sum(d1[min(k, 3)] for k in before.values()) / len(pairs) if pairs else 1

    def p1(w):
        return (max(before[w] - d1[min(before[w], 3)], 0) / len(pairs) if pairs else 0) + rest / (v + 1)

    def p(h, w):
        k = pairs.get((h, w), 0)
        return (max(k - d2[min(k, 3)], 0) + free[h] * p1(w)) / total[h] if total[h] else p1(w)

    for h in ["begin", "the", "never seen"]:
        assert sum(p(h, w) for w in single) + p(h, "unknown") == pytest.approx(1)
    return {(i, t): (len(w), sum(x in single for x in w), n, sum(log10((single[x] + 1) / (n + v + 1)) for x in w),
                     sum(log10(p(h, x)) for h, x in zip(["begin", *w], w, strict=False))) for (i, w), (_, t) in zip(words, rows, strict=True)}


def check_scores(got, rows, learns):
    want = brute_scores(rows, learns)
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for (i, _), x in want.items():
        by_id[i].append(x)
    for r in got:
        assert any((r.n_tokens, r.n_known, r.train_tokens) == x[:3] and r.base_score == pytest.approx(x[3]) and r.score == pytest.approx(x[4]) for x in by_id[r.doc_id])


def test_kneser_ney(llm_spark, small, odd, none, texts):
    got = QUERIES["op3_kneser_ney"](llm_spark, small).collect()
    check_scores(got, list(texts.items()), lambda i: not held(i, 7, 2))
    assert all(r.held_out == held(r.doc_id, 7, 2) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check_scores(kneser_ney.score_documents(odd, crc_fold(F.col("doc_id"), 7) != 2).collect(), rows, lambda i: not held(i, 7, 2))
    unread = kneser_ney.score_documents(odd, F.lit(False)).collect()
    assert all((r.n_known, r.train_tokens, r.score, r.base_score) == (0, 0, 0, 0) for r in unread)
    assert kneser_ney.score_documents(none, F.lit(True)).count() == 0


def test_large_counts_and_ranges(llm_spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "RANGE_BYTES", 400)
    rows = [(i, "a b " * (200 if i == 0 else i)) for i in range(12)] + [(50, "a c d")]
    got = kneser_ney.score_documents(llm_spark.createDataFrame(rows, "doc_id int, text string"), F.lit(True)).collect()
    check_scores(got, rows, lambda i: True)


# --- packing

def test_differencing_keeps_all_items():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = rng.integers(1, 100, rng.integers(1, 40)).tolist()
        k = int(rng.integers(1, 12))
        parts = packing.differencing(sizes, k)
        assert len(parts) <= k and sorted(i for _, items in parts for i in items) == list(range(len(sizes)))
        assert all(total == sum(sizes[i] for i in items) for total, items in parts)
        assert all(total <= 128 for total, _ in packing.fitted(sizes, 128))
    assert sorted(t for t, _ in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


def check_packed(rows, texts, window=2048):
    library = Tokenizer.from_file(WORDS)
    ids = defaultdict(list)
    for i, t in texts:
        ids[i].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    for r in rows:
        assert any(r.doc_tokens == len(x) and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(len(x) for xs in ids.values() for x in xs)
    sequence = defaultdict(list)
    for r in rows:
        sequence[r.sequence_id].append((r.offset, r.length))
    for parts in sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= window
    return sum(r.length for r in rows) / (window * max(1, len(sequence)))


def test_packing(llm_spark, small, odd, none, texts):
    assert check_packed(QUERIES["op5_packing"](llm_spark, small).collect(), list(texts.items())) > 0.97
    check_packed(packing.pack_documents(odd, WORDS).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack_documents(none, WORDS).count() == 0


# --- quality

def test_rules_are_paths_of_the_trees():
    text = "Tree 0\n  If (feature 1 <= 0.5)\n   If (feature 1 <= 0.25)\n    Predict: 0.0\n   Else (feature 1 > 0.25)\n    Predict: 1.0\n  Else (feature 1 > 0.5)\n   Predict: 1.0\n"
    rules = [r.bounds for r in quality_rules.rules_of(text)]
    assert rules == [((1, None, 0.5),), ((1, None, 0.25),), ((1, 0.25, 0.5),), ((1, 0.5, None),)]


def test_statistics_of_pieces_agree(llm_spark, documents, monkeypatch):
    names = [f"_{s}" for s in quality_rules.STATISTICS]
    whole = {r.doc_id: r for r in quality_rules.statistics(documents).collect()}
    r = next(iter(whole))
    text = {d.doc_id: d.text for d in documents.collect()}[r]
    words = text.encode().split()
    assert whole[r]._log_words == pytest.approx(np.log1p(len(words))) and whole[r]._distinct_words == pytest.approx(len(set(words)) / len(words))
    assert whole[r]._same_as_before == pytest.approx(sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words))
    alone = quality_rules.statistics(documents.where(F.col("doc_id") == r)).collect()[0]
    assert all(alone[n] == pytest.approx(whole[r][n]) for n in names)


def test_quality_holds_out(llm_spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op6_quality"](llm_spark, folder).collect()}
    labels = llm_spark.read.parquet(f"{folder}/labels.parquet").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held(i, 3, 1) for i, r in rows.items())
    out = [(rows[x.doc_id].predicted, x.quality) for x in labels if rows[x.doc_id].held_out]
    assert sum(a == b for a, b in out) / len(out) > 0.97


def test_quality_of_odd_tables(llm_spark, odd, none):
    labels = llm_spark.createDataFrame([(1, 1), (2, None), (None, 0), (5, 1), (5, 0), (8, 1), (13, 0)], "doc_id bigint, quality int")
    for known in (labels, labels.where("false"), labels.where("quality = 1")):
        model = quality_rules.train(odd, known)
        got = quality_rules.scored(odd, model).collect()
        assert len(got) == 17 and all(0 <= r.score <= 1 for r in got)
    assert quality_rules.scored(none, model).count() == 0


# --- SimHash

def brute_print(text, shingle=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, distance):
    values = sorted(set(values))
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= distance:
                label[root(a)] = root(b)
    return {v: root(v) for v in values}


def check_groups(rows, texts):
    prints = [(i, brute_print(t)) for i, t in texts]
    root = components([p for _, p in prints], 2)
    low = {}
    for i, p in prints:
        if i is not None:
            low[root[p]] = min(low.get(root[p], i), i)
    want = Counter((i, f"{p:016x}", low.get(root[p])) for i, p in prints)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want


def test_simhash(llm_spark, small, odd, none, texts):
    check_groups(QUERIES["op7_simhash"](llm_spark, small).collect(), list(texts.items()))
    found = simhash.near_copies(odd).select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")
    check_groups(found.collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.near_copies(none).count() == 0


@pytest.mark.parametrize("paired", [1, 3, 1000])
def test_links_connect_what_chains_connect(llm_spark, paired):
    rng = np.random.default_rng(paired)
    centre = [int(x) for x in rng.integers(0, 1 << 63, 4)]
    values = {c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centre for _ in range(60)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = [(r.src % (1 << 64), r.dst % (1 << 64)) for r in simhash.links(llm_spark.createDataFrame([(v,) for v in signed], "fingerprint bigint"), 2, paired).collect()]
    assert all(0 < (a ^ b).bit_count() <= 2 for a, b in edges)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a, b in edges:
        root[find(a)] = find(b)
    want = components(values, 2)
    assert len({find(v) for v in values}) == len(set(want.values()))
    assert all(len({find(v) for v in values if want[v] == w}) == 1 for w in set(want.values()))


def test_one_of_each(odd, documents, none):
    ids = sorted(str(r.doc_id) for r in simhash.one_of_each(odd).collect())
    assert ids.count("None") == 2 and ids.count("5") == 1 and "6" not in ids and "2" not in ids and "3" not in ids and "1" in ids
    kept = simhash.one_of_each(documents)
    assert kept.columns == documents.columns
    groups = simhash.near_copies(documents).collect()
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in groups}
    assert simhash.one_of_each(none).count() == 0


# --- passages

def brute_kept(rows, width):
    seen = Counter()
    words = [(t or "").encode().split() for _, t in rows]
    for w in words:
        seen.update(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(w) - width + 1):
            if seen[tuple(w[p:p + width])] > 1:
                gone.update(range(p, p + width))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), sha256(kept).hexdigest()))
    return Counter(out)


def digest(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.h) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h")).collect())


def test_passages(llm_spark, small, odd, none, texts):
    rows = QUERIES["op8_substring"](llm_spark, small).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == brute_kept(list(texts.items()), 35)
    assert digest(substring.remove_repeats(odd)) == brute_kept([(r.doc_id, r.text) for r in odd.collect()], 35)
    assert substring.remove_repeats(none).count() == 0


@pytest.mark.parametrize("width", [1, 3, 13])
def test_passages_of_few_words(llm_spark, width, monkeypatch):
    monkeypatch.setattr(substring, "UNIT", 50)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 300)
    rng = np.random.default_rng(width)
    rows = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 60)))) for i in range(40)]
    df = llm_spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    assert digest(substring.remove_repeats(df, width)) == brute_kept(rows, width)


# --- mixing

def check_mixed(rows, block_rows, share=None):
    by_slot = {}
    for r in rows:
        assert by_slot.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(by_slot) == list(range(len(by_slot)))
    count, used = Counter(r.source for r in rows), Counter()
    blocks = {s: -(-n // block_rows) for s, n in count.items()}
    for slot in range(len(by_slot)):
        source, block = by_slot[slot]
        assert block == used[source]
        used[source] += 1
    assert used == blocks
    places = Counter((r.source, r.block, r.place) for r in rows)
    assert max(places.values(), default=1) == 1
    return by_slot


def test_mixing(llm_spark, small, odd, none, texts):
    rows = QUERIES["op9_mixing"](llm_spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    check_mixed(rows, 16)
    hard = mixing.mixed_rows(odd, block_rows=1).collect()
    assert len(hard) == 17
    check_mixed(hard, 1)
    assert mixing.mixed_rows(none).count() == 0 and mixing.in_order(mixing.mixed_rows(none)).count() == 0


def test_shares_deviate_by_less_than_a_block(llm_spark):
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    df = llm_spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(800)], "doc_id int, source string")
    by_slot = check_mixed(mixing.mixed_rows(df, weights, block_rows=1, period=12).collect(), 1)
    used, whole = Counter(), mixing.whole_weights(weights, 12)
    assert sum(whole.values()) == 12
    for slot in range(len(by_slot)):
        used[by_slot[slot][0]] += 1
        if max(used.values()) == 200:
            break
        for s, w in whole.items():
            assert abs(used[s] - (slot + 1) * w / 12) < 1
    assert {by_slot[s][0] for s in range(600, 800)} == {"d"}


def test_order_of_the_written_rows(llm_spark, documents, tmp_path):
    mixed = mixing.mixed_rows(documents, block_rows=4)
    place = {r.doc_id: (r.slot, r.place) for r in mixed.collect()}
    mixing.in_order(mixed, 40).write.parquet(str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("*.parquet"))
    ids = [i for f in files for i in __import__("pyarrow.parquet").parquet.read_table(f).column("doc_id").to_pylist()]
    assert len(files) > 1 and ids == sorted(place, key=place.get)
