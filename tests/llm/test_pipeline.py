"""The stages of the pipeline, one after the other, each against brute force on its own input."""

from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_near_text import kept_ids
from test_text_operators import check_packed

import corpus_pipeline
from slopeline.llm import mixing, packing, quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return Counter(tuple(r) for r in df.select(COLUMNS).collect())


def kept_texts(rows, width=35):
    seen = Counter()
    for r in rows:
        w = (r.text or "").encode().split()
        seen.update(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
    out = Counter()
    for r in rows:
        w = (r.text or "").encode().split()
        gone = {q for p in range(len(w) - width + 1) if seen[tuple(w[p:p + width])] > 1 for q in range(p, p + width)}
        text = b" ".join(x for p, x in enumerate(w) if p not in gone).decode() if gone else r.text
        out[(r.doc_id, text, r.lang, r.source, None if text is None else len(text))] += 1
    return out


@pytest.fixture(scope="module")
def stages(llm_spark, tmp_path_factory):
    """Input and output of every stage over a whole small table."""
    folder = "/root/testdata/sf0.001"
    docs, out = llm_spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(llm_spark, docs, folder).write.parquet(path)
        out[name] = (docs, llm_spark.read.parquet(path), path)
        docs = out[name][1]
    return out


def test_all_but_the_last_return_documents(stages):
    assert list(stages) == ["quality", "near_duplicates", "passages", "mixing", "packing"]
    assert all(out.columns == COLUMNS for name, (_, out, _) in stages.items() if name != "packing")


def test_quality(llm_spark, stages):
    docs, out, _ = stages["quality"]
    model = quality_rules.train(docs, llm_spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    good = {r.doc_id for r in quality_rules.scored(docs, model).where("predicted = 1").collect()}
    assert rows_of(out) == rows_of(docs.where(F.col("doc_id").isin(good))) and 0 < len(good) < docs.count()


def test_near_duplicates(stages):
    docs, out, _ = stages["near_duplicates"]
    assert rows_of(out) == rows_of(docs.where(F.col("doc_id").isin(kept_ids(docs.collect()))))


def test_passages(stages):
    docs, out, _ = stages["passages"]
    assert rows_of(out) == kept_texts(docs.collect()) != rows_of(docs)


def test_mixing(stages):
    docs, out, path = stages["mixing"]
    assert rows_of(out) == rows_of(docs)
    place = {r.doc_id: (r.slot, r.place) for r in mixing.mixed_rows(docs).collect()}
    from pathlib import Path
    ids = [i for f in sorted(Path(path).glob("*.parquet")) for i in pq.read_table(f).column("doc_id").to_pylist()]
    assert ids == sorted(place, key=place.get)


def test_packing(stages):
    docs, out, _ = stages["packing"]
    assert check_packed(out.collect(), [(r.doc_id, r.text) for r in docs.collect()]) > 0.95


def test_sequences_follow_the_mix(llm_spark, stages, tmp_path):
    """Also when the last files are the largest, which Spark reads first."""
    docs = stages["mixing"][0]
    mixed = mixing.mixed_rows(docs, block_rows=4)
    place = {r.doc_id: (r.slot, r.place) for r in mixed.collect()}
    rank = {i: n for n, i in enumerate(sorted(place, key=place.get))}
    path = str(tmp_path / "mixed")
    mixing.in_order(mixed, 60).write.parquet(path)
    written = llm_spark.read.parquet(path)
    for most in (1024, 100):
        if most == 1024:
            rows = corpus_pipeline.packing(llm_spark, written, "").collect()
        else:
            pieces = packing.token_pieces(mixing.with_place(written), public_tokenizers.path("word_bpe_49k.json"), order=("_mixed",))
            rows = packing.pack(pieces, group_rows=most, order=("_mixed",)).collect()
        assert check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()]) > 0.9
        sequences, groups = {}, {}
        for r in rows:
            sequences.setdefault(r.sequence_id, []).append((rank[r.doc_id], r.start))
            groups.setdefault(r.sequence_id >> 32, []).append((rank[r.doc_id], r.start))
        assert len(groups) == -(-len(rows) // most) and max(map(len, groups.values())) <= most
        for a, b in zip(sorted(groups), sorted(groups)[1:], strict=False):
            assert max(groups[a]) < min(groups[b])
        first = [min(sequences[s]) for s in sorted(sequences)]
        assert first == sorted(first)


def test_run(llm_spark, stages):
    out = corpus_pipeline.run(llm_spark, "/root/testdata/sf0.001")
    assert out.columns == stages["packing"][1].columns and out.count() == stages["packing"][1].count()


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(llm_spark, odd, none, empty, tmp_path):
    more = {"lang": F.lit("en"), "n_chars": F.length("text").cast("bigint")}
    docs = (none if empty else odd).withColumns(more)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        stage(llm_spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = llm_spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == before
    assert (docs.count() == 0) == empty
