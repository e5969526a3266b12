"""The corpus pipeline: quality rules, near copies, repeated passages, mixing, packing.

Each stage takes all rows that the one before kept, is written as Parquet and read again. The first four
return the columns of ``documents``, the last one row per packed piece.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeline.llm.common import ready
from slopeline.llm.mixing import in_order, mixed_rows, with_place
from slopeline.llm.near_text import one_of_each
from slopeline.llm.packing import pack_documents
from slopeline.llm.quality_rules import scored, train
from slopeline.llm.substring import remove_repeats
from slopeline.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject. It learns from labelled documents outside the
    held-out fold; without labels of both classes nothing is rejected but by their share."""
    ready(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    columns = docs.columns
    keyed = docs.select(F.struct(*columns).alias("_row"), "doc_id", "text")
    return scored(keyed, model, ("_row", "doc_id")).where("predicted = 1").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of texts that agree to 0.8 in their
    five-word shingles. Candidates come from SimHash, and from MinHash where fingerprints lie too far apart."""
    ready(spark)
    return one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words that repeated windows cover; a text that loses none stays as it is.
    n_chars follows the text."""
    ready(spark)
    rest = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("rest")
    cleaned = remove_repeats(docs.select("doc_id", "text", rest))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text")
    out = cleaned.select("doc_id", text, "rest").select("doc_id", "text", "rest.*")
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the schedule: the files of the stage follow each other, and so do the
    rows in them. Sources are weighted by the square roots of their sizes."""
    ready(spark)
    rows = docs.select("doc_id", "source", F.struct(*docs.columns).alias("whole"))
    return in_order(mixed_rows(rows)).select("whole.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences, which follow the documents in the order of their files: that of the
    schedule."""
    ready(spark)
    return pack_documents(with_place(docs), public_tokenizers.path("word_bpe_49k.json"), order=("_mixed",))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mixing", mixing), ("packing", packing)]
#: Stages that SQL cannot express are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with the tables between them in the shared folder."""
    folder = f"{shared_folder(spark)}/slopeline-{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
