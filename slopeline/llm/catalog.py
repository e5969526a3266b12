"""The registered queries of the training-data operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeline.llm.ann import nearest
from slopeline.llm.chat import format_conversations, read_back, with_control_case
from slopeline.llm.common import crc_fold, ready
from slopeline.llm.embed_dedup import near_vectors
from slopeline.llm.hard_negatives import hard_negatives
from slopeline.llm.kneser_ney import score_documents
from slopeline.llm.mixing import mixed_rows
from slopeline.llm.packing import pack_documents
from slopeline.llm.quality_rules import scored, train
from slopeline.llm.repair import damaged, repair_report
from slopeline.llm.sharding import shard_documents
from slopeline.llm.simhash import as_hex, near_copies
from slopeline.llm.substring import remove_repeats
from slopeline.llm.token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(_table(spark, folder, "documents"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    fold = crc_fold(F.col("doc_id"), 7)
    scores = score_documents(_table(spark, folder, "documents"), fold != 2)
    return scores.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_ann(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return scored(docs, train(docs, _table(spark, folder, "labels")))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_copies(_table(spark, folder, "documents"))
    return found.select("doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op8_substring(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_rows(_table(spark, folder, "documents"), columns=["doc_id", "source"])


def op10_embed_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


def op11_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_control_case(_table(spark, folder, "conversations"))
    return read_back(format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json")))


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations")
    return repair_report(damaged(rows), rows)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_sharding, op2_token_counts, op3_kneser_ney, op4_ann, op5_packing, op6_quality, op7_simhash, op8_substring, op9_mixing, op10_embed_dedup,
    op11_chat, op12_repair, op13_hard_negatives)}
#: Independent SQL for what SQL can express over the whole tables.
SQL: dict[str, str] = {
    "op8_substring": r"""
        WITH words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w : w <> '') AS w FROM documents),
        places AS (SELECT doc_id, w, unnest(range(len(w) - 34)) AS p FROM words WHERE len(w) >= 35),
        windows AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 35], ' ') AS t FROM places),
        twice AS (SELECT t FROM windows GROUP BY t HAVING count(*) > 1),
        hits AS (SELECT doc_id, list(DISTINCT p) AS ps FROM windows JOIN twice USING (t) GROUP BY doc_id),
        gone AS (SELECT doc_id, list_distinct(flatten(list_transform(ps, lambda p : range(p, p + 35)))) AS g FROM hits),
        kept AS (
            SELECT doc_id, w, CASE WHEN g IS NULL THEN w
                ELSE list_transform(list_filter(range(len(w)), lambda i : NOT list_contains(g, i)), lambda i : w[i + 1]) END AS k
            FROM words LEFT JOIN gone USING (doc_id))
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
        FROM kept""",
}
