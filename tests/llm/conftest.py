import pytest
from pyspark.sql import functions as F

from slopeline.llm.common import ready

SCHEMA = "doc_id bigint, text string, source string, slot string, n_tokens string, score string, block int, n_words int, fingerprint int, length int"


def _line(n: int, word: str = "w") -> str:
    return " ".join(f"{word}{i}" for i in range(n))


#: NULLs everywhere, empty and blank texts, a very long one, repeated rows, equal texts, ties, other scripts.
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (None, "no id at all", "b"), (5, "one", "b"), (5, "one", "b"), (6, "one", "c"),
    (7, _line(60_000), "a"), (8, "The quick BROWN fox. The quick BROWN fox.", "a"), (9, "été naïve İstanbul ΣΣ 日本語 é \x1c|", "c"),
    (10, "<|endoftext|> a <|startoftext|>b <|endoftext|>", None), (11, _line(80, "q"), "a"), (12, "x " + _line(80, "q") + " y", "a"),
    (13, "the the " * 300, "d"), (14, "x" * 5000, "d"), (-3, "negative id", ""), (None, None, None),
]


@pytest.fixture(scope="session")
def llm_spark(spark):
    return ready(spark)


@pytest.fixture(scope="session")
def odd(llm_spark):
    """A small table of hard cases, with columns whose names clash with results."""
    return llm_spark.createDataFrame([(i, t, s, "x", "y", "z", 1, 2, 3, 4) for i, t, s in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def none(llm_spark):
    return llm_spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(llm_spark, small):
    return llm_spark.read.parquet(f"{small}/documents.parquet").where(F.col("doc_id").isNotNull())


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
