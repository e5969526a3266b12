"""Readers and file inventories."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               where: Column | str | None = None) -> DataFrame:
    """Parquet with pruned columns; simple predicates reach the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df if columns is None else df.select(*columns)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: Sequence[str] | None = None,
             sample_rows: int | None = None) -> DataFrame:
    """CSV with a declared schema; ``sample_rows`` reads a bounded sample."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    df = df if columns is None else df.select(*columns)
    return df if sample_rows is None else df.limit(sample_rows)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_matching(spark: SparkSession, pattern: str, status: Column | None = None) -> DataFrame:
    """Every parquet file of a path pattern as one table, optionally filtered by status."""
    df = spark.read.parquet(pattern)
    return df if status is None else df.where(status)


def event_rows(docs: DataFrame, text: str, event_ddl: str, keep: Sequence[str] = ()) -> DataFrame:
    """Events of JSON documents in any of three envelopes: a list, a single one, or the bare event."""
    event = T._parse_datatype_string(event_ddl)
    envelope = T.StructType([T.StructField("events", T.ArrayType(event)), T.StructField("event", event)])
    bare = F.from_json(F.col(text), event)
    doc = F.from_json(F.col(text), envelope)
    listed = F.coalesce(doc["events"], F.when(doc["event"].isNotNull(), F.array(doc["event"])), F.array(bare))
    return docs.select(*keep, F.explode(listed).alias("_e")).select(*keep, "_e.*")


def read_event_documents(spark: SparkSession, path: str, event_ddl: str) -> DataFrame:
    """One JSON document per file."""
    return event_rows(spark.read.text(path, wholetext=True), "value", event_ddl)


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modification time of every file below a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", "length", "modificationTime"))


def dated_files(files: DataFrame, pattern: str = r"(\d{4}[.\-]\d{2}[.\-]\d{2})") -> DataFrame:
    """Files with a date in their name; names without a valid date are skipped."""
    name = F.element_at(F.split("path", "/"), -1)
    text = F.regexp_replace(F.regexp_extract(name, pattern, 1), r"\.", "-")
    return files.withColumn("file_date", F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")).where(
        "file_date IS NOT NULL").orderBy("file_date")


SUPPORTED = ["csv", "json", "jsonl", "parquet", "txt", "geojson"]
#: Files up to this length are hashed as one value; longer ones are read piece by piece.
HASHED_BYTES = 256 << 20
PIECE_BYTES = 8 << 20


def _opened(path: str):
    """A stream over a file that a task can reach: local paths directly, stores by their file system."""
    # paths of the reader are not encoded
    if path.startswith(("file:", "/")):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_stream(name)


def stream_digests(paths: DataFrame) -> DataFrame:
    """path and sha256 of files of any length. A task holds one piece of one file; a digest runs over a file
    from its start, so a file is one task's work."""
    def work(batches):
        import hashlib

        import pyarrow as pa
        for batch in batches:
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with _opened(path) as stream:
                    while piece := stream.read(PIECE_BYTES):
                        digest.update(piece)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], ["path", "sha256"])

    return paths.select("path").repartition("path").mapInArrow(work, "path string, sha256 string")


def file_inventory(spark: SparkSession, path: str, with_hash: bool = True) -> DataFrame:
    """path, size, extension, time, sha256 and whether the type is supported.

    Every file has its hash: contents up to ``HASHED_BYTES`` in the reader, longer ones by ``stream_digests``.
    Spark's file listing leaves out files of no bytes, so they are not listed.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    cols = ["path", F.col("length").alias("size_bytes"), ext.alias("extension"), "modificationTime",
            ext.isin(SUPPORTED).alias("supported")]
    if not with_hash:
        return df.select(*cols)
    # the reader skips the contents of files that a filter on the length leaves out
    fits = F.col("length") <= HASHED_BYTES
    long = df.where(~fits).select(*cols)
    return df.where(fits).select(*cols, F.sha2("content", 256).alias("sha256")).unionByName(long.join(stream_digests(long), "path"))


def build_manifest(inventory: DataFrame, root: str, excluded: Sequence[str] = (), minimum_files: int = 1) -> DataFrame:
    """relative path -> sha256; too few files fail the job."""
    # a root may be a whole path with a scheme or without, or its last folders
    root = "".join(f"/{part}" for part in re.sub("^[A-Za-z0-9+.-]+:", "", root).split("/") if part not in ("", ".", "..")) + "/"
    at = F.instr("path", root)
    rel = F.when(at > 0, F.substr(F.col("path"), at + len(root))).otherwise(F.col("path"))
    out = inventory.select(rel.alias("relative_path"), "sha256", "size_bytes")
    for prefix in excluded:
        out = out.where(~F.col("relative_path").startswith(prefix))
    n = out.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if n < minimum_files:
        raise ValueError(f"the manifest covers {n} files, at least {minimum_files} are required")
    return out


def table_manifest(manifest: DataFrame, suffix: str = ".parquet") -> DataFrame:
    """One line per table: a table written as a folder of files has the digest of its files' names and digests, in
    order of their names; tables of one file keep theirs. A file without a hash leaves its table without one."""
    name = F.regexp_extract("relative_path", "^(.*?" + suffix.replace(".", "[.]") + ")/", 1)
    table = F.when(name != "", name).otherwise(F.col("relative_path"))
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "relative_path", "sha256")))
    whole = F.when(F.count("sha256") == F.count(F.lit(1)), F.sha2(F.array_join(lines, "\n"), 256))
    alone = F.max(F.when(name == "", F.col("sha256")))
    return manifest.groupBy(table.alias("_table")).agg(F.coalesce(alone, whole).alias("sha256"), F.sum("size_bytes").alias("size_bytes")).select(
        F.col("_table").alias("relative_path"), "sha256", "size_bytes")


def verify_manifest(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """OK, MISSING, MISMATCH, UNLISTED or UNHASHED (on either side) per path."""
    a = actual.select("relative_path", F.col("sha256").alias("actual_sha256"), F.lit(True).alias("_here"))
    m = manifest.select("relative_path", "sha256", F.lit(True).alias("_listed"))
    j = m.join(a, "relative_path", "full")
    return j.withColumn("status", F.when(F.col("_here").isNull(), "MISSING").when(F.col("_listed").isNull(), "UNLISTED")
                        .when(F.col("sha256") == F.col("actual_sha256"), "OK")
                        .when(F.col("sha256").isNull() | F.col("actual_sha256").isNull(), "UNHASHED")
                        .otherwise("MISMATCH")).drop("_here", "_listed")
