"""Session settings and the written tables that cut long lineages."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Settings that only change how the plan runs; set on every session we are handed.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "slopeline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a temporary one only when running locally."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = _local_folder(sc.applicationId)
    return folder


@lru_cache(maxsize=4)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-slopeline-")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Lost executors re-read the table instead of replaying its lineage, and later stages still prune its
    columns. A reliable RDD checkpoint would compute the plan twice. All tables of an application sit in
    one folder, so that they can be dropped with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/slopeline-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


# Rows that a task takes of a table that is dealt anew, and bytes of input behind them.
TASK_ROWS, TASK_BYTES = 100_000, 4 << 20


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over tasks of about TASK_ROWS rows, however few files hold it; small tables stay as they are.

    ``df`` should be a projection of a table, whose rows are counted from the footers of its files.
    """
    n = df.count() // TASK_ROWS
    return df.repartition(n, *by) if n > 1 else df


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` into partitions whose number follows the bytes of its tables; starts no job.

    Partitions of a given number are not merged again at run time, so a task's memory does not grow with the input.
    """
    n = input_bytes(df) // TASK_BYTES
    return df.repartition(n, *by) if n > 1 else df


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables below ``df``, as the leaves of its analysed plan give them.

    Nothing is optimised and no job or file is opened, so the depth of the plan costs nothing. A leaf of
    unknown size counts as very large.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``durable`` that no later job reads; other frames are left alone."""
    for df in tables:
        path = getattr(df, "written_to", None)
        if path is not None:
            sc = df.sparkSession.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
