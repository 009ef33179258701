"""Append-only logs on shared storage (B4) and status events.

A log is a folder with ``data/run=<id>`` for every run that appended to it and
``commits/run=<id>`` for every run that finished.  The commit is one small file
written last, so readers see a run as a whole or not at all:

* a run that was killed leaves data without a commit: nobody reads it;
* the same run repeated replaces what it left, then commits;
* a run that is committed already appends nothing again.

Commits are numbered; the number orders runs, so "last one wins" goes by
``(log_seq, order column)``.  One writer at a time may append to a log (two that
start together would get the same number; their order is then that of the ids).
Everything goes through Spark's readers and writers, on any storage they reach.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "run string, log_seq bigint"
RUN_ID = re.compile(r"[A-Za-z0-9_-]+")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def commits(spark: SparkSession, log: str) -> DataFrame:
    """``(run, log_seq)`` of the finished runs."""
    if not _exists(spark, f"{log}/commits"):
        return spark.createDataFrame([], COMMIT)
    # the folder names the run; only the number is inside
    return spark.read.schema("log_seq bigint, run string").parquet(f"{log}/commits").select("run", "log_seq")


def append(rows: DataFrame, log: str, run_id: str) -> bool:
    """Append ``rows`` as run ``run_id``; False if that run is committed already."""
    if not RUN_ID.fullmatch(run_id):
        raise ValueError(f"a run id has letters, digits, _ and - only: {run_id!r}")
    spark = rows.sparkSession
    done = commits(spark, log).agg(F.coalesce(F.max("log_seq"), F.lit(0)).alias("last"),
                                   F.count_if(F.col("run") == run_id).alias("mine")).first()
    if done["mine"]:
        return False
    write_run(rows, log, run_id)
    commit_run(spark, log, run_id, done["last"] + 1)
    return True


def write_run(rows: DataFrame, log: str, run_id: str) -> None:
    rows.write.mode("overwrite").parquet(f"{log}/data/run={run_id}")


def commit_run(spark: SparkSession, log: str, run_id: str, number: int) -> None:
    one = spark.range(1).select(F.lit(number).cast("bigint").alias("log_seq"))
    one.coalesce(1).write.mode("overwrite").parquet(f"{log}/commits/run={run_id}")


def read(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """The rows of all finished runs with ``log_seq``.  Runs are folders, so the join with the
    commits prunes those that are not wanted."""
    if not _exists(spark, f"{log}/data"):
        return spark.createDataFrame([], T.StructType([*T.StructType.fromDDL(schema), T.StructField("log_seq", T.LongType())]))
    fields = T.StructType([*T.StructType.fromDDL(schema), T.StructField("run", T.StringType())])
    rows = spark.read.schema(fields).parquet(f"{log}/data")
    return rows.join(commits(spark, log), "run").drop("run")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """G3 over a log: the last row of each key, by run and then by ``order``."""
    others = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct("log_seq", order))
    return rows.groupBy(key).agg(last.alias("_r")).select(key, "_r.*").drop("log_seq")


# ---- status events -----------------------------------------------------------------

def append_status(batches: DataFrame, log: str, run_id: str, status: str, key: str = "batch_id") -> bool:
    """One event ``(batch_id, status)`` for every row of ``batches``; events are never changed."""
    return append(batches.select(key, F.lit(status).alias("status")), log, run_id)


def status_events(spark: SparkSession, log: str, key: str = "batch_id bigint") -> DataFrame:
    """``(batch_id, event_seq, status)`` in the order of the runs, as ``resume.batch_current_status`` takes them."""
    return read(spark, log, f"{key}, status string").withColumnRenamed("log_seq", "event_seq")
