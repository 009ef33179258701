"""L1 resume semantics: a second poll without new files appends nothing, and
keys re-sent later are skipped (the checkpointed state is the done-set)."""

import tempfile

from pyspark.sql import functions as F

from sitelens.streaming import resumable as S

SCHEMA = "seq long, domain string, ok string"


def test_resumable_log_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="sitelens-stream-")
    src, log, ckpt = f"{base}/in", f"{base}/log", f"{base}/ckpt"
    first = spark.range(0, 20).select(F.col("id").alias("seq"),
                                      F.concat(F.lit("d"), F.col("id").cast("string")).alias("domain"),
                                      F.lit("True").alias("ok"))
    first.write.parquet(src, mode="append")
    S.resumable_log(spark, src, SCHEMA, "domain", log, ckpt)
    assert spark.read.parquet(log).count() == 20
    S.resumable_log(spark, src, SCHEMA, "domain", log, ckpt)  # nothing new
    assert spark.read.parquet(log).count() == 20
    again = first.filter(F.col("seq") < 5).withColumn("ok", F.lit("False"))
    fresh = spark.createDataFrame([(99, "d99", "True")], SCHEMA)
    again.unionByName(fresh).write.parquet(src, mode="append")
    S.resumable_log(spark, src, SCHEMA, "domain", log, ckpt)
    out = spark.read.parquet(log)
    assert out.count() == 21
    assert out.filter(F.col("ok") == "False").count() == 0


def test_progress_counts_every_micro_batch(spark):
    base = tempfile.mkdtemp(prefix="sitelens-progress-")
    rows = spark.range(0, 1200).select(F.col("id"), F.col("id").cast("double").alias("value"))
    rows.repartition(105).write.parquet(f"{base}/in")
    out = S.progress(spark, f"{base}/in", "id long, value double", "value", f"{base}/ckpt", f"{base}/out",
                     max_files_per_trigger=1)
    got = out.agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.sum("value_sum").alias("s")).first()
    assert got["n"] == 105 and got["rows"] == 1200 and got["s"] == sum(range(1200))


COLLECT = "domain_id long, part long, n_parts long, result_type string, text string"


def collector(spark, name):
    base = tempfile.mkdtemp(prefix=f"sitelens-{name}-")
    src, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"

    def send(*rows, **how):
        if rows:
            spark.createDataFrame(rows, COLLECT).coalesce(1).write.mode("append").json(src)
        S.collect_when_complete(spark, src, COLLECT, out, ckpt, poll_s=0.1, **how)
        got = spark.read.schema(S.OUT_SCHEMA).parquet(f"{out}/*").collect()
        return sorted((r.domain_id, r.status, r.parts, r.chars_out) for r in got)

    return send


def test_collector_counts_a_part_once_over_restarts(spark):
    send = collector(spark, "collect")
    got = send((1, 0, 2, "errored", None), (1, 0, 2, "errored", None), (2, 1, 2, "succeeded", "b"), (3, 0, 2, "succeeded", "x"),
               wait_s=3600.0)
    assert got == []  # every domain still misses a part
    got = send((2, 0, 2, "succeeded", "a"), (2, 0, 2, "succeeded", "z"), wait_s=3600.0)
    assert got == [(2, "ok", 2, 3)]
    got = send((2, 1, 2, "succeeded", "late"), (1, 1, 2, "succeeded", "y"), wait_s=3600.0)
    assert got == [(1, "error", 2, None), (2, "ok", 2, 3)]


def test_collector_timers_survive_a_restart(spark):
    send = collector(spark, "timers")
    assert send((1, 0, 2, "succeeded", "a"), (2, 0, 1, "succeeded", "b"), (3, 0, 3, "succeeded", "c"), wait_s=4.0) == [(2, "ok", 1, 1)]
    # the timers of 1 and 3 were set by the run before; the part that comes in time still counts
    got = send((1, 1, 2, "succeeded", "d"), wait_s=4.0, until_done=True)
    assert got == [(1, "ok", 2, 3), (2, "ok", 1, 1), (3, "error", 3, None)]
    # late parts, also the last missing ones, change nothing
    assert send((3, 1, 3, "succeeded", "x"), (3, 2, 3, "succeeded", "y"), (1, 0, 2, "succeeded", "z"), wait_s=0.0, until_done=True) == got


def test_resumable_log_takes_the_first_of_a_micro_batch(spark):
    base = tempfile.mkdtemp(prefix="sitelens-first-")
    rows = [(5, "a", "False"), (2, "a", "True"), (9, "a", "False"), (1, "b", "x")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{base}/in")
    S.resumable_log(spark, f"{base}/in", SCHEMA, "domain", f"{base}/log", f"{base}/ckpt")
    got = spark.read.schema(SCHEMA).parquet(f"{base}/log").collect()
    assert sorted((r.seq, r.domain, r.ok) for r in got) == [(1, "b", "x"), (2, "a", "True")]


def test_resumable_log_keeps_its_done_set_without_python_workers(spark):
    """Keys are told apart in the state store; a key sent again and again, or null, is logged once."""
    base = tempfile.mkdtemp(prefix="sitelens-done-")
    src, log, ckpt = f"{base}/in", f"{base}/log", f"{base}/ckpt"
    for k in range(4):
        rows = [(10 - k, "a", str(k)), (None, "b", str(k)), (k, "b", f"{k}!"), (k, None, str(k)), (k, f"new{k}", str(k))]
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(src, mode="append")
        S.resumable_log(spark, src, SCHEMA, "domain", log, ckpt, max_files_per_trigger=1 if k == 3 else None)
    got = spark.read.schema(SCHEMA).parquet(log).collect()
    assert sorted((str(r.domain), r.ok) for r in got) == [("None", "0"), ("a", "0"), ("b", "0!"), ("new0", "0"), ("new1", "1"), ("new2", "2"), ("new3", "3")]
