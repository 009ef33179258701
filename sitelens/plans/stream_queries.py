"""Query keys for the streaming forms and the last report keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.functions import text as TX
from sitelens.operators import reports as RP
from sitelens.operators.ordering import global_ordinal
from sitelens.plans import oracle as O
from sitelens.plans.catalog import query
from sitelens.session import shared_path
from sitelens.sources import fixtures as FX
from sitelens.sources.tables import table
from sitelens.streaming import resumable as S

SCRAPE_SCHEMA = "seq long, domain string, ok string, reason string, chars long"
RESULT_SCHEMA = ("batch_id long, custom_id string, domain_id long, part long, n_parts long, "
                 "result_type string, text string")


@query("failure_breakdown", O.with_views(r"""
SELECT coalesce(nullif(regexp_extract(reason, 'ERR_[A-Z0-9_]+', 0), ''), reason) AS reason,
  count(*) AS n FROM scrape_log WHERE NOT """ + O.text_true("ok") + """ GROUP BY 1""", "scrape_log"))
def q_failure_breakdown(spark, sf_dir):
    return RP.failure_breakdown(FX.scrape_log(spark, sf_dir))


@query("format_duration", f"""
SELECT user_id, CAST(epoch(max(ts)) - epoch(min(ts)) AS DOUBLE) AS seconds,
  {O.format_duration('epoch(max(ts)) - epoch(min(ts))')} AS duration FROM events GROUP BY user_id""")
def q_format_duration(spark, sf_dir):
    """J22 over per-user activity spans of ``events``."""
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    g = e.groupBy("user_id").agg(
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("_us"))
    sec = (F.col("_us") / F.lit(1e6)).cast("double")
    return g.select("user_id", sec.alias("seconds"), TX.format_duration(sec).alias("duration"))


@query("resume_stream", O.with_views("SELECT seq, domain, ok, reason, chars FROM scrape_log", "scrape_log"))
def q_resume_stream(spark, sf_dir):
    """L1: outcomes arrive as files in two runs; the second run re-sends the
    rows of every fifth domain (retries).  Only first outcomes are logged."""
    base = shared_path(spark, "resume-stream")
    src, log, ckpt = f"{base}/in", f"{base}/log", f"{base}/checkpoint"
    logs = FX.scrape_log(spark, sf_dir)
    logs.write.mode("append").parquet(src)
    S.resumable_log(spark, src, SCRAPE_SCHEMA, "domain", log, ckpt)
    retries = FX.done_log(spark, sf_dir).withColumn("reason", F.lit("retry"))
    retries.write.mode("append").parquet(src)
    S.resumable_log(spark, src, SCRAPE_SCHEMA, "domain", log, ckpt)
    return spark.read.schema(SCRAPE_SCHEMA).parquet(log).select("seq", "domain", "ok", "reason", "chars")


@query("collect_stream", O.with_views("""
SELECT domain_id, CASE WHEN whole THEN 'ok' ELSE 'error' END AS status, parts,
  CASE WHEN whole THEN CAST(length(joined) AS BIGINT) END AS chars_out, CASE WHEN whole THEN md5(joined) END AS text_md5
FROM (SELECT domain_id, CAST(max(n_parts) AS INTEGER) AS parts, string_agg(text, chr(10) ORDER BY part) AS joined,
        count(*) FILTER (WHERE result_type = 'succeeded') = max(n_parts) AS whole
      FROM batch_results GROUP BY domain_id)""", "batch_results"))
def q_collect_stream(spark, sf_dir):
    """L2: the result feed lands batch by batch in two runs of the stream; domains are emitted once
    complete, and those that still miss a part when their timer fires as errors."""
    base = shared_path(spark, "collect-stream")
    src, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/checkpoint"
    feed = FX.batch_results(spark, sf_dir)
    for last, some in ((False, feed.filter("batch_id < 2")), (True, feed.filter("batch_id >= 2"))):
        some.write.mode("append").partitionBy("batch_id").json(src)
        S.collect_when_complete(spark, src, RESULT_SCHEMA, out, ckpt, wait_s=0.0, until_done=last, poll_s=0.1)
    return spark.read.schema(S.OUT_SCHEMA).parquet(f"{out}/*").select("domain_id", "status", "parts", "chars_out",
                                                                "text_md5")


STEP_ROWS = 1000


@query("progress_steps", f"""
SELECT min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS rows, round(sum(value), 4) AS value_sum, bool_or(handed) AS handed
FROM (SELECT event_id, value, true AS handed, (row_number() OVER (ORDER BY event_id) - 1) // {STEP_ROWS} AS step FROM events) GROUP BY step""")
def q_progress_steps(spark, sf_dir):
    """L3: the counters of every 1000 rows of the ``events`` log, observed as they stream by;
    ``handed``: a listener was handed the same counters."""
    base = shared_path(spark, "progress-steps")
    src = f"{base}/in"
    events = table(spark, sf_dir, "events").select("event_id", "value")
    step = F.floor(F.col("ordinal") / STEP_ROWS).alias("_step")
    placed = global_ordinal(events, ["event_id", "value"]).select("event_id", "value", step)
    # a step is one file, written by one task; many tasks share the steps
    placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_step").write.partitionBy("_step").parquet(src)
    taken = {}
    steps = S.observed_steps(
        spark, f"{src}/*", "event_id long, value double",
        {"first_id": F.min("event_id"), "last_id": F.max("event_id"), "rows": F.count(F.lit(1)), "value_sum": F.round(F.sum("value"), 4)},
        f"{base}/checkpoint", f"{base}/out", lambda step, counters: taken.update({step: counters["rows"]}))
    handed = spark.createDataFrame(list(taken.items()), "step long, seen long")
    return steps.join(handed, "step", "left").select("first_id", "last_id", "rows", "value_sum",
                                                     F.coalesce(F.col("seen") == F.col("rows"), F.lit(False)).alias("handed"))


@query("progress_counters", """SELECT CAST(count(*) AS BIGINT) AS rows, round(sum(value), 4) AS value_sum FROM events""")
def q_progress_counters(spark, sf_dir):
    """L3: totals of the per micro-batch row counts and value sums over the ``events`` log."""
    base = shared_path(spark, "progress")
    src = f"{base}/in"
    table(spark, sf_dir, "events").select("event_id", "ts", "value").write.mode("overwrite").parquet(src)
    each = S.progress(spark, src, "event_id long, ts timestamp, value double", "value", f"{base}/checkpoint", f"{base}/out")
    return each.agg(F.sum("rows").alias("rows"), F.round(F.sum("value_sum"), 4).alias("value_sum"))
