"""Structured Streaming forms of the reference's resumable loops (L1-L3).

* L1 ``resumable_log``: a file stream of outcomes, the first of each key (the
  state store *is* the done-set), appended to a Parquet log by
  ``foreachBatch``.  The checkpoint is the resume state: rerunning after new
  files arrive appends only keys never seen before.
* L2 ``collect_when_complete``: results arrive part by part; a domain is
  emitted once all its parts are in (``ok``, or ``error`` when a part failed),
  and as ``error`` when its timer fires without them.
  ``transformWithStateInPandas`` keyed by domain; list state = the parts seen so
  far (bounded by one document), then a flag, both with a time to live.
* L3 ``progress``: counters written per micro-batch.

Every query reads what there is and ends (one poll), and keeps a checkpoint in the
shared folder, so a lost executor or driver restart resumes from the last commit;
L2 can also poll on until nothing is open.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener


def _append_to(path: str):
    def sink(batch: DataFrame, epoch_id: int) -> None:
        # idempotent per epoch: a retried epoch rewrites its own folder
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")
    return sink


def resumable_log(spark: SparkSession, source_dir: str, schema: str, key: str, log_dir: str,
                  checkpoint: str, max_files_per_trigger: int | None = None, order: str = "seq") -> None:
    """L1: append every key's first outcome to ``log_dir``; earlier keys are skipped.

    Inside a micro-batch the outcome with the smallest ``order`` counts (nulls last).  The state is the
    done-set itself, so it lasts as long as the log: one aggregate row a key, which holds the first and
    the last micro-batch (by its logged time) that had the key.  A key is new while they are the same.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    stream = stream.select(F.struct(*stream.columns).alias("_row"), F.col(key).alias("_key"),
                           F.struct(F.col(order).isNull(), F.col(order)).alias("_rank"), F.current_timestamp().alias("_now"))
    seen = stream.groupBy("_key").agg(F.min_by("_row", "_rank").alias("_row"), F.min("_now").alias("_first"), F.max("_now").alias("_last"))
    new = seen.filter(F.col("_first") == F.col("_last")).select("_row.*")
    q = (new.writeStream.outputMode("update").foreachBatch(_append_to(log_dir)).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


OUT_SCHEMA = "domain_id long, status string, parts int, chars_out long, text_md5 string"
PART_STATE = "part int, text string, ok boolean"
SEEN_STATE = "n_parts int, done boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: How long a finished domain is remembered, so that what comes late or again changes nothing.
REMEMBERED_MS = 30 * 24 * 3600 * 1000


class Collector(StatefulProcessor):
    """The parts of a domain as list state until all are in or its timer fires.

    The timer is set when the first part of a domain arrives.  Parts and the
    finished flag have a time to live, so state does not grow for ever.
    """

    def __init__(self, wait_ms: int, remembered_ms: int = REMEMBERED_MS) -> None:
        self.wait_ms, self.remembered_ms = wait_ms, remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", PART_STATE, ttlDurationMs=self.remembered_ms)
        self.seen = handle.getValueState("seen", SEEN_STATE, ttlDurationMs=self.remembered_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n_parts, done = self.seen.get() if self.seen.exists() else (None, False)
        if done:
            return
        if n_parts is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        held = {p: (t, ok) for p, t, ok in self.parts.get()}
        fresh = {}
        for pdf in rows:
            for part, text, kind, n in zip(pdf["part"], pdf["text"], pdf["result_type"], pdf["n_parts"]):
                n_parts = int(n)
                if int(part) not in held:  # a part counts once, however often it is sent
                    ok = kind == "succeeded"
                    held[int(part)] = fresh[int(part)] = ((text or "") if ok else "", ok)
        if len(held) >= n_parts:
            self._finish(n_parts)
            yield _collected(int(key[0]), n_parts, held if all(ok for _, ok in held.values()) else None)
        else:
            for part, (text, ok) in fresh.items():
                self.parts.appendValue((part, text, ok))
            self.seen.update((n_parts, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n_parts, done = self.seen.get() if self.seen.exists() else (None, True)
        if not done:
            self._finish(n_parts)
            yield _collected(int(key[0]), n_parts, None)

    def _finish(self, n_parts: int) -> None:
        self.parts.clear()
        self.seen.update((n_parts, True))

    def close(self) -> None:
        pass


def _collected(domain_id: int, n_parts: int, held: dict | None) -> pd.DataFrame:
    text = None if held is None else "\n".join(held[p][0] for p in sorted(held))
    return pd.DataFrame({"domain_id": [domain_id], "status": ["error" if text is None else "ok"], "parts": [n_parts],
                         "chars_out": pd.array([None if text is None else len(text)], dtype="Int64"),
                         "text_md5": [None if text is None else hashlib.md5(text.encode("utf-8")).hexdigest()]})


def collect_when_complete(spark: SparkSession, source_dir: str, schema: str, out_dir: str, checkpoint: str,
                          wait_s: float = 60.0, until_done: bool = False, poll_s: float = 0.5) -> None:
    """L2: emit each domain once all of its parts have arrived, and as ``error`` when ``wait_s`` have
    passed since its first part and some are still missing.

    One call reads what there is and leaves; timers live in the checkpoint and fire in the
    next call.  ``until_done`` polls on and ends by itself once every timer had its time.
    """
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, ROCKSDB)  # list state, timers and time to live need it
    try:
        out = spark.readStream.schema(schema).json(source_dir).groupBy("domain_id").transformWithStateInPandas(
            Collector(int(wait_s * 1000)), OUT_SCHEMA, "append", "ProcessingTime")
        q = (out.writeStream.foreachBatch(_append_to(out_dir)).option("checkpointLocation", checkpoint)
             .trigger(processingTime=f"{int(poll_s * 1000)} milliseconds").start())
    finally:
        spark.conf.set(store, before)
    try:
        _until_quiet(q, wait_s if until_done else None)
    finally:
        q.stop()


def _until_quiet(q: StreamingQuery, wait_s: float | None) -> None:
    """Return after a batch without new rows; with ``wait_s`` after one that began so long after the
    first such batch (timers are set in batches with rows, so all of them have fired)."""
    since = None
    while True:
        if q.exception() is not None:
            raise q.exception()
        p = q.lastProgress
        if p is not None:
            at = pd.Timestamp(p["timestamp"]).timestamp()
            if p["numInputRows"]:
                since = None
            elif wait_s is None or (since is not None and at > since + wait_s):
                return
            elif since is None:
                since = at
        time.sleep(0.05)


class StepCounters(StreamingQueryListener):
    """Hands the observed counters of a micro-batch's steps to ``take``, in order, as the micro-batch ends."""

    def __init__(self, take: Callable[[int, dict], None]) -> None:
        self.take = take
        self.observed: dict[int, list[dict]] = {}  # by micro-batch, until its end is reported
        self.ended = threading.Event()  # set after the counters of the last step

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for counters in self.observed.pop(event.progress.batchId, ()):
            self.take(counters.pop("step"), counters)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


#: Files, and so steps, of one micro-batch.
STEPS_A_BATCH = 1000


def observed_steps(spark: SparkSession, source_dir: str, schema: str, counters: dict[str, Column], checkpoint: str,
                   out_dir: str, take: Callable[[int, dict], None] | None = None, steps_a_batch: int = STEPS_A_BATCH) -> DataFrame:
    """L3: copy a file stream to ``out_dir`` and count every step of it (one file a step; files of N rows
    make steps of N rows; a file without rows is none).  Steps are numbered from 0 in the order the
    files came.  Returns ``step`` and the counters, one row a step, in a table under ``out_dir``; ``take``
    gets each step's counters as its micro-batch ends.

    A micro-batch takes up to ``steps_a_batch`` files and counts them in one aggregate by file, so its fixed
    costs are shared by many steps and the driver holds the counters of one micro-batch.  Rows and
    counters are written under the micro-batch's number, so one that is repeated after a failure
    replaces itself.
    """
    name = uuid.uuid4().hex[:8]
    file, at, listed = f"_file_{name}", f"_at_{name}", f"steps_{name}"
    kinds = T.StructType([T.StructField("step", T.LongType()), *spark.createDataFrame([], schema).agg(
        *[c.alias(k) for k, c in counters.items()]).schema])
    spark.createDataFrame([], kinds).write.mode("overwrite").parquet(f"{out_dir}/counters/no=-1")  # a table even without a step
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", steps_a_batch).parquet(source_dir)
    stream = stream.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_modification_time").alias(at))
    listener = StepCounters(take) if take else None
    ended: dict[int, int] = {}  # steps up to the end of a micro-batch

    def before(no: int) -> int:
        """Steps of all micro-batches before ``no``; read from the table at the first of a run only."""
        if no - 1 not in ended:
            ended[no - 1] = spark.read.schema("step long, no long").parquet(f"{out_dir}/counters").filter(F.col("no") < no).count()
        return ended.pop(no - 1)

    def sink(batch: DataFrame, no: int) -> None:
        first = before(no)
        each = batch.groupBy(file, at).agg(*[c.alias(k) for k, c in counters.items()])
        order = Window.orderBy(at, file)  # one row a file of this micro-batch
        each = each.select((F.row_number().over(order) + F.lit(first - 1)).cast("bigint").alias("step"), *counters, file)
        seen = Observation(f"{listed}_{no}")
        each.observe(seen, F.collect_list(F.struct("step", *counters)).alias(listed)).coalesce(1).write.mode("overwrite").parquet(
            f"{out_dir}/counters/no={no}")
        steps = seen.get[listed]
        ended[no] = first + len(steps)
        if listener:
            listener.observed[no] = sorted((r.asDict() for r in steps), key=lambda c: c["step"])
        numbers = spark.read.schema(T.StructType([kinds["step"], T.StructField(file, T.StringType())])).parquet(f"{out_dir}/counters/no={no}")
        batch.join(F.broadcast(numbers), file).drop(file, at).write.mode("overwrite").parquet(f"{out_dir}/rows/no={no}")

    if listener:
        spark.streams.addListener(listener)
    try:
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        if listener:
            listener.ended.wait(60)  # events come from another thread
    finally:
        if listener:
            spark.streams.removeListener(listener)
    return spark.read.schema(kinds).parquet(f"{out_dir}/counters/no=*")


def progress(spark: SparkSession, source_dir: str, schema: str, value: str, checkpoint: str, out_dir: str,
             max_files_per_trigger: int = 1) -> DataFrame:
    """L3: per micro-batch counters (rows, sum of ``value``).

    Each micro-batch writes its counters under its own number, so a repeated
    batch overwrites itself and none is forgotten, however many there are.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)

    def count(batch: DataFrame, batch_id: int) -> None:
        c = batch.agg(F.lit(batch_id).cast("bigint").alias("batch_id"), F.count(F.lit(1)).alias("rows"),
                      F.coalesce(F.sum(value), F.lit(0.0)).alias("value_sum"))
        c.write.mode("overwrite").parquet(f"{out_dir}/no={batch_id}")

    q = stream.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("batch_id long, rows long, value_sum double").parquet(f"{out_dir}/no=*")
