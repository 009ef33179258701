"""A run is read as a whole or not at all, whatever was killed or repeated."""

import pytest
from pyspark.sql import functions as F

from sitelens.operators import resume as RS
from sitelens.sources import append_log as AL

ROW = "domain string, seq bigint, ok string"


def rows(spark, *names, ok="True"):
    return spark.createDataFrame([(n, i, ok) for i, n in enumerate(names)], ROW)


def seen(spark, log):
    return sorted((r.domain, r.ok, r.log_seq) for r in AL.read(spark, log, ROW).collect())


def test_kill_and_repeat(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    assert seen(spark, log) == [] and AL.commits(spark, log).count() == 0
    assert AL.append(rows(spark, "a", "b"), log, "run-1")
    first = [("a", "True", 1), ("b", "True", 1)]
    assert seen(spark, log) == first
    # the same run again changes nothing, even with other rows
    assert not AL.append(rows(spark, "a", "z"), log, "run-1")
    assert seen(spark, log) == first
    # killed between data and commit
    with monkeypatch.context() as m:
        m.setattr(AL, "commit_run", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            AL.append(rows(spark, "c", "d", "e"), log, "run-2")
    assert seen(spark, log) == first
    # killed while writing: some tasks fail
    half = rows(spark, "c", "d").repartition(2).withColumn("ok", F.when(F.col("domain") == "d", F.raise_error(F.lit("killed"))).otherwise("x"))
    with pytest.raises(Exception, match="killed"):
        AL.append(half, log, "run-2")
    assert seen(spark, log) == first
    # repeated: exactly the rows of the run that finished, once
    assert AL.append(rows(spark, "c", "a", ok="False"), log, "run-2")
    assert seen(spark, log) == sorted([*first, ("c", "False", 2), ("a", "False", 2)])
    last = {r.domain: r.ok for r in AL.latest(AL.read(spark, log, ROW), "domain", "seq").collect()}
    assert last == {"a": "False", "b": "True", "c": "False"}
    todo = spark.createDataFrame([("a",), ("d",)], "domain string")
    assert [r.domain for r in RS.not_done(todo, AL.read(spark, log, ROW)).collect()] == ["d"]
    assert AL.append(rows(spark), log, "empty") and len(seen(spark, log)) == 4
    with pytest.raises(ValueError):
        AL.append(rows(spark), log, "../x")


def test_status_events(spark, tmp_path):
    log = str(tmp_path / "status")
    batches = spark.createDataFrame([(1,), (2,), (3,)], "batch_id bigint")
    AL.append_status(batches, log, "submit-1", "submitted")
    AL.append_status(batches.filter("batch_id = 2"), log, "collect-1", "collected")
    AL.append_status(batches.filter("batch_id = 2"), log, "collect-1", "collected")
    now = {r.batch_id: r.status for r in RS.batch_current_status(AL.status_events(spark, log)).collect()}
    assert now == {1: "submitted", 2: "collected", 3: "submitted"}
    requests = spark.createDataFrame([(1, "x"), (2, "y")], "batch_id bigint, domain string")
    assert [r.domain for r in RS.in_flight(requests, AL.status_events(spark, log)).collect()] == ["x"]
