"""Resume algebra (E1-E3, E5, H1, I2): "only what is not done yet".

Done-sets can be as large as the work itself, so they are joined with
``left_anti`` (sort-merge or, when AQE measures a small side at runtime,
broadcast) instead of being collected to the driver.  ``null``-safe keys keep
rows with a null key from silently vanishing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.ordering import last_per_key


def not_done(todo: DataFrame, done: DataFrame, key: str = "domain") -> DataFrame:
    """Drop every key that has any recorded outcome."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def done_ok(index: DataFrame, key: str = "domain", text: str | None = "text") -> DataFrame:
    """Keys whose recorded status is ``ok`` (and, for translations, whose
    output is non-empty)."""
    d = index.filter(F.col("status") == "ok")
    if text is not None:
        d = d.filter(F.length(F.col(text)) > 0)
    return d.select(key).distinct()


def batch_current_status(events: DataFrame) -> DataFrame:
    """G3 + B7: a batch's status is its last event."""
    return last_per_key(events.select("batch_id", "event_seq", "status"), "batch_id", "event_seq")


def in_flight(requests: DataFrame, events: DataFrame, key: str = "domain") -> DataFrame:
    """Keys with a request in a batch that is not collected yet."""
    open_batches = batch_current_status(events).filter(F.col("status") != "collected").select("batch_id")
    return requests.join(open_batches, "batch_id", "left_semi").select(key).distinct()


def work_list(todo: DataFrame, done: DataFrame, flying: DataFrame, key: str = "domain") -> DataFrame:
    """To-do minus done minus in flight (anti joins keep todo's columns)."""
    return todo.join(done, key, "left_anti").join(flying, key, "left_anti")


def preferred_source(sources: DataFrame, translations: DataFrame, key: str = "domain") -> DataFrame:
    """E5 / A10: the translation when it is non-empty, else the scraped text."""
    t = translations.select(key, F.col("text").alias("_t"))
    j = sources.join(t, key, "left")
    use_t = F.coalesce(F.length("_t") > 0, F.lit(False))
    return (j.withColumn("source", F.when(use_t, F.lit("translated")).otherwise(F.lit("scraped")))
             .withColumn("text", F.when(use_t, F.col("_t")).otherwise(F.col("text"))).drop("_t"))


def take_first(df: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """H1: first ``n`` in work order (0 = all); a TakeOrdered, not a sort."""
    return df.orderBy(order).limit(n) if n else df
