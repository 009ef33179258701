"""Connected components of a large link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) of every linked node ``u`` but the roots: ``v`` is the smallest
    node of its component.

    Rounds of large star (neighbours above a node point to its smallest
    neighbour) and small star (neighbours below it do), each an aggregate with
    map-side combine and a join; the link table never grows, and a table is
    written each round.  It ends when a round changes nothing.
    """
    now = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                  "links")
    state = _digest(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            return now
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select("v", "m").union(low.select("u", "m")).toDF("u", "v")
        now = written(small.filter("u <> v").distinct(), "links")
        before, state = state, _digest(now)
        if state == before:
            return now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _digest(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]
