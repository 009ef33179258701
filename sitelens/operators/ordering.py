"""Order-dependent operators without single-partition sorts.

* ``first_per_key`` / ``last_per_key``: ``min_by``/``max_by`` aggregates, which
  combine map-side, so a hot key costs one partial row per task, not a sort.
* ``global_ordinal`` / ``key_ordinal``: rows fall into buckets by an expression of
  the order column that never decreases along the order (a slice of the integer,
  a prefix of the string).  Buckets are counted (map-side combine), the small
  count table gives each bucket its offset, and ``row_number`` numbers the rows
  inside a bucket.  Nothing is sampled, so counts and rows always agree, and one
  hot key is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Integers that share a bucket, and leading characters of a string that name one.
BUCKET_WIDTH = 1 << 16
BUCKET_PREFIX = 3


def first_per_key(df: DataFrame, keys, order_col: str, cols=None) -> DataFrame:
    """G1: the row with the smallest ``order_col`` per key ("first one wins")."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = cols or [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("_r"))
    return agg.select(*keys, "_r.*")


def last_per_key(df: DataFrame, keys, order_col: str, cols=None) -> DataFrame:
    """The row with the largest ``order_col`` per key ("last one wins")."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = cols or [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("_r"))
    return agg.select(*keys, "_r.*")


def _bucket(df: DataFrame, order_col: str) -> Column:
    kind = df.schema[order_col].dataType
    if isinstance(kind, T.IntegralType):
        return F.floor(F.col(order_col) / F.lit(BUCKET_WIDTH)).cast("bigint")
    if isinstance(kind, T.StringType):
        return F.substring(order_col, 1, BUCKET_PREFIX)
    raise TypeError(f"no default bucket for {order_col}: {kind.simpleString()}; pass one")


def global_ordinal(df: DataFrame, order_cols, name: str = "ordinal", start: int = 0,
                   bucket: Column | None = None) -> DataFrame:
    """Dense 0-based (or ``start``-based) row number over ``order_cols``.

    ``order_cols`` must be unique per row (add a tie-breaker otherwise).
    ``bucket`` must not decrease along the order; by default it is cut from the
    first order column (integers by :data:`BUCKET_WIDTH`, strings by prefix).
    """
    return key_ordinal(df, [], order_cols, name, start, bucket)


def key_ordinal(df: DataFrame, keys, order_cols, name: str = "ordinal", start: int = 0,
                bucket: Column | None = None) -> DataFrame:
    """0-based position of each row inside its key, ordered by ``order_cols``.

    Skew-safe replacement for ``row_number() over (partition by key ...)``: a
    window holds one bucket of a key, never the key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    rows = df.withColumn("_bucket", bucket if bucket is not None else _bucket(df, order_cols[0]))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_key{i}" for i in range(len(keys))]
    offsets = counts.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_bucket").alias("_in"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_bucket").eqNullSafe(F.col("_in"))
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order_cols)
    out = rows.join(offsets, same).withColumn("_no", F.row_number().over(inside))
    return out.withColumn(name, (F.col("_before") + F.col("_no") + F.lit(start - 1)).cast("bigint")) \
              .drop("_bucket", "_in", "_before", "_no", *names)


def key_running_total(df: DataFrame, order_col: str, amount: str, name: str, bucket: Column | None = None) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows before each row, by buckets like :func:`key_ordinal`."""
    rows = df.withColumn("_bucket", bucket if bucket is not None else _bucket(df, order_col))
    sums = rows.groupBy("_bucket").agg(F.sum(amount).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_bucket").alias("_in"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, F.col("_bucket").eqNullSafe(F.col("_in")))
    return out.withColumn(name, (F.col("_before") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).cast("bigint")) \
              .drop("_bucket", "_in", "_before")
