"""Uniform shuffle into shards by a hypergeometric communication matrix.

1. Count the rows of every input partition.
2. Draw, on the driver, how many rows each partition sends to each shard: rows
   of the matrix are multivariate hypergeometric draws from the places still
   free, so row sums are the partition sizes and column sums the exact shard
   sizes (counts differ by one at most).  The matrix holds partitions x shards
   integers, whatever the number of rows.
3. Permute locally: each task deals its counts to its rows at random while the
   rows stream by (a hypergeometric draw a block of rows), without holding them.
4. Exchange, and permute again: rows get a random 64-bit key; buckets of the
   key's leading bits are exchanged and sorted apart from one another, and the
   sums of the bucket counts make the slots of a shard gapless.  No task ever
   holds a shard, only a bucket of it.

All draws come from Philox streams keyed by (seed, partition, block).  Blocks are
numbered by row positions, however Arrow cuts its batches (by rows and by bytes),
so a retried task and a narrower view of the rows are dealt the same.  That needs an input that reads the same rows in
the same order again: a table scan does; for anything else pass
``settled=False`` and the input is written to the shared folder first.  Each
task checks its count against the matrix and fails loudly on a mismatch.

Defined cases: null texts have no bytes; null or repeated ids and equal rows
are rows like any other; an empty table gives no rows; input columns named like
an output column are replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import bound_batches, free_name, quoted, without, written

#: Rows of one bucket of a shard, on average; the unit that one task sorts.
BUCKET_ROWS = 20_000
#: Rows dealt by one draw.
BLOCK_ROWS = 256


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows each partition sends to each shard; exact row and column sums."""
    total = sum(sizes)
    free = np.full(shards, total // shards, np.int64)
    free[: total % shards] += 1
    rng = np.random.Generator(np.random.Philox(seed))
    out = np.zeros((len(sizes), shards), np.int64)
    for i, n in enumerate(sizes):
        out[i] = _draw(rng, free, n)
        free -= out[i]
    return out


def _draw(rng: np.random.Generator, free: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric draw of ``n`` from ``free``, colour by colour."""
    got = np.zeros(len(free), np.int64)
    rest = int(free.sum())
    for j, have in enumerate(free):
        if n <= 0:
            break
        rest -= int(have)
        got[j] = _hypergeometric(rng, int(have), rest, n)
        n -= int(got[j])
    return got


def _hypergeometric(rng, good: int, bad: int, n: int) -> int:
    if good == 0 or n == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    # beyond the bound of numpy's sampler: invert the distribution around its middle,
    # from the ratios of neighbouring probabilities (12 standard deviations each way)
    total = good + bad
    mean = n * (good / total)
    spread = int(12 * math.sqrt(mean * (bad / total) * ((total - n) / (total - 1)))) + 50
    low = max(0, n - bad, int(mean) - spread)
    high = min(good, n, int(mean) + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    weight = np.concatenate(([0.0], np.cumsum(steps)))
    chance = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(chance, rng.random() * chance[-1], side="right"))


def partition_sizes(df: DataFrame) -> list[int]:
    """Rows of each partition of ``df``, by partition id."""
    got = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    sizes = [0] * (max((r["p"] for r in got), default=-1) + 1)
    for r in got:
        sizes[r["p"]] = r["count"]
    return sizes


def shuffle_shards(df: DataFrame, shards: int = 24, seed: int = 7, settled: bool = True,
                   bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each
    shard), uniformly shuffled; shard sizes differ by one row at most."""
    spark = df.sparkSession
    for name in ("shard", "slot"):
        df = without(df, name)
    if not settled:
        df = written(df, "shards-input")
    bound_batches(spark)
    sizes = partition_sizes(df)
    matrix = communication_matrix(sizes, shards, seed)
    total = sum(sizes)
    dealt = spark.sparkContext.broadcast(matrix)
    pid, idx, order, bucket, ahead, rank = (free_name(df, f"__{x}") for x in ("pid", "idx", "key", "bucket", "off", "rank"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p = TaskContext.get().partitionId()
        left = dealt.value[p].copy() if p < len(dealt.value) else np.zeros(shards, np.int64)
        start = block = 0
        dealt_out = np.empty(0, np.int32)  # targets drawn for rows still to come
        for b in batches:
            n = b.num_rows
            parts = [dealt_out]
            have = len(dealt_out)
            while have < n:
                size = min(BLOCK_ROWS, int(left.sum()))
                if not size:
                    raise RuntimeError("the input changed between counting and dealing; pass settled=False")
                rng = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), (p << 32) + block]))
                got = _draw(rng, left, size)
                left -= got
                parts.append(rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), got)))
                have += size
                block += 1
            targets = np.concatenate(parts)
            targets, dealt_out = targets[:n], targets[n:]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(targets), pa.array(np.full(n, p, np.int32)), pa.array(np.arange(start, start + n))],
                names=[*b.schema.names, "shard", pid, idx])
            start += n
        if len(dealt_out) or left.sum():
            raise RuntimeError("the input changed between counting and dealing; pass settled=False")

    def placed(rows: DataFrame) -> DataFrame:
        schema = T.StructType([*rows.schema, T.StructField("shard", T.IntegerType()),
                               T.StructField(pid, T.IntegerType()), T.StructField(idx, T.LongType())])
        buckets = max(1, -(-total // (shards * bucket_rows)))
        key = F.xxhash64(F.lit(seed), F.col(pid), F.col(idx))
        return (rows.mapInArrow(deal, schema).withColumn(order, key)
                    .withColumn(bucket, F.pmod(F.shiftrightunsigned(F.col(order), 20), F.lit(buckets)).cast("int")))

    # bucket counts from the narrowest view of the same rows: the deal depends on positions alone
    counts = placed(df.select(F.lit(True).alias("__row"))).groupBy("shard", bucket).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", bucket, F.coalesce(F.sum("n").over(w), F.lit(0)).alias(ahead))
    inside = Window.partitionBy("shard", bucket).orderBy(order, pid, idx)
    out = placed(df).join(offsets, ["shard", bucket]).withColumn(rank, F.row_number().over(inside))
    return out.select(*[quoted(c) for c in df.columns], "shard",
                      (F.col(ahead) + F.col(rank) - 1).cast("bigint").alias("slot"))
