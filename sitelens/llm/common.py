"""Shared helpers: text columns into Arrow batches, written tables, word scanning.

Conventions of all operators here:

* a document is a row; rows are never merged, dropped or sampled, so repeated
  rows and repeated or null ids each keep their own result;
* a null text counts as the empty text;
* results come as ONE struct column added to the input columns.  An input column
  whose name equals the result column (ignoring case) is replaced by the result;
  every other extra column passes through untouched.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.session import shared_path

#: Rows of one Arrow batch at most; long texts make a batch of more rows too large for a task.
BATCH_ROWS = 256

#: Words of decontamination and licence scans, after lower-casing A-Z, on UTF-8 bytes:
#: code points outside 00-2F, 3A-60 and 7B-7F are digits, a-z and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def bound_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to :data:`BATCH_ROWS` for this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def words_of(data: bytes) -> list[bytes]:
    """Words of a whole text (``bytes.lower`` changes A-Z only)."""
    return WORD.findall(data.lower())


def without(df: DataFrame, name: str) -> DataFrame:
    """``df`` without columns named like ``name`` (ignoring case)."""
    return df.select(*[quoted(c) for c in df.columns if c.lower() != name.lower()])


def quoted(name: str):
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def utf8(col):
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(col.cast("string"), F.lit("")).cast("binary")


def map_texts(df: DataFrame, text_col: str, result: str, fields: T.StructType,
              make: Callable[[], Callable[[pa.Array], dict[str, object]]], carry_text: bool = True,
              gather: int = 0) -> DataFrame:
    """Add the struct column ``result`` computed from the whole text of each row.

    ``make`` runs once a task and returns a function from one Arrow array of
    UTF-8 bytes to the columns of ``fields``.  A narrow ``mapInArrow``: no
    shuffle, memory bounded by one batch.  ``carry_text=False`` drops the text
    column from the output, for callers that need the result alone.  ``gather``
    joins batches up to so many bytes first, for work with a high cost a batch.
    """
    bound_batches(df.sparkSession)
    base = without(df, result) if result.lower() != text_col.lower() else df
    tmp = free_name(base, "__utf8")
    src = base.withColumn(tmp, utf8(quoted(text_col)))
    if result.lower() == text_col.lower() or not carry_text:
        src = without(src, text_col)
    keep = [c for c in src.columns if c != tmp]
    schema = T.StructType([*[src.schema[c] for c in keep], T.StructField(result, fields, False)])
    names = [f.name for f in fields]
    types = [to_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in gathered(batches, gather) if gather else batches:
            got = work(b.column(b.num_columns - 1))
            arrays = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, type=t)
                      for v, t in ((got[n], t) for n, t in zip(names, types))]
            st = pa.StructArray.from_arrays(arrays, names=names)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], st], names=[*keep, result])

    return src.mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of ``size`` bytes or more (the last may have less)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def to_arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def written(df: DataFrame, name: str, partition: Sequence[str] = ()) -> DataFrame:
    """Cut the lineage: write ``df`` as a table below ``spark.checkpoint.dir``
    (shared by driver and executors) and read it back, so a lost executor costs
    no recomputation of what led to it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    w = df.write.option("compression", "zstd")
    if partition:
        w = w.partitionBy(*partition)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def query_id() -> str:
    return uuid.uuid4().hex[:8]
