"""File sources (A1-A8, A10) and sinks.

Every reader takes explicit types (no inference pass over 100 TB), finds CSV
columns by their header, and numbers rows in file order itself.  Every
writer is a plain DataFrame writer: Parquet for tables that are read again,
CSV/JSON only as exports.  No file per row: one-document-per-site output is a
row per site in a columnar table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.text import text_true, trim_ws
from sitelens.sources.json_items import head_of, json_items, layout_of

REGISTER_RECORD = (
    "seq BIGINT, businessId STRUCT<value:STRING>, "
    "names ARRAY<STRUCT<name:STRING,type:STRING,version:INT>>, website STRUCT<url:STRING>, "
    "companyForms ARRAY<STRUCT<type:STRING,version:INT,descriptions:ARRAY<STRUCT<languageCode:STRING,"
    "description:STRING>>>>, tradeRegisterStatus STRING")

MANIFEST_CSV = ("seq BIGINT, businessId STRING, name STRING, companyForm STRING, status STRING, "
                "homepage STRING, domain STRING, shared_site INT")

ACCESSIBILITY_CSV = ("domain STRING, homepage STRING, accessible STRING, status STRING, final_url STRING, "
                     "reason STRING, tls STRING, elapsed_s STRING, seq BIGINT")

SCRAPE_INDEX_CSV = ("domain STRING, url STRING, final_url STRING, ok STRING, chars STRING, reason STRING, "
                    "text_path STRING, seq BIGINT")

REQUEST_ENTRY = "custom_id STRING, domain STRING, part INT, n_parts INT, source_path STRING"
BATCH_MANIFEST = f"batch_id STRING, created STRING, status STRING, requests ARRAY<STRUCT<{REQUEST_ENTRY}>>"
BATCH_RESULT = ("batch_id STRING, custom_id STRING, result_type STRING, "
                "content ARRAY<STRUCT<type:STRING,text:STRING>>")


# ---- order and headers ----------------------------------------------------------

def in_file_order(scan: DataFrame, name: str = "seq") -> DataFrame:
    """A plain file scan with the dense 0-based position of each row over all its
    files (by path, then place in the file).

    Splits of files are counted and the small count table gives each its offset;
    rows of a split keep the order in which the scan reads them.
    """
    here = scan.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
                       F.monotonically_increasing_id().alias("_mid"))
    splits = here.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    offsets = splits.select("_path", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    at = (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint")
    return here.join(offsets, ["_path", "_start"]).withColumn(name, at).drop("_path", "_start", "_mid", "_first", "_off")


def read_csv_by_header(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV columns by the names in its header: those of ``ddl`` (missing ones
    null, others left out).  ``seq`` is the row's position in file order unless
    the file has such a column."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    if "seq" not in raw.columns:
        raw = in_file_order(raw)
    cols = [(F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in T.StructType.fromDDL(ddl)]
    return raw.select(*cols)


def json_layout(spark: SparkSession, path: str, layout: str = "auto") -> str:
    """``lines``, ``array`` or ``object`` (one document holding ``companies``); ``auto`` reads the
    first bytes of the first file, never more."""
    return layout_of(head_of(spark, path)) if layout == "auto" else layout


def read_json_records(spark: SparkSession, path: str, ddl: str, layout: str = "auto") -> DataFrame:
    """Records of ``ddl`` from JSON lines, a top-level array or an object
    ``{"companies": [...]}``; ``seq`` is the position unless the records have one.

    All layouts are read in splits by many tasks (:mod:`sitelens.sources.json_items`).
    """
    layout = json_layout(spark, path, layout)
    fields = [f.name for f in T.StructType.fromDDL(ddl) if f.name != "seq"]
    if layout == "lines":
        raw = in_file_order(spark.read.schema(ddl).json(path), "_at")
        return raw.select(F.coalesce("seq", "_at").alias("seq"), *fields)
    if layout not in ("array", "object"):
        raise ValueError(layout)
    items = json_items(spark, path, "companies" if layout == "object" else None)
    x = items.select("pos", F.from_json("item", ddl).alias("r"))
    return x.select(F.coalesce("r.seq", "pos").alias("seq"), *[f"r.{f}" for f in fields])


# ---- A1 register --------------------------------------------------------------

def read_register(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame:
    """A1: register records in any of the layouts of :func:`read_json_records`."""
    return read_json_records(spark, path, REGISTER_RECORD, layout)


def land_register(spark: SparkSession, src: str, dest: str, layout: str = "auto") -> DataFrame:
    """Parse the register once into Parquet; later scans are splittable."""
    read_register(spark, src, layout).write.mode("overwrite").parquet(dest)
    return spark.read.parquet(dest)


def write_register_lines(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_json_document(records: DataFrame, path: str, order: str = "seq", member: str | None = None,
                        head: dict | None = None) -> None:
    """``records`` without ``order``, in its order, as JSON documents of one line: an array, or an
    object with the fields of ``head`` and the array under ``member``.  One document a file; a
    file holds a range of ``order`` and files are read back in that order."""
    opening = "[" if member is None else json.dumps(head or {})[:-1] + (", " if head else "") + json.dumps(member) + ": ["
    closing = "]" if member is None else "]}"
    ordered = records.repartitionByRange(order).sortWithinPartitions(order)
    texts = ordered.select(F.to_json(F.struct(*[c for c in records.columns if c != order])).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = opening
        for b in batches:
            rows = []
            for v in b.column(0).to_pylist():
                rows.append(lead + v)
                lead = ", "
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([closing if lead == ", " else opening + closing])], names=["value"])

    texts.mapInArrow(run, "value string").write.mode("overwrite").option("lineSep", " ").text(path)


# ---- A2 manifest / B1 ---------------------------------------------------------

def write_manifest(kept: DataFrame, csv_path: str | None = None, json_path: str | None = None,
                   parquet_path: str | None = None) -> None:
    """B1: manifest as Parquet (main), CSV (``shared_site`` as 0/1) and JSON lines."""
    out = kept.select("seq", F.col("business_id").alias("businessId"), "name",
                      F.col("company_form").alias("companyForm"), "status", "homepage", "domain",
                      F.col("shared_site").cast("int").alias("shared_site"))
    if parquet_path:
        kept.write.mode("overwrite").parquet(parquet_path)
    if csv_path:
        out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(csv_path)
    if json_path:
        out.write.mode("overwrite").json(json_path)


def read_manifest(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A2: manifest rows with a non-blank homepage; ``domain`` falls back to the
    homepage; missing id/name become ``""``.  CSV columns go by header; JSON may
    be lines, an array or ``{total_scanned, companies}``."""
    df = read_csv_by_header(spark, path, MANIFEST_CSV) if fmt == "csv" else read_json_records(spark, path, MANIFEST_CSV)
    hp = trim_ws(F.coalesce(F.col("homepage"), F.lit("")))
    dom = F.when(F.coalesce(F.col("domain"), F.lit("")) == "", hp).otherwise(F.col("domain"))
    return (df.withColumn("homepage", hp).filter(F.col("homepage") != "")
              .select("seq", F.coalesce("businessId", F.lit("")).alias("business_id"),
                      F.coalesce("name", F.lit("")).alias("name"), "homepage", trim_ws(dom).alias("domain")))


# ---- A3 accessibility / A4 scrape index ---------------------------------------

def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_accessibility(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_by_header(spark, path, ACCESSIBILITY_CSV)


def read_scrape_index(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_by_header(spark, path, SCRAPE_INDEX_CSV)


def accessible_urls(acc: DataFrame) -> DataFrame:
    """D1 + G1: reachable rows -> first url per domain.  url = ``final_url`` if
    non-empty else ``homepage``, *then* trimmed: a whitespace-only final_url
    does not fall back and the row is dropped."""
    url = trim_ws(F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("homepage"), F.lit("")))
    x = acc.filter(text_true("accessible")).select(
        "seq", trim_ws(F.coalesce("domain", F.lit(""))).alias("domain"), url.alias("url"))
    x = x.filter((F.col("domain") != "") & (F.col("url") != ""))
    g = x.groupBy("domain").agg(F.min_by("url", "seq").alias("url"))
    return g


def ok_domains(index: DataFrame, texts: DataFrame) -> DataFrame:
    """D2 + A4: ``ok`` is true, domain and path non-blank, text non-empty
    (semi join to the text table instead of a file-size probe); first per domain."""
    x = index.filter(text_true("ok")).select(
        "seq", trim_ws(F.coalesce("domain", F.lit(""))).alias("domain"),
        trim_ws(F.coalesce("text_path", F.lit(""))).alias("text_path"))
    x = x.filter((F.col("domain") != "") & (F.col("text_path") != ""))
    nonempty = texts.filter(F.length("text") > 0).select("domain")
    x = x.join(nonempty, "domain", "left_semi")
    return x.groupBy("domain").agg(F.min_by("text_path", "seq").alias("text_path"),
                                   F.min("seq").alias("seq"))


# ---- A5 corpus directory --------------------------------------------------------

def read_corpus_dir(spark: SparkSession, path: str, normalise_newlines: bool = False) -> DataFrame:
    """A5: ``*.txt`` files; domain = file stem; text = UTF-8 with replacement.

    Many small files are slow to list and open: compact once to Parquet
    (``domain, path, content, text``) and use that table afterwards.
    """
    df = (spark.read.format("binaryFile").option("pathGlobFilter", "*.txt")
          .option("recursiveFileLookup", "true").load(path))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    out = df.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("domain"), "path", "content",
                    text.alias("text"))
    if normalise_newlines:
        out = out.withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))
    return out


# ---- A6 batch manifests / A7 results / A8 id list ---------------------------------

def read_batch_manifests(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(BATCH_MANIFEST).option("multiLine", multi_line).json(path)


def explode_requests(manifests: DataFrame) -> DataFrame:
    """One row per request entry, keeping its batch and the batch status."""
    return manifests.select("batch_id", "status", F.explode("requests").alias("r")).select(
        "batch_id", "status", "r.custom_id", "r.domain", "r.part", "r.n_parts", "r.source_path")


def read_batch_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BATCH_RESULT).json(path)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, trimmed, blanks skipped; ``pos`` is the line's position over all files, in file order."""
    t = in_file_order(spark.read.text(path), "pos")
    return t.select("pos", trim_ws("value").alias("business_id")).filter(F.col("business_id") != "")
