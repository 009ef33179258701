"""Corpus analytics: per-document counts and the summaries built on them
(J1-J9, D7, D8, F7-F9, F16, O2).

Per-document work is native column expressions; each summary is a single
aggregate with map-side partial aggregation.  Text never crosses a shuffle:
only ids and numbers are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import text as TX


def symbol_counts(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  raw: str | None = None) -> DataFrame:
    """Chars (code points), bytes (raw UTF-8), words, lines per document."""
    b = F.octet_length(F.col(raw)) if raw else TX.byte_count(text)
    return docs.select(key, TX.char_count(text).alias("chars"), b.cast("bigint").alias("bytes"),
                       TX.word_count(text).alias("words"), TX.line_count(text).alias("lines"))


def symbol_summary(counts: DataFrame) -> DataFrame:
    """totals and the char distribution (min, exact median, mean, max, empty).

    ``median`` is exact and interpolates the two middle values like
    ``statistics.median``; its buffer holds one counter per *distinct* length,
    so it stays bounded however many documents there are.  0 instead of null
    for an empty corpus.
    """
    z = F.lit(0)
    return counts.agg(
        F.count(F.lit(1)).cast("bigint").alias("files"),
        F.coalesce(F.sum("chars"), z).cast("bigint").alias("total_chars"),
        F.coalesce(F.sum("bytes"), z).cast("bigint").alias("total_bytes"),
        F.coalesce(F.sum("words"), z).cast("bigint").alias("total_words"),
        F.coalesce(F.sum("lines"), z).cast("bigint").alias("total_lines"),
        F.coalesce(F.min("chars"), z).cast("bigint").alias("min_chars"),
        F.coalesce(F.round(F.median("chars"), 6), z.cast("double")).alias("median_chars"),
        F.coalesce(F.round(F.avg("chars"), 6), z.cast("double")).alias("mean_chars"),
        F.coalesce(F.max("chars"), z).cast("bigint").alias("max_chars"),
        F.count_if(F.col("chars") == 0).cast("bigint").alias("empty"))


#: Rank error of a sketch of size K: about 1.65 % at 200 (99 % of the time), falling as 1/K.
SKETCH_K = 200


def length_sketches(counts: DataFrame, part: list[str], value: str = "chars", k: int = SKETCH_K) -> DataFrame:
    """F7, mergeable: one quantile sketch (KLL) of ``value`` and the exact count, sum, min and max per
    partition of the corpus.  The table is a few KB a partition: it is kept beside the data, a new
    partition adds a row, and :func:`merged_distribution` never reads the corpus again."""
    v = F.col(value).cast("bigint")
    return counts.groupBy(*part).agg(
        F.kll_sketch_agg_bigint(v, k).alias("sketch"), F.count(v).cast("bigint").alias("files"), F.sum(v).alias("total"),
        F.min(v).alias("least"), F.max(v).alias("most"))


def merged_distribution(sketches: DataFrame, quantiles=(0.25, 0.5, 0.75, 0.99), keys=()) -> DataFrame:
    """The distribution over all partitions (or by ``keys``): exact files, mean, min, max and estimated
    quantiles ``q25``, ``q50`` ... from the merged sketches."""
    merged = sketches.groupBy(*keys).agg(
        F.kll_merge_agg_bigint("sketch").alias("_s"), F.sum("files").cast("bigint").alias("files"),
        F.sum("total").alias("_t"), F.min("least").alias("min_chars"), F.max("most").alias("max_chars"))
    return merged.select(*keys, "files", F.round(F.try_divide(F.col("_t").cast("double"), F.col("files").cast("double")), 6).alias("mean_chars"),
                         "min_chars", "max_chars",
                         *[F.when(F.col("files") > 0, F.kll_sketch_get_quantile_bigint("_s", F.lit(q))).alias(f"q{round(q * 100)}")
                           for q in quantiles])


def text_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 token_counter=None) -> DataFrame:
    """J1 + J4 + J6 per document: Char_clean, Words_clean, Tokens of the cleaned text.

    ``token_counter`` maps a string Column to a token-count Column (e.g. an
    Arrow UDF around a BPE encoding the user provides); default ``ceil(chars/4)``.
    """
    clean = docs.select(key, TX.clean_text(text).alias("_clean"))
    tok = token_counter(F.col("_clean")) if token_counter else TX.token_estimate("_clean")
    chars = F.length("_clean")
    spaces = chars - F.length(F.replace("_clean", F.lit(" "), F.lit("")))  # one between two words, none at the ends
    words = F.when(chars > 0, spaces + 1).otherwise(spaces)
    return clean.select(key, chars.cast("bigint").alias("Char_clean"), words.cast("bigint").alias("Words_clean"), tok.cast("bigint").alias("Tokens"))


def text_length_summary(lengths: DataFrame) -> DataFrame:
    """F8: one row per variable with mean, sample std (ddof=1), min, max."""
    long = lengths.unpivot([], ["Char_clean", "Words_clean", "Tokens"], "variable", "value")
    return long.groupBy("variable").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"),
        F.min("value").cast("bigint").alias("min"), F.max("value").cast("bigint").alias("max"))


def language_labels(docs: DataFrame, detected: Column, key: str = "doc_id", text: str = "text",
                    min_chars: int = 25, drop_junk: bool = True) -> DataFrame:
    """J9 + D7 per document: ``blocked`` (junk first), ``short``, detector label, ``unknown``."""
    junk = TX.is_junk(text) if drop_junk else None
    return docs.select(key, TX.language_label(text, detected, min_chars, junk).alias("lang"),
                       TX.char_count(text).alias("chars"))


def english_index(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """O2: the index of every document with its label and ``english`` flag."""
    return labels.select(key, "lang", "chars", (F.col("lang") == "en").alias("english"))


def language_breakdown(labels: DataFrame, top: int = 12) -> DataFrame:
    """F9 + H3: documents per label, top ``top`` by count (ties by label), with the
    share of all documents.  The grouped table has one row per label, so the
    final top-k runs over a handful of rows."""
    counts = labels.groupBy("lang").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    total = labels.select(F.count(F.lit(1)).cast("double")).scalar()
    return (counts.orderBy(F.desc("n"), F.asc("lang")).limit(top)
            .withColumn("pct", F.round(F.lit(100.0) * F.col("n") / total, 2)))


def english_summary(labels: DataFrame) -> DataFrame:
    """F9 totals: documents, English count and share, junk count."""
    return labels.agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.count_if(F.col("lang") == "en").cast("bigint").alias("english"),
        F.round(F.try_divide(F.lit(100.0) * F.count_if(F.col("lang") == "en"),
                             F.count(F.lit(1)).cast("double")), 1).alias("english_pct"),
        F.count_if(F.col("lang") == "blocked").cast("bigint").alias("junk"))


def context_fit(lengths: DataFrame, limit: int) -> DataFrame:
    """F16: does every document fit a context window of ``limit`` tokens?"""
    return lengths.agg(
        F.count(F.lit(1)).cast("bigint").alias("documents"),
        F.max("Tokens").cast("bigint").alias("max_tokens"),
        F.round(F.avg("Tokens"), 6).alias("avg_tokens"),
        F.count_if(F.col("Tokens") > limit).cast("bigint").alias("over_limit"),
        F.lit(limit).cast("bigint").alias("context_limit"))


def empty_sources(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose text is blank become ``error='empty_source'`` entries."""
    return docs.filter(TX.is_blank(text)).select(key, F.lit("empty_source").alias("error"))
