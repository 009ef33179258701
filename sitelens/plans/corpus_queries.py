"""Query keys for corpus analytics over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.functions import text as TX
from sitelens.operators import corpus as C
from sitelens.plans import oracle as O
from sitelens.plans.catalog import query
from sitelens.sources import exports as EX
from sitelens.sources.tables import landed, table

CONTEXT_LIMIT = 8192
MAX_INPUT_CHARS = 16000
MIN_CHARS = 25


def _docs(spark, sf_dir, *cols):
    return table(spark, sf_dir, "documents").select("doc_id", *cols)


def _labels(spark, sf_dir):
    d = _docs(spark, sf_dir, "text", "lang")
    return C.language_labels(d, F.col("lang"), min_chars=MIN_CHARS)


def _english(spark, sf_dir):
    """Texts labelled English, in one pass: the label is a filter, not a join."""
    d = _docs(spark, sf_dir, "text", "lang")
    label = TX.language_label("text", F.col("lang"), MIN_CHARS, TX.is_junk("text"))
    return d.filter(F.col("lang") == "en").filter(label == "en").select("doc_id", "text")  # what is not detected so is never labelled so


LABEL_SQL = f"""CASE WHEN {O.is_junk('text')} THEN 'blocked'
  WHEN length({O.trim_ws('text')}) < {MIN_CHARS} THEN 'short' ELSE coalesce(lang, 'unknown') END"""

LABELS_CTE = f"labels AS (SELECT doc_id, {LABEL_SQL} AS lang, CAST(length(text) AS BIGINT) AS chars FROM documents)"

LENGTHS_CTE = f"""cleaned AS (SELECT l.doc_id, {O.clean_text('d.text')} AS c FROM labels l JOIN documents d USING (doc_id)
  WHERE l.lang = 'en'),
lengths AS (SELECT doc_id, CAST(length(c) AS BIGINT) AS Char_clean, {O.word_count('c')} AS Words_clean,
  CAST(ceil(length(c) / 4) AS BIGINT) AS Tokens FROM cleaned)"""


@query("clean_text", f"SELECT doc_id, {O.clean_text('text')} AS clean FROM documents")
def q_clean_text(spark, sf_dir):
    return _docs(spark, sf_dir, "text").select("doc_id", TX.clean_text("text").alias("clean"))


@query("symbol_counts", f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes,
  {O.word_count('text')} AS words, {O.line_count('text')} AS lines FROM documents""")
def q_symbol_counts(spark, sf_dir):
    return C.symbol_counts(_docs(spark, sf_dir, "text"))


@query("symbol_summary", f"""
WITH c AS (SELECT CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes,
  {O.word_count('text')} AS words, {O.line_count('text')} AS lines FROM documents)
SELECT count(*) AS files, CAST(coalesce(sum(chars), 0) AS BIGINT) AS total_chars,
  CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes, CAST(coalesce(sum(words), 0) AS BIGINT) AS total_words,
  CAST(coalesce(sum(lines), 0) AS BIGINT) AS total_lines, coalesce(min(chars), 0) AS min_chars,
  coalesce(round(quantile_cont(chars, 0.5), 6), 0) AS median_chars, coalesce(round(avg(chars), 6), 0) AS mean_chars,
  coalesce(max(chars), 0) AS max_chars, count(*) FILTER (WHERE chars = 0) AS empty FROM c""")
def q_symbol_summary(spark, sf_dir):
    return C.symbol_summary(C.symbol_counts(_docs(spark, sf_dir, "text")))


SKETCHED = (0.25, 0.5, 0.75, 0.99)


@query("length_sketch", f"""SELECT count(*) AS files, round(avg(length(text)), 6) AS mean_chars, CAST(min(length(text)) AS BIGINT) AS min_chars,
  CAST(max(length(text)) AS BIGINT) AS max_chars, {", ".join(f"true AS q{round(q * 100)}_close" for q in SKETCHED)} FROM documents""")
def q_length_sketch(spark, sf_dir):
    """F7 by sketches kept per source and merged: exact totals, and whether each estimated quantile's
    rank is within 2 % of the one asked for (checked against all lengths)."""
    counts = _docs(spark, sf_dir, "text", "source").select("source", TX.char_count("text").alias("chars"))
    merged = C.merged_distribution(landed(C.length_sketches(counts, ["source"]), "sketches"), SKETCHED)
    ask = merged.select(F.struct(*merged.columns)).scalar()
    names = [f"q{round(q * 100)}" for q in SKETCHED]
    ranks = counts.agg(*[F.struct(F.avg((F.col("chars") < ask.getField(n)).cast("double")).alias("low"),
                                  F.avg((F.col("chars") <= ask.getField(n)).cast("double")).alias("high")).alias(n) for n in names])
    close = [((F.col(n)["low"] <= q + 0.02) & (F.col(n)["high"] >= q - 0.02)).alias(f"{n}_close") for n, q in zip(names, SKETCHED)]
    return ranks.select(*[ask.getField(c).alias(c) for c in ("files", "mean_chars", "min_chars", "max_chars")], *close)


@query("text_length_summary", f"""
WITH {LABELS_CTE}, {LENGTHS_CTE},
long AS (SELECT 'Char_clean' AS variable, Char_clean AS value FROM lengths
         UNION ALL SELECT 'Words_clean', Words_clean FROM lengths UNION ALL SELECT 'Tokens', Tokens FROM lengths)
SELECT variable, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  CAST(min(value) AS BIGINT) AS min, CAST(max(value) AS BIGINT) AS max FROM long GROUP BY variable""")
def q_text_length_summary(spark, sf_dir):
    return C.text_length_summary(C.text_lengths(_english(spark, sf_dir)))


@query("summary_table", f"""
WITH {LABELS_CTE}, {LENGTHS_CTE},
long AS (SELECT 2 AS line_no, 'Char_clean' AS variable, '{EX.DEFINITIONS['Char_clean']}' AS d, Char_clean AS value FROM lengths
  UNION ALL SELECT 3, 'Words_clean', '{EX.DEFINITIONS['Words_clean']}', Words_clean FROM lengths
  UNION ALL SELECT 4, 'Tokens', '{EX.DEFINITIONS['Tokens']}', Tokens FROM lengths)
SELECT 0 AS line_no, concat(rpad('Variable', 13, ' '), rpad('Definition', 43, ' '), '    Mean      Std    Min      Max') AS line
UNION ALL SELECT 1, repeat('-', 89)
UNION ALL SELECT line_no, concat(rpad(variable, 13, ' '), rpad(d, 43, ' '), lpad(printf('%.0f', avg(value)), 8, ' '), ' ', lpad(printf('%.0f', stddev_samp(value)), 8, ' '), ' ',
  lpad(CAST(min(value) AS VARCHAR), 6, ' '), ' ', lpad(CAST(max(value) AS VARCHAR), 8, ' ')) FROM long GROUP BY line_no, variable, d""")
def q_summary_table(spark, sf_dir):
    """The text-length summary as lines of a table."""
    return EX.summary_table(C.text_length_summary(C.text_lengths(_english(spark, sf_dir))))


@query("token_estimate", f"""SELECT doc_id, CAST(ceil(length({O.clean_text('text')}) / 4) AS BIGINT) AS tokens
FROM documents""")
def q_token_estimate(spark, sf_dir):
    d = _docs(spark, sf_dir, "text")
    return d.select("doc_id", TX.token_estimate(TX.clean_text("text")).alias("tokens"))


@query("context_fit", f"""
WITH {LABELS_CTE}, {LENGTHS_CTE}
SELECT count(*) AS documents, max(Tokens) AS max_tokens, round(avg(Tokens), 6) AS avg_tokens,
  count(*) FILTER (WHERE Tokens > {CONTEXT_LIMIT}) AS over_limit, CAST({CONTEXT_LIMIT} AS BIGINT) AS context_limit
FROM lengths""")
def q_context_fit(spark, sf_dir):
    return C.context_fit(C.text_lengths(_english(spark, sf_dir)), CONTEXT_LIMIT)


@query("truncate_input", f"""SELECT doc_id, substring(text, 1, {MAX_INPUT_CHARS}) AS input_text,
  CAST(length(substring(text, 1, {MAX_INPUT_CHARS})) AS BIGINT) AS input_chars FROM documents""")
def q_truncate_input(spark, sf_dir):
    d = _docs(spark, sf_dir, "text")
    t = TX.truncate("text", MAX_INPUT_CHARS)
    return d.select("doc_id", t.alias("input_text"), F.length(t).cast("bigint").alias("input_chars"))


@query("junk_pages", f"SELECT doc_id, lang FROM documents WHERE {O.is_junk('text')}")
def q_junk_pages(spark, sf_dir):
    d = _docs(spark, sf_dir, "text", "lang")
    return d.filter(TX.is_junk("text")).select("doc_id", "lang")


@query("empty_sources", f"SELECT doc_id, 'empty_source' AS error FROM documents WHERE {O.is_blank('text')}")
def q_empty_sources(spark, sf_dir):
    return C.empty_sources(_docs(spark, sf_dir, "text"))


@query("language_label", f"WITH {LABELS_CTE} SELECT doc_id, lang, chars FROM labels")
def q_language_label(spark, sf_dir):
    return _labels(spark, sf_dir)


@query("english_index", f"WITH {LABELS_CTE} SELECT doc_id, lang, chars, lang = 'en' AS english FROM labels")
def q_english_index(spark, sf_dir):
    return C.english_index(_labels(spark, sf_dir))


@query("language_breakdown", f"""
WITH {LABELS_CTE}
SELECT lang, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM labels), 2) AS pct
FROM labels GROUP BY lang ORDER BY n DESC, lang LIMIT 12""")
def q_language_breakdown(spark, sf_dir):
    return C.language_breakdown(_labels(spark, sf_dir))


@query("english_summary", f"""
WITH {LABELS_CTE}
SELECT count(*) AS total, count(*) FILTER (WHERE lang = 'en') AS english,
  round(100.0 * count(*) FILTER (WHERE lang = 'en') / count(*), 1) AS english_pct,
  count(*) FILTER (WHERE lang = 'blocked') AS junk FROM labels""")
def q_english_summary(spark, sf_dir):
    return C.english_summary(_labels(spark, sf_dir))
