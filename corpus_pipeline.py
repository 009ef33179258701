"""Training-data pipeline over ``documents``: quality classifier, near-copies,
long repeats, benchmark passages, packing.

``STAGES`` holds (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that the next one gets as docs (written and read again).
All but the last return the columns of ``docs``.  The operators and what they
do with nulls, empty texts, ties and repeated rows are described in
``sitelens.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import decontamination, packing, quality_classifier, simhash, suffix_dedup
from sitelens.llm.common import free_name, quoted, written
from sitelens.llm.queries import packed_digest
from sitelens.sources.tables import table

ORACLE_SQL = None  # trained scores, XXH64 and the tokenizer are beyond SQL; tests/llm/test_pipeline.py has brute force a stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "__quality")
    kept = quality_classifier.scored(docs, model, result=name).filter(F.col(f"{name}.predicted") == 1)
    return kept.select(*[quoted(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: 3-word shingles, fingerprints linked at 2 bits or fewer."""
    return simhash.one_of_each(docs, shingle=3, max_bits=2)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that start elsewhere too; all documents stay."""
    return recounted(suffix_dedup.cleaned(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    name = free_name(docs, "__decon")
    found = decontamination.find_hits(docs, table(spark, sf_dir, "benchmark"), result=name)
    return found.filter(~decontamination.contaminated(name)).select(*[quoted(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    import public_tokenizers

    pieces = packing.tokenized(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packed_digest(pieces)


def recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_copies),
    ("suffix-array dedup", long_repeats),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
