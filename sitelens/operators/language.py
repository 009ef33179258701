"""Language identification (O1) in the JVM: naive Bayes over 1- to 3-character
substrings hashed into a fixed number of buckets.

Training counts the three-character substrings of whole texts per language (partial
sums in each task) and their buckets from them.  Every bucket that occurs gets one row of add-one log-probabilities, one
number a language; a bucket that never occurs has the same probability in all
texts of a language, known from its total.  A text's grams meet the weights by
their three characters if these are frequent, else by bucket, and are summed per row: at
most ``COMMON`` and ``BUCKETS`` rows, sent to the tasks, whatever the corpus.  The best score wins (ties: the smaller
code); a text without any gram that occurred gives null ("unknown").

Everything is expressions and joins: no Python worker runs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import trim_ws
from sitelens.sources.tables import landed

SAMPLE_CHARS = 5000
#: A prime, and the factors of a gram's three characters and its size (fixed values of our hash).
BUCKETS = 262_139
FACTORS, SIZE_FACTOR = (73_856_093, 19_349_663, 83_492_791), 50_331_653
#: Three-character substrings that are looked up whole, the most frequent ones; rarer ones bucket by bucket.
COMMON = 1 << 17
#: Up to so many languages both tables of a model (at most BUCKETS and COMMON rows) are hinted as broadcasts.
HINTED = 32


@dataclass(frozen=True)
class LanguageModel:
    """``weights``: (bucket, w) with ``w[i]`` the gain of ``languages[i]`` over an unseen bucket;
    ``unseen[i]``: the log-probability of one; ``common``: (_t, _v), the summed gains of the buckets of
    a frequent three-character substring."""

    languages: list[str]
    unseen: list[float]
    weights: DataFrame
    common: DataFrame


def sample(text, sample_chars: int = SAMPLE_CHARS) -> Column:
    """The text to be detected: its first characters, lower-cased."""
    return F.lower(F.substring(trim_ws(text), 1, sample_chars))


def trigrams(text: str) -> Column:
    """The array of 3 characters from every position of column ``text`` on, fewer at its end."""
    return F.regexp_extract_all(F.col(text), F.lit("(?s)(?=(.{1,3}))."), F.lit(1))


def buckets(gram: str) -> Column:
    """The buckets of the first 1, 2 and 3 characters of column ``gram``, null for those it lacks."""
    a, b, c = (F.ascii(F.substr(F.col(gram), F.lit(k + 1), F.lit(1))).cast("bigint") * f for k, f in enumerate(FACTORS))
    size = F.char_length(gram)
    return F.array(*[F.when(size > k, (v + SIZE_FACTOR * (k + 1)) % BUCKETS) for k, v in enumerate((a, a + b, a + b + c))])


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", common: int = COMMON) -> LanguageModel:
    """The model of all grams of all labelled texts.  The driver gets one row a language.

    Positions are counted by their three characters first, so buckets are computed once for each
    distinct three; those counts are a table in the shared folder.
    """
    s = labelled.select(F.col(lang).alias("lang"), F.lower(trim_ws(F.col(text))).alias("_s"))
    s = s.filter(F.col("lang").isNotNull() & (F.length("_s") > 0))
    counted = landed(s.select("lang", F.explode(trigrams("_s")).alias("_t")).groupBy("lang", "_t").agg(F.count(F.lit(1)).alias("n")), "grams")
    counts = counted.select("lang", F.explode(buckets("_t")).alias("bucket"), "n").filter(F.col("bucket").isNotNull())
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    total = {r["lang"]: r["n"] for r in s.groupBy("lang").agg(F.sum(_grams(F.char_length("_s"))).alias("n")).collect()}
    languages = sorted(total)
    each = [F.max(F.when(F.col("lang") == x, F.col("n"))) for x in languages]
    # log((n + 1) / (total + buckets)) less that of n = 0
    gain = [F.log1p(F.coalesce(n, F.lit(0)).cast("double")) for n in each]
    weights = counts.groupBy("bucket").agg(F.array(*gain).alias("w") if gain else F.array().cast("array<double>").alias("w"))
    unseen = [-math.log(total[x] + BUCKETS) for x in languages]
    most = counted.groupBy("_t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "_t").limit(common)
    parts = most.select("_t", F.explode(buckets("_t")).alias("bucket")).join(weights, "bucket")
    sums = parts.groupBy("_t").agg(F.array(*[F.sum(F.col("w")[i]) for i in range(len(languages))]).alias("_v")) if languages else \
        parts.select("_t", F.col("w").alias("_v"))
    return LanguageModel(languages, unseen, weights, sums)


def _grams(n) -> Column:
    """How many grams a text of ``n`` characters has."""
    return F.greatest(n, F.lit(0)) + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_id)``, one row a document (null when no gram of the model occurs)."""
    if not model.languages:
        return docs.select(key, F.lit(None).cast("string").alias("lang_id"))
    s = docs.select(F.monotonically_increasing_id().alias("_row"), key, sample(F.col(text)).alias("_s"))
    s = s.withColumn("_of", _grams(F.coalesce(F.char_length("_s"), F.lit(0))))
    hint = F.broadcast if len(model.languages) <= HINTED else lambda df: df
    at = s.select("_row", key, "_of", F.explode_outer(trigrams("_s")).alias("_t")).join(hint(model.common), "_t", "left")
    # the common ones are looked up whole, the others bucket by bucket
    at = at.select("_row", key, "_of", "_v", F.explode_outer(F.when(F.col("_v").isNull(), buckets("_t"))).alias("bucket"))
    known = at.join(hint(model.weights), "bucket", "left").withColumn("_w", F.coalesce("_v", "w"))
    sums = [F.sum(F.col("_w")[i]).alias(f"_{i}") for i in range(len(model.languages))]
    scored = known.groupBy("_row", key, "_of").agg(*sums)
    scores = F.array(*[F.col(f"_{i}") + F.col("_of") * F.lit(u) for i, u in enumerate(model.unseen)])
    best = F.array_position(scores, F.array_max(scores)).cast("int")
    names = F.array(*[F.lit(x) for x in model.languages])
    return scored.select(key, F.when(F.col("_0").isNotNull(), F.element_at(names, best)).alias("lang_id"))
