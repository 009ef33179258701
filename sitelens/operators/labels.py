"""Labelling, splitting and evaluation operators from the paper.

Class-keyed work never runs as a window over a class: with two classes each
would be half of the data in one task.  Positions inside a class come from the
skew-safe ``key_ordinal``; per-class counts are a two-row table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import requests as RQ
from sitelens.operators.ordering import key_ordinal

SPLIT_SEED = "42"
TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"


def expert_labels(codes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Majority of the raters' 0/1 codes per item (ties -> 0)."""
    g = codes.groupBy(key).agg(F.sum("code").alias("_pos"), F.count(F.lit(1)).alias("_n"))
    return g.select(key, F.when(F.col("_pos") * 2 > F.col("_n"), 1).otherwise(0).alias("label"))


def label_corpus(positive_list: DataFrame, experts: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Positive list(s) united with expert negatives, reconciled per id (a
    listed positive wins), de-duplicated, joined to the text."""
    pos = positive_list.select(key, F.lit(1).alias("label"), F.lit("list").alias("source"))
    neg = experts.filter(F.col("label") == 0).select(key, "label", F.lit("expert").alias("source"))
    u = pos.unionByName(neg)
    rec = u.groupBy(key).agg(F.max("label").alias("label"), F.max_by("source", "label").alias("source"))
    return rec.join(texts, key)


def label_summary(corpus: DataFrame) -> DataFrame:
    """count, mean and sample std of the 0/1 label, share of each class."""
    return corpus.agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.avg("label"), 6).alias("mean"),
        F.round(F.stddev_samp("label"), 6).alias("std"),
        F.round(F.lit(100.0) * F.avg(F.when(F.col("label") == 0, 1).otherwise(0)), 6).alias("pct_negative"))


def stratified_split(corpus: DataFrame, key: str = "doc_id", label: str = "label", seed: str = SPLIT_SEED,
                     train: int = 80, validation: int = 5) -> DataFrame:
    """O3: deterministic stratified split.  Inside each class, rows are ordered
    by ``md5(id:seed)``; the first ``train``% go to train, the next
    ``validation``% to validation, the rest to test, so every split keeps the
    class ratio."""
    h = corpus.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed))))
    pos = key_ordinal(h, label, ["_h", key], "_ord")
    sizes = corpus.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))  # one row per class
    x = pos.join(sizes, label)
    o, n = F.col("_ord"), F.col("_n")
    split = (F.when(o * 100 < n * train, F.lit("train"))
             .when(o * 100 < n * (train + validation), F.lit("validation")).otherwise(F.lit("test")))
    return x.withColumn("split", split).drop("_h", "_ord", "_n")


def tokens(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lower-cased word tokens (Unicode letters, digits, underscore)."""
    t = df.select(key, F.explode(F.split(F.lower(F.col(text)), TOKEN_SPLIT)).alias("term"))
    return t.filter(F.col("term") != "")


def tfidf(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """O4 weights: tf = term count in the document, idf = ln((N + 1) / (df + 1))
    (the smoothing of Spark ML's IDF), weight = tf * idf.

    The document-frequency table is one row per term; a very common term is a
    hot join key, which AQE's skew-join handling splits.
    """
    tf = tokens(df, key, text).groupBy(key, "term").agg(F.count(F.lit(1)).cast("bigint").alias("tf"))
    n_docs = df.select(F.count(F.lit(1)).cast("double")).scalar()
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    j = tf.join(dfreq, "term")
    idf = F.log((n_docs + F.lit(1.0)) / (F.col("df") + F.lit(1.0)))
    return j.select(key, "term", "tf", F.round(F.col("tf") * idf, 6).alias("tfidf"))


#: Binned features (4 bytes each) of one partition of the forest's training rows.
FOREST_CELLS = 25_000_000


def train_forest(train: DataFrame, vocab_size: int, min_df: float, trees: int = 20,
                 depth: int = 5, seed: int = 42):
    """O4 model: RegexTokenizer -> CountVectorizer -> IDF -> RandomForest (pyspark.ml).

    ``vocab_size`` and ``min_df`` bound the model's features; the caller states them.  The forest keeps
    a dense row of binned features a document, many times its text, so more than :data:`FOREST_CELLS`
    of them are dealt out anew before it is fitted.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer

    rows = train.select("doc_id", "text", F.col("label").cast("double").alias("label"))
    features = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=TOKEN_SPLIT, toLowercase=True),
        CountVectorizer(inputCol="words", outputCol="tf", vocabSize=vocab_size, minDF=min_df),
        IDF(inputCol="tf", outputCol="features")]).fit(rows)
    points = features.transform(rows).select("label", "features")
    parts = -(-rows.count() * vocab_size // FOREST_CELLS)
    if parts > 1:
        points = points.repartition(parts)
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(points)
    return PipelineModel([*features.stages, forest])


def predictors(docs: DataFrame, label: str = "label", text: str = "text", top: int = 20, min_docs: int = 1) -> DataFrame:
    """O5 without a model: the ``top`` terms whose presence tells most about a 0/1 label.

    One aggregate of (term, label) with partial sums gives every term's contingency table:
    ``positive`` and ``negative`` documents that hold it.  ``chi2`` (ties: smaller term) orders
    them; ``mutual_info`` is in nats; ``share`` is the term's share of positive documents.  Terms
    of a document count once, no (document, term) table is made, and the top is a TakeOrdered.
    Rows with a null label are left out; without both labels all scores are 0.
    """
    d = docs.filter(F.col(label).isNotNull()).select((F.col(label) == 1).alias("_y"), text)
    terms = d.select("_y", F.explode(F.array_distinct(F.split(F.lower(F.col(text)), TOKEN_SPLIT))).alias("term"))
    table = terms.filter(F.col("term") != "").groupBy("term").agg(
        F.count_if(F.col("_y")).cast("double").alias("a"), F.count_if(~F.col("_y")).cast("double").alias("b"))
    sizes = d.agg(F.count_if(F.col("_y")).cast("double").alias("p"), F.count_if(~F.col("_y")).cast("double").alias("q"))
    both = sizes.select(F.struct("p", "q")).scalar()
    x = table.filter(F.col("a") + F.col("b") >= min_docs).select(
        "term", "a", "b", (both.getField("p") - F.col("a")).alias("c"), (both.getField("q") - F.col("b")).alias("d"))
    x = x.withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("d"))

    def part(k: str, row: tuple[str, str], col: tuple[str, str]) -> Column:
        """One cell's k/n * ln(k n / (row col)), 0 for an empty cell."""
        v, r, c = F.col(k), F.col(row[0]) + F.col(row[1]), F.col(col[0]) + F.col(col[1])
        return F.when(v > 0, v / F.col("n") * F.log(v * F.col("n") / (r * c))).otherwise(0.0)

    ad, bc = F.col("a") * F.col("d"), F.col("b") * F.col("c")
    margins = (F.col("a") + F.col("b")) * (F.col("c") + F.col("d")) * (F.col("a") + F.col("c")) * (F.col("b") + F.col("d"))
    chi2 = F.coalesce(F.try_divide(F.col("n") * (ad - bc) * (ad - bc), margins), F.lit(0.0))
    info = (part("a", ("a", "b"), ("a", "c")) + part("b", ("a", "b"), ("b", "d"))
            + part("c", ("c", "d"), ("a", "c")) + part("d", ("c", "d"), ("b", "d")))
    out = x.select("term", F.col("a").cast("bigint").alias("positive"), F.col("b").cast("bigint").alias("negative"),
                   F.round(chi2, 6).alias("chi2"), F.round(info, 9).alias("mutual_info"),
                   F.round(F.col("a") / (F.col("a") + F.col("b")), 6).alias("share"))
    return out.orderBy(F.desc("chi2"), "term").limit(top)


def feature_importance(model, spark, top: int = 20) -> DataFrame:
    """Global feature importance of the forest joined to the vocabulary."""
    vocab = model.stages[1].vocabulary
    imp = model.stages[-1].featureImportances
    rows = [(vocab[int(i)], float(v)) for i, v in zip(imp.indices, imp.values)]
    df = spark.createDataFrame(rows, "term string, importance double")
    return df.orderBy(F.desc("importance"), "term").limit(top)


def confusion(pred: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Accuracy and confusion counts of a 0/1 prediction."""
    y, p = F.col(label).cast("int"), F.col(predicted).cast("int")
    return pred.agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count_if(y == p).cast("bigint").alias("correct"),
        F.round(F.avg((y == p).cast("double")), 6).alias("accuracy"),
        F.count_if((y == 1) & (p == 1)).cast("bigint").alias("tp"),
        F.count_if((y == 0) & (p == 1)).cast("bigint").alias("fp"),
        F.count_if((y == 0) & (p == 0)).cast("bigint").alias("tn"),
        F.count_if((y == 1) & (p == 0)).cast("bigint").alias("fn"))


def footprint(codes: DataFrame, threshold: int, key: str = "doc_id") -> DataFrame:
    """Footprint score = number of signalled dimensions; label = score >= t."""
    g = codes.groupBy(key).agg(F.max("label").alias("label"),
                               F.countDistinct(F.when(F.col("signalled") == 1, F.col("dim"))).cast("int").alias("score"))
    return g.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def threshold_sweep(codes: DataFrame, max_t: int = 10, key: str = "doc_id") -> DataFrame:
    """Accuracy and coverage (share predicted innovative) for t = 1..max_t.
    Thresholds are generated per item (``explode(sequence)``), not cross-joined."""
    s = footprint(codes, 1, key).select(key, "label", "score")
    x = s.select("label", "score", F.explode(F.sequence(F.lit(1), F.lit(max_t))).alias("t"))
    pred = (F.col("score") >= F.col("t")).cast("int")
    return x.groupBy("t").agg(F.round(F.avg((pred == F.col("label")).cast("double")), 6).alias("accuracy"),
                              F.round(F.avg(pred.cast("double")), 6).alias("coverage"))


def evidence_check(evidence: DataFrame, texts: DataFrame, verdicts: DataFrame, key: str = "doc_id") -> DataFrame:
    """A quote is valid only when it is a verbatim substring of the source;
    a non-innovative verdict that cites evidence is inconsistent."""
    j = evidence.join(texts.select(key, "text"), key).join(
        verdicts.filter(F.col("status") == "ok").select(key, "innovative"), key, "left")
    status = F.when(F.contains(F.col("text"), F.col("quote")), F.lit("valid")).otherwise(F.lit("hallucinated"))
    consistent = ~F.coalesce(F.col("innovative") == F.lit(False), F.lit(False))
    return j.select(key, "dimension", status.alias("quote_status"), consistent.alias("consistent"))


def fleiss_kappa(codes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fleiss' kappa for 0/1 codes, closed form from per-item counts."""
    per = codes.groupBy(key).agg(F.sum("code").cast("double").alias("n1"), F.count(F.lit(1)).cast("double").alias("n"))
    per = per.withColumn("p_i", (F.col("n1") ** 2 + (F.col("n") - F.col("n1")) ** 2 - F.col("n"))
                         / (F.col("n") * (F.col("n") - 1)))
    a = per.agg(F.count(F.lit(1)).cast("bigint").alias("items"), F.max("n").cast("bigint").alias("raters"),
                F.avg("p_i").alias("p_bar"), (F.sum("n1") / F.sum("n")).alias("p1"))
    pe = F.col("p1") ** 2 + (1 - F.col("p1")) ** 2
    return a.select("items", "raters", F.round("p_bar", 6).alias("p_bar"), F.round(pe, 6).alias("p_e"),
                    F.round((F.col("p_bar") - pe) / (1 - pe), 6).alias("kappa"))


def chat_examples(corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """system/user/assistant training examples as one JSON document per row, texts whole."""
    user = RQ.user_prompt(F.concat(F.lit("doc-"), F.col(key).cast("string")), F.col("text"))
    answer = F.when(F.col("label") == 1, F.lit('{"innovative": true}')).otherwise(F.lit('{"innovative": false}'))
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(RQ.CLASSIFY_SYSTEM_PROMPT).alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")),
                   F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    return corpus.select(key, F.to_json(F.struct(msgs.alias("messages"))).alias("example"))


def normalised_corpus(docs: DataFrame, translations: DataFrame, key: str = "doc_id") -> DataFrame:
    """English kept as written, other languages replaced by their
    non-empty translation; no translation -> ``missing`` (left out of training)."""
    t = translations.filter(F.length("text") > 0).select(key, F.col("text").alias("_t"))
    j = docs.join(t, key, "left")
    en = F.col("lang") == "en"
    source = F.when(en, F.lit("original")).when(F.col("_t").isNotNull(), F.lit("translated")).otherwise(F.lit("missing"))
    text = F.when(en, F.col("text")).otherwise(F.col("_t"))
    return j.select(key, "lang", source.alias("source"), text.alias("text"))
