"""Query keys for labels, splits, TF-IDF, evaluation and language id (SURVEY §2.5 E12,
§2.6 F15, §2.12 O1-O12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.functions import requests as RQ
from sitelens.operators import batches as B
from sitelens.operators import labels as L
from sitelens.operators import language as LG
from sitelens.plans import oracle as O
from sitelens.plans.catalog import query
from sitelens.plans.request_queries import VERDICT_CTE
from sitelens.sources import fixtures as FX
from sitelens.sources.tables import table

FOOTPRINT_T = 3

CORPUS_CTE = """experts AS (SELECT doc_id, CASE WHEN sum(code) * 2 > count(*) THEN 1 ELSE 0 END AS label
  FROM rater_codes GROUP BY doc_id),
u AS (SELECT doc_id, 1 AS label, 'list' AS source FROM labels WHERE quality = 1
      UNION ALL SELECT doc_id, label, 'expert' AS source FROM experts WHERE label = 0),
rec AS (SELECT doc_id, max(label) AS label, arg_max(source, label) AS source FROM u GROUP BY doc_id),
corpus AS (SELECT r.doc_id, r.label, r.source, d.text FROM rec r JOIN documents d USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':42')), doc_id) - 1 AS o,
  count(*) OVER (PARTITION BY label) AS n FROM corpus),
split AS (SELECT doc_id, label, source, text, CASE WHEN o * 100 < n * 80 THEN 'train'
  WHEN o * 100 < n * 85 THEN 'validation' ELSE 'test' END AS split FROM ranked)"""


def corpus(spark, sf_dir):
    pos = table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    experts = L.expert_labels(FX.rater_codes(spark, sf_dir))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return L.label_corpus(pos, experts, texts)


def split(spark, sf_dir):
    return L.stratified_split(corpus(spark, sf_dir))


@query("label_corpus", O.with_views(
    "SELECT doc_id, label, source, CAST(length(text) AS BIGINT) AS text_chars FROM corpus", "rater_codes",
    extra=CORPUS_CTE))
def q_label_corpus(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.select("doc_id", "label", "source", F.length("text").cast("bigint").alias("text_chars"))


@query("label_summary", O.with_views("""
SELECT count(*) AS n, round(avg(label), 6) AS mean, round(stddev_samp(label), 6) AS std,
  round(100.0 * avg(CASE WHEN label = 0 THEN 1 ELSE 0 END), 6) AS pct_negative FROM corpus""", "rater_codes",
    extra=CORPUS_CTE))
def q_label_summary(spark, sf_dir):
    return L.label_summary(corpus(spark, sf_dir))


@query("stratified_split", O.with_views("SELECT doc_id, label, split FROM split", "rater_codes", extra=CORPUS_CTE))
def q_stratified_split(spark, sf_dir):
    return split(spark, sf_dir).select("doc_id", "label", "split")


TFIDF_CTE = CORPUS_CTE + f""",
tr AS (SELECT doc_id, text FROM split WHERE split = 'train'),
toks AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), {O.q(L.TOKEN_SPLIT)})) AS term FROM tr),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks WHERE term <> '' GROUP BY doc_id, term),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


@query("tfidf", O.with_views("""
SELECT tf.doc_id, tf.term, tf.tf, round(tf.tf * ln(((SELECT count(*) FROM tr) + 1.0) / (dfq.df + 1.0)), 6) AS tfidf
FROM tf JOIN dfq USING (term)""", "rater_codes", extra=TFIDF_CTE))
def q_tfidf(spark, sf_dir):
    tr = split(spark, sf_dir).filter(F.col("split") == "train").select("doc_id", "text")
    return L.tfidf(tr)


#: Features of the forest: the most frequent terms of the training split.
FOREST_VOCABULARY = 5000


def _forest(spark, sf_dir):
    s = split(spark, sf_dir).select("doc_id", "label", "text", "split")
    model = L.train_forest(s.filter(F.col("split") == "train"), vocab_size=FOREST_VOCABULARY, min_df=2.0)
    return model, s


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    model, _ = _forest(spark, sf_dir)
    return L.feature_importance(model, spark)


PREDICTOR_CTE = CORPUS_CTE + f""",
pt AS (SELECT DISTINCT doc_id, label, unnest(regexp_split_to_array(lower(text), {O.q(L.TOKEN_SPLIT)})) AS term FROM split WHERE split = 'train'),
tot AS (SELECT CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE label <> 1) AS DOUBLE) AS q FROM split WHERE split = 'train'),
cell AS (SELECT term, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE label <> 1) AS DOUBLE) AS b
  FROM pt WHERE term <> '' GROUP BY term),
tab AS (SELECT term, a, b, p - a AS c, q - b AS d, p + q AS n FROM cell, tot)"""


@query("predictors", O.with_views("""
SELECT term, CAST(a AS BIGINT) AS positive, CAST(b AS BIGINT) AS negative,
  round(coalesce(n * (a * d - b * c) * (a * d - b * c) / nullif((a + b) * (c + d) * (a + c) * (b + d), 0), 0), 6) AS chi2,
  round((CASE WHEN a > 0 THEN a / n * ln(a * n / ((a + b) * (a + c))) ELSE 0 END) + (CASE WHEN b > 0 THEN b / n * ln(b * n / ((a + b) * (b + d))) ELSE 0 END)
    + (CASE WHEN c > 0 THEN c / n * ln(c * n / ((c + d) * (a + c))) ELSE 0 END) + (CASE WHEN d > 0 THEN d / n * ln(d * n / ((c + d) * (b + d))) ELSE 0 END), 9) AS mutual_info,
  round(a / (a + b), 6) AS share
FROM tab ORDER BY chi2 DESC, term LIMIT 20""", "rater_codes", extra=PREDICTOR_CTE))
def q_predictors(spark, sf_dir):
    """The terms of the training split that tell most about the label."""
    return L.predictors(split(spark, sf_dir).filter(F.col("split") == "train"), top=20)


@query("model_accuracy")
def q_model_accuracy(spark, sf_dir):
    model, s = _forest(spark, sf_dir)
    pred = model.transform(s.filter(F.col("split") == "test").select("doc_id", "text", "label"))
    return L.confusion(pred.withColumn("predicted", F.col("prediction").cast("int")))


ACCURACY_CTE = CORPUS_CTE + ",\n" + VERDICT_CTE + """,
v AS (SELECT doc_id, CAST(innovative AS INTEGER) AS predicted FROM verdicts WHERE status = 'ok'),
p AS (SELECT c.label, v.predicted FROM corpus c JOIN v USING (doc_id))"""


@query("accuracy", O.with_views("""
SELECT count(*) AS n, count(*) FILTER (WHERE label = predicted) AS correct,
  round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  count(*) FILTER (WHERE label = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE label = 0 AND predicted = 1) AS fp,
  count(*) FILTER (WHERE label = 0 AND predicted = 0) AS tn, count(*) FILTER (WHERE label = 1 AND predicted = 0) AS fn
FROM p""", "rater_codes", "verdict_feed", extra=ACCURACY_CTE))
def q_accuracy(spark, sf_dir):
    """Verdicts (J19) against the consolidated labels."""
    v = B.parse_verdicts(FX.verdict_feed(spark, sf_dir)).filter(F.col("status") == "ok")
    p = corpus(spark, sf_dir).select("doc_id", "label").join(
        v.select("doc_id", F.col("innovative").cast("int").alias("predicted")), "doc_id")
    return L.confusion(p)


@query("footprint", O.with_views(f"""
SELECT doc_id, max(label) AS label, CAST(count(DISTINCT CASE WHEN signalled = 1 THEN dim END) AS INTEGER) AS score,
  CAST(count(DISTINCT CASE WHEN signalled = 1 THEN dim END) >= {FOOTPRINT_T} AS INTEGER) AS predicted
FROM dimension_codes GROUP BY doc_id""", "dimension_codes"))
def q_footprint(spark, sf_dir):
    return L.footprint(FX.dimension_codes(spark, sf_dir), FOOTPRINT_T)


@query("threshold_sweep", O.with_views("""
SELECT t, round(avg(CASE WHEN (score >= t) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(CASE WHEN score >= t THEN 1.0 ELSE 0.0 END), 6) AS coverage
FROM s, (SELECT unnest(range(1, 11)) AS t) ts GROUP BY t""", "dimension_codes", extra="""s AS (SELECT doc_id,
  max(label) AS label, count(DISTINCT CASE WHEN signalled = 1 THEN dim END) AS score FROM dimension_codes GROUP BY doc_id)"""))
def q_threshold_sweep(spark, sf_dir):
    return L.threshold_sweep(FX.dimension_codes(spark, sf_dir))


@query("evidence_check", O.with_views("""
SELECT e.doc_id, e.dimension, CASE WHEN contains(d.text, e.quote) THEN 'valid' ELSE 'hallucinated' END AS quote_status,
  NOT coalesce(v.innovative = false, false) AS consistent
FROM evidence_feed e JOIN documents d USING (doc_id) LEFT JOIN (SELECT doc_id, innovative FROM verdicts WHERE status = 'ok') v
  USING (doc_id)""", "evidence_feed", "verdict_feed",
    extra=VERDICT_CTE))
def q_evidence_check(spark, sf_dir):
    v = B.parse_verdicts(FX.verdict_feed(spark, sf_dir))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return L.evidence_check(FX.evidence_feed(spark, sf_dir), texts, v)


@query("fleiss_kappa", O.with_views("""
SELECT count(*) AS items, CAST(max(n) AS BIGINT) AS raters, round(avg(p_i), 6) AS p_bar,
  round(pow(sum(n1) / sum(n), 2) + pow(1 - sum(n1) / sum(n), 2), 6) AS p_e,
  round((avg(p_i) - (pow(sum(n1) / sum(n), 2) + pow(1 - sum(n1) / sum(n), 2)))
        / (1 - (pow(sum(n1) / sum(n), 2) + pow(1 - sum(n1) / sum(n), 2))), 6) AS kappa
FROM (SELECT doc_id, n1, n, (n1 * n1 + (n - n1) * (n - n1) - n) / (n * (n - 1)) AS p_i
      FROM (SELECT doc_id, CAST(sum(code) AS DOUBLE) AS n1, CAST(count(*) AS DOUBLE) AS n FROM rater_codes GROUP BY doc_id))""",
    "rater_codes"))
def q_fleiss_kappa(spark, sf_dir):
    return L.fleiss_kappa(FX.rater_codes(spark, sf_dir))


@query("chat_examples", O.with_views(f"""
SELECT doc_id, md5(ex) AS example_md5, CAST(length(ex) AS BIGINT) AS example_chars FROM (
  SELECT doc_id, CAST(to_json({{'messages': [
    {{'role': 'system', 'content': {O.q(RQ.CLASSIFY_SYSTEM_PROMPT)}}},
    {{'role': 'user', 'content': concat({O.q(RQ.USER_TEMPLATE_HEAD)}, concat('doc-', CAST(doc_id AS VARCHAR)),
        {O.q(RQ.USER_TEMPLATE_MID)}, text, {O.q(RQ.USER_TEMPLATE_TAIL)})}},
    {{'role': 'assistant', 'content': CASE WHEN label = 1 THEN '{{"innovative": true}}' ELSE '{{"innovative": false}}' END}}
  ]}}) AS VARCHAR) AS ex FROM split WHERE split = 'train')""", "rater_codes", extra=CORPUS_CTE))
def q_chat_examples(spark, sf_dir):
    tr = split(spark, sf_dir).filter(F.col("split") == "train")
    ex = L.chat_examples(tr)
    return ex.select("doc_id", F.md5("example").alias("example_md5"),
                     F.length("example").cast("bigint").alias("example_chars"))


@query("normalised_corpus", O.with_views("""
SELECT d.doc_id, d.lang, CASE WHEN d.lang = 'en' THEN 'original' WHEN t.text IS NOT NULL THEN 'translated' ELSE 'missing' END AS source,
  CAST(length(CASE WHEN d.lang = 'en' THEN d.text ELSE t.text END) AS BIGINT) AS text_chars
FROM documents d LEFT JOIN (SELECT seq AS doc_id, text FROM translated WHERE length(text) > 0) t USING (doc_id)""",
    "translated"))
def q_normalised_corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    tr = FX.translated(spark, sf_dir).select(F.col("seq").alias("doc_id"), "text")
    n = L.normalised_corpus(docs, tr)
    return n.select("doc_id", "lang", "source", F.length("text").cast("bigint").alias("text_chars"))


def _sample_sql(e: str) -> str:
    return f"lower(substring({O.trim_ws(e)}, 1, {LG.SAMPLE_CHARS}))"


def _grams_sql(source: str, key: str) -> str:
    """Buckets of all substrings of 1 to 3 characters of ``s``, character by character."""
    a, b, c = LG.FACTORS
    code = lambda k: f"unicode(substring(s, i + {k}, 1))"
    parts = ((0, f"{code(0)} * {a}"), (1, f"{code(0)} * {a} + {code(1)} * {b}"), (2, f"{code(0)} * {a} + {code(1)} * {b} + {code(2)} * {c}"))
    return " UNION ALL ".join(
        f"SELECT {key}, (CAST({e.replace(' * ', '::BIGINT * ')} AS BIGINT) + {LG.SIZE_FACTOR * (k + 1)}) % {LG.BUCKETS} AS bucket "
        f"FROM {source}, LATERAL (SELECT unnest(range(1, length(s) + 1 - {k})) AS i)" for k, e in parts)


LANGID_CTE = f"""whole AS (SELECT lang, lower({O.trim_ws('text')}) AS s FROM documents WHERE lang IS NOT NULL),
top AS (SELECT lang, bucket, count(*) AS cnt FROM ({_grams_sql('whole', 'lang')}) GROUP BY 1, 2),
tot AS (SELECT lang, sum(cnt) AS t FROM top GROUP BY lang),
seen AS (SELECT DISTINCT bucket FROM top),
samp AS (SELECT doc_id, {_sample_sql('text')} AS s FROM documents),
grams AS (SELECT doc_id, bucket, count(*) AS cnt FROM ({_grams_sql('samp', 'doc_id')}) GROUP BY 1, 2),
many AS (SELECT doc_id, sum(cnt) AS n FROM grams GROUP BY doc_id),
hit AS (SELECT DISTINCT doc_id FROM grams JOIN seen USING (bucket)),
part AS (SELECT g.doc_id, m.lang, sum(g.cnt * ln(m.cnt + 1)) AS s FROM grams g JOIN top m USING (bucket) GROUP BY g.doc_id, m.lang),
scored AS (SELECT h.doc_id, t.lang, coalesce(p.s, 0) - m.n * ln(t.t + {LG.BUCKETS}) AS score
  FROM hit h JOIN many m USING (doc_id) JOIN tot t ON true LEFT JOIN part p ON p.doc_id = h.doc_id AND p.lang = t.lang),
best AS (SELECT doc_id, lang AS lang_id FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)"""


@query("language_id", O.with_views("SELECT d.doc_id, b.lang_id FROM documents d LEFT JOIN best b USING (doc_id)",
                                   extra=LANGID_CTE))
def q_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = LG.train(docs)
    return LG.identify(docs.select("doc_id", "text"), model)
