"""Fixture views derived from the driver tables (FIXTURES.md §3), DataFrame API.

Each view is a deterministic function of the given tables, so its size grows
with them.  The DuckDB twins (used by the oracle) live in
``sitelens.plans.oracle``.  Small generated lists (attempts, raters,
dimensions) are ``explode(sequence(..))`` generators, never cross joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.sources.tables import table

HOST_RE = r"^https?://([^/?#:]+)"


def _domain_of(url_col):
    return F.regexp_replace(F.regexp_extract(url_col, HOST_RE, 1), r"^www[.]", "")


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract(F.col("url"), HOST_RE, 1)
    return p.select(F.col("page_id").alias("seq"), "url", host.alias("host"),
                    _domain_of(F.col("url")).alias("domain"), "html")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat company register: blank and duplicate ids, missing/blank/scheme-less sites."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    n_pages = p.select(F.count(F.lit(1))).scalar()  # scalar subquery, no cross join
    k = F.col("c_custkey")
    c = c.withColumn("page_ref", (k * 7) % n_pages)
    j = c.join(p, F.col("page_ref") == F.col("page_id"), "inner")
    bid = F.when(k % 97 == 0, F.lit("")).otherwise(
        F.concat(F.lpad((k - F.when(k % 11 == 0, 1).otherwise(0)).cast("string"), 7, "0"), F.lit("-1")))
    website = (F.when(k % 3 == 0, F.lit(None).cast("string"))
               .when(k % 7 == 0, F.lit("  "))
               .when(k % 5 == 0, F.regexp_replace(F.col("url"), r"^https?://", ""))
               .otherwise(F.col("url")))
    form = F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment"))
    status = F.when(k % 13 == 0, F.lit("Deregistered")).otherwise(F.lit("Registered"))
    return j.select(k.alias("seq"), bid.alias("business_id"), F.col("c_name").alias("name"),
                    website.alias("website"), form.alias("company_form"), status.alias("status"))


def registry_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register records in the nested API shape (A1 / C1-C4 input).

    names by ``seq % 5``: 0 former (v2) + current (v1, type "1"); 1 auxiliary
    (v1, type "3") + current (v1, type null); 2 only a v2 name; 3 only an
    auxiliary v1 name; 4 none.  forms by ``seq % 3`` (none when the flat form is
    null): 1 descriptions "1" and "3"; 2 only "1"; 0 an old v2 form plus a v1
    form whose "3" description is null.
    """
    r = registry(spark, sf_dir)
    nm = F.col("name")

    def name(n, t, v):
        return F.struct(n.alias("name"), F.lit(t).cast("string").alias("type"), F.lit(v).alias("version"))

    k5 = F.col("seq") % 5
    names = (F.when(k5 == 0, F.array(name(F.concat(F.lit("Former "), nm), "1", 2), name(nm, "1", 1)))
             .when(k5 == 1, F.array(name(F.concat(F.lit("Aux "), nm), "3", 1), name(nm, None, 1)))
             .when(k5 == 2, F.array(name(F.concat(F.lit("Past "), nm), None, 2)))
             .when(k5 == 3, F.array(name(F.concat(F.lit("Aux "), nm), "3", 1)))
             .otherwise(F.array().cast("array<struct<name:string,type:string,version:int>>")))
    cf = F.col("company_form")

    def desc(code, text):
        return F.struct(F.lit(code).alias("languageCode"), text.cast("string").alias("description"))

    def form(t, v, descs):
        return F.struct(t.alias("type"), F.lit(v).alias("version"), F.array(*descs).alias("descriptions"))

    k3 = F.col("seq") % 3
    forms_t = "array<struct<type:string,version:int,descriptions:array<struct<languageCode:string,description:string>>>>"
    forms = (F.when(cf.isNull(), F.array().cast(forms_t))
             .when(k3 == 1, F.array(form(F.concat(F.lit("T-"), cf), 1,
                                         [desc("1", F.concat(F.lit("fi:"), cf)), desc("3", cf)])))
             .when(k3 == 2, F.array(form(F.concat(F.lit("T-"), cf), 1, [desc("1", F.concat(F.lit("fi:"), cf))])))
             .otherwise(F.array(form(F.lit("OLD"), 2, [desc("3", F.lit("old"))]),
                                form(F.concat(F.lit("T-"), cf), 1, [desc("3", F.lit(None))]))))
    return r.select(
        F.col("seq"),
        F.struct(F.col("business_id").alias("value")).alias("businessId"),
        names.alias("names"),
        F.when(F.col("website").isNull(), F.lit(None)).otherwise(
            F.struct(F.col("website").alias("url"))).alias("website"),
        forms.alias("companyForms"),
        F.col("status").alias("tradeRegisterStatus"))


def probe_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt log, up to three attempts per domain (see FIXTURES.md)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    d = p.groupBy(_domain_of(F.col("url")).alias("domain")).agg(F.min("page_id").alias("page_id"))
    attempts = F.array(
        F.struct(F.lit(1).alias("attempt_no"), F.lit("secure").alias("ctx"), F.lit("HEAD").alias("method")),
        F.struct(F.lit(2).alias("attempt_no"), F.lit("secure").alias("ctx"), F.lit("GET").alias("method")),
        F.struct(F.lit(3).alias("attempt_no"), F.lit("relaxed").alias("ctx"), F.lit("HEAD").alias("method")))
    x = d.select("page_id", "domain", F.explode(attempts).alias("a")).select(
        "page_id", "domain", "a.attempt_no", "a.ctx", "a.method")
    pid, a = F.col("page_id"), F.col("attempt_no")
    x = x.filter((a == 1) | ((a == 2) & (pid % 6 == 2)) | ((a == 3) & (pid % 6).isin(0, 5)))
    status = (F.when((a == 1) & (pid % 6 == 1), 200).when((a == 1) & (pid % 6 == 2), 405)
              .when((a == 1) & (pid % 6 == 3), 404).when((a == 1) & (pid % 6 == 4), 503)
              .when((a == 2) & (pid % 6 == 2), 200).when((a == 3) & (pid % 12 == 5), 200))
    err = (F.when((a == 1) & (pid % 6 == 0), "dns_error").when((a == 1) & (pid % 6 == 5), "tls_error")
           .when((a == 3) & (pid % 6 == 0), "dns_error").when((a == 3) & (pid % 12 == 11), "timeout"))
    return x.select(pid.alias("seq"), "domain", "attempt_no", "ctx", "method",
                    status.cast("int").alias("http_status"), err.alias("error_kind"))


def scrape_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrape index with text booleans and failure reasons (all columns text-ish)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    i = F.col("doc_id")
    ok = F.when(i % 10 == 7, "False").when(i % 10 == 8, "True ").otherwise("True")
    reason = (F.when(i % 30 == 7, "Error:Page.goto: net::ERR_NAME_NOT_RESOLVED")
              .when(i % 30 == 17, "nav_timeout").when(i % 10 == 7, "empty_extract").otherwise("ok"))
    chars = F.when(i % 10 == 7, F.lit(0).cast("bigint")).otherwise(F.col("n_chars"))
    return d.select(i.alias("seq"), F.concat(F.lit("d"), i.cast("string"), F.lit(".example")).alias("domain"),
                    ok.alias("ok"), reason.alias("reason"), chars.alias("chars"))


def scrape_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped text per domain of ``scrape_log`` (the corpus, B5 layout)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".example")).alias("domain"),
                    F.col("doc_id").alias("seq"), "text")


def done_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier outcomes already recorded (every fifth scrape row)."""
    return scrape_log(spark, sf_dir).filter(F.col("seq") % 5 == 0)


def translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation index + text: every second document, some empty, some errored."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    d = d.filter(i % 2 == 0)
    text = F.when(i % 8 == 0, F.lit("")).otherwise(F.concat(F.lit("[en] "), F.col("text")))
    status = F.when(i % 6 == 0, F.lit("error")).otherwise(F.lit("ok"))
    return d.select(F.concat(F.lit("d"), i.cast("string"), F.lit(".example")).alias("domain"),
                    i.alias("seq"), status.alias("status"), text.alias("text"))


def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-part results with an errored part and a missing part."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    n = c.groupBy("conv_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_parts"))
    x = c.join(n, "conv_id")
    cid, turn = F.col("conv_id"), F.col("turn")
    x = x.filter(~((cid % 19 == 5) & (turn == 0)))
    rtype = F.when((cid % 17 == 3) & (turn == 1), "errored").otherwise("succeeded")
    return x.select((cid % 3).alias("batch_id"),
                    F.concat(F.lit("r"), cid.cast("string"), F.lit("-"), turn.cast("string")).alias("custom_id"),
                    cid.alias("domain_id"), turn.alias("part"), "n_parts", rtype.alias("result_type"), "text")


def batch_requests_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests that were submitted for ``batch_results`` (every turn)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    n = c.groupBy("conv_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_parts"))
    x = c.join(n, "conv_id")
    cid, turn = F.col("conv_id"), F.col("turn")
    return x.select((cid % 3).alias("batch_id"),
                    F.concat(F.lit("r"), cid.cast("string"), F.lit("-"), turn.cast("string")).alias("custom_id"),
                    cid.alias("domain_id"), turn.alias("part"), "n_parts")


def manifest_status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events per batch: all submitted, batches 0 and 1 later collected."""
    b = batch_requests_log(spark, sf_dir).select("batch_id").distinct()
    ev = F.explode(F.array(
        F.struct(F.lit(1).alias("event_seq"), F.lit("submitted").alias("status")),
        F.struct(F.lit(2).alias("event_seq"), F.lit("collected").alias("status"))))
    x = b.select("batch_id", ev.alias("e")).select("batch_id", "e.event_seq", "e.status")
    return x.filter((F.col("event_seq") == 1) | (F.col("batch_id") != 2))


def verdict_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON verdict bodies: valid, malformed, missing fields, not succeeded."""
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    rtype = F.when(i % 23 == 4, "expired").otherwise("succeeded")
    good = F.concat(F.lit('{"innovative": '), F.when(F.col("quality") == 1, "true").otherwise("false"),
                    F.lit(', "confidence": 0.'), (F.lit(5) + i % 5).cast("string"),
                    F.lit(r', "rationale": " line one\nline two "}'))
    body = (F.when(i % 29 == 6, F.lit('{"innovative": true,'))
            .when(i % 31 == 8, F.lit('{"innovative": false}')).otherwise(good))
    return l.select(i.alias("doc_id"), rtype.alias("result_type"), body.alias("body"))


def rater_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    x = l.select("doc_id", "quality", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rater"))
    flip = (F.col("doc_id") * 3 + F.col("rater") * F.col("rater")) % 5 == 0
    return x.select("doc_id", "rater",
                    F.when(flip, 1 - F.col("quality")).otherwise(F.col("quality")).alias("code"))


def dimension_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    x = l.select("doc_id", "quality", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("dim"))
    lim = F.when(F.col("quality") == 1, 4).otherwise(1)
    sig = F.when((F.col("doc_id") * 7 + F.col("dim") * 13) % 11 < lim, 1).otherwise(0)
    return x.select("doc_id", F.col("quality").alias("label"), "dim", sig.alias("signalled"))


def evidence_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    d = d.filter(i % 3 == 0)
    head = F.substring(F.col("text"), 1, 20)
    quote = F.when(i % 4 == 0, F.concat(head, F.lit(" made up"))).otherwise(head)
    return d.select(i.alias("doc_id"), quote.alias("quote"),
                    F.concat(F.lit("O-"), (F.lit(1) + i % 10).cast("string"), F.lit("d")).alias("dimension"))


# ---- small fixed tables ---------------------------------------------------

# Public suffixes used for registered-domain tests.
PUBLIC_SUFFIXES = ("com", "net", "org", "fi", "se", "co.uk")


def public_suffix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in PUBLIC_SUFFIXES], "suffix string")


#: Rules of all three kinds over the hosts of the given pages.
SUFFIX_RULES = ("// rules", "com", "net", "org", "example.net", "*.example.org", "!thther.example.org")


def suffix_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SUFFIX_RULES], "suffix string")


def registry_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat register with each company's place (its nation), line of business and post code."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("seq"), F.col("n_name").alias("location"), F.col("c_mktsegment").alias("business_line"),
        F.lpad((F.col("c_custkey") % 7).cast("string"), 5, "0").alias("post_code"))
    return registry(spark, sf_dir).join(p, "seq")


def probe_log_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt log with error messages and kinds that show them."""
    message = F.concat(F.lit("cannot reach "), F.col("domain"), F.lit(" after some attempts"))
    kind = (F.when((F.col("error_kind") == "dns_error") & (F.col("seq") % 12 == 0), "url_error")
            .when(F.col("error_kind") == "timeout", "IncompleteRead").otherwise(F.col("error_kind")))
    return probe_log(spark, sf_dir).withColumn("message", F.when(kind.isNotNull(), message)).withColumn("error_kind", kind)
