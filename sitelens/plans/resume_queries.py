"""Query keys for the resume algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.operators import pages as P
from sitelens.operators import resume as RS
from sitelens.plans import oracle as O
from sitelens.plans.catalog import query
from sitelens.plans.page_queries import REACH_EXTRA, _reach
from sitelens.session import shared_path
from sitelens.sources import append_log as AL
from sitelens.sources import files as FS
from sitelens.sources import fixtures as FX

TODO_LIMIT = 100

OK_CTE = f"""okd AS (SELECT domain, arg_min(text_path, seq) AS text_path, min(seq) AS seq FROM (
    SELECT seq, {O.trim_ws("coalesce(domain, '')")} AS domain, {O.trim_ws("concat(domain, '.txt')")} AS text_path
    FROM scrape_log WHERE {O.text_true('ok')}) x
  WHERE domain <> '' AND text_path <> '' AND domain IN (SELECT domain FROM scrape_text WHERE length(text) > 0)
  GROUP BY domain),
done_t AS (SELECT DISTINCT domain FROM translated WHERE status = 'ok' AND length(text) > 0),
flying AS (SELECT DISTINCT concat('d', CAST(r.domain_id AS VARCHAR), '.example') AS domain FROM batch_requests_log r
  WHERE r.batch_id IN (SELECT batch_id FROM manifest_status_log GROUP BY batch_id HAVING arg_max(status, event_seq) <> 'collected'))"""

OK_VIEWS = ("scrape_log", "scrape_text", "translated", "batch_requests_log", "manifest_status_log")


def ok_domains(spark, sf_dir):
    """A4 + D2 over the scrape index (text_path = ``<domain>.txt``)."""
    idx = FX.scrape_log(spark, sf_dir).withColumn("text_path", F.concat("domain", F.lit(".txt")))
    return FS.ok_domains(idx, FX.scrape_text(spark, sf_dir))


def in_flight(spark, sf_dir):
    req = FX.batch_requests_log(spark, sf_dir).withColumn(
        "domain", F.concat(F.lit("d"), F.col("domain_id").cast("string"), F.lit(".example")))
    return RS.in_flight(req, FX.manifest_status_log(spark, sf_dir))


def translate_work(spark, sf_dir):
    """Ok domains minus translated-ok minus in flight, with their scraped text."""
    todo = ok_domains(spark, sf_dir)
    done = RS.done_ok(FX.translated(spark, sf_dir))
    work = RS.work_list(todo, done, in_flight(spark, sf_dir))
    return work.join(FX.scrape_text(spark, sf_dir).select("domain", "text"), "domain")


@query("ok_domains", O.with_views("SELECT domain, text_path, seq FROM okd", *OK_VIEWS, extra=OK_CTE))
def q_ok_domains(spark, sf_dir):
    return ok_domains(spark, sf_dir)


@query("accessible_urls", O.with_views(f"""
SELECT domain, arg_min(url, seq) AS url FROM (
  SELECT seq, {O.trim_ws("coalesce(domain, '')")} AS domain,
    {O.trim_ws("coalesce(nullif(final_url, ''), homepage, '')")} AS url
  FROM (SELECT r.domain, r.homepage, CAST(r.accessible AS VARCHAR) AS accessible, r.final_url, h.seq
        FROM reach r JOIN home h ON h.domain = r.domain) a
  WHERE {O.text_true('accessible')}) x
WHERE domain <> '' AND url <> '' GROUP BY domain""", "site_pages", "probe_log", extra=REACH_EXTRA))
def q_accessible_urls(spark, sf_dir):
    """B4 -> A3 round trip: write the reachability log as CSV, load the reachable urls."""
    reach = _reach(spark, sf_dir)
    home = P.homepages(FX.site_pages(spark, sf_dir)).select("domain", "seq")
    log = reach.join(home, "domain").select(
        "domain", "homepage", F.col("accessible").cast("string").alias("accessible"),
        F.col("status").cast("string").alias("status"), "final_url", "reason", "tls",
        F.lit(None).cast("string").alias("elapsed_s"), "seq")
    path = shared_path(spark, "accessibility-csv")
    FS.write_csv(log, path)
    return FS.accessible_urls(FS.read_accessibility(spark, path))


@query("resume_any", O.with_views("""
SELECT t.domain, t.seq FROM scrape_text t WHERE t.domain NOT IN (SELECT domain FROM done_log)""",
    "scrape_text", "done_log"))
def q_resume_any(spark, sf_dir):
    todo = FX.scrape_text(spark, sf_dir).select("domain", "seq")
    return RS.not_done(todo, FX.done_log(spark, sf_dir))


@query("todo_limit", O.with_views(f"""
SELECT t.domain, t.seq FROM scrape_text t WHERE t.domain NOT IN (SELECT domain FROM done_log)
ORDER BY t.seq LIMIT {TODO_LIMIT}""", "scrape_text", "done_log"))
def q_todo_limit(spark, sf_dir):
    todo = FX.scrape_text(spark, sf_dir).select("domain", "seq")
    return RS.take_first(RS.not_done(todo, FX.done_log(spark, sf_dir)), TODO_LIMIT)


@query("resume_ok", O.with_views("""
SELECT domain, text_path, seq FROM okd WHERE domain NOT IN (SELECT domain FROM done_t)""", *OK_VIEWS, extra=OK_CTE))
def q_resume_ok(spark, sf_dir):
    return ok_domains(spark, sf_dir).join(RS.done_ok(FX.translated(spark, sf_dir)), "domain", "left_anti")


@query("resume_inflight", O.with_views("""
SELECT domain, text_path, seq FROM okd WHERE domain NOT IN (SELECT domain FROM flying)""", *OK_VIEWS, extra=OK_CTE))
def q_resume_inflight(spark, sf_dir):
    return ok_domains(spark, sf_dir).join(in_flight(spark, sf_dir), "domain", "left_anti")


@query("work_list", O.with_views("""
SELECT domain, text_path, seq FROM okd WHERE domain NOT IN (SELECT domain FROM done_t)
  AND domain NOT IN (SELECT domain FROM flying)""", *OK_VIEWS, extra=OK_CTE))
def q_work_list(spark, sf_dir):
    return RS.work_list(ok_domains(spark, sf_dir), RS.done_ok(FX.translated(spark, sf_dir)), in_flight(spark, sf_dir))


PREF_CTE = OK_CTE + """,
pref AS (SELECT o.domain, o.seq, CASE WHEN coalesce(length(t.text) > 0, false) THEN 'translated' ELSE 'scraped' END AS source,
  CASE WHEN coalesce(length(t.text) > 0, false) THEN t.text ELSE s.text END AS text
  FROM okd o JOIN scrape_text s ON s.domain = o.domain LEFT JOIN translated t ON t.domain = o.domain)"""


def classify_work(spark, sf_dir):
    """Verdict work: ok domains with the preferred source text (E5)."""
    src = ok_domains(spark, sf_dir).select("domain", "seq").join(
        FX.scrape_text(spark, sf_dir).select("domain", "text"), "domain")
    return RS.preferred_source(src, FX.translated(spark, sf_dir))


@query("preferred_source", O.with_views(
    "SELECT domain, seq, source, CAST(length(text) AS BIGINT) AS text_chars FROM pref", *OK_VIEWS, extra=PREF_CTE))
def q_preferred_source(spark, sf_dir):
    w = classify_work(spark, sf_dir)
    return w.select("domain", "seq", "source", F.length("text").cast("bigint").alias("text_chars"))


LOG_SCHEMA = "seq bigint, domain string, ok string, reason string, chars bigint"


def outcome_log(spark, sf_dir):
    """Scrape outcomes appended by three runs: odd rows, even rows with retries of every fifth,
    and a run that was killed before its commit.  The second run is sent twice."""
    log = shared_path(spark, "outcomes")
    rows = FX.scrape_log(spark, sf_dir)
    retries = FX.done_log(spark, sf_dir).withColumn("reason", F.lit("retry"))
    AL.append(rows.filter("seq % 2 = 1"), log, "first")
    for _ in range(2):
        AL.append(rows.filter("seq % 2 = 0 and seq % 5 <> 0").unionByName(retries), log, "second")
    AL.write_run(rows, log, "killed")
    return AL.read(spark, log, LOG_SCHEMA)


LOGGED_CTE = """logged AS (SELECT seq, domain, ok, reason, chars, 1 AS log_seq FROM scrape_log WHERE seq % 2 = 1
  UNION ALL SELECT seq, domain, ok, CASE WHEN seq % 5 = 0 THEN 'retry' ELSE reason END, chars, 2 FROM scrape_log WHERE seq % 2 = 0 OR seq % 5 = 0)"""


@query("append_log", O.with_views("SELECT seq, domain, ok, reason, chars, CAST(log_seq AS BIGINT) AS log_seq FROM logged",
                                  "scrape_log", extra=LOGGED_CTE))
def q_append_log(spark, sf_dir):
    return outcome_log(spark, sf_dir).select("seq", "domain", "ok", "reason", "chars", "log_seq")


@query("log_latest", O.with_views("""SELECT domain, ok, reason, chars FROM logged
QUALIFY row_number() OVER (PARTITION BY domain ORDER BY log_seq DESC, seq DESC) = 1""", "scrape_log", extra=LOGGED_CTE))
def q_log_latest(spark, sf_dir):
    """G3 over the log: the last outcome of each domain, by run."""
    return AL.latest(outcome_log(spark, sf_dir), "domain", "seq").select("domain", "ok", "reason", "chars")


@query("status_log", O.with_views("""SELECT DISTINCT concat('d', CAST(r.domain_id AS VARCHAR), '.example') AS domain FROM batch_requests_log r
WHERE r.batch_id IN (SELECT batch_id FROM manifest_status_log GROUP BY batch_id HAVING arg_max(status, event_seq) <> 'collected')""",
    "batch_requests_log", "manifest_status_log"))
def q_status_log(spark, sf_dir):
    """Batches submitted, then collected, as events of a log; what is in flight (E3) by their last."""
    log = shared_path(spark, "status")
    events = FX.manifest_status_log(spark, sf_dir)
    for no, status in ((1, "submitted"), (2, "collected")):
        AL.append_status(events.filter(F.col("event_seq") == no).select("batch_id"), log, f"run-{no}", status)
    req = FX.batch_requests_log(spark, sf_dir).withColumn(
        "domain", F.concat(F.lit("d"), F.col("domain_id").cast("string"), F.lit(".example")))
    return RS.in_flight(req, AL.status_events(spark, log))
