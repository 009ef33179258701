"""Query keys for captured pages and reachability."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.functions import html as H
from sitelens.functions import urls as U
from sitelens.operators import pages as P
from sitelens.operators import registry as R
from sitelens.operators import reports as RP
from sitelens.operators.ordering import first_per_key
from sitelens.plans import oracle as O
from sitelens.plans.catalog import query
from sitelens.plans.registry_queries import KEPT_CTE
from sitelens.session import shared_path
from sitelens.sources import exports as EX
from sitelens.sources import fixtures as FX

LANGS = ("en", "de")
LANGS_SQL = ", ".join(O.q(x) for x in LANGS)
BATCH_OFFSET, BATCH_LIMIT = 10, 20

EXTRACT_CTE = f"""{O.PAGE_TEXT},
ex AS (SELECT seq, url, domain, {O.page_title('html')} AS title, {O.page_language('html')} AS language,
  text FROM site_pages LEFT JOIN page_text USING (seq)),
ext AS (SELECT *, CASE WHEN coalesce(text, '') = '' THEN 'extraction_failed' END AS error FROM ex),
home AS (SELECT domain, seq, url FROM site_pages QUALIFY row_number() OVER (PARTITION BY domain ORDER BY seq) = 1)"""

LINKS_CTE = f"""raw AS (SELECT h.domain, h.url AS home_url, unnest(regexp_extract_all(p.html, {O.q(H.LINK_RE)}, 1)) AS href,
  generate_subscripts(regexp_extract_all(p.html, {O.q(H.LINK_RE)}, 1), 1) - 1 AS pos
  FROM home h JOIN site_pages p ON p.seq = h.seq),
trimmed AS (SELECT domain, home_url, pos, {O.trim_ws('href')} AS h FROM raw),
resolved AS (SELECT domain, home_url, pos, {O.resolve_link('h', 'home_url')} AS r FROM trimmed),
cleaned AS (SELECT domain, home_url, pos, {O.clean_url('r')} AS link FROM resolved WHERE r IS NOT NULL),
homec AS (SELECT domain, home_url, pos, link, regexp_replace(link, '/+$', '') AS canon,
  regexp_replace({O.clean_url('home_url')}, '/+$', '') AS home_canon FROM cleaned),
kept_links AS (SELECT * FROM homec WHERE {O.site_key('link')} = {O.site_key('home_url')}
  AND NOT regexp_matches({O.url_path('link')}, {O.q(U.ASSET_RE)})
  AND canon <> '' AND canon <> home_canon),
firsts AS (SELECT domain, canon, arg_min(link, pos) AS url, min(pos) AS pos FROM kept_links GROUP BY domain, canon),
links AS (SELECT domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY pos) - 1 AS INTEGER) AS link_no, url
  FROM firsts QUALIFY row_number() OVER (PARTITION BY domain ORDER BY pos) <= {P.MAX_SUBPAGES})"""


@query("page_extract", O.with_views(
    "SELECT seq, url, domain, title, language, text, error FROM ext", "site_pages", extra=EXTRACT_CTE))
def q_page_extract(spark, sf_dir):
    return P.extract_pages(FX.site_pages(spark, sf_dir))


@query("first_level_links", O.with_views("SELECT domain, link_no, url FROM links", "site_pages",
                                         extra=EXTRACT_CTE + ",\n" + LINKS_CTE))
def q_first_level_links(spark, sf_dir):
    pages = FX.site_pages(spark, sf_dir)
    return P.first_level_links(P.homepages(pages), pages)


@query("language_filter", O.with_views(f"""
SELECT e.seq, e.url, e.language,
  CASE WHEN e.language IS NOT NULL AND e.language NOT IN ({LANGS_SQL}) THEN NULL ELSE e.title END AS title,
  CASE WHEN e.language IS NOT NULL AND e.language NOT IN ({LANGS_SQL}) THEN NULL ELSE e.text END AS text,
  CASE WHEN e.language IS NOT NULL AND e.language NOT IN ({LANGS_SQL}) THEN 'language_filtered' ELSE e.error END AS error
FROM ext e WHERE e.seq NOT IN (SELECT seq FROM home)""", "site_pages", extra=EXTRACT_CTE))
def q_language_filter(spark, sf_dir):
    pages = FX.site_pages(spark, sf_dir)
    subs = pages.join(P.homepages(pages).select("seq"), "seq", "left_anti")
    out = P.language_filter(P.extract_pages(subs), LANGS)
    return out.select("seq", "url", "language", "title", "text", "error")


def _quality_sql():
    head = "lower(concat_ws(' ', title, text))"
    bad = " OR ".join(f"contains({head}, {O.q(m)})" for m in P.ERROR_PAGE_MARKERS)
    return O.with_views(f"""SELECT seq, url, domain FROM ext
WHERE error IS NULL AND NOT ({bad}) AND NOT {O.is_junk("coalesce(text, '')")}""", "site_pages", extra=EXTRACT_CTE)


@query("quality_filter", _quality_sql())
def q_quality_filter(spark, sf_dir):
    return P.quality_filter(P.extract_pages(FX.site_pages(spark, sf_dir))).select("seq", "url", "domain")


SITE_CTE = f"""captured AS (SELECT regexp_replace({O.clean_url('url')}, '/+$', '') AS canon, seq, title, language, text, error
  FROM ext QUALIFY row_number() OVER (PARTITION BY regexp_replace({O.clean_url('url')}, '/+$', '') ORDER BY seq) = 1),
sub AS (SELECT l.domain, c.seq, c.language, CASE WHEN c.seq IS NULL THEN 'download_failed' ELSE c.error END AS error
  FROM links l LEFT JOIN captured c ON c.canon = regexp_replace(l.url, '/+$', '')),
subs AS (SELECT domain, CAST(count(*) AS INTEGER) AS subpage_count,
  CAST(count(*) FILTER (WHERE error IS NOT NULL) AS INTEGER) AS failed_subpages,
  list_distinct(list(language)) AS sub_langs FROM sub GROUP BY domain),
site_result AS (SELECT h.domain, h.url AS homepage, m.title AS main_title, m.language AS main_language,
  CAST(length(m.text) AS BIGINT) AS main_chars, m.error AS main_error,
  coalesce(s.subpage_count, 0) AS subpage_count, coalesce(s.failed_subpages, 0) AS failed_subpages,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(s.sub_langs, []),
     CASE WHEN m.language IS NULL THEN [] ELSE [m.language] END))), '|') AS languages,
  CASE WHEN {O.is_blank('p.html')} THEN 'homepage_unreachable' ELSE '' END AS site_error
  FROM home h LEFT JOIN ext m ON m.seq = h.seq LEFT JOIN subs s ON s.domain = h.domain LEFT JOIN site_pages p ON p.seq = h.seq)"""

SITE_EXTRA = EXTRACT_CTE + ",\n" + LINKS_CTE + ",\n" + SITE_CTE


@query("site_result", O.with_views("SELECT * FROM site_result", "site_pages", extra=SITE_EXTRA))
def q_site_result(spark, sf_dir):
    return P.site_results(FX.site_pages(spark, sf_dir))


@query("site_pages_result", O.with_views("""
SELECT domain, 0 AS page_no, h.url, e.title, e.language, md5(e.text) AS text_md5, e.error FROM home h JOIN ext e USING (domain, seq)
UNION ALL SELECT l.domain, l.link_no + 1, l.url, c.title, c.language, md5(c.text),
  CASE WHEN c.seq IS NULL THEN 'download_failed' ELSE c.error END
FROM links l LEFT JOIN captured c ON c.canon = regexp_replace(l.url, '/+$', '')""", "site_pages", extra=SITE_EXTRA))
def q_site_pages_result(spark, sf_dir):
    """M4: the pages of every site with their texts (digested here)."""
    r = P.site_page_rows(FX.site_pages(spark, sf_dir))
    return r.select("domain", F.col("page_no").cast("int").alias("page_no"), "url", "title", "language",
                    F.md5("text").alias("text_md5"), "error")


@query("site_languages", O.with_views("SELECT domain, languages FROM site_result", "site_pages", extra=SITE_EXTRA))
def q_site_languages(spark, sf_dir):
    return P.site_results(FX.site_pages(spark, sf_dir)).select("domain", "languages")


@query("site_summary", O.with_views("""
SELECT m.business_id, m.name, m.company_form, m.homepage, m.domain, coalesce(s.subpage_count, 0) AS subpage_count,
  coalesce(s.languages, '') AS languages, coalesce(s.site_error, '') AS site_error
FROM manifest m LEFT JOIN site_result s ON s.domain = m.domain""", "site_pages", "registry",
    extra=SITE_EXTRA + "," + KEPT_CTE))
def q_site_summary(spark, sf_dir):
    """J15 + B2's flat CSV: one row per company with its site's languages."""
    m = R.manifest(FX.registry(spark, sf_dir))
    s = P.site_results(FX.site_pages(spark, sf_dir))
    j = m.join(s.select("domain", "subpage_count", "languages", "site_error"), "domain", "left")
    return j.select("business_id", "name", "company_form", "homepage", "domain",
                    F.coalesce("subpage_count", F.lit(0)).alias("subpage_count"),
                    F.coalesce("languages", F.lit("")).alias("languages"),
                    F.coalesce("site_error", F.lit("")).alias("site_error"))


# ---- M6 / J12 / E4 / F4 / M3 / E9 / F5 / M5 / F3 -------------------------------------

REACH_CTE = """pl AS (SELECT *, http_status IS NOT NULL AND NOT (method = 'HEAD' AND http_status IN (403, 405, 406, 501)) AS d,
  error_kind IS NOT NULL AS e FROM probe_log),
pg AS (SELECT domain, min(CASE WHEN d THEN attempt_no END) AS dec_no, min(CASE WHEN e THEN attempt_no END) AS first_no,
  max(CASE WHEN e THEN attempt_no END) AS last_no FROM pl GROUP BY domain),
pv AS (SELECT g.domain, dd.http_status AS st, dd.ctx AS ctx, fe.error_kind AS first_err, le.error_kind AS last_err
  FROM pg g LEFT JOIN pl dd ON dd.domain = g.domain AND dd.attempt_no = g.dec_no
  LEFT JOIN pl fe ON fe.domain = g.domain AND fe.attempt_no = g.first_no
  LEFT JOIN pl le ON le.domain = g.domain AND le.attempt_no = g.last_no),
pk AS (SELECT *, CASE WHEN first_err = 'tls_error' THEN coalesce(last_err, first_err) ELSE first_err END AS kind FROM pv),
reach AS (SELECT k.domain, coalesce(k.st IS NOT NULL AND k.st < 500, false) AS accessible, CAST(k.st AS INTEGER) AS status,
  CASE WHEN k.st IS NOT NULL AND k.st < 400 THEN 'ok' WHEN k.st IS NOT NULL THEN concat('http_', CAST(k.st AS VARCHAR))
       WHEN k.kind IN ('timeout', 'dns_error', 'tls_error', 'connection_error') THEN k.kind
       WHEN k.kind = 'url_error' THEN 'url_error:' WHEN k.kind IS NOT NULL THEN concat(k.kind, ':') ELSE 'no_response' END AS reason,
  CASE WHEN k.st IS NOT NULL AND k.ctx = 'secure' THEN 'ok' WHEN k.st IS NOT NULL THEN 'insecure-retry' ELSE 'n/a' END AS tls,
  h.url AS homepage, CASE WHEN k.st IS NOT NULL THEN h.url END AS final_url
  FROM pk k LEFT JOIN home h ON h.domain = k.domain)"""

REACH_EXTRA = EXTRACT_CTE + ",\n" + REACH_CTE


def _reach(spark, sf_dir):
    pages = FX.site_pages(spark, sf_dir)
    return P.reachability(FX.probe_log(spark, sf_dir), P.homepages(pages))


@query("reachability", O.with_views("SELECT domain, accessible, status, reason, tls, homepage, final_url FROM reach",
                                    "site_pages", "probe_log", extra=REACH_EXTRA))
def q_reachability(spark, sf_dir):
    return _reach(spark, sf_dir).select("domain", "accessible", "status", "reason", "tls", "homepage", "final_url")


SAID_CTE = """probe_said AS (SELECT seq, domain, attempt_no, ctx, method, http_status,
  CASE WHEN error_kind = 'dns_error' AND seq % 12 = 0 THEN 'url_error' WHEN error_kind = 'timeout' THEN 'IncompleteRead' ELSE error_kind END AS error_kind,
  CASE WHEN error_kind IS NOT NULL THEN concat('cannot reach ', domain, ' after some attempts') END AS message FROM probe_log)"""
SAID_REACH = REACH_CTE.replace("FROM probe_log)", "FROM probe_said)").replace(
    "le.error_kind AS last_err", "le.error_kind AS last_err, CASE WHEN fe.error_kind = 'tls_error' THEN le.message ELSE fe.message END AS msg").replace(
    "THEN 'url_error:'", "THEN concat('url_error:', substring(coalesce(k.msg, ''), 1, 40))").replace(
    "THEN concat(k.kind, ':')", "THEN concat(k.kind, ':', substring(coalesce(k.msg, ''), 1, 40))")


@query("reachability_messages", O.with_views("SELECT domain, accessible, status, reason, tls FROM reach", "site_pages", "probe_log",
                                             extra=EXTRACT_CTE + ",\n" + SAID_CTE + ",\n" + SAID_REACH))
def q_reachability_messages(spark, sf_dir):
    """Reasons with the first 40 characters of the error's message."""
    out = P.reachability(FX.probe_log_messages(spark, sf_dir), P.homepages(FX.site_pages(spark, sf_dir)))
    return out.select("domain", "accessible", "status", "reason", "tls")


@query("latest_result", O.with_views("""
SELECT domain, arg_max(attempt_no, attempt_no) AS attempt_no, arg_max(ctx, attempt_no) AS ctx,
  arg_max(method, attempt_no) AS method FROM probe_log GROUP BY domain""", "probe_log"))
def q_latest_result(spark, sf_dir):
    """The last attempt per domain ("last one wins")."""
    from sitelens.operators.ordering import last_per_key
    p = FX.probe_log(spark, sf_dir).select("domain", "attempt_no", "ctx", "method")
    return last_per_key(p, "domain", "attempt_no")


@query("companies_accessible", O.with_views("""
SELECT m.business_id, m.domain, coalesce(r.accessible, false) AS accessible
FROM manifest m LEFT JOIN reach r ON r.domain = m.domain""", "site_pages", "probe_log", "registry",
    extra=REACH_EXTRA + "," + KEPT_CTE))
def q_companies_accessible(spark, sf_dir):
    m = R.manifest(FX.registry(spark, sf_dir))
    return RP.companies_accessible(m, _reach(spark, sf_dir))


@query("accessibility_summary", O.with_views("""
SELECT (SELECT count(*) FROM manifest) AS companies_in_manifest,
  (SELECT count(DISTINCT domain) FROM manifest) AS unique_domains,
  (SELECT count(*) FROM reach WHERE domain IN (SELECT domain FROM manifest)) AS domains_checked_this_run,
  (SELECT count(*) FROM reach WHERE accessible) AS domains_accessible,
  (SELECT count(*) FROM reach) AS domains_total_recorded,
  (SELECT count(*) FROM manifest m JOIN reach r ON r.domain = m.domain WHERE r.accessible) AS companies_with_accessible_site
""", "site_pages", "probe_log", "registry", extra=REACH_EXTRA + "," + KEPT_CTE))
def q_accessibility_summary(spark, sf_dir):
    m = R.manifest(FX.registry(spark, sf_dir))
    return RP.accessibility_summary(m, _reach(spark, sf_dir))


SCRAPE_CTE = f"""scrape AS (SELECT r.domain, coalesce(r.final_url, r.homepage) AS url, h.url AS final_url,
  NOT {O.is_blank('e.text')} AS ok,
  CAST(CASE WHEN {O.is_blank('e.text')} THEN 0 ELSE length(e.text) END AS BIGINT) AS chars,
  CASE WHEN {O.is_blank('e.text')} THEN 'empty_extract' ELSE 'ok' END AS reason
  FROM reach r JOIN home h ON h.domain = r.domain JOIN ext e ON e.seq = h.seq WHERE r.accessible)"""


def _scrape(spark, sf_dir):
    return P.scrape_index(FX.site_pages(spark, sf_dir), _reach(spark, sf_dir))


@query("scrape_index", O.with_views("SELECT * FROM scrape", "site_pages", "probe_log",
                                    extra=REACH_EXTRA + ",\n" + SCRAPE_CTE))
def q_scrape_index(spark, sf_dir):
    return _scrape(spark, sf_dir)


@query("scrape_cached", O.with_views("""
SELECT s.domain, s.url, CASE WHEN h.seq % 3 = 0 THEN s.url ELSE s.final_url END AS final_url, h.seq % 3 = 0 OR s.ok AS ok,
  CASE WHEN h.seq % 3 = 0 THEN CAST(strlen(h.url) AS BIGINT) ELSE s.chars END AS chars, CASE WHEN h.seq % 3 = 0 THEN 'cached' ELSE s.reason END AS reason
FROM scrape s JOIN home h USING (domain)""", "site_pages", "probe_log", extra=REACH_EXTRA + ",\n" + SCRAPE_CTE))
def q_scrape_cached(spark, sf_dir):
    """M3 with texts on file: a third of the domains is reported as cached with its stored size."""
    pages = FX.site_pages(spark, sf_dir)
    cached = P.homepages(pages).filter("seq % 3 = 0").select("domain", F.octet_length("url").cast("bigint").alias("chars"))
    return P.scrape_index(pages, _reach(spark, sf_dir), cached)


@query("site_documents", O.with_views("""
SELECT m.domain, CAST(0 AS INTEGER) AS part, CAST(1 AS INTEGER) AS n_parts, CAST(m.n AS INTEGER) AS n_companies, m.first_id, s.homepage,
  s.main_title, CAST(s.main_chars AS BIGINT) AS main_chars, s.subpage_count, s.site_error
FROM (SELECT domain, count(*) AS n, arg_min(business_id, seq) AS first_id FROM manifest GROUP BY domain) m LEFT JOIN (
  SELECT domain, homepage, main_title, main_chars, subpage_count, nullif(site_error, '') AS site_error FROM site_result) s USING (domain)""",
    "site_pages", "registry", extra=SITE_EXTRA + "," + KEPT_CTE))
def q_site_documents(spark, sf_dir):
    """A document a site with its companies and pages, written as JSON lines and read again."""
    pages = FX.site_pages(spark, sf_dir)
    sites = EX.nested_sites(P.site_page_rows(pages), P.site_results(pages))
    path = shared_path(spark, "site-documents")
    EX.write_site_documents(EX.site_documents(R.manifest(FX.registry(spark, sf_dir)), sites), path)
    d = spark.read.schema(EX.SITE_DOCUMENT).json(path)
    return d.select("domain", "part", "n_parts", F.size("companies").alias("n_companies"), F.col("companies")[0]["businessId"].alias("first_id"),
                    "homepage", F.col("main_page.title").alias("main_title"), F.length("main_page.text").cast("bigint").alias("main_chars"),
                    "subpage_count", F.col("error").alias("site_error"))


@query("orphan_domains", O.with_views("""
SELECT s.domain FROM scrape s WHERE s.ok AND s.domain NOT IN (SELECT domain FROM manifest)""",
    "site_pages", "probe_log", "registry", extra=REACH_EXTRA + ",\n" + SCRAPE_CTE + "," + KEPT_CTE))
def q_orphan_domains(spark, sf_dir):
    m = R.manifest(FX.registry(spark, sf_dir))
    return RP.orphan_domains(_scrape(spark, sf_dir), m)


FUNNEL_CTE = """u AS (SELECT DISTINCT domain FROM manifest),
st AS (SELECT u.domain, coalesce(r.accessible, false) AS reachable, s.domain IS NOT NULL AS attempted,
  coalesce(s.ok, false) AS scraped FROM u LEFT JOIN reach r ON r.domain = u.domain LEFT JOIN scrape s ON s.domain = u.domain),
c AS (SELECT (SELECT count(*) FROM manifest) AS companies, count(*) AS uniq, count(*) FILTER (WHERE reachable) AS reachable,
  count(*) FILTER (WHERE attempted) AS attempted, count(*) FILTER (WHERE scraped) AS scraped FROM st)"""


@query("domain_funnel", O.with_views("""
SELECT stage, n, round(100.0 * n / nullif(uniq, 0), 2) AS pct FROM c, LATERAL (VALUES
  ('company_rows', companies), ('unique_domains', uniq), ('reachable', reachable), ('attempted', attempted),
  ('scraped_ok', scraped), ('unreachable', uniq - reachable), ('reachable_not_scraped', reachable - scraped)) v(stage, n)""",
    "site_pages", "probe_log", "registry",
    extra=REACH_EXTRA + ",\n" + SCRAPE_CTE + "," + KEPT_CTE + ",\n" + FUNNEL_CTE))
def q_domain_funnel(spark, sf_dir):
    m = R.manifest(FX.registry(spark, sf_dir))
    return RP.domain_funnel(m, _reach(spark, sf_dir), _scrape(spark, sf_dir))


CRAWL_CTE = f"""sites AS (SELECT domain, seq, homepage, business_id AS first_business_id FROM manifest
  QUALIFY row_number() OVER (PARTITION BY domain ORDER BY seq) = 1),
batch AS (SELECT * FROM sites ORDER BY seq LIMIT {BATCH_LIMIT} OFFSET {BATCH_OFFSET}),
crawl AS (SELECT domain, homepage, first_business_id,
  CASE WHEN starts_with(domain, 'blog.') THEN 'skipped' ELSE 'crawl' END AS action FROM batch)"""


def _crawl(spark, sf_dir):
    m = R.manifest(FX.registry(spark, sf_dir))
    existing = m.select("domain").distinct().filter(F.col("domain").startswith("blog."))
    return RP.crawl_batch(m, BATCH_OFFSET, BATCH_LIMIT, existing)


@query("crawl_batch", O.with_views("SELECT * FROM crawl", "registry", extra=KEPT_CTE + ",\n" + CRAWL_CTE))
def q_crawl_batch(spark, sf_dir):
    return _crawl(spark, sf_dir)


@query("crawl_summary", O.with_views("""
SELECT (SELECT count(*) FROM sites) AS unique_sites_total, count(*) AS in_this_batch,
  count(*) FILTER (WHERE action = 'crawl') AS crawled, count(*) FILTER (WHERE action = 'skipped') AS skipped_existing,
  CAST(0 AS BIGINT) AS failed FROM crawl""", "registry", extra=KEPT_CTE + ",\n" + CRAWL_CTE))
def q_crawl_summary(spark, sf_dir):
    m = R.manifest(FX.registry(spark, sf_dir))
    return RP.crawl_summary(m, _crawl(spark, sf_dir))


@query("first_per_domain", O.with_views("""
SELECT domain, seq, url FROM site_pages QUALIFY row_number() OVER (PARTITION BY domain ORDER BY seq) = 1""",
    "site_pages"))
def q_first_per_domain(spark, sf_dir):
    return first_per_key(FX.site_pages(spark, sf_dir).select("domain", "seq", "url"), "domain", "seq")


@query("url_depth", O.with_views(f"SELECT seq, url, {O.url_depth('url')} AS depth FROM site_pages", "site_pages"))
def q_url_depth(spark, sf_dir):
    """C7 over the captured page urls."""
    return FX.site_pages(spark, sf_dir).select("seq", "url", U.url_depth("url").alias("depth"))
