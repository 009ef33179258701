"""Query keys for the company register and the manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.functions import text as TX
from sitelens.functions import urls as U
from sitelens.operators import registry as R
from sitelens.plans import oracle as O
from sitelens.plans.catalog import query
from sitelens.session import shared_path
from sitelens.sources import files as FS
from sitelens.sources import fixtures as FX

# ---- shared oracle fragments --------------------------------------------------

PARSED_SQL = O.with_views(f"""
SELECT seq, business_id,
  CASE seq % 5 WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN concat('Past ', name)
               WHEN 3 THEN concat('Aux ', name) ELSE '' END AS name,
  nullif({O.trim_ws('website')}, '') AS website,
  CASE WHEN company_form IS NULL THEN NULL WHEN seq % 3 = 1 THEN company_form
       WHEN seq % 3 = 2 THEN concat('T-', company_form) ELSE NULL END AS company_form,
  status
FROM registry""", "registry")

KEPT_CTE = f"""
q AS (SELECT seq, business_id, name, company_form, status, {O.normalise_homepage('website')} AS homepage
      FROM registry WHERE coalesce(business_id, '') <> '' AND NOT {O.is_blank('website')}),
q2 AS (SELECT *, {O.site_key('homepage')} AS domain FROM q WHERE homepage IS NOT NULL),
kept AS (SELECT * FROM q2 QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY seq) = 1),
manifest AS (SELECT seq, business_id, name, company_form, status, homepage, domain,
                    seq > min(seq) OVER (PARTITION BY domain) AS shared_site FROM kept)"""


# ---- A1 / C1-C4 -------------------------------------------------------------------

@query("parse_company", PARSED_SQL)
def q_parse_company(spark, sf_dir):
    return R.parse_company(FX.registry_nested(spark, sf_dir))


@query("primary_name", f"SELECT seq, name FROM ({PARSED_SQL})")
def q_primary_name(spark, sf_dir):
    r = FX.registry_nested(spark, sf_dir)
    return r.select("seq", R.primary_name("names").alias("name"))


@query("website_url", f"SELECT seq, website FROM ({PARSED_SQL})")
def q_website_url(spark, sf_dir):
    r = FX.registry_nested(spark, sf_dir)
    return r.select("seq", R.website_url("website").alias("website"))


@query("company_form", f"SELECT seq, company_form FROM ({PARSED_SQL})")
def q_company_form(spark, sf_dir):
    r = FX.registry_nested(spark, sf_dir)
    return r.select("seq", R.company_form("companyForms").alias("company_form"))


@query("registry_scan", PARSED_SQL)
def q_registry_scan(spark, sf_dir):
    """A1: land the nested register as JSON lines, scan it back with an explicit
    schema (auto layout detection), parse (C4)."""
    path = shared_path(spark, "register")
    FS.write_register_lines(FX.registry_nested(spark, sf_dir), path)
    return R.parse_company(FS.read_register(spark, path))


@query("registry_array_scan", f"""SELECT CAST(row_number() OVER (ORDER BY seq) - 1 AS BIGINT) AS seq,
  business_id, name, website, company_form, status FROM ({PARSED_SQL})""")
def q_registry_array_scan(spark, sf_dir):
    """A1: the register as one-line documents ``{"total_scanned": .., "companies": [...]}`` without
    positions, found by its head, read in splits, numbered by place, parsed (C4)."""
    path = shared_path(spark, "register-document")
    FS.write_json_document(FX.registry_nested(spark, sf_dir), path, member="companies", head={"total_scanned": 0})
    return R.parse_company(FS.read_register(spark, path))


# ---- C5 / D3 / manifest -------------------------------------------------------------

@query("homepage_normalise", O.with_views(
    f"SELECT seq, website, {O.normalise_homepage('website')} AS homepage FROM registry", "registry"))
def q_homepage_normalise(spark, sf_dir):
    r = FX.registry(spark, sf_dir)
    return r.select("seq", "website", U.normalise_homepage("website").alias("homepage"))


@query("has_website", O.with_views(
    f"SELECT seq, business_id, website FROM registry WHERE NOT {O.is_blank('website')}", "registry"))
def q_has_website(spark, sf_dir):
    return R.has_website(FX.registry(spark, sf_dir)).select("seq", "business_id", "website")


@query("manifest", O.with_views("SELECT * FROM manifest", "registry", extra=KEPT_CTE))
def q_manifest(spark, sf_dir):
    return R.manifest(FX.registry(spark, sf_dir))


@query("manifest_summary", O.with_views("""
SELECT (SELECT count(*) FROM registry) AS total_scanned, count(*) AS with_website,
       count(DISTINCT domain) AS unique_sites, count(*) AS companies FROM manifest""", "registry", extra=KEPT_CTE))
def q_manifest_summary(spark, sf_dir):
    reg = FX.registry(spark, sf_dir)
    return R.manifest_summary(reg, R.manifest(reg))


@query("manifest_scan", O.with_views(
    "SELECT seq, business_id, name, homepage, domain FROM manifest", "registry", extra=KEPT_CTE))
def q_manifest_scan(spark, sf_dir):
    """B1 -> A2 round trip: write the manifest CSV, load it with the manifest rules."""
    path = shared_path(spark, "manifest-csv")
    FS.write_manifest(R.manifest(FX.registry(spark, sf_dir)), csv_path=path)
    return FS.read_manifest(spark, path, "csv")


@query("site_companies", O.with_views("""
SELECT domain, seq, business_id, name,
  CAST(row_number() OVER (PARTITION BY domain ORDER BY seq) - 1 AS BIGINT) AS company_no,
  count(*) OVER (PARTITION BY domain) AS n_companies,
  first_value(business_id) OVER (PARTITION BY domain ORDER BY seq) AS first_business_id
FROM manifest""", "registry", extra=KEPT_CTE))
def q_site_companies(spark, sf_dir):
    return R.site_companies(R.manifest(FX.registry(spark, sf_dir)))


# ---- C6 / C9 ---------------------------------------------------------------------------

_PSL_LIST = ", ".join(O.q(s) for s in FX.PUBLIC_SUFFIXES)


@query("site_key", O.with_views(f"""
SELECT s.seq, s.url, coalesce(r.registered_domain, {O.site_key('s.url')}) AS registered_domain
FROM site_pages s LEFT JOIN (
  SELECT url, array_to_string(any_value(labels)[min(i) - 1:], '.') AS registered_domain
  FROM (SELECT url, labels, i FROM (
          SELECT url, string_split(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '.') AS labels
          FROM (SELECT DISTINCT url FROM site_pages)) h,
        LATERAL (SELECT unnest(range(2, greatest(len(h.labels), 2) + 1)) AS i) t
        WHERE array_to_string(h.labels[i:], '.') IN ({_PSL_LIST})) c
  GROUP BY url) r ON r.url = s.url""", "site_pages"))
def q_site_key(spark, sf_dir):
    p = FX.site_pages(spark, sf_dir).select("seq", "url")
    urls = p.select("url").distinct()
    reg = R.registered_domain(urls, "url", FX.public_suffix(spark))
    return p.join(reg, "url", "left").select("seq", "url", "registered_domain")


def _suffix_key(url: str) -> str:
    """The registered domain by :data:`FX.SUFFIX_RULES`, rule by rule."""
    h = f"lower(regexp_extract({url}, '^https?://([^/?#:]+)', 1))"
    tail = lambda n: f"array_to_string(string_split({h}, '.')[-{n}:], '.')"
    some = lambda n: f"len(string_split({h}, '.')) >= {n}"
    return (f"(CASE WHEN {tail(3)} = 'thther.example.org' THEN {tail(3)} "
            f"WHEN {tail(2)} = 'example.org' AND {some(4)} THEN {tail(4)} WHEN {tail(2)} = 'example.org' AND {some(3)} THEN {O.site_key(url)} "
            f"WHEN {tail(2)} = 'example.net' AND {some(3)} THEN {tail(3)} WHEN {tail(2)} = 'example.net' THEN {O.site_key(url)} "
            f"WHEN {tail(1)} IN ('com', 'net', 'org') AND {some(2)} THEN {tail(2)} ELSE {O.site_key(url)} END)")


@query("site_key_rules", O.with_views(f"SELECT seq, url, {_suffix_key('url')} AS registered_domain FROM site_pages", "site_pages"))
def q_site_key_rules(spark, sf_dir):
    """C6 by plain, wildcard and exception rules."""
    return R.registered_domain(FX.site_pages(spark, sf_dir).select("seq", "url"), "url", FX.suffix_rules(spark))


@query("manifest_registered", O.with_views("SELECT * FROM manifest", "registry", extra=KEPT_CTE.replace(
    O.site_key("homepage"), _suffix_key("homepage"))))
def q_manifest_registered(spark, sf_dir):
    """C6 in the manifest: sites told apart by their registered domain."""
    return R.manifest(FX.registry(spark, sf_dir), FX.suffix_rules(spark))


@query("safe_key", O.with_views(r"""
SELECT seq, domain, regexp_replace(domain, '[^A-Za-z0-9._-]', '_', 'g') AS safe_name,
  coalesce(nullif(substring(regexp_replace(domain, '[^A-Za-z0-9._-]', '_', 'g'), 1, 120), ''), 'site') AS crawl_name
FROM site_pages""", "site_pages"))
def q_safe_key(spark, sf_dir):
    p = FX.site_pages(spark, sf_dir)
    return p.select("seq", "domain", TX.safe_key("domain").alias("safe_name"),
                    TX.safe_key("domain", 120, "site").alias("crawl_name"))


# ---- D5 / H4 / A8 / E11 / G2 / I1 / E7 / F2 / D10 -------------------------------------

SEARCH = dict(name="#0000001", company_form="BUILDING", max_companies=200)

SEARCH_SQL = """SELECT * FROM registry WHERE contains(lower(name), '#0000001') AND company_form = 'BUILDING'
ORDER BY seq LIMIT 200"""


@query("company_search", O.with_views(SEARCH_SQL, "registry"))
def q_company_search(spark, sf_dir):
    return R.search(FX.registry(spark, sf_dir), **SEARCH)


PLACE = dict(location="nation_1", main_business_line="BUILDING", post_code="00003", max_companies=50)


@query("search_places", O.with_views("""SELECT r.*, n.n_name AS location, c.c_mktsegment AS business_line, lpad(CAST(c.c_custkey % 7 AS VARCHAR), 5, '0') AS post_code
FROM registry r JOIN customer c ON c.c_custkey = r.seq JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE lower(n.n_name) = 'nation_1' AND c.c_mktsegment = 'BUILDING' AND c.c_custkey % 7 = 3 ORDER BY r.seq LIMIT 50""", "registry"))
def q_search_places(spark, sf_dir):
    """Search by location, line of business and post code."""
    return R.search(FX.registry_places(spark, sf_dir), **PLACE)


def _id_file(spark, sf_dir):
    """A8 input: ids of deregistered companies, one per line, padded, with blanks."""
    reg = FX.registry(spark, sf_dir)
    ids = reg.filter((F.col("status") == "Deregistered") & (F.col("business_id") != ""))
    lines = ids.select("seq", F.explode(F.array(F.concat(F.lit("  "), F.col("business_id"), F.lit(" ")),
                                                   F.lit(""))).alias("value"))
    path = shared_path(spark, "ids")
    # a global sort writes the part files in order, and they are read back in file order
    lines.orderBy("seq").select("value").write.mode("overwrite").text(path)
    return FS.read_id_list(spark, path)


IDS_CTES = """,
ids AS (SELECT seq AS pos, business_id FROM registry WHERE status = 'Deregistered' AND business_id <> ''),
firsts AS (SELECT * FROM registry WHERE business_id <> '' QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY seq) = 1),
by_id AS (SELECT i.pos, f.seq, f.business_id, f.name, f.website, f.company_form, f.status FROM ids i JOIN firsts f USING (business_id))"""


def _reg_sql(body: str, extra: str = "") -> str:
    return O.with_views(body, "registry", extra=IDS_CTES + extra)


@query("companies_by_id", _reg_sql(
    "SELECT business_id, seq, name, website, company_form, status FROM by_id"))
def q_companies_by_id(spark, sf_dir):
    found = R.by_ids(FX.registry(spark, sf_dir), _id_file(spark, sf_dir))
    return found.select("business_id", "seq", "name", "website", "company_form", "status")


GATHER_CTES = f""",
search AS ({SEARCH_SQL}),
gathered AS (SELECT 0 AS src, pos, business_id, name, website, company_form, status FROM by_id
             UNION ALL SELECT 1 AS src, seq AS pos, business_id, name, website, company_form, status FROM search),
deduped AS (SELECT * FROM gathered WHERE coalesce(business_id, '') <> ''
            QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY src, pos) = 1),
withsite AS (SELECT *, {O.normalise_homepage('website')} AS homepage0 FROM deduped WHERE NOT {O.is_blank('website')}),
sited AS (SELECT *, {O.site_key('homepage0')} AS domain FROM withsite WHERE homepage0 IS NOT NULL),
company_site AS (SELECT src, business_id, name, company_form, status,
   first_value(homepage0) OVER (PARTITION BY domain ORDER BY src, pos) AS homepage, domain,
   row_number() OVER (PARTITION BY domain ORDER BY src, pos) > 1 AS shared_site FROM sited)"""


def _gathered(spark, sf_dir):
    reg = FX.registry(spark, sf_dir)
    by_id = R.by_ids(reg, _id_file(spark, sf_dir)).select(
        F.col("pos").alias("seq"), "business_id", "name", "website", "company_form", "status")
    found = R.search(reg, **SEARCH)
    return R.gather_companies(by_id, found)


@query("gather_companies", _reg_sql(
    "SELECT src, business_id, name, website, company_form, status FROM gathered", GATHER_CTES))
def q_gather_companies(spark, sf_dir):
    g = _gathered(spark, sf_dir)
    return g.select(F.shiftright("seq", 40).cast("int").alias("src"), "business_id", "name", "website",
                    "company_form", "status")


@query("dedupe_companies", _reg_sql(
    "SELECT src, business_id, name, website FROM deduped", GATHER_CTES))
def q_dedupe_companies(spark, sf_dir):
    d = R.dedupe_companies(_gathered(spark, sf_dir))
    return d.select(F.shiftright("seq", 40).cast("int").alias("src"), "business_id", "name", "website")


@query("company_site", _reg_sql(
    "SELECT src, business_id, name, company_form, status, homepage, domain, shared_site FROM company_site",
    GATHER_CTES))
def q_company_site(spark, sf_dir):
    c = R.company_site(_gathered(spark, sf_dir))
    return c.select(F.shiftright("seq", 40).cast("int").alias("src"), "business_id", "name", "company_form",
                    "status", "homepage", "domain", "shared_site")


@query("run_summary", _reg_sql("""
SELECT (SELECT count(*) FROM deduped) AS companies_fetched,
       (SELECT count(*) FROM deduped WHERE NOT """ + O.is_blank("website") + """) AS with_website,
       (SELECT count(DISTINCT domain) FROM company_site) AS unique_sites_crawled,
       (SELECT count(*) FROM company_site) AS companies_in_output""", GATHER_CTES))
def q_run_summary(spark, sf_dir):
    g = _gathered(spark, sf_dir)
    d = R.dedupe_companies(g)
    cs = R.company_site(g)
    fetched = d.select(F.count(F.lit(1)).cast("bigint")).scalar()
    with_site = d.select(F.count_if(~TX.is_blank("website")).cast("bigint")).scalar()
    return cs.agg(F.countDistinct("domain").cast("bigint").alias("unique_sites_crawled"),
                  F.count(F.lit(1)).cast("bigint").alias("companies_in_output")).select(
        fetched.alias("companies_fetched"), with_site.alias("with_website"),
        "unique_sites_crawled", "companies_in_output")


@query("sampling_frame", O.with_views(f"""
SELECT company_form, count(*) AS frame_size, count(*) FILTER (WHERE NOT {O.is_blank('website')}) AS with_website,
  round(100.0 * count(*) FILTER (WHERE NOT {O.is_blank('website')}) / count(*), 2) AS pct_with_website
FROM registry WHERE company_form IN ('BUILDING') AND status = 'Registered' GROUP BY company_form""", "registry"))
def q_sampling_frame(spark, sf_dir):
    return R.sampling_frame(FX.registry(spark, sf_dir), forms=("BUILDING",), status="Registered")
