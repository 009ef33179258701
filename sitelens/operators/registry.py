"""Company register operators: C1-C4, C6 (suffix join), D3-D5, D10, G2, G4, F1, I1, E7, E8, E11.

Register records are either the nested API shape (``names``, ``companyForms``
arrays) or the flat form (``business_id, name, website, company_form,
status``); both carry an explicit ``seq`` because "first one wins" needs an
order that Spark does not keep by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import is_blank, trim_ws
from sitelens.functions.urls import host_of, normalise_homepage, site_key
from sitelens.operators.ordering import first_per_key, key_ordinal


# ---- C1-C4 projections ----------------------------------------------------

def primary_name(names) -> Column:
    """Version-1 names (or all when none), first with type "1"/null and a
    non-empty name; else the first pool entry's name if non-empty; else ""."""
    names = F.coalesce(F.col(names) if isinstance(names, str) else names,
                       F.array().cast("array<struct<name:string,type:string,version:int>>"))
    current = F.filter(names, lambda n: n["version"] == 1)
    pool = F.when(F.size(current) > 0, current).otherwise(names)
    typed = F.filter(pool, lambda n: (n["type"].isNull() | (n["type"] == "1"))
                     & (F.coalesce(n["name"], F.lit("")) != ""))
    return F.coalesce(F.get(typed, 0)["name"], F.nullif(F.get(pool, 0)["name"], F.lit("")), F.lit(""))


def website_url(website) -> Column:
    """``website.url`` trimmed, empty -> null."""
    w = F.col(website) if isinstance(website, str) else website
    return F.nullif(trim_ws(w["url"]), F.lit(""))


def company_form(forms) -> Column:
    """Version-1 forms (or all); null when none; first description with
    languageCode "3" (even a null text) else the form type."""
    forms = F.col(forms) if isinstance(forms, str) else forms
    forms = F.coalesce(forms, F.array().cast(
        "array<struct<type:string,version:int,descriptions:array<struct<languageCode:string,description:string>>>>"))
    current = F.filter(forms, lambda f: f["version"] == 1)
    pool = F.when(F.size(current) > 0, current).otherwise(forms)
    first = F.get(pool, 0)
    en = F.filter(F.coalesce(first["descriptions"], F.array().cast(
        "array<struct<languageCode:string,description:string>>")), lambda d: d["languageCode"] == "3")
    return (F.when(F.size(pool) == 0, F.lit(None).cast("string"))
            .when(F.size(en) > 0, F.get(en, 0)["description"])
            .otherwise(first["type"]))


def parse_company(records: DataFrame) -> DataFrame:
    """C4: nested register record -> flat company."""
    return records.select(
        "seq",
        F.coalesce(F.col("businessId.value"), F.lit("")).alias("business_id"),
        primary_name("names").alias("name"),
        website_url("website").alias("website"),
        company_form("companyForms").alias("company_form"),
        F.col("tradeRegisterStatus").alias("status"))


# ---- filters -------------------------------------------------------------

def has_website(companies: DataFrame) -> DataFrame:
    """D3: website present and not blank."""
    return companies.filter(~is_blank("website"))


def search(companies: DataFrame, name: str | None = None, company_form: str | None = None,
           status: str | None = None, max_companies: int | None = 200, location: str | None = None,
           main_business_line: str | None = None, post_code: str | None = None) -> DataFrame:
    """D5 + H4: optional predicates (null = no filter); name is a case-insensitive
    substring, location a case-insensitive equality, the others are equality (columns
    ``location``, ``business_line``, ``post_code`` of the companies).  ``max_companies`` caps the result in
    register order (the cap is the feature of the search)."""
    out = companies
    if name is not None:
        out = out.filter(F.contains(F.lower(F.col("name")), F.lit(name.lower())))
    if company_form is not None:
        out = out.filter(F.col("company_form") == company_form)
    if status is not None:
        out = out.filter(F.col("status") == status)
    if location is not None:
        out = out.filter(F.lower("location") == location.lower())
    if main_business_line is not None:
        out = out.filter(F.col("business_line") == main_business_line)
    if post_code is not None:
        out = out.filter(F.col("post_code") == post_code)
    if max_companies:
        out = out.orderBy("seq").limit(max_companies)
    return out


def by_ids(companies: DataFrame, ids: DataFrame) -> DataFrame:
    """Id-list lookup as a join (one row per id-list entry that exists).

    ``ids`` has ``pos`` (list order) and ``business_id``; duplicates in the
    register resolve to the first record, like a lookup that returns one.
    """
    first = first_per_key(companies.filter(F.col("business_id") != ""), "business_id", "seq")
    return ids.join(first, "business_id", "inner")


# ---- G2 / G4 / manifest ----------------------------------------------------

def dedupe_companies(companies: DataFrame, order_col: str = "seq") -> DataFrame:
    """G2 (search path): first record per business id, blank ids dropped,
    *before* any website filter."""
    c = companies.filter(F.coalesce(F.col("business_id"), F.lit("")) != "")
    return first_per_key(c, "business_id", order_col)


def manifest(companies: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Bulk path (D4, C5, C6, G2, G4): the first record per id that *qualifies*
    (id, website, homepage), its site key, and ``shared_site`` = an earlier kept
    row has the same key.  ``suffixes``: public-suffix rules for the key (default: the host rule).

    Shuffles: one on ``business_id`` (partial ``min_by``), one on ``domain``
    (partial ``min``), and a join back on ``domain`` whose skew AQE splits.
    """
    q = (companies
         .withColumn("homepage", normalise_homepage("website"))
         .filter((F.coalesce(F.col("business_id"), F.lit("")) != "") & ~is_blank("website")
                 & F.col("homepage").isNotNull()))
    q = with_site(q, "homepage", "domain", suffixes).select(
        "seq", "business_id", "name", "company_form", "status", "homepage", "domain")
    kept = first_per_key(q, "business_id", "seq")
    first_seq = kept.groupBy("domain").agg(F.min("seq").alias("_first_seq"))
    out = kept.join(first_seq, "domain")
    return out.select("seq", "business_id", "name", "company_form", "status", "homepage", "domain",
                      (F.col("seq") > F.col("_first_seq")).alias("shared_site"))


def manifest_summary(companies: DataFrame, kept: DataFrame) -> DataFrame:
    """total scanned, with website (kept rows), unique sites, companies."""
    total = companies.select(F.count(F.lit(1)).cast("bigint")).scalar()
    b = kept.agg(F.count(F.lit(1)).cast("bigint").alias("with_website"),
                 F.countDistinct("domain").cast("bigint").alias("unique_sites"))
    return b.select(total.alias("total_scanned"), "with_website", "unique_sites",
                    F.col("with_website").alias("companies"))


def sampling_frame(companies: DataFrame, forms=("BUILDING",), status: str = "Registered") -> DataFrame:
    """D10 + F-style share: companies of the given forms and status, and the
    share of them with a website."""
    f = companies.filter(F.col("company_form").isin(*forms) & (F.col("status") == status))
    return f.groupBy("company_form").agg(
        F.count(F.lit(1)).cast("bigint").alias("frame_size"),
        F.count_if(~is_blank("website")).cast("bigint").alias("with_website"),
        F.round(F.try_divide(F.count_if(~is_blank("website")) * F.lit(100.0),
                             F.count(F.lit(1)).cast("double")), 2).alias("pct_with_website"))


# ---- C6 registered domain (public-suffix join) ----------------------------

def suffix_rules(rules: DataFrame, col: str = "suffix") -> DataFrame:
    """Public-suffix rules as ``(rule)``: lower case, without comments (``//``), blanks and leading dots."""
    r = F.lower(F.regexp_extract(F.col(col), r"^\s*([^\s]*)", 1))
    r = F.regexp_replace(r, r"^(!?)[.]+", "$1")
    return rules.select(r.alias("rule")).filter((F.col("rule") != "") & ~F.col("rule").startswith("//")).distinct()


def registered_domain(urls: DataFrame, url_col: str, suffixes: DataFrame, name: str = "registered_domain") -> DataFrame:
    """C6 with public-suffix rules: ``urls`` with the registered domain of each url's host.

    Rules are plain (``co.uk``), wildcard (``*.ck``: any one label before) or exceptions
    (``!www.ck``: this is no suffix).  Every dotted ending of a distinct host asks for the three
    rules that could match it, in one equality join on the reversed labels' ending; an exception
    prevails, else the longest match.  The registered domain is the suffix and one label more; a
    host without a rule, or one that is a suffix itself, falls back to the host rule.  The rules
    are not hinted: the optimizer broadcasts them while they are small.
    """
    base = urls.withColumn("_host", F.lower(host_of(F.col(url_col))))
    hosts = base.select("_host").distinct().withColumn("_labels", F.split("_host", r"\."))
    ending = F.array_join(F.slice("_labels", F.col("_i"), F.size("_labels")), ".")
    behind = F.array_join(F.slice("_labels", F.col("_i") + 1, F.size("_labels")), ".")
    cand = hosts.select("_host", F.explode(F.sequence(F.lit(1), F.size("_labels"))).alias("_i"), "_labels").select(
        "_host", F.explode(F.array(
            F.struct(ending.alias("rule"), F.col("_i").alias("at"), F.lit(False).alias("exception")),
            F.struct(F.concat(F.lit("*."), behind).alias("rule"), F.col("_i").alias("at"), F.lit(False).alias("exception")),
            F.struct(F.concat(F.lit("!"), ending).alias("rule"), (F.col("_i") + 1).alias("at"), F.lit(True).alias("exception")))).alias("c"))
    hit = cand.select("_host", "c.*").join(suffix_rules(suffixes, suffixes.columns[0]), "rule")
    best = hit.groupBy("_host").agg(F.coalesce(F.max(F.when(F.col("exception"), F.col("at"))), F.min("at")).alias("_at"))
    labels = F.split("_host", r"\.")
    best = best.filter("_at > 1").select("_host", F.array_join(F.slice(labels, F.col("_at") - 1, F.size(labels)), ".").alias("_reg"))
    out = base.join(best, "_host", "left")
    return out.withColumn(name, F.coalesce("_reg", site_key(F.col(url_col)))).drop("_host", "_reg")


def with_site(df: DataFrame, url_col: str, name: str = "domain", suffixes: DataFrame | None = None) -> DataFrame:
    """``df`` with the site key of ``url_col``: the registered domain if rules are given, else the host rule."""
    return df.withColumn(name, site_key(url_col)) if suffixes is None else registered_domain(df, url_col, suffixes, name)


# ---- E7 / E8 -----------------------------------------------------------------

def company_site(companies: DataFrame, site_results: DataFrame | None = None,
                 suffixes: DataFrame | None = None) -> DataFrame:
    """E7 + G5 (search path): deduped companies with a website, each attributed
    to its site; the site record carries the first company's homepage;
    ``shared_site`` = an earlier output record has the same domain (nulls equal).
    ``suffixes``: public-suffix rules for the key.
    """
    d = dedupe_companies(companies)
    d = has_website(d).withColumn("_hp", normalise_homepage("website")).filter(F.col("_hp").isNotNull())
    d = with_site(d, "_hp", "domain", suffixes)
    site_first = first_per_key(d.select("domain", "seq", "_hp"), "domain", "seq")
    site_first = site_first.select("domain", F.col("seq").alias("_first_seq"), F.col("_hp").alias("homepage"))
    out = d.join(site_first, d["domain"].eqNullSafe(site_first["domain"])).drop(site_first["domain"])
    out = out.withColumn("shared_site", F.col("seq") > F.col("_first_seq"))
    cols = ["seq", "business_id", "name", "company_form", "status", "homepage", "domain", "shared_site"]
    out = out.select(*cols)
    if site_results is not None:
        out = out.join(site_results, "domain", "left")
    return out


def site_companies(kept: DataFrame) -> DataFrame:
    """The companies of each site, flattened and clustered instead of nested:
    ``company_no`` is the position inside the site (skew-safe ordinal),
    ``n_companies`` the site's size and ``first_business_id`` its first company."""
    per_site = kept.groupBy("domain").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_companies"),
        F.min_by("business_id", "seq").alias("first_business_id"))
    pos = key_ordinal(kept.select("domain", "seq", "business_id", "name"), "domain", "seq", "company_no")
    return pos.join(per_site, "domain")


def gather_companies(*sources: DataFrame) -> DataFrame:
    """Union-all of company sources in the given order; ``seq`` becomes the
    global order (source rank, position inside the source)."""
    parts = []
    for rank, s in enumerate(sources):
        parts.append(s.select(F.lit(rank).alias("_src"), F.col("seq").alias("_pos"),
                              "business_id", "name", "website", "company_form", "status"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.withColumn("seq", F.col("_src").cast("bigint") * F.lit(1 << 40) + F.col("_pos")).drop("_src", "_pos")
